"""Quality classifier by co-training.

Two views of a document have a classifier each: the text view (hashed words
present, shares of hashed word-end shapes, how repetitive it is) and the
page-metadata view (source, language, length).  A view's classifier has two
parts.  A logistic regression is fitted on labelled documents.  Log odds of its
features come from class counts: in each of ``ROUNDS`` rounds both views score
every unlabelled document in the tasks, and all documents of which one view is
confident (calibrated probability at least ``CONFIDENT``) are counted, by pseudo-
label, into the features of the other view.  The counts are sums over all
partitions, in whole numbers, so they do not depend on how rows are dealt.  The
two parts are weighed and calibrated on labelled documents that neither was
fitted on, and so are, at the end, the two views.

Two targets are learned this way: ``quality`` = 1 and ``toxic`` = 1.  A document
is kept when its quality probability is at least one half and its toxic
probability below one half.

Only the labelled documents are a bounded, hashed sample (about ``LABELLED``
ids, one row of each); the regressions are fitted on it on the driver.  Every
unlabelled document takes part in each round, and every document is scored, from
its whole text.  What goes to the tasks and what comes back are weights and
counts, whose size is fixed; they are added up in a tree.

Defined results: null text has no words; null metadata is a value of its own;
null labels do not count, and with several label rows a document is low quality
if any says so and toxic if any says so; a target without two classes among the
labels is constant (its mean, or 1 for quality and 0 for toxic without labels);
repeated rows get equal scores; an empty table gives no rows; other columns are
ignored (``keep`` passes them on).
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qoeflow.llm.common import U64, blocks, fresh, release, seeded
from qoeflow.llm.words import BLOCK, Poly, spans

LABELLED = 4000
ROUNDS = 2
CONFIDENT = 0.95
#: Hashed words, hashed shapes, hashed metadata values.
WORDS, SHAPES, META = 1 << 15, 1 << 10, 1 << 9
#: Tenths of the words that repeat the word before, and of distinct words.
TENTHS = 11
TEXT_WIDTH = WORDS + SHAPES + 2 * TENTHS
STEPS = 250
#: Feature sums count in units of one over this; rows of sums added by one task.
UNIT, FAN = 4096, 64
#: Counts added to a feature's, for its log odds.
PRIOR = 10

_VALUES, _POLY = seeded(256, 51), Poly(501)
_PUNCT = np.zeros(256, bool)
_PUNCT[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
#: Class of each byte: letters and digits by kind, the rest as itself.
_CLASS = np.arange(256, dtype=U64)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 2


def text_features(texts: list[bytes]):
    """Rows (document numbers), columns and values of the text view."""
    rows, cols, vals = [], [], []
    for first, end in blocks([len(t) + 1 for t in texts], BLOCK // 2):
        data = b"\n".join(texts[first:end])
        edge = np.cumsum([0] + [len(t) + 1 for t in texts[first:end]])
        start, stop = spans(data)
        if not len(start):
            continue
        doc = np.repeat(np.arange(end - first), np.diff(np.searchsorted(start, edge)))
        codes = np.frombuffer(data.lower(), np.uint8)
        body = stop.copy()
        for _ in range(3):                       # without up to three punctuation marks at the end
            body -= (body - start > 1) & _PUNCT[codes[body - 1]]
        h = _POLY.ranges(_POLY.prefix(_VALUES[codes]), start, body) % U64(WORDS)
        key = np.unique(doc.astype(U64) * U64(WORDS) + h)
        rows.append((key // U64(WORDS)).astype(np.int64) + first)
        cols.append((key % U64(WORDS)).astype(np.int64))
        vals.append(np.ones(len(key), np.float32))
        n_words = np.bincount(doc, minlength=end - first)
        some = np.flatnonzero(n_words)
        again = np.bincount(doc[1:][(h[1:] == h[:-1]) & (doc[1:] == doc[:-1])], minlength=end - first)
        distinct = np.bincount((key // U64(WORDS)).astype(np.int64), minlength=end - first)
        for k, part in enumerate((again, distinct)):
            rows.append(some + first)
            cols.append(WORDS + SHAPES + k * TENTHS + 10 * part[some] // n_words[some])
            vals.append(np.ones(len(some), np.float32))
        raw = _CLASS[np.frombuffer(data, np.uint8)]
        shape = raw[stop - 1] * U64(65536) + raw[np.maximum(stop - 2, start)] * U64(256) + raw[np.maximum(stop - 3, start)]
        shape = (shape * U64(0x9E3779B97F4A7C15) >> U64(54)) % U64(SHAPES)
        key, n = np.unique(doc.astype(U64) * U64(SHAPES) + shape, return_counts=True)
        d = (key // U64(SHAPES)).astype(np.int64)
        rows.append(d + first)
        cols.append((key % U64(SHAPES)).astype(np.int64) + WORDS)
        vals.append((4 * n / n_words[d]).astype(np.float32))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(vals)


def meta_column():
    """Hashed metadata values of a row: source, language, source and language,
    and the length in powers of the square root of two."""
    size = F.floor(2 * F.log2(F.coalesce(F.col("n_chars"), F.lit(0)) + 1))
    parts = [F.struct(F.lit(0), F.col("source")), F.struct(F.lit(1), F.col("lang")),
             F.struct(F.lit(2), F.col("lang"), F.col("source")), F.struct(F.lit(3), size)]
    return F.array(*[F.pmod(F.xxhash64(p), F.lit(META)).cast("int") for p in parts]).alias("meta")


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Sparse:
    """Rows of a sparse matrix by (row, column, value)."""

    def __init__(self, rows, cols, vals, n: int, width: int):
        order = np.argsort(rows, kind="stable")
        self.rows, self.cols, self.vals, self.n, self.width = rows[order], cols[order], vals[order], n, width

    def dot(self, w):
        return np.bincount(self.rows, self.vals * w[self.cols], self.n)

    def back(self, g):
        return np.bincount(self.cols, self.vals * g[self.rows], self.width)

    def extremes(self, w, k: int = 3) -> tuple[np.ndarray, np.ndarray]:
        """Means of the ``k`` largest and smallest ``w`` among each row's columns
        (0 for a row without columns)."""
        order = np.lexsort((w[self.cols], self.rows))
        value = w[self.cols][order]
        end = np.searchsorted(self.rows, np.arange(self.n), "right")
        start = np.searchsorted(self.rows, np.arange(self.n))
        some = np.minimum(end - start, k)
        done = np.concatenate([[0.0], np.cumsum(value)])
        return tuple((done[b] - done[a]) / np.maximum(some, 1) for a, b in ((end - some, end), (start, start + some)))

    def take(self, pick):
        new = np.full(self.n, -1)
        new[pick] = np.arange(len(pick))
        ok = new[self.rows] >= 0
        return Sparse(new[self.rows[ok]], self.cols[ok], self.vals[ok], len(pick), self.width)


def logistic(x: Sparse, y, penalty: float = 1e-3, steps: int = STEPS):
    """Weights and bias; both classes weigh alike (accelerated gradient steps
    of the length that the largest row allows, L2 penalty)."""
    w = ahead = np.zeros(x.width + 1)
    share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y == 0).sum(), 1))
    norms = np.bincount(x.rows, x.vals * x.vals, x.n) + 1
    rate = 1 / (0.25 * float((share * norms).sum()) + penalty)
    for t in range(1, steps + 1):
        g = share * (_sigmoid(x.dot(ahead[:-1]) + ahead[-1]) - y)
        new = ahead - rate * np.append(x.back(g) + penalty * ahead[:-1], g.sum())
        ahead = new + (t - 1) / (t + 2) * (new - w)
        w = new
    return w


def calibrate(scores: np.ndarray, y: np.ndarray, start: np.ndarray | None = None, steps: int = 50) -> np.ndarray:
    """Weights of a logistic regression on some scores and 1 (Newton steps,
    with a weak pull towards ``start``, by default the scores' mean), for
    probabilities at the labels' own rate."""
    x = np.column_stack([scores, np.ones(len(y))])
    if start is None:
        start = np.append(np.full(x.shape[1] - 1, 1.0 / (x.shape[1] - 1)), 0.0)
    w, pull = start.copy(), np.append(np.full(x.shape[1] - 1, 1.0), 0.01)
    for _ in range(steps):
        p = _sigmoid(x @ w)
        g = x.T @ (p - y) + pull * (w - start)
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(pull)
        step = np.linalg.solve(h, g)
        w = w - np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class Head:
    """One target: for each view (text, metadata) the weights of its regression,
    the log odds of its features and the weights that combine and calibrate the
    two; the combination of the calibrated views; or a constant."""

    constant: float | None = None
    weights: tuple = ()
    odds: tuple = ()
    blend: tuple = ()
    both: np.ndarray | None = None

    def parts(self, text: Sparse, meta: Sparse) -> list[np.ndarray]:
        """For each view the regression's logit, the mean log odds and the
        means of the few largest and smallest ones."""
        out = []
        for x, w, o in zip((text, meta), self.weights, self.odds):
            mean = x.dot(o) / np.maximum(x.dot(np.ones(x.width)), 1e-9)
            out.append(np.column_stack([x.dot(w[:-1]) + w[-1], mean, *x.extremes(o)]))
        return out

    def views(self, text: Sparse, meta: Sparse) -> np.ndarray:
        """Calibrated logits of both views."""
        return np.column_stack([p @ b[:-1] + b[-1] for p, b in zip(self.parts(text, meta), self.blend)])

    def score(self, text: Sparse, meta: Sparse):
        """Probabilities by text, by metadata and combined."""
        if self.constant is not None:
            return (np.full(text.n, self.constant),) * 3
        v = self.views(text, meta)
        return _sigmoid(v[:, 0]), _sigmoid(v[:, 1]), _sigmoid(v @ self.both[:2] + self.both[2])

    def lessons(self, text: Sparse, meta: Sparse) -> list[np.ndarray]:
        """What each view learns from the other one on some documents: sums of
        its features by pseudo-label, (2, width) for text and for metadata."""
        p = _sigmoid(self.views(text, meta))
        return [class_sums(x, np.where(sure >= CONFIDENT, 1, np.where(sure <= 1 - CONFIDENT, 0, -1)))
                for x, sure in ((text, p[:, 1]), (meta, p[:, 0]))]


def class_sums(x: Sparse, label: np.ndarray) -> np.ndarray:
    """Sums of features by label (0, 1; others do not count), in whole units of
    1/``UNIT``, so that any order of adding gives the same."""
    whole = np.round(x.vals * UNIT)
    return np.stack([np.bincount(x.cols, whole * (label[x.rows] == k), x.width) for k in (0, 1)])


def log_odds(sums: np.ndarray) -> np.ndarray:
    """Log odds of each feature between the classes, with ``PRIOR`` counts that
    are split like the classes, so that a rare feature says little."""
    n = sums / UNIT
    total = n.sum(1, keepdims=True) + 1
    share = (n + PRIOR * total / total.sum()) / total
    return np.log(share[1] / share[0])


class Learner:
    """Co-training of one target on the labelled sample, and on whatever the
    rounds' sums report of the unlabelled documents."""

    def __init__(self, text: Sparse, meta: Sparse, y: np.ndarray, empty: float):
        known = np.flatnonzero(~np.isnan(y))
        self.head = Head(constant=empty)
        if not len(known):
            return
        self.head = Head(constant=float(y[known[0]]))
        if y[known].min() == y[known].max():
            return
        test = known[np.arange(len(known)) % 4 == 3]
        fit = np.setdiff1d(known, test)
        if min(len(np.unique(y[test])), len(np.unique(y[fit]))) < 2:
            test = fit = known
        self.test, self.y = [x.take(test) for x in (text, meta)], y[test]
        views = [x.take(fit) for x in (text, meta)]
        self.own = [class_sums(x, y[fit]) for x in views]
        self.head = Head(weights=tuple(logistic(x, y[fit]) for x in views))
        self.learn([np.zeros_like(s) for s in self.own])

    def learn(self, sums: list[np.ndarray]) -> None:
        """Take in the sums of a round over all unlabelled documents."""
        if self.head.constant is not None:
            return
        h = self.head
        h.odds = tuple(log_odds(own + s) for own, s in zip(self.own, sums))
        # the regression as it is, the odds as far as they help
        h.blend = tuple(calibrate(p, self.y, np.array([1.0, 0.0, 0.0, 0.0, 0.0])) for p in h.parts(*self.test))
        h.both = calibrate(h.views(*self.test), self.y)


def _features(batch: pa.RecordBatch):
    texts = [t or b"" for t in batch.column("text").to_pylist()]
    n = len(texts)
    meta = np.array(batch.column("meta").flatten())
    return (Sparse(*text_features(texts), n, TEXT_WIDTH),
            Sparse(np.repeat(np.arange(n), 4), meta, np.ones(len(meta), np.float32), n, META))


def _feature_blocks(batch: pa.RecordBatch):
    """Features of a batch, about half a block of text at a time."""
    sizes = pc.binary_length(batch.column("text")).fill_null(0).to_pylist()
    for first, end in blocks(sizes, BLOCK // 2):
        yield _features(batch.slice(first, end - first))


def _all_sums(docs: DataFrame, heads: dict[str, Head]) -> dict[str, list[np.ndarray]]:
    """``Head.lessons`` added up over all rows of ``docs`` (text, meta)."""
    def read(raw: bytes) -> np.ndarray:
        return np.frombuffer(zlib.decompress(raw), np.float64)

    def run(batches):
        total = None
        for b in batches:
            for text, meta in _feature_blocks(b):
                got = np.concatenate([s.ravel() for h in heads.values() for s in h.lessons(text, meta)])
                total = got if total is None else total + got
            release()
        if total is not None:
            yield pa.record_batch({"sums": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    def add(batches):
        total = None
        for b in batches:
            for raw in b.column("sums"):
                total = read(raw.as_py()) if total is None else total + read(raw.as_py())
        if total is not None:
            yield pa.record_batch({"sums": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    sums = docs.mapInArrow(run, "sums binary")
    n = docs.rdd.getNumPartitions()                # of the plan; no job
    while n > FAN:                                 # a tree, so that neither a task nor the driver gets all
        n = -(-n // FAN)
        sums = sums.repartition(n).mapInArrow(add, "sums binary")
    total = sum((read(bytes(r["sums"])) for r in sums.collect()), np.zeros(len(heads) * 2 * (TEXT_WIDTH + META)))
    out, at = {}, 0
    for name in heads:
        out[name] = []
        for width in (TEXT_WIDTH, META):
            out[name].append(total[at:at + 2 * width].reshape(2, width))
            at += 2 * width
    return out


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS) -> dict[str, Head]:
    """Heads ``quality`` and ``toxic``."""
    spark = docs.sparkSession
    by_doc = (labels.filter("doc_id is not null").groupBy("doc_id")
              .agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic")))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 24)) / F.lit(float(1 << 24))
    rows = by_doc.filter(draw < min(1.0, labelled / max(by_doc.count(), 1))).collect()
    want = {r["doc_id"]: (r["quality"], r["toxic"]) for r in rows}
    # at most about ``labelled`` ids, so the broadcast is bounded
    ids = F.broadcast(spark.createDataFrame([(i,) for i in want], "doc_id long"))
    all_docs = docs.select("doc_id", F.col("text").cast("binary").alias("text"), meta_column())
    # an id counts once, however many rows have it
    sample = (all_docs.join(ids, "doc_id").groupBy("doc_id")
              .agg(F.min_by(F.struct("text", "meta"), F.xxhash64("text", "meta")).alias("x")).select("doc_id", "x.*"))

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                text = _features(part)[0]
                cut = np.searchsorted(text.rows, np.arange(1, part.num_rows))
                yield pa.record_batch({
                    "doc_id": part.column("doc_id"), "meta": part.column("meta"),
                    "cols": [c.astype("<u2").tobytes() for c in np.split(text.cols, cut)],
                    "vals": [v.astype("<f4").tobytes() for v in np.split(text.vals, cut)]})

    got = sorted(sample.mapInArrow(run, "doc_id long, meta array<int>, cols binary, vals binary").collect(),
                 key=lambda r: r["doc_id"])
    n = len(got)
    size = np.array([len(r["cols"]) // 2 for r in got], np.int64)
    text = Sparse(np.repeat(np.arange(n), size), np.frombuffer(b"".join(r["cols"] for r in got), "<u2").astype(np.int64),
                  np.frombuffer(b"".join(r["vals"] for r in got), "<f4"), n, TEXT_WIDTH)
    meta = Sparse(np.repeat(np.arange(n), 4), np.array([m for r in got for m in r["meta"]], np.int64),
                  np.ones(4 * n), n, META)
    learners = {}
    for i, (name, empty) in enumerate((("quality", 1.0), ("toxic", 0.0))):
        y = [want[r["doc_id"]][i] for r in got]
        learners[name] = Learner(text, meta, np.array([np.nan if v is None else float(v) for v in y], float), empty)
    free = all_docs.join(ids, "doc_id", "left_anti").select("text", "meta")
    for _ in range(rounds):
        heads = {k: x.head for k, x in learners.items() if x.head.constant is None}
        if heads:
            for name, sums in _all_sums(free, heads).items():
                learners[name].learn(sums)
    return {k: x.head for k, x in learners.items()}


def _judge(heads: dict[str, Head], batch: pa.RecordBatch):
    """Columns text_quality, meta_quality, quality, toxic, keep of a batch."""
    out = []
    for text, meta in _feature_blocks(batch):
        by_text, by_meta, quality = heads["quality"].score(text, meta)
        toxic = heads["toxic"].score(text, meta)[2]
        out.append((by_text, by_meta, quality, toxic, (quality >= 0.5) & (toxic < 0.5)))
    return [np.concatenate([o[i] for o in out]) if out else np.zeros(0, (float, bool)[i == 4]) for i in range(5)]


def scores(docs: DataFrame, heads: dict[str, Head]) -> DataFrame:
    """doc_id, text_quality, meta_quality, quality, toxic (probabilities) and
    keep of every document."""
    def run(batches):
        for b in batches:
            c = _judge(heads, b)
            yield pa.record_batch([b.column("doc_id"), *map(pa.array, c)],
                                  ["doc_id", "text_quality", "meta_quality", "quality", "toxic", "keep"])
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"),
                        meta_column())
            .mapInArrow(run, "doc_id long, text_quality double, meta_quality double, quality double, toxic double, "
                             "keep boolean"))


def keep(docs: DataFrame, heads: dict[str, Head]) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    names = docs.columns

    text = names.index("text")

    def run(batches):
        for b in batches:
            view = pa.record_batch([b.column(text).cast(pa.binary()), b.column(len(names))], ["text", "meta"])
            rows = pa.record_batch([b.column(i) for i in range(len(names))], names)
            yield rows.filter(pa.array(_judge(heads, view)[4]))
            release()
    return docs.select("*", meta_column().alias(fresh(docs, "meta"))).mapInArrow(run, docs.schema)

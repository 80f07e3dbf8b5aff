"""Nearest neighbours, quality classifier and language identification."""

import math
import random

import llm_cases as C
import numpy as np

from qoeflow.llm import hnsw, language_id, quality


def brute_nearest(rows, every, k):
    """rows: distinct (vec_id, vector)."""
    ok = [(i, np.array(v, float)) for i, v in rows
          if i is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    out = {}
    for q, x in ok:
        if q % every == 0:
            near = sorted((-float(np.einsum("i,i->", x, y)), i) for i, y in ok if i != q and len(y) == len(x))
            out[q] = [(i, -s) for s, i in near[:k]]
    return out


def vectors(spark, data):
    return spark.createDataFrame(data, "vec_id long, embedding array<float>").selectExpr(
        "*", "vec_id as rep", "embedding as v", "'x' as shard", "1 as size", "2 as place").repartition(3)


def test_search_finds_exact_neighbours_of_odd_rows(spark):
    r = random.Random(4)
    f32 = lambda v: [float(np.float32(c)) for c in v]
    data = [(i, f32([r.gauss(0, 1) * (1 + i % 3) for _ in range(6)])) for i in range(150)]
    data += [(1000 + i, data[7][1]) for i in range(60)]                       # one vector very often
    data += [(2000, None), (2001, [0.0] * 6), (2002, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2003, [float("nan")] * 6),
             (2004, [float("inf")] + [0.0] * 5), (2005, []), (None, data[3][1]), data[3], data[3],
             (2010, [1.0, 2.0]), (2020, [2.0, 1.0]), (2040, f32([-0.0] * 5 + [1.0])), (2060, f32([0.0] * 5 + [1.0]))]
    got = {}
    for x in hnsw.search(vectors(spark, data), every=20, k=20, shard_rows=64).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.score))
    distinct = list({(i, None if v is None else tuple(v)) for i, v in data})
    want = brute_nearest(distinct, 20, 20)
    assert set(got) == set(want)
    for q, near in want.items():
        mine = sorted(got[q])
        assert [x[0] for x in mine] == list(range(1, len(near) + 1))
        assert [x[1] for x in mine] == [i for i, _ in near]
        assert np.allclose([x[2] for x in mine], [s for _, s in near], rtol=1e-12)


def test_search_recall(spark):
    sf = "/root/testdata/sf0.1/embeddings.parquet"
    df = spark.read.parquet(sf)
    data = [(r.vec_id, list(r.embedding)) for r in df.collect()]
    ids, x = np.array([i for i, _ in data]), np.array([v for _, v in data], float)
    hit = total = 0
    got = {}
    for r in hnsw.search(df, shard_rows=700).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    for q, found in got.items():
        s = x @ x[np.flatnonzero(ids == q)[0]]
        s[ids == q] = -np.inf
        hit += len(found & set(ids[np.lexsort((ids, -s))[:20]].tolist()))
        total += 20
    assert len(got) == sum(ids % 20 == 0) and hit / total >= 0.97


def test_recall_beside_one_long_vector(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(1500, 24))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[777] *= 10_000
    hit = total = 0
    got = {}
    for row in hnsw.search(vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)])).collect():
        got.setdefault(row.query_id, set()).add(row.vec_id)
    for q, found in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        hit += len(found & set(np.argsort(-s)[:20].tolist()))
        total += 20
    print("recall", hit / total)
    assert len(got) == 75 and hit / total >= 0.97


def test_routed_recall_with_bands_cells_and_hot_shards(spark, monkeypatch):
    r = np.random.default_rng(8)
    centres = r.normal(size=(12, 16)) * 4
    x = centres[np.where(np.arange(3000) % 3 == 0, 0, r.integers(0, 12, 3000))] + r.normal(size=(3000, 16))
    x[:400] /= 50                                                             # shorter ones: other bands
    x = x.astype(np.float32).astype(float)                                     # as the table holds them
    monkeypatch.setattr(hnsw, "TASK_QUERIES", 20)                              # a shard is read by several tasks
    df = vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    largest = float(np.linalg.norm(x, axis=1).max())
    band = np.minimum(np.floor(np.log2(largest / np.linalg.norm(x, axis=1))), hnsw.BANDS - 1).astype(int)
    nodes = spark.createDataFrame([(i, 16, int(b), v.tolist()) for i, (b, v) in enumerate(zip(band, x))],
                                  "vec_id long, size int, band int, v array<double>")
    groups = hnsw._groups(nodes, largest, 20, 150)
    assert len(groups) > 3 and any(len(g["first"]) > 1 for g in groups.values())
    assert any(g["probes"] < len(g["first"]) for g in groups.values())         # not all cells are visited
    assert any(g["parts"].max() > 1 for g in groups.values())                  # a large cell is several shards
    numbers = np.concatenate([np.arange(f, f + p) for g in groups.values() for f, p in zip(g["first"], g["parts"])])
    assert sorted(numbers) == list(range(len(numbers)))
    hit = total = 0
    got = {}
    for row in hnsw.search(df, shard_rows=150).collect():
        got.setdefault(row.query_id, []).append((row.rank, row.vec_id, row.score))
    for q, found in got.items():
        s = x @ x[q]
        assert np.allclose([f[2] for f in found], s[[f[1] for f in found]], rtol=1e-12)
        s[q] = -np.inf
        hit += len({f[1] for f in found} & set(np.argsort(-s)[:20].tolist()))
        total += 20
    assert len(got) == 150 and all(len(f) == 20 for f in got.values()) and hit / total >= 0.95


def test_vectors_of_extreme_length(spark):
    r = np.random.default_rng(9)
    x = r.normal(size=(60, 4)) * 10.0 ** r.integers(-120, 120, 60)[:, None]
    got = {}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    for row in hnsw.search(df).collect():
        got.setdefault(row.query_id, []).append(row.vec_id)
    assert set(got) == {0, 20, 40} and all(len(set(g)) == 20 for g in got.values())


def test_graph_levels_and_arrays():
    r = np.random.default_rng(0)
    x = r.normal(size=(900, 8)).astype(np.float32)
    order, links = hnsw.build(x, hnsw.levels(np.arange(900), 8), 8)
    assert sorted(order) == list(range(900)) and len(links) >= 3
    for nbr in links:
        n = len(nbr)
        assert nbr.shape[1] == 16 and nbr.max(initial=-1) < n
        for i, row in enumerate(nbr):
            row = row[row >= 0]
            assert len(set(row)) == len(row) and i not in row
    found = hnsw.Shard(x[order], links).search(x[order][:200], 1, 32)
    assert (found[:, 0] == np.arange(200)).mean() > 0.99


def test_search_of_nothing(spark):
    assert hnsw.search(vectors(spark, [])).count() == 0
    assert hnsw.search(vectors(spark, [(1, None), (20, [0.0])])).count() == 0
    assert hnsw.search(vectors(spark, [(20, [1.0, 2.0])])).count() == 0


def corpus(n=700, seed=6):
    """Documents whose quality shows in the text and, weakly, in the source;
    labels of every third."""
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(300)]
    docs, labels, truth = [], [], {}
    for i in range(n):
        bad, rude = r.random() < 0.25, r.random() < 0.2
        words = [r.choice(vocab) for _ in range(r.randint(20, 80))]
        if bad:
            words = [w + r.choice(["###", "$$$"]) for w in words]
        if rude:
            words[5:5] = ["moron", "idiot"]
        docs.append((i, " ".join(words), "en", ("spam" if bad else "good") if r.random() < 0.9 else "other", 1))
        truth[i] = not bad and not rude
        if i % 3 == 0:
            labels.append((i, int(not bad), int(rude)))
    return docs, labels, truth


def test_co_training_on_held_out_documents(spark):
    docs, labels, truth = corpus()
    df = C.frame(spark, docs)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    heads = quality.train(df, lab)
    got = {r.doc_id: r for r in quality.scores(df, heads).collect()}
    held = [i for i in truth if i % 3]
    assert np.mean([got[i].keep == truth[i] for i in held]) > 0.95
    kept = quality.keep(df, heads)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i in got if got[i].keep)


def test_views_teach_each_other():
    """Few labels, which hardly show the text's words; the metadata shares the
    class with all rows and teaches the text view words it has no label for."""
    r = np.random.default_rng(0)
    n = 4000
    y = r.random(n) < 0.5
    # a word of the class out of 200 each, and one that says nothing
    word = np.where(y, 0, 200) + r.integers(0, 200, n)
    a = quality.Sparse(np.repeat(np.arange(n), 2), np.stack([word, 400 + r.integers(0, 20, n)]).T.ravel(), np.ones(2 * n), n, 420)
    b = quality.Sparse(np.arange(n), np.where(y, 0, 1), np.ones(n), n, 2)
    lab = np.where(np.arange(n) < 60, y.astype(float), np.nan)
    learner = quality.Learner(a, b, lab, 1.0)
    before = ((learner.head.score(a, b)[0][60:] > 0.5) == y[60:]).mean()
    rest = np.arange(60, n)
    for _ in range(quality.ROUNDS):
        learner.learn(learner.head.lessons(a.take(rest), b.take(rest)))
    text, meta, both = learner.head.score(a, b)
    assert ((both[60:] > 0.5) == y[60:]).mean() > 0.97
    assert ((text[60:] > 0.5) == y[60:]).mean() > 0.9 > before


def test_every_unlabelled_document_counts_however_rows_are_dealt(spark, monkeypatch):
    docs, labels, _ = corpus()
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    seen = []
    real = quality._all_sums

    def counted(free, heads):
        seen.append((free.count(), real(free, heads)))
        return seen[-1][1]
    monkeypatch.setattr(quality, "_all_sums", counted)
    monkeypatch.setattr(quality, "FAN", 2)                   # the tree has several levels
    got = []
    for parts in (1, 9):
        heads = quality.train(C.frame(spark, docs).repartition(parts), lab)
        got.append(heads)
    ids = {i for i, *_ in labels}
    assert {n for n, _ in seen} == {sum(d[0] not in ids for d in docs)} and len(seen) == 2 * quality.ROUNDS
    for x, y in zip(seen[0][1].values(), seen[quality.ROUNDS][1].values()):
        assert all((p == q).all() for p, q in zip(x, y))
    assert all(np.array_equal(got[0][k].both, got[1][k].both) for k in got[0] if got[0][k].both is not None)


def test_quality_of_odd_rows_and_labels(spark):
    df = C.frame(spark)
    schema = "doc_id long, quality int, toxic int"
    for lab, want in (([], (1.0, 0.0)), ([(0, 1, None), (1, 1, 0), (None, 0, 1)], (1.0, 0.0)),
                      ([(0, None, 1)], (1.0, 1.0))):
        heads = quality.train(df, spark.createDataFrame(lab, schema))
        got = quality.scores(df, heads).collect()
        assert len(got) == len(C.rows())
        assert {(r.quality, r.toxic) for r in got} == {want}
    heads = quality.train(df, spark.createDataFrame([(i, i % 2, i % 3 == 0) for i in range(60)] + [(0, 0, True)],
                                                    "doc_id long, quality int, toxic boolean")
                          .selectExpr("doc_id", "quality", "cast(toxic as int) as toxic"))
    got = quality.scores(df, heads).collect()
    assert all(0 <= r.quality <= 1 and 0 <= r.toxic <= 1 for r in got)
    none = C.frame(spark, [])
    assert quality.scores(none, quality.train(none, spark.createDataFrame([], schema))).count() == 0
    assert quality.keep(none, heads).count() == 0


def test_gru_gradients_match_differences():
    g = language_id.ByteGru(["a", "b", "c"], 4)
    g.p = {k: v.astype(np.float64) for k, v in g.p.items()}
    r = np.random.default_rng(0)
    x, length, y = r.integers(0, 256, (3, 7)).astype(np.uint8), np.array([7, 4, 1]), np.array([0, 1, 2])
    _, grad = g.gradients(x, length, y)
    for k in g.p:
        flat = g.p[k].reshape(-1)
        for i in np.argsort(-np.abs(grad[k]).reshape(-1))[:3]:
            old = flat[i]
            flat[i] = old + 1e-3
            up = g.gradients(x, length, y)[0]
            flat[i] = old - 1e-3
            down = g.gradients(x, length, y)[0]
            flat[i] = old
            assert abs((up - down) / 2e-3 - grad[k].reshape(-1)[i]) < 1e-5


def test_gru_reads_every_position_like_the_reference_form(monkeypatch):
    m = language_id.ByteGru(["a", "b", "c", "d"])
    r = np.random.default_rng(1)
    texts = [bytes(r.integers(0, 256, n).astype(np.uint8)) for n in (1, 5, 127, 128, 129, 700, 0)]
    monkeypatch.setattr(language_id, "LANES", 3)
    got = m.pooled(texts)
    for text, p in zip(texts, got):
        total = np.zeros(4)
        for at in range(0, len(text), language_id.SEGMENT):
            part = np.frombuffer(text[at:at + language_id.SEGMENT], np.uint8)[None, :]
            z = m.logits(m.states(part, np.array([part.shape[1]])))[:, 0]
            e = np.exp(z - z.max(-1, keepdims=True))
            total += (e / e.sum(-1, keepdims=True)).sum(0)
        assert np.allclose(p, total / max(len(text), 1), atol=1e-5)


def test_language_id_on_held_out_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r.doc_id: r.lang for r in df.select("doc_id", "lang").collect()}
    got = language_id.language_id(df).collect()
    held = [r for r in got if r.held_out]
    import zlib
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_language_of_odd_rows(spark):
    df = C.frame(spark)
    got = language_id.language_id(df).collect()
    assert len(got) == len(C.rows())
    texts = {r[0]: r[1] for r in C.rows() if r[0] not in (5, 7)}
    for r in got:
        if r.doc_id in texts and r.doc_id is not None:
            letter = any(c.isalpha() for c in texts[r.doc_id] or "")
            assert (r.lang_pred in ("en", "de")) == letter and (letter or r.score == 0)
        if r.doc_id is None:
            assert r.held_out is False
    none = C.frame(spark, [])
    assert language_id.language_id(none).count() == 0
    unknown = df.withColumn("lang", df.lang.substr(9, 1)).filter("lang is null")
    assert {r.lang_pred for r in language_id.language_id(unknown).collect()} == {"und"}

"""Token counts by finite-state tokenizer compilation.

Two deterministic transducers are compiled from a public ``tokenizers`` file;
no ids are formed and the library encodes nothing on the main path.

* The **lexer** reads one class a byte (white space, letter, number, other, two
  kinds of apostrophe that begin a contraction, continuation byte) and emits a
  mark where a piece of the pre-tokenizer begins.  It has five states; the maps
  from state to state that runs of classes can cause are finitely many, so a
  map is one small number and two maps compose by a table.  A block of text is
  cut into chunks of ``LANE`` bytes; all chunks are folded to their maps side
  by side, the maps are combined by a parallel prefix scan, which gives the
  state that each chunk is entered in, and with it every byte's mark.
* The **piece** transducer reads a piece byte by byte (its last byte as an end
  symbol) and annotates each transition with the change in the number of
  tokens emitted so far, which may be negative where a merge swallows tokens.
  A state holds, for every suffix of what was read that may still become part
  of a later token, that suffix, the last token before it and the tokens since.
  Of the candidates for the next last token exactly one may stand behind the
  token before it (no merge of the vocabulary joins the two earlier than they
  are formed), so each step is deterministic.  Transitions are compiled when
  first met and shared by all texts of a worker; all pieces of a block step
  side by side.  When a worker knows ``STATES`` states it starts anew.

Only runs with characters beyond ASCII and the common Latin letters go through
the library's normalizer first; the class of each such character is asked from
the library's pre-tokenizer once.  Special tokens' strings count one each and
end the pieces beside them, as by the library's default.  A tokenizer file of
another shape (checked when it is loaded) is not compiled: the library then
counts whole texts.

A text longer than a block is cut at white space, and its counts are added; a
run without white space is never cut, so a task's memory follows the longest of
those and the block size, not the text.  There is no shuffle.

Defined results: null text is empty (0 bytes, 0 tokens); null and repeated ids
are rows of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qoeflow.llm.common import U64, mix64
from qoeflow.llm.tokens import default_path

#: Documents with more tokens than this are over the limit.
LIMIT = 2048
#: Bytes of text worked off at once; numpy temporaries take about 40 times this.
BLOCK_BYTES = 1 << 19
#: Bytes of a chunk whose state maps are folded side by side.
LANE = 64
#: States of the piece transducer after which a worker starts anew.
STATES = 300_000
#: Pieces still open below which the rest is walked one by one.
FEW = 8

# Fixed values of the tokenizer format: the pattern of pieces this lexer implements.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
CONTRACTIONS_1, CONTRACTIONS_2 = b"stmd", (b"re", b"ve", b"ll")

# ------------------------------------------------------------------ the lexer
#: Byte classes: white space, letter, number, other, apostrophe of a contraction
#: with one letter, with two letters, continuation of a character.
W, L, N, O, A1, A2, X = range(7)  # noqa: E741
#: States: nothing open, in letters, in others, one or two contraction letters left.
OPEN, LETTERS, OTHERS, ONE, TWO = range(5)


def _lexer() -> tuple[np.ndarray, np.ndarray]:
    """Next state and begin mark by (state, class)."""
    to, mark = np.zeros((5, 7), np.uint8), np.zeros((5, 7), bool)
    for s in range(5):
        left = {ONE: OPEN, TWO: ONE}.get(s)
        for c in range(7):
            if c == X:
                to[s, c] = s
            elif c == W:
                to[s, c] = OPEN
            elif left is not None:              # a letter that belongs to the contraction
                to[s, c] = left
            else:
                inside = (c == L and s == LETTERS) or (c in (O, A1, A2) and s == OTHERS)
                mark[s, c] = not inside
                to[s, c] = {L: LETTERS, N: OPEN, O: OTHERS, A1: ONE, A2: TWO}[c] if not inside else s
    return to, mark


def _monoid(to: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All maps that runs of classes cause, as rows; the number of each
    class's map; the table of compositions (first, then)."""
    maps: list[tuple] = [tuple(range(len(to)))]
    number = {maps[0]: 0}
    for m in maps:                              # grows until it is closed
        for c in range(to.shape[1]):
            x = tuple(int(to[s, c]) for s in m)
            if x not in number:
                number[x] = len(maps)
                maps.append(x)
    rows = np.array(maps, np.uint8)
    table = np.array([[number[tuple(int(b[s]) for s in a)] for b in maps] for a in maps], np.uint8)
    return rows, np.array([number[tuple(int(x) for x in to[:, c])] for c in range(to.shape[1])], np.uint8), table


_TO, _MARK = _lexer()
_MAPS, _OF_CLASS, _THEN = _monoid(_TO)


def entered_states(classes: np.ndarray) -> np.ndarray:
    """The lexer's state before each byte: maps of ``LANE`` bytes are folded
    side by side, then combined by a parallel prefix scan."""
    n = len(classes)
    lanes = -(-n // LANE)
    g = np.zeros(lanes * LANE, np.uint8)        # padding: the map that changes nothing
    g[:n] = _OF_CLASS[classes]
    g = np.ascontiguousarray(g.reshape(lanes, LANE).T)
    before = np.zeros_like(g)
    m = np.zeros(lanes, np.uint8)
    for k in range(LANE):
        before[k] = m
        m = _THEN[m, g[k]]
    step = 1
    while step < lanes:                         # inclusive scan, doubling its reach
        m = np.concatenate([m[:step], _THEN[m[:-step], m[step:]]])
        step *= 2
    entry = np.zeros(lanes, np.uint8)
    entry[1:] = _MAPS[m[:-1], OPEN]
    return _MAPS[before, entry[None, :]].T.reshape(-1)[:n]


# ------------------------------------------------------- the piece transducer
class Pieces:
    """The lazily compiled transducer of the merges; symbols are bytes, plus
    256 for the last byte of a piece."""

    def __init__(self, vocab: dict[str, int], merges: list, letters: dict[str, int], suffix: str):
        def symbols(token: str) -> tuple[int, ...]:
            end = token.endswith(suffix)
            s = [letters[c] for c in (token[:-len(suffix)] if end else token)]
            return (*s[:-1], s[-1] + 256) if end else tuple(s)

        self.rule: dict[tuple[int, int], tuple[int, int]] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for rank, m in enumerate(merges):
            a, b = m if isinstance(m, list) else m.split(" ", 1)
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.rule[x, y] = rank, z
            self.made[z] = rank, x, y
        # the tree of the symbols of tokens: node -> {symbol: node}, token at a node
        self.child: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        one = 0
        for t, i in vocab.items():
            s = symbols(t)
            if len(s) > 1 and i not in self.made:
                continue                        # never formed
            one += len(s) == 1
            node = 0
            for x in s:
                nxt = self.child[node].get(x)
                if nxt is None:
                    nxt = self.child[node][x] = len(self.child)
                    self.child.append({})
                    self.token.append(-1)
                node = nxt
            self.token[node] = i
        if one != 512 or len(self.made) != len(merges):
            raise ValueError("not a byte-level vocabulary with one merge a token")
        for _, (rank, x, y) in self.made.items():
            if max(self.made.get(x, (-1,))[0], self.made.get(y, (-1,))[0]) >= rank:
                raise ValueError("a merge comes before its parts")
        self.pair: dict[tuple[int, int], bool] = {}
        self.reset()

    def reset(self) -> None:
        #: items of each state: (node, last token before the suffix, tokens since)
        self.items: list[tuple] = [((0, -1, 0),)]
        self.state: dict[tuple, int] = {self.items[0]: 0}
        self.slots = 1 << 16
        self.key = np.zeros(self.slots, np.int64)
        self.to = np.zeros(self.slots, np.int32)
        self.out = np.zeros(self.slots, np.int16)
        self.edges = 0

    def follows(self, a: int, b: int) -> bool:
        """Whether token b may stand behind a: no rule joins a part at a's end
        with a part at b's beginning while both exist (the left one of equal
        rules goes first)."""
        known = self.pair.get((a, b))
        if known is None:
            left, right = [], []                # (part, rank of the rule that uses it up)
            x, end = a, len(self.rule)
            while True:
                left.append((x, end))
                if x not in self.made:
                    break
                end, _, x = self.made[x]
            y, end = b, len(self.rule)
            while True:
                right.append((y, end))
                if y not in self.made:
                    break
                end, y, _ = self.made[y]
            known = self.pair[a, b] = not any(
                (r := self.rule.get((x, y))) is not None and r[0] < ex and r[0] <= ey
                for x, ex in left for y, ey in right)
        return known

    def step(self, state: int, symbol: int) -> tuple[int, int]:
        """Next state and change of the number of tokens."""
        kept, last, delta = [], -1, 0
        child, token = self.child, self.token
        for node, before, since in self.items[state]:
            nxt = child[node].get(symbol)
            if nxt is None:
                continue
            t = token[nxt]
            if t >= 0 and (before < 0 or self.follows(before, t)):
                if last >= 0:
                    raise AssertionError("two ways to read a piece")
                last, delta = t, since + 1
            if child[nxt]:
                kept.append((nxt, before, since))
        if last < 0:
            raise AssertionError("no way to read a piece")
        if symbol >= 256:
            return 0, delta
        items = ((0, last, 0), *((n, b, s - delta) for n, b, s in kept))
        number = self.state.get(items)
        if number is None:
            number = self.state[items] = len(self.items)
            self.items.append(items)
        return number, delta

    # Open-addressing table of transitions: key = state * 512 + symbol + 1.
    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (mix64(key.view(U64)) & U64(self.slots - 1)).view(np.int64)

    def _find(self, key: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 where it is unknown."""
        at = self._slot(key)
        have = self.key[at]
        out = np.where(have == key, at, -1)
        rest = np.flatnonzero((have != key) & (have != 0))
        while len(rest):
            at[rest] = (at[rest] + 1) & (self.slots - 1)
            have = self.key[at[rest]]
            hit = have == key[rest]
            out[rest[hit]] = at[rest[hit]]
            rest = rest[~hit & (have != 0)]
        return out

    def _put(self, key: np.ndarray, to: np.ndarray, out: np.ndarray) -> None:
        at = self._slot(key)
        rest = np.arange(len(key))
        while len(rest):
            free = self.key[at[rest]] == 0
            _, first = np.unique(at[rest], return_index=True)
            mine = np.zeros(len(rest), bool)
            mine[first] = True
            mine &= free
            done = rest[mine]
            self.key[at[done]], self.to[at[done]], self.out[at[done]] = key[done], to[done], out[done]
            rest = rest[~mine]
            at[rest] = (at[rest] + 1) & (self.slots - 1)

    def _learn(self, keys: np.ndarray) -> None:
        """Compile transitions that are not known yet (distinct keys)."""
        new = [self.step((k - 1) >> 9, (k - 1) & 511) for k in keys.tolist()]
        if 3 * (self.edges + len(new)) > self.slots:
            used = self.key != 0
            old = self.key[used], self.to[used], self.out[used]
            while 3 * (self.edges + len(new)) > self.slots:
                self.slots *= 2
            self.key = np.zeros(self.slots, np.int64)
            self.to, self.out = np.zeros(self.slots, np.int32), np.zeros(self.slots, np.int16)
            self._put(*old)
        self._put(keys, np.array([s for s, _ in new], np.int32), np.array([d for _, d in new], np.int16))
        self.edges += len(new)

    def moves(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (state.astype(np.int64) << 9) + symbol + 1
        at = self._find(key)
        if len(new := np.flatnonzero(at < 0)):
            self._learn(np.unique(key[new]))
            at = self._find(key)
        return self.to[at], self.out[at]

    def counts(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Tokens of each piece ``data[start:end]``; all pieces step side by
        side, longest first."""
        if len(self.items) > STATES:
            self.reset()
        size = end - start
        order = np.argsort(-size, kind="stable")
        start, size = start[order], size[order]
        state, total = np.zeros(len(start), np.int32), np.zeros(len(start), np.int64)
        open_ = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), "left")
        for k, m in enumerate(open_.tolist()):
            if m < FEW:
                for i in range(m):
                    total[i] += self._walk(int(state[i]), data[start[i] + k:start[i] + size[i]].tolist())
                break
            symbol = data[start[:m] + k].astype(np.int64)
            symbol[size[:m] == k + 1] += 256
            state[:m], out = self.moves(state[:m], symbol)
            total[:m] += out
        back = np.empty(len(order), np.int64)
        back[order] = total
        return back

    def _walk(self, state: int, symbols: list[int]) -> int:
        symbols[-1] += 256
        known: dict[tuple[int, int], tuple[int, int]] = {}
        total = 0
        for x in symbols:
            move = known.get((state, x))
            if move is None:
                to, out = self.moves(np.array([state], np.int32), np.array([x]))
                move = known[state, x] = int(to[0]), int(out[0])
                if len(known) > STATES:
                    known.clear()
            state, total = move[0], total + move[1]
        return total


# ---------------------------------------------------------------- whole texts
_SIMPLE = np.full(256, O, np.uint8)             # class of each byte of simple runs
_SIMPLE[[9, 10, 11, 12, 13, 32]] = W
_SIMPLE[48:58] = N
_SIMPLE[97:123] = L
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Second bytes of lower-case Latin letters behind 0xC3 in UTF-8.
_LATIN = np.zeros(256, bool)
_LATIN[[b for b in range(0x9F, 0xC0) if b != 0xB7]] = True
#: Of their capitals, 32 below.
_CAPITAL = np.zeros(256, bool)
_CAPITAL[[b for b in range(0x80, 0x9F) if b != 0x97]] = True


class Counter:
    """Counts of whole texts by one tokenizer file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"   # one core a task
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.normal: dict[bytes, tuple[bytes, np.ndarray]] = {}
        self.kind: dict[str, int] = {}
        text = json.loads(self.tok.to_str())
        self.special = [t["content"].encode() for t in text["added_tokens"]]
        self.pieces = self._compile(text) if self._fits(text) else None

    @staticmethod
    def _fits(text: dict) -> bool:
        """Whether the file has the shape that is compiled."""
        norm, pre, model = text["normalizer"] or {}, text["pre_tokenizer"] or {}, text["model"]
        steps = norm.get("normalizers", [])
        parts = pre.get("pretokenizers", [])
        return ([s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"]
                and (steps[1]["pattern"], steps[1]["content"]) == ({"Regex": r"\s+"}, " ")
                and [p["type"] for p in parts] == ["Split", "ByteLevel"]
                and (parts[0]["pattern"], parts[0]["behavior"], parts[0]["invert"]) == ({"Regex": PIECES}, "Removed", True)
                and not parts[1]["add_prefix_space"] and not parts[1]["use_regex"]
                and model["type"] == "BPE" and bool(model["end_of_word_suffix"])
                and not (model["dropout"] or model["continuing_subword_prefix"] or model.get("ignore_merges"))
                and all(t["special"] and not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"])
                        for t in text["added_tokens"]))

    def _compile(self, text: dict) -> Pieces | None:
        # byte-level vocabularies write a byte as itself where it is printable, else as the next free character
        keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in keep]
        letters = {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}
        model = text["model"]
        try:
            return Pieces(model["vocab"], model["merges"], letters, model["end_of_word_suffix"])
        except (ValueError, KeyError):
            return None

    def _class(self, c: str) -> int:
        """Class of a character, by the library's pre-tokenizer: whether it
        joins letters, joins marks, vanishes or stands alone."""
        known = self.kind.get(c)
        if known is None:
            joins, marks, rest = (len(self.tok.pre_tokenizer.pre_tokenize_str(p)) for p in (f"a{c}a", f"#{c}#", f"1{c}"))
            known = self.kind[c] = L if joins == 1 else O if marks == 1 else W if rest == 1 else N
        return known

    def _normalized(self, run: bytes) -> tuple[bytes, np.ndarray]:
        """Normal form of a run and the classes of its bytes."""
        known = self.normal.get(run)
        if known is None:
            text = self.tok.normalizer.normalize_str(run.decode("utf-8", "replace"))
            data = text.encode()
            codes = np.frombuffer(data, np.uint8)
            classes = np.full(len(data), X, np.uint8)
            classes[(codes & 0xC0) != 0x80] = [
                _SIMPLE[ord(c)] if ord(c) < 128 else self._class(c) for c in text]
            known = data, classes
            if len(run) <= 64:
                if len(self.normal) >= 100_000:
                    self.normal.clear()
                self.normal[run] = known
        return known

    def _prepared(self, codes: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Normal bytes, their classes and where the texts end among them; the
        last byte of each text is white space."""
        data = _LOWER[codes]
        after_c3 = np.zeros(len(data), bool)
        after_c3[1:] = data[:-1] == 0xC3
        data[after_c3 & _CAPITAL[data]] += 32
        classes = _SIMPLE[data]
        latin = after_c3 & _LATIN[data]
        classes[latin] = L
        classes[np.flatnonzero(latin) - 1] = L
        hard = (data >= 0x80) & (classes != L)
        if not hard.any():
            return data, classes, edge
        space = np.flatnonzero(classes == W)
        run = np.unique(np.searchsorted(space, np.flatnonzero(hard)))     # runs between white space
        parts, kinds, at = [], [], 0
        grown = np.zeros(len(space) + 1, np.int64)
        for r in run.tolist():
            a = int(space[r - 1]) + 1 if r else 0
            z = int(space[r]) if r < len(space) else len(data)
            new, kind = self._normalized(codes[a:z].tobytes())
            parts += [data[at:a], np.frombuffer(new, np.uint8)]
            kinds += [classes[at:a], kind]
            at = z
            grown[r] = len(new) - (z - a)
        parts.append(data[at:])
        kinds.append(classes[at:])
        # an edge lies behind a text's last byte, which is white space
        moved = np.cumsum(grown)[np.searchsorted(space, edge - 1)]
        return np.concatenate(parts), np.concatenate(kinds), edge + moved

    def block(self, data: bytes | np.ndarray, edge: np.ndarray) -> np.ndarray:
        """Tokens of the texts that end at each ``edge``; each ends with a byte
        of white space."""
        codes = np.frombuffer(data, np.uint8)
        more = np.zeros(len(edge), np.int64)
        raw = codes.tobytes()
        if any(s in raw for s in self.special):
            codes = codes.copy()
            either = re.compile(b"|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)))
            for m in either.finditer(raw):
                codes[m.start():m.end()] = 32
                more[np.searchsorted(edge, m.start(), "right")] += 1
        text, classes, edge = self._prepared(codes, edge)
        mark = np.flatnonzero((text[:-1] == 39) & (classes[:-1] == O))
        ahead = np.concatenate([text, np.zeros(3, np.uint8)])
        one = np.isin(ahead[mark + 1], np.frombuffer(CONTRACTIONS_1, np.uint8))
        two = np.zeros(len(mark), bool)
        for a, b in CONTRACTIONS_2:
            two |= (ahead[mark + 1] == a) & (ahead[mark + 2] == b)
        classes[mark[one]], classes[mark[two]] = A1, A2
        start = np.flatnonzero(_MARK[entered_states(classes), classes])
        space = np.concatenate([np.flatnonzero(classes == W), [len(text)]])
        end = np.minimum(np.append(start[1:], len(text)), space[np.searchsorted(space, start)])
        done = np.concatenate([[0], np.cumsum(self.pieces.counts(text, start, end))])
        upto = done[np.searchsorted(start, edge)]
        return np.diff(upto, prepend=0) + more

    def library(self, texts: list[bytes]) -> list[int]:
        got = self.tok.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
        return [len(e) for e in got]

    def column(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each text of an Arrow column of bytes (its buffers)."""
        n = len(offsets) - 1
        total = np.zeros(n, np.int64)
        i = 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + BLOCK_BYTES, "right")) - 1)
            if self.pieces is None:
                total[i:j] = self.library([data[a:z].tobytes() for a, z in zip(offsets[i:j], offsets[i + 1:j + 1])])
            elif offsets[j] - offsets[i] <= 2 * BLOCK_BYTES:
                size = np.diff(offsets[i:j + 1])
                edge = np.cumsum(size + 1)
                text = np.full(int(edge[-1]), 32, np.uint8)
                keep = np.ones(len(text), bool)
                keep[edge - 1] = False
                text[keep] = data[offsets[i]:offsets[j]]
                total[i:j] = self.block(text, edge)
            else:
                total[i] = sum(int(self.block(np.append(data[a:z], np.uint8(32)), np.array([z - a + 1]))[0])
                               for a, z in self._cuts(data, int(offsets[i]), int(offsets[i + 1])))
            i = j
        return total

    @staticmethod
    def _cuts(data: np.ndarray, at: int, end: int):
        """Parts of about a block that begin at white space (but the first)."""
        while at < end:
            stop = min(end, at + BLOCK_BYTES)
            if stop < end:
                back = np.flatnonzero(_SIMPLE[data[at + 1:stop]] == W)
                while not len(back) and stop < end:            # one run longer than a block
                    first, stop = stop, min(end, stop + BLOCK_BYTES)
                    back = np.flatnonzero(_SIMPLE[data[first:stop]] == W) + first - at - 1
                if len(back) and stop < end:
                    stop = at + 1 + int(back[-1])
            yield at, stop
            at = stop


_LOADED: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """The worker's counter of a tokenizer file."""
    if path not in _LOADED:
        _LOADED[path] = Counter(path)
    return _LOADED[path]


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary column, without copies; a null is empty."""
    column = column.fill_null(b"").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def token_counts(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit of every row."""
    path = path or default_path()

    def run(batches):
        count = counter(path)
        for b in batches:
            data, offsets = column_bytes(b.column("text"))
            tokens = count.column(data, offsets)
            yield pa.record_batch({"doc_id": b.column("doc_id"), "n_bytes": pa.array(np.diff(offsets)),
                                   "n_tokens": pa.array(tokens), "over_limit": pa.array(tokens > limit)})
    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
            .mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean"))

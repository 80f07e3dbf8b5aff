"""Token ids by a public ``tokenizers`` file, in blocks of whole texts.

Where the tokenizer drops white space and joins nothing across it (checked when
it is loaded), a text's ids are its words' ids in order, so each worker keeps
the ids of words it has met and hands only new ones to the library; otherwise
whole texts are encoded.  Where it also ignores the case of A-Z and splits
letters from the marks behind them (checked too), words are met in lower case,
and one with marks at its end is put together from its parts.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

from qoeflow.llm.common import U64, blocks, seeded
from qoeflow.llm.words import Poly, spans

#: Slots of a worker's table of words it has met (12 bytes each); half full it
#: starts anew.
SLOTS = 1 << 21
#: Bytes of text worked off at once.
BLOCK_BYTES = 1 << 19
#: New words handed over in one string, separated by a special token.
JOIN = 512


#: Words of lower-case Latin letters: one piece to the pre-tokenizer, and as they
#: are to NFC and lower-casing; and the marks that are split off behind a letter.
_PLAIN = re.compile("[a-zß-öø-ÿ]+")
MARKS = ".,!?;:#*%$&|"
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in MARKS]] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(97, 123)]] = True
#: Second bytes of the Latin letters that begin with 0xC3 in UTF-8.
_LATIN = np.zeros(256, bool)
_LATIN[[b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)]] = True

_VALUES, _POLY = seeded(256, 71), Poly(701)


def _byte_letters() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each
    byte: itself where it is one, else the next free one from 256 on."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    return {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Words:
    """Open-addressing table from a word's 64-bit hash to its number."""

    def __init__(self, slots: int = 0):
        self.slots = slots or SLOTS
        self.key = np.zeros(self.slots, U64)
        self.number = np.zeros(self.slots, np.int32)
        self.known = 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """Numbers of hashes, -1 for unknown ones."""
        slot = (h >> U64(20)) & U64(self.slots - 1)
        key = self.key[slot]
        out = np.where(key == h, self.number[slot], np.int32(-1))
        rest = np.flatnonzero((key != h) & (key != 0))
        while len(rest):
            slot[rest] = (slot[rest] + U64(1)) & U64(self.slots - 1)
            key = self.key[slot[rest]]
            hit = key == h[rest]
            out[rest[hit]] = self.number[slot[rest[hit]]]
            rest = rest[~hit & (key != 0)]
        return out

    def add(self, h: np.ndarray) -> None:
        """Number distinct new hashes in their order."""
        number = np.arange(self.known, self.known + len(h), dtype=np.int32)
        self.known += len(h)
        slot = (h >> U64(20)) & U64(self.slots - 1)
        rest = np.arange(len(h))
        while len(rest):
            free = self.key[slot[rest]] == 0
            _, first = np.unique(slot[rest], return_index=True)
            mine = np.zeros(len(rest), bool)
            mine[first] = True
            mine &= free
            done = rest[mine]
            self.key[slot[done]], self.number[slot[done]] = h[done], number[done]
            rest = rest[~mine]
            slot[rest] = (slot[rest] + U64(1)) & U64(self.slots - 1)


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"   # one core a task
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        one = [self._whole(x) for x in ("Ab", "c.d", "Ab c.d", " \nAb\t\x0b\x0c\r c.d ")]
        self.by_word = one[2] == one[0] + one[1] == one[3]
        marks = [(str(t.content), i) for i, t in self.tok.get_added_tokens_decoder().items()
                 if t.special and not (t.lstrip or t.rstrip or t.single_word)]
        self.mark = marks[0] if marks else None
        self.specials = tuple(t.content for t in self.tok.get_added_tokens_decoder().values())
        self.fold = self.by_word and self._folds()
        self.letters = _byte_letters()
        self._reset()

    def _folds(self) -> bool:
        """Whether A-Z equals a-z, marks are split off behind a letter, and the
        model alone gives a plain word's ids."""
        text = json.loads(self.tok.to_str())
        steps = text["normalizer"].get("normalizers", [text["normalizer"]]) if text["normalizer"] else []
        if not any(x["type"] == "Lowercase" for x in steps):
            return False
        letters = _byte_letters()
        for body in ("qa", "zé", "ß", "øre", "a1", "7"):
            piece = "".join(letters[b] for b in body.encode())
            if _PLAIN.fullmatch(body) and [t.id for t in self.tok.model.tokenize(piece)] != self._whole(body):
                return False
            if any(self._whole(body + m) != self._whole(body) + self._whole(m)
                   for m in (*MARKS, "...", "!!", "###", "***", "%%%", "$$$", "&&&", ".!?", ",.", "|.")):
                return False
        return True

    def _reset(self):
        self.words = _Words()
        self.start = np.zeros(1024, np.int64)
        self.size = np.zeros(1024, np.int64)
        self.flat = np.zeros(4096, np.uint32)
        self.used = 0

    def _whole(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def _words(self, words: list[str]) -> list[np.ndarray]:
        """Ids of whole words by the library."""
        out: list = [None] * len(words)
        if self.fold:
            model, letters = self.tok.model.tokenize, self.letters
            for i, w in enumerate(words):
                if _PLAIN.fullmatch(w):
                    piece = w if w.isascii() else "".join(letters[b] for b in w.encode())
                    out[i] = np.array([t.id for t in model(piece)], np.uint32)
        join = [i for i, w in enumerate(words) if out[i] is None and self.mark and not any(s in w for s in self.specials)]
        parts = [join[i:i + JOIN] for i in range(0, len(join), JOIN)]
        mark, mark_id = self.mark or ("", -1)
        joined = [mark + mark.join(words[i] for i in p) for p in parts]
        for p, e in zip(parts, self.tok.encode_batch_fast(joined, add_special_tokens=False)):
            ids = np.array(e.ids, np.uint32)
            cut = np.flatnonzero(ids == mark_id)
            for i, a, b in zip(p, cut, [*cut[1:], len(ids)]):
                out[i] = ids[a + 1:b]
        for i, w in enumerate(words):
            if out[i] is None:
                out[i] = np.array(self._whole(w), np.uint32)
        return out

    def _learn(self, words: list[bytes]) -> None:
        """Keep the ids of words that have just been numbered."""
        found = self._words([w.decode("utf-8", "replace") for w in words])
        known = self.words.known - len(found)
        n = self.words.known
        size = np.fromiter(map(len, found), np.int64, len(found))
        total = self.used + int(size.sum())
        if n > len(self.size):
            self.start, self.size = (np.resize(a, 2 * n) for a in (self.start, self.size))
        if total > len(self.flat):
            self.flat = np.resize(self.flat, 2 * total)
        self.size[known:n] = size
        self.start[known:n] = self.used + np.cumsum(size) - size
        self.flat[self.used:total] = np.concatenate(found)
        self.used = total

    def _pieces(self, data: bytes):
        """Start and end of each piece looked up: words, marks behind a letter
        or digit apart."""
        start, stop = spans(data)
        if not self.fold:
            return start, stop
        codes = np.frombuffer(data, np.uint8)
        body = stop.copy()
        for _ in range(8):
            body -= (body - start > 1) & _MARK[codes[body - 1]]
        last, before = codes[body - 1], codes[np.maximum(body - 2, 0)]
        letter = _ALNUM[last] | ((before == 0xC3) & _LATIN[last] & (body - start > 1))
        body = np.where(letter, body, stop)
        marked = body < stop
        at = np.arange(len(start)) + np.cumsum(marked) - marked
        first, end = np.empty(len(start) + int(marked.sum()), np.int64), np.empty(len(start) + int(marked.sum()), np.int64)
        first[at], end[at] = start, body
        first[at[marked] + 1], end[at[marked] + 1] = body[marked], stop[marked]
        return first, end

    def _block(self, texts: list[bytes]) -> list[np.ndarray]:
        data = b"\n".join(t.lower() for t in texts) if self.fold else b"\n".join(texts)
        first, end = self._pieces(data)
        if 2 * (self.words.known + len(first)) > self.words.slots:
            self._reset()
            if 4 * len(first) > self.words.slots:
                self.words = _Words(1 << (8 * len(first) - 1).bit_length())
        h = _POLY.ranges(_POLY.prefix(_VALUES[np.frombuffer(data, np.uint8)]), first, end)
        # the length goes into the hash; 0 marks an empty slot
        h = (h ^ ((end - first).astype(U64) * U64(0x9E3779B97F4A7C15))) | U64(1)
        at = self.words.find(h)
        new = np.flatnonzero(at < 0)
        if len(new):
            hashes, where = np.unique(h[new], return_index=True)
            self.words.add(hashes)
            self._learn([data[a:z] for a, z in zip(first[new[where]].tolist(), end[new[where]].tolist())])
            at[new] = self.words.find(h[new])
        size = self.size[at]
        done = np.cumsum(size)
        ids = self.flat[np.repeat(self.start[at] - done + size, size) + np.arange(int(done[-1]) if len(done) else 0)]
        edge = np.cumsum([len(t) + 1 for t in texts])
        cut = np.concatenate([[0], done])[np.searchsorted(first, edge)]
        return np.split(ids, cut[:-1])

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text (UTF-8)."""
        special = [i for i, t in enumerate(texts) if not self.by_word or any(s.encode() in t for s in self.specials)]
        whole = dict(zip(special, self.tok.encode_batch_fast([texts[i].decode("utf-8", "replace") for i in special],
                                                             add_special_tokens=False)))
        parts, of = [], []                  # a long text is cut at white space
        for i, t in enumerate(texts):
            for part in ([b""] if i in whole else _cut(t)):
                parts.append(part)
                of.append(i)
        ids: list[np.ndarray] = []
        for a, z in blocks([len(t) for t in parts], BLOCK_BYTES):
            ids += self._block(parts[a:z])
        out: list[np.ndarray] = []
        for i, x in zip(of, ids):
            if i < len(out):
                out[i] = np.concatenate([out[i], x])
            else:
                out.append(x)
        for i, e in whole.items():
            out[i] = np.array(e.ids, np.uint32)
        return out


def _cut(text: bytes) -> list[bytes]:
    """Parts of about ``BLOCK_BYTES`` that begin and end at white space."""
    parts, at = [], 0
    while len(text) - at > 2 * BLOCK_BYTES:
        end = max(text.rfind(b, at, at + BLOCK_BYTES) for b in (b" ", b"\n", b"\t"))
        if end <= at:
            break
        parts.append(text[at:end])
        at = end
    return [*parts, text[at:]]


_LOADED: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of a tokenizer file."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")

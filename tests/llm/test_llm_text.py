"""Operators over texts against brute force: substring dedup, SimHash, secrets,
packing, token files."""

import hashlib
import re
import zlib

import llm_cases as C
import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from qoeflow.llm import packing, secret_scan, simhash, token_files
from qoeflow.llm.common import scratch
from qoeflow.llm.graph import connected_components
from qoeflow.llm.substring_dedup import substring_dedup
from qoeflow.llm.tokens import Encoder, default_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_substrings(data, n=13):
    docs = [(i, WORD.findall(t or "")) for i, t in data]
    least = {}
    for i, w in docs:
        for k in range(len(w) - n + 1):
            if i is not None:
                key = tuple(w[k:k + n])
                least[key] = min(least.get(key, i), i)
    out = []
    for i, w in docs:
        gone = set()
        for k in range(len(w) - n + 1):
            if i is not None and least[tuple(w[k:k + n])] < i:
                gone.update(range(k, k + n))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bucket_bytes", [2_000, 1 << 22])
def test_substring_dedup_equals_brute_force(spark, bucket_bytes):
    got = C.plain(substring_dedup(C.frame(spark), bucket_bytes=bucket_bytes), "doc_id", "n_words", "n_removed",
                  "kept_sha256")
    want = brute_substrings([r[:2] for r in C.rows()])
    assert got == want and sum(r[2] for r in got) > 500


def test_substring_dedup_periodic_and_random_binary_words(spark):
    import random
    r = random.Random(1)
    data = []
    for i in range(200):
        k = r.randint(0, 50)
        text = r.choice([" ".join(["x"] * k), " ".join(r.choice("ab") for _ in range(k)), " ".join(["p q r"] * (k // 3)),
                         " ".join(["x"] * 15 + ["y"] * k + ["x"] * 20)])
        data.append((r.randint(0, 90), text, None, None, None))
    got = C.plain(substring_dedup(C.frame(spark, data), bucket_bytes=3_000), "doc_id", "n_words", "n_removed",
                  "kept_sha256")
    assert got == brute_substrings([x[:2] for x in data])


def test_substring_dedup_long_text_parts_and_kept_text(spark, monkeypatch):
    data = [(1, " ".join(f"w{k % 977}" for k in range(3000)), None, None, None),
            (2, "start " + " ".join(f"w{k % 977}" for k in range(500, 2500)) + " end", None, None, None)]
    import qoeflow.llm.substring_dedup as S
    monkeypatch.setattr(S, "UNIT_WORDS", 100)
    texts = [t.encode() for _, t, *_ in data]
    for text in texts:      # a window's anchor does not depend on where a part ends
        whole = np.concatenate([p.anchor for _, _, p in S._units([text], 13)])
        monkeypatch.setattr(S, "UNIT_WORDS", 10**6)
        assert (whole == np.concatenate([p.anchor for _, _, p in S._units([text], 13)])).all()
        monkeypatch.setattr(S, "UNIT_WORDS", 100)
    got = {r.doc_id: r for r in substring_dedup(C.frame(spark, data), with_text=True).collect()}
    assert got[2].kept_text == "start end" and got[1].n_removed == 0


def brute_fingerprint(text, n=4):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[k:k + n]) for k in range(max(1, len(w) - n + 1))]
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def brute_components(prints, d=4):
    """prints: (id, fingerprint); smallest id of each row's component."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    a = np.array([p for _, p in prints], np.uint64)
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1:] ^ a[i]) <= d):
            root[find(i)] = find(i + 1 + int(j))
    least = {}
    for k, (i, _) in enumerate(prints):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [least.get(find(k)) for k in range(len(prints))]


def test_simhash_equals_brute_force(spark):
    data = C.rows()
    prints = [(r[0], brute_fingerprint(r[1])) for r in data]
    want = sorted(((i, format(p, "016x"), c) for (i, p), c in zip(prints, brute_components(prints))), key=repr)
    got = C.plain(simhash.simhash_components(C.frame(spark)), "doc_id", "fingerprint", "component_id")
    assert got == want


@pytest.mark.parametrize("block_rows", [40, 8192])
def test_simhash_links_of_dense_groups(spark, block_rows):
    """Near copies around a few centres, also split into pairs of sub-blocks."""
    import random
    r = random.Random(5)
    prints = set()
    for _ in range(4):
        centre = r.getrandbits(64)
        for _ in range(200):
            p = centre
            for _ in range(r.randint(0, 7)):
                p ^= 1 << r.randrange(64)
            prints.add(p)
    prints = sorted(prints)

    def s(p):
        return p - (1 << 64) if p >> 63 else p
    df = spark.createDataFrame([(s(p),) for p in prints], "fp long").select("fp", *simhash.pivot_columns())
    roots = {x.node: x.root for x in connected_components(simhash.links(df, 4, block_rows)).collect()}
    mine, want = {}, {}
    for k, (p, c) in enumerate(zip(prints, brute_components(list(enumerate(prints))))):
        mine.setdefault(roots.get(s(p), s(p)), []).append(k)
        want.setdefault(c, []).append(k)
    assert sorted(mine.values()) == sorted(want.values())


def test_simhash_pivot_filter_keeps_every_link(spark):
    r = np.random.default_rng(1)
    x = r.integers(0, 1 << 63, 300).astype(np.uint64)
    flips = np.array([sum(1 << int(b) for b in r.choice(64, 4, replace=False)) for _ in range(300)], np.uint64)
    both = np.concatenate([x, x ^ flips])
    df = spark.createDataFrame([(int(p),) for p in both.view(np.int64)], "fp long").select("fp", *simhash.pivot_columns())
    rows = {r.fp: r for r in df.collect()}
    packed = [np.array([rows[int(p)][c] for p in both.view(np.int64)], np.int64) for c in df.columns[1:]]
    t = simhash.pivot_table(*packed)
    assert (t == np.stack([np.bitwise_count(both ^ p) for p in simhash.PIVOTS])).all()
    u, v = simhash._survivors(t, both, np.arange(300), np.arange(300) + 300, 4)
    assert len(u) == 300


def test_keep_one_leaves_one_row_of_each_component(spark):
    df = C.frame(spark)
    parts = simhash.simhash_components(df).collect()
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({p.component_id for p in parts if p.component_id is not None})


def brute_spans(text):
    text = text or ""
    found = []
    for m in re.finditer(r"""((?:(?a:(?i:password|passwd|secret|token|api_?key))))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                         text):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, m.end(), "assign"))
    for k, (kind, pattern, least) in enumerate((("access", "AKIA[A-Z0-9]+", 20), ("hex", "[0-9a-f]+", 24))):
        found += [(m.start(), k + 1, m.end(), kind) for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found)]


EXTRA = ["token=token: abcdefgh", "TOKEN='abcdef' secret: short API_KEY=\"x/y+z_1.\"", "é😀 passwd=abcdef1",
         "AKIA" + "A" * 15 + " AKIA" + "A" * 16, "0" * 23 + " " + "a" * 24, "apikey==abcdefg tokentoken=1234567"]


def test_secret_spans_equal_brute_force(spark):
    data = C.rows() + [(400 + k, t, None, None, None) for k, t in enumerate(EXTRA)]
    df = C.frame(spark, data)
    ledger = secret_scan.update_ledger(spark, df, scratch(spark, "t-ledger"), new=True)
    found = secret_scan.findings(df, ledger)
    got = sorted(((r[0], r[1]) for r in found.select("id", secret_scan.span_list(found["spans"])).collect()), key=repr)
    assert got == sorted(((r[0], ",".join(brute_spans(r[1]))) for r in data), key=repr)
    assert sum(bool(x[1]) for x in got) > 10


def test_ledger_scans_only_what_it_has_not_seen(spark):
    path = scratch(spark, "t-ledger")
    one = spark.createDataFrame([(1, "token=abcdef1"), (2, "token=abcdef1"), (3, None)], "doc_id long, text string")
    n = secret_scan.update_ledger(spark, one, path, new=True).count()
    assert n == 2 * 3                                       # two blobs, three rules
    two = one.union(spark.createDataFrame([(4, "secret: abcdef2")], one.schema))
    assert secret_scan.update_ledger(spark, two, path).count() == n + 3
    assert secret_scan.update_ledger(spark, two, path).count() == n + 3
    newer = (*secret_scan.RULES[:2], secret_scan.Rule("hex", "2", "[0-9a-f]{6,}"))
    ledger = secret_scan.update_ledger(spark, two, path, rules=newer)
    assert ledger.count() == n + 3 + 3                       # one rule over three blobs
    found = {r.id: [s.kind for s in r.spans] for r in secret_scan.findings(two, ledger, newer).collect()}
    assert found == {1: ["assign", "hex"], 2: ["assign", "hex"], 3: [], 4: ["assign", "hex"]}


def test_mask_hides_overlapping_spans_and_keeps_rows(spark):
    df = C.frame(spark, C.rows() + [(401, "é token=" + "a" * 30 + "! tail", None, None, None)])
    ledger = secret_scan.update_ledger(spark, df, scratch(spark, "t-ledger"), new=True)
    out = secret_scan.mask(df, ledger)
    assert out.columns == df.columns and out.count() == df.count()
    got = {r.doc_id: r.text for r in out.collect()}
    assert got[401] == "é [secret]! tail" and got[200] is None
    assert all(not brute_spans(t) for t in got.values())


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def ids_of(tok, text):
    return tok.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_word_ids_equal_the_library(tok):
    texts = [r[1] or "" for r in C.rows()] + ["a\x0bb\x0cc", "x<|endoftext|>y <|startoftext|> z", "ÉCOLE Σας don't it's",
                                             "é́ ́x", " em nb", "İ ǅ ﬁ", "<|endoftext|>"]
    enc = Encoder(default_path())
    assert enc.by_word
    assert [x.tolist() for x in enc.encode([t.encode() for t in texts])] == [ids_of(tok, t) for t in texts]
    import qoeflow.llm.tokens as T
    old, T.BLOCK_BYTES = T.BLOCK_BYTES, 200        # parts and blocks of few words
    try:
        assert [x.tolist() for x in enc.encode([t.encode() for t in texts])] == [ids_of(tok, t) for t in texts]
        enc.words = T._Words(1 << 10)                                               # starts anew again and again
        enc.used = 0
        assert [x.tolist() for x in enc.encode([t.encode() for t in texts])] == [ids_of(tok, t) for t in texts]
    finally:
        T.BLOCK_BYTES = old
    enc.by_word = False
    assert [x.tolist() for x in enc.encode([t.encode() for t in texts])] == [ids_of(tok, t) for t in texts]


def test_packing_places_every_piece_once(spark, tok):
    data = C.rows()
    got = packing.pack(C.frame(spark), max_len=512, with_ids=True).collect()
    want = []
    for i, text, *_ in data:
        ids = ids_of(tok, text) + [0]
        want += [(i, k, a, len(ids[a:a + 512]), crc(ids[a:a + 512])) for k, a in enumerate(range(0, len(ids), 512))]
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length, r.ids))
    for parts in by_sequence.values():
        at = 0
        for offset, length, ids in sorted(parts):
            assert offset == at and len(ids) == 4 * length
            at += length
        assert at <= 512
    assert len(by_sequence) <= -(-sum(w[3] for w in want) // 512) + 1
    packed = packing.pack(C.frame(spark), max_len=512, with_ids=True)
    assert packing.sequences(packed).filter("length(ids) <> 4 * n_tokens").count() == 0


def test_plan_is_best_fit_and_complete():
    import random
    r = random.Random(2)
    for _ in range(200):
        cap = r.choice([7, 20, 64])
        histogram = {n: r.randint(1, 40) for n in r.sample(range(1, cap + 1), r.randint(1, 6))}
        rows = packing.plan(histogram, cap)
        fill, count = {}, {}
        for length, first, n, seq, each, at in rows:
            for i in range(n):
                s, o = seq + i // each, at + i % each * length
                fill.setdefault(s, []).append((o, length))
                count.setdefault(length, []).append(first + i)
        assert {k: sorted(v) for k, v in count.items()} == {k: list(range(v)) for k, v in histogram.items()}
        for parts in fill.values():
            at = 0
            for o, length in sorted(parts):
                assert o == at
                at += length
            assert at <= cap
        # one document at a time, longest first, tightest sequence that has room
        room = []
        for length in sorted((x for k, v in histogram.items() for x in [k] * v), reverse=True):
            fits = [k for k, x in enumerate(room) if x >= length]
            if fits:
                k = min(fits, key=lambda z: room[z])
                room[k] -= length
            else:
                room.append(cap - length)
        assert len(fill) == len(room)


def test_variable_length_coding_round_trip():
    r = np.random.default_rng(3)
    for n in (0, 1, 3, 4, 5, 1000):
        v = (r.integers(0, 1 << 32, n, dtype=np.uint64) >> r.integers(0, 32, n).astype(np.uint64)).astype(np.uint32)
        assert (token_files.decode_values(*token_files.encode_values(v), n) == v).all()


def test_token_files_round_trip(spark, tok):
    data = C.rows()
    df, folder = C.frame(spark), scratch(spark, "t-tokens")
    manifest = token_files.write_tokens(df, folder, shard_tokens=5_000)
    got = token_files.read_tokens(spark, manifest, folder, with_ids=True).collect()
    want = sorted(((i, len(x), crc(x)) for i, x in ((r[0], ids_of(tok, r[1]) + [1]) for r in data)), key=repr)
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=repr) == want
    at, order = 0, sorted(got, key=lambda r: r.start)
    for r in order:
        assert r.start == at and zlib.crc32(r.ids) == r.ids_crc32
        at += r.n_tokens
    known = [r.doc_id for r in order if r.doc_id is not None]
    assert known == sorted(known) and all(r.doc_id is None for r in order[:len(order) - len(known)])
    assert manifest.count() > 2


def test_empty_tables(spark):
    none = C.frame(spark, [])
    assert substring_dedup(none).count() == 0
    assert simhash.simhash_components(none).count() == 0
    assert simhash.keep_one(none).count() == 0
    ledger = secret_scan.update_ledger(spark, none, scratch(spark, "t-ledger"), new=True)
    assert ledger.count() == 0 and secret_scan.findings(none, ledger).count() == 0
    assert packing.pack(none).count() == 0
    assert token_files.token_round_trip(none).count() == 0

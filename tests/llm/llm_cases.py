"""Rows that every operator over documents has to get through: null columns,
empty and very long texts, ties, repeated rows, extra columns with names the
operators use themselves."""

import random

DOC = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside; here they belong to the caller.
CLASH = ["fp", "blob", "row_key", "length", "n", "bucket", "words", "a", "lo", "ids", "task", "score", "rank", "shard",
         "meta", "labelled", "kind", "spans", "salt", "start", "row", "__row", "old", "__old", "__blob", "__salt",
         "__spans", "blob_key", "spans_found", "blob_salt", "__meta", "hash", "items", "item"]


def rows(seed: int = 3, n: int = 120):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6))) for _ in range(60)]
    shared = " ".join(r.choice(vocab) for _ in range(40))
    out = []
    for i in range(n):
        words = [r.choice(vocab) for _ in range(r.randint(0, 70))]
        if i % 5 == 0:
            words[3:3] = shared.split()
        if i % 11 == 0:
            words += ["run"] * 30
        text = r.choice([" ", "  ", "\n", "\t"]).join(words)
        if i % 13 == 0:
            text += f' password = "abc{i}defghi" token=x1 AKIA{"ABCDEFGH" * 2}{i % 10} {"0123456789abcdef" * 2}'
        if i % 17 == 0:
            text = text.upper() + " É ß Σ 😀 日本 " + text
        out.append((i, text, r.choice(["en", "de", None]), r.choice(["s1", None]), len(text)))
    out += [(200, None, None, None, None), (201, "", "en", "s1", 0), (202, " \n\t ", "en", "s1", 4),
            (203, "word", "en", "s1", 4), (None, out[5][1], "en", "s1", 1), (None, None, None, None, None),
            out[5], out[5], (7, "another text under a used id " + shared, "de", "s1", 5),
            (300, " ".join(r.choice(vocab) for _ in range(30_000)), "en", "s1", 1),
            (301, "x" * 100_000, "en", "s1", 100_000)]
    return out


def frame(spark, data=None, clash: bool = True):
    df = spark.createDataFrame(rows() if data is None else data, DOC)
    if clash:
        for c in CLASH:
            df = df.withColumn(c, df.text)
    return df.repartition(3)


def plain(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)

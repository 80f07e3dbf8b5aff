"""The merge table: newest row per key, bytes that follow the batch, replays."""

import os
import random

import pytest
from pyspark.sql import functions as F

from qoeflow.session import file_system, scratch_path
from qoeflow.streaming.tables import MergeTable

SCHEMA = "k string, v bigint, seq bigint"


def plain(df):
    return sorted(map(tuple, df.collect()), key=repr)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).coalesce(2)


def written(path):
    """Bytes of data files now below ``path``, by file."""
    out = {}
    for d, _, names in os.walk(path):
        out.update({f"{d}/{n}": os.path.getsize(f"{d}/{n}") for n in names if n.startswith("part-")})
    return out


def test_newest_row_of_each_key_over_many_batches(spark):
    r = random.Random(3)
    t = MergeTable(spark, scratch_path(spark, "t-merge"), SCHEMA, ["k"], order=["seq"], buckets=4, fan=3)
    want = {}
    for batch in range(14):
        rows = [(f"k{r.randint(0, 30)}", r.randint(0, 999), r.randint(0, 10**6)) for _ in range(r.randint(0, 12))]
        t.merge(frame(spark, rows), batch)
        for k, v, seq in rows:
            if k not in want or (seq, batch) >= (want[k][1], want[k][2]):
                want[k] = (v, seq, batch)
    assert plain(t.read()) == sorted(((k, v, s) for k, (v, s, _) in want.items()), key=repr)
    levels = os.listdir(t.path)
    assert "base" in levels or "level1" in levels                 # something was merged
    again = MergeTable(spark, os.path.dirname(t.path), SCHEMA, ["k"], order=["seq"], buckets=99)
    assert again.buckets == 4 and plain(again.read()) == plain(t.read())


def test_bytes_written_follow_the_batch_not_the_table(spark):
    t = MergeTable(spark, scratch_path(spark, "t-bytes"), SCHEMA, ["k"], buckets=4, fan=4)
    t.merge(spark.range(60_000).selectExpr("concat('key', id) as k", "id * 7919 % 65521 as v", "id as seq"), 0)
    whole = sum(written(t.path).values())
    total, seen = 0, set(written(t.path))
    for batch in range(1, 25):
        t.merge(frame(spark, [(f"key{batch * 37 % 60_000}", batch, batch), ("hot", batch, batch)]), batch)
        now = written(t.path)
        total += sum(size for f, size in now.items() if f not in seen)
        seen |= set(now)
    assert whole > 200_000
    # 24 batches of two rows each; rewriting the table would have taken 24 times ``whole``
    assert total < 2.2 * whole, (total, whole)
    got = dict((k, v) for k, v, _ in plain(t.read()))
    assert got["hot"] == 24 and got["key37"] == 1 and len(got) == 60_001
    assert len([f for f in os.listdir(f"{t.path}/level0") if f.startswith("b=")]) <= 40


def test_a_batch_that_runs_again_and_a_merge_that_died(spark):
    path = scratch_path(spark, "t-replay")
    t = MergeTable(spark, path, SCHEMA, ["k"], buckets=2, fan=2)
    for batch in range(5):
        before = plain(t.read(before=batch))
        rows = frame(spark, [("a", batch, 0), (f"b{batch}", batch, 0)])
        t.merge(rows, batch)
        assert plain(t.read(before=batch)) == before              # a batch never sees its own rows
        after = plain(t.read())
        t.merge(rows, batch)
        assert plain(t.read()) == after
    # a merge that died after writing some files: no marker, so it counts as nothing
    good = plain(t.read())
    for level in ("base", "level1"):
        dead = f"{t.path}/{level}/b=4/bucket=0"
        frame(spark, [("a", -1, 0), ("ghost", 1, 1)]).withColumn("_batch", F.lit(99)) \
            .write.mode("overwrite").parquet(dead)
        fs, marker = file_system(spark, f"{t.path}/{level}/b=4/_SUCCESS")
        fs.delete(marker, False)
    assert plain(t.read()) == good
    t.merge(frame(spark, [("c", 1, 0)]), 5)                         # the next batch merges anew over it
    assert plain(t.read()) == sorted([*good, ("c", 1, 0)], key=repr)


def test_only_the_buckets_of_some_keys_are_read(spark):
    t = MergeTable(spark, scratch_path(spark, "t-some"), SCHEMA, ["k", "v"], by=["k"], buckets=8)
    t.merge(frame(spark, [(f"k{i % 40}", i, 0) for i in range(400)]), 0)
    some = spark.createDataFrame([("k1",), ("k2",), (None,)], "k string")
    got = t.read(of=some)
    assert got.where("k in ('k1', 'k2')").count() == 20 and got.count() < 400
    assert len(got.inputFiles()) <= 3


def test_a_file_that_cannot_be_read_fails(spark):
    t = MergeTable(spark, scratch_path(spark, "t-broken"), SCHEMA, ["k"], buckets=1)
    t.merge(frame(spark, [("a", 1, 1)]), 0)
    for f in written(t.path):
        with open(f, "wb") as out:
            out.write(b"broken")
    with pytest.raises(Exception):
        t.read().collect()

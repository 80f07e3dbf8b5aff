"""File sources and sinks that the registered queries do not exercise."""

import os
import tempfile

from pyspark.sql import functions as F

from qoeflow.operators import records as R
from qoeflow.sources import sinks
from qoeflow.sources.result_log import read_result_log


def _tmp():
    return tempfile.mkdtemp(prefix="qoeflow-io-")


def test_result_log_file_order(spark):
    d = _tmp()
    with open(os.path.join(d, "a.csv"), "w") as f:
        for i in range(250):
            f.write(f"{i % 2},{'online' if i % 3 else 'local'},{i}.5\n")
        f.write("broken line\n")
    log = read_result_log(spark, d)
    rows = log.orderBy("line_no").collect()
    assert len(rows) == 250                           # the broken line is dropped
    assert [r.cost for r in rows[:3]] == [0.5, 1.5, 2.5]
    assert [r.line_no for r in rows[:3]] == [1, 2, 3]


def test_label_config_file(spark):
    d = _tmp()
    p = os.path.join(d, "gm.conf")
    with open(p, "w") as f:
        f.write("Time\tAsn\tdecision\tsocre\ndecision\tsocre\n")
    labels, keep = R.read_label_config(spark, p)
    assert R.label_indexes(labels, keep) == [2, 3]


def test_decision_files_and_series(spark):
    d = _tmp()
    dec = spark.createDataFrame([("g1", "a", ["b", "c"], 0.9), ("g2", "x", [], 0.9)],
                                "group_id string, best string, rest array<string>, epsilon double")
    lines = sinks.export_epsilon(dec)
    sinks.write_decision_files(lines, f"{d}/dec")
    g1 = [r.value for r in spark.read.text(f"{d}/dec/group_id=g1").collect()]
    assert g1 == ["0.9", "a", "b", "c"]
    series = spark.createDataFrame([(2, 1.5), (0, 0.5), (1, None)], "second long, avg_cost double")
    sinks.write_series(series, "second", "avg_cost", f"{d}/series")
    vals = [r.value for r in spark.read.text(f"{d}/series").collect()]
    assert sorted(v for v in vals if v) == ["0.5", "1.5"]


def test_merge_latest_versions(spark):
    d = _tmp()
    b0 = spark.createDataFrame([("g", "a:b:", 1), ("h", "x:", 1)], "group_id string, slots string, tick long")
    b1 = spark.createDataFrame([("g", "c:", 2)], "group_id string, slots string, tick long")
    sinks.merge_latest(b0, d, 0)
    out = sinks.merge_latest(b1, d, 1)
    got = {r.group_id: (r.slots, r.tick) for r in out.collect()}
    assert got == {"g": ("c:", 2), "h": ("x:", 1)}
    out = sinks.merge_latest(b1, d, 1)                # replaying a batch is idempotent
    assert {r.group_id: (r.slots, r.tick) for r in out.collect()} == got
    # of equal ticks the later batch wins; within a batch the largest payload
    tie = spark.createDataFrame([("g", "p:", 2), ("g", "d:", 2), ("h", "w:", 0)], b0.schema)
    got = {r.group_id: (r.slots, r.tick) for r in sinks.merge_latest(tie, d, 2).collect()}
    assert got == {"g": ("p:", 2), "h": ("x:", 1)}


def test_result_log_order_survives_splits(spark):
    d = _tmp()
    with open(os.path.join(d, "big.csv"), "w") as f:
        for i in range(20000):
            f.write(f"{i % 2},online,{i}.25\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")     # force many splits
    try:
        log = read_result_log(spark, d)
        rows = log.orderBy("line_no").select("cost").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r.cost for r in rows] == [i + 0.25 for i in range(20000)]


def test_trace_files_sort_and_parse(spark):
    from qoeflow.sources.lines import read_lines
    from qoeflow.sources.traces import read_trace_files, sort_traces
    d = _tmp()
    with open(os.path.join(d, "t.txt"), "w") as f:
        f.write("2000\tx\tDecisionMap\ta,1\tLoadMap\ta,0.1;2\n")
        f.write("1000\ty\tDecisionMap\ta,2\tLoadMap\ta,0.1;2\n")
        f.write("999\tz\tDecisionMap\ta,3\tLoadMap\ta,0.1;2\n")
    t = {r.line_no: r.decision_map["a"] for r in read_trace_files(spark, d).collect()}
    assert t == {1: 1.0, 2: 2.0, 3: 3.0}
    pos = {r.line_no: r.sort_pos for r in sort_traces(read_lines(spark, d)).collect()}
    assert pos == {2: 1, 1: 2, 3: 3}          # text order: '1000' < '2000' < '999'

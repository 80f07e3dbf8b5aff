"""Skew experiment: one group holding a third of all rows.

usage: python tools/skew_experiment.py <scratch_dir> [copies] [query ...]

Builds ``<scratch_dir>/skew/events.parquet`` from the sf0.1 ``events``
table (``copies`` shifted copies, default 30; a third of the rows moved to
user 0), runs the given registered queries (default: discounted_state,
load_share, policy_replay, stream_state, sliding_stream) on local[8] with the event log in
``<scratch_dir>/eventlog-*``, and prints, per heavy stage, the largest
task's share of the stage's records and its time against the median.
Scratch data only -- nothing here is a registered query.
"""

from __future__ import annotations

import glob
import io
import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def build(spark, out: str, copies: int) -> None:
    from pyspark.sql import functions as F
    ev = spark.read.parquet("/root/testdata/sf0.1/events.parquet")
    hot = F.pmod(F.xxhash64("event_id", "k"), F.lit(3)) == 0
    # every event once per copy k (a narrow explode, no join), spread over 32 files
    x = ev.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).repartition(32)
    x.select((F.col("event_id") * copies + F.col("k")).alias("event_id"),
             (F.col("ts") + F.make_interval(days=(F.col("k") * 30).cast("int"))).alias("ts"),
             F.when(hot, F.lit(0)).otherwise(F.col("user_id") + 10000 * F.col("k")).cast("bigint")
             .alias("user_id"), "event_type", "value", "props") \
        .write.mode("overwrite").parquet(f"{out}/events.parquet")


def stage_report(elog: str) -> None:
    import zstandard
    stages = {}
    for f in glob.glob(elog + "/**/events_*", recursive=True):
        raw = open(f, "rb").read()
        if f.endswith(".zstd"):
            raw = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw)).read()
        for line in raw.decode().splitlines():
            e = json.loads(line)
            if e.get("Event") != "SparkListenerTaskEnd":
                continue
            ti, m = e["Task Info"], e.get("Task Metrics") or {}
            recs = ((m.get("Input Metrics") or {}).get("Records Read", 0)
                    + (m.get("Shuffle Read Metrics") or {}).get("Total Records Read", 0))
            stages.setdefault(e["Stage ID"], []).append((ti["Finish Time"] - ti["Launch Time"], recs))
    print("stage  tasks  max_task_ms  median_ms  max_task_share_of_records")
    for sid, ts in sorted(stages.items()):
        total = sum(r for _, r in ts)
        if len(ts) < 2 or total < 100000:
            continue
        ds = sorted(d for d, _ in ts)
        print(f"{sid:5d}  {len(ts):5d}  {ds[-1]:11d}  {ds[len(ds) // 2]:9d}  "
              f"{max(r for _, r in ts) / total:.3f}")


def main() -> None:
    scratch = sys.argv[1]
    copies = int(sys.argv[2]) if len(sys.argv) > 2 else 30
    names = sys.argv[3:] or ["discounted_state", "load_share", "policy_replay", "stream_state", "sliding_stream"]
    from qoeflow.plans.catalog import REGISTRY
    from qoeflow.session import build_session
    elog = os.path.join(scratch, f"eventlog-{int(time.time())}")
    os.makedirs(elog)
    spark = build_session("local[8]", extra={"spark.eventLog.enabled": "true", "spark.eventLog.dir": elog,
                                             "spark.driver.memory": "8g"})
    data = os.path.join(scratch, "skew")
    if not os.path.exists(f"{data}/events.parquet"):
        build(spark, data, copies)
    for n in names:
        t0 = time.time()
        REGISTRY[n](spark, data).write.format("noop").mode("overwrite").save()
        print(f"{n}: {time.time() - t0:.1f} s")
    spark.stop()
    stage_report(elog)


if __name__ == "__main__":
    main()

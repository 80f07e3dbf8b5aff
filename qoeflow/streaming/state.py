"""The decision-state stream.

Per group, the state store keeps the decision catalogue's discounted
(score_sum, n), the tick each decision was last active and the group's
last active tick.  Each micro-batch is first summed per (group, decision,
tick) where it is read (``jobs.combine``); a group's sums are then folded
tick by tick (bounded by ticks x decisions of a micro-batch; the state
itself by the decision catalogue):

  tick t > last:  decay everything by gamma^(t - last - 1) (idle ticks),
                  then active decisions: new + gamma * old;
  tick t == last: a tick split across batches: decisions already active
                  at t add, the others fold as above;
  tick t < last:  late; as in a live loop, where a record counts in the batch
                  it arrives in, it is folded into the group's current tick
                  (and counted in ``late``).

Idle groups are not touched (T8 lazy decay): ``decay_to`` multiplies by
gamma^(T - last) when the state is read at tick T, which gives exactly
the batch closed form of ``stats.discounted_state``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

OUT_SCHEMA = ("group_id string, decision string, score_sum double, n double, "
              "last_tick bigint, group_tick bigint, late bigint")
STATE_SCHEMA = ("g_last bigint, decisions array<string>, sums array<double>, "
                "ns array<double>, d_last array<bigint>, late bigint")


def tick_sums(pdfs: Iterator[pd.DataFrame], g_last: int | None) -> tuple[dict[tuple[int, str], list[float]], int]:
    """A group's partial sums of a micro-batch by (tick, decision), late ticks
    moved to ``g_last``, and the number of late updates."""
    acc: dict[tuple[int, str], list[float]] = {}
    late = 0
    for p in pdfs:
        for t, d, s, c in zip(p["tick"].tolist(), p["decision"].tolist(), p["s"].tolist(), p["c"].tolist()):
            if g_last is not None and t < g_last:
                late, t = late + int(c), g_last
            a = acc.setdefault((t, d), [0.0, 0.0])
            a[0] += s
            a[1] += c
    return acc, late


def _fold(gamma: float):
    def fn(key, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.exists:
            g_last, decs, sums, ns, dl, late = state.get
            st = {d: [s, n, t] for d, s, n, t in zip(decs, sums, ns, dl)}
        else:
            g_last, st, late = None, {}, 0
        acc, more = tick_sums(pdfs, g_last)
        late += more
        for (t, d), (s, c) in sorted(acc.items()):
            if g_last is not None and t > g_last:
                f = gamma ** (t - g_last - 1)
                if f != 1.0:
                    for v in st.values():
                        v[0] *= f
                        v[1] *= f
                g_last = t
            elif g_last is None:
                g_last = t
            old = st.get(d)
            if old is None:
                st[d] = [s, c, t]
            elif old[2] == t:
                old[0] += s
                old[1] += c
            else:
                st[d] = [s + gamma * old[0], c + gamma * old[1], t]
        decs = sorted(st)
        sums = [st[d][0] for d in decs]
        ns = [st[d][1] for d in decs]
        dl = [st[d][2] for d in decs]
        state.update((g_last, decs, sums, ns, dl, late))
        k = len(decs)
        yield pd.DataFrame({"group_id": [key[0]] * k, "decision": decs, "score_sum": sums, "n": ns,
                            "last_tick": dl, "group_tick": [g_last] * k, "late": [late] * k})
    return fn


def decision_stream(updates: DataFrame, gamma: float) -> DataFrame:
    """Updates stream (group_id, decision, cost, tick) -> per batch, the
    new state of every (group, decision) whose group got data."""
    from qoeflow.streaming.jobs import combine
    return (combine(updates).groupBy("group_id")
            .applyInPandasWithState(_fold(gamma), OUT_SCHEMA, STATE_SCHEMA, "update",
                                    GroupStateTimeout.NoTimeout))


def decay_to(state: DataFrame, gamma: float, at_tick: Column) -> DataFrame:
    """Read the lazily decayed state at tick T (idle ticks since the
    group's last active tick)."""
    f = F.pow(F.lit(gamma), at_tick - F.col("group_tick"))
    return state.withColumn("score_sum", F.col("score_sum") * f).withColumn("n", F.col("n") * f)


def latest_state(snapshots: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Newest emitted row per (group, decision) from the appended snapshots."""
    cols = [c for c in snapshots.columns if c not in ("group_id", "decision", batch)]
    b = F.max_by(F.struct(*cols), F.col(batch))
    return (snapshots.groupBy("group_id", "decision").agg(b.alias("_b"))
            .select("group_id", "decision", *[F.col(f"_b.{c}").alias(c) for c in cols]))

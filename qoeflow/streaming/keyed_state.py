"""T1 on ``transformWithStateInPandas``: per-decision map state, lazy decay.

State per group: a value (last active tick, cumulative idle ticks, late
rows) and a map decision -> (score_sum, n, last tick, idle count when
written).  Between a decision's last write and any later tick it only
decays on the group's idle ticks (an active group leaves inactive
decisions unchanged), so its true value is
``stored * gamma^(idle_now - idle_at_write)``: a micro-batch touches only
the decisions it carries -- work per batch is proportional to the
updates, not to the decision catalogue -- and emits only those.
``read_state`` applies the remaining decay at tick T, which equals the
batch closed form.  Needs the RocksDB state store provider.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from qoeflow.streaming.jobs import combine
from qoeflow.streaming.pages import PageTicks, joined, pack, page_of, parcels, unpack
from qoeflow.streaming.state import tick_sums

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT_SCHEMA = ("group_id string, decision string, score_sum double, n double, last_tick bigint, "
              "idle_at bigint, group_tick bigint, group_idle bigint, late bigint")


class LazyDecayProcessor(StatefulProcessor):
    def __init__(self, gamma: float):
        self.gamma = gamma

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.grp = handle.getValueState("grp", "g_last bigint, idle bigint, late bigint")
        self.dec = handle.getMapState("dec", "decision string",
                                      "s double, n double, d_last bigint, idle_at bigint")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        """A group's rows of ``initial_state``: its state as of a tick counts as
        the state after that tick, with no idle ticks yet."""
        at = None
        for d, s, n, last, at in zip(initialState["decision"], initialState["score_sum"], initialState["n"],
                                     initialState["last_tick"], initialState["at_tick"]):
            self.dec.updateValue((d,), (float(s), float(n), int(last), 0))
        if at is not None:
            self.grp.update((int(at), 0, 0))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        g = self.gamma
        g_last, idle, late = self.grp.get() if self.grp.exists() else (None, 0, 0)
        acc, more = tick_sums(rows, g_last)
        late += more
        # one state read and one write per touched decision
        cache: dict[str, list] = {}
        for d in {d for _, d in acc}:
            v = self.dec.getValue((d,))          # None when absent
            cache[d] = list(v) if v is not None else None
        for (t, d), (s, c) in sorted(acc.items()):
            if g_last is None:
                g_last = t
            elif t > g_last:
                idle += t - g_last - 1
                g_last = t
            old = cache[d]
            if old is None:
                ns, nn = s, c
            else:
                f = g ** (idle - old[3])
                if old[2] == t:
                    ns, nn = old[0] * f + s, old[1] * f + c
                else:
                    ns, nn = s + g * old[0] * f, c + g * old[1] * f
            cache[d] = [ns, nn, t, idle]
        out = [(d, *v) for d, v in cache.items() if v is not None]
        for d, ns, nn, t, i in out:
            self.dec.updateValue((d,), (ns, nn, t, i))
        self.grp.update((g_last, idle, late))
        if out:
            d, s_, n_, t_, i_ = zip(*out)
            yield pd.DataFrame({"group_id": key[0], "decision": d, "score_sum": s_, "n": n_,
                                "last_tick": t_, "idle_at": i_, "group_tick": g_last,
                                "group_idle": idle, "late": late})

    def close(self) -> None:
        pass


class TimedDecayProcessor(StatefulProcessor):
    """T8 with event-time timers: after its input, a group is due at the start
    of the tick after its last active tick.  When the watermark passes it the
    group is idle: every decision is emitted decayed to the watermark's tick,
    and the group is due again at the next tick -- so idle groups keep
    publishing fresh (decayed) state as event time advances.

    The fold is that of ``LazyDecayProcessor``, on the groups of a page at once
    (``pages``).  State of a page: a row per group (``armed``: the tick it is due
    after), a row per decision, and its one timer, at the first time a group is due."""

    def __init__(self, gamma: float, tick_s: int):
        self.gamma, self.tick_ms = gamma, tick_s * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.page = handle.getValueState("page", "groups binary, decisions binary, timer bigint")

    def _load(self) -> tuple[dict, dict, int | None]:
        held = self.page.get()
        if held is not None:
            return unpack(held[0]), unpack(held[1]), held[2]
        names, whole, real = np.empty(0, object), np.empty(0, np.int64), np.empty(0)
        return (dict(group_id=names, g_last=whole, idle=whole, late=whole, armed=whole),
                dict(g=whole, decision=names, s=real, n=real, d_last=whole, idle_at=whole), None)

    def _store(self, groups: dict, decs: dict, timer: int | None) -> None:
        at = (int(groups["armed"].min()) + 1) * self.tick_ms
        if at != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(at)
        self.page.update((pack(groups), pack(decs), at))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        groups, decs, timer = self._load()
        x = PageTicks(groups["group_id"], groups["g_last"], pd.concat(list(rows)))
        none = np.zeros(len(x.groups) - len(groups["group_id"]), np.int64)
        idle, late, armed = (np.concatenate([groups[c], none]) for c in ("idle", "late", "armed"))
        late, last = late + x.late, x.last
        # idle ticks of the group up to each of its ticks
        passed = np.cumsum(x.step_idle)
        n_steps = np.diff([*x.group_at, len(passed)])
        upto = passed + np.repeat(idle[x.touched] - passed[x.group_at] + x.step_idle[x.group_at], n_steps)
        idle[x.touched] = upto[x.group_at + n_steps - 1]
        last[x.touched] = armed[x.touched] = x.now
        groups = dict(group_id=x.groups, g_last=last, idle=idle, late=late, armed=armed)
        # a row is worth gamma^(active ticks of its decision + idle ticks of its group since)
        first, at_tick = x.pair_at, upto[x.step]
        end = np.append(first[1:], len(x.pair)) - 1
        place = np.arange(len(x.pair)) + at_tick
        worth = self.gamma ** (place[end][x.pair] - place).astype(np.float64)
        s, n = np.add.reduceat(x.s * worth, first), np.add.reduceat(x.c * worth, first)
        own = x.pairs_in(decs["g"], decs["decision"])
        met = np.flatnonzero(own >= 0)
        p = own[met]
        same = x.tick[first[p]] == decs["d_last"][met]      # the tick goes on
        since = place[end[p]] - place[first[p]] + at_tick[first[p]] - decs["idle_at"][met] + ~same
        worth = self.gamma ** since.astype(np.float64)
        s[p] += decs["s"][met] * worth
        n[p] += decs["n"][met] * worth
        new = dict(g=x.pair_g, decision=x.pair_d, s=s, n=n, d_last=x.tick[end], idle_at=at_tick[end])
        decs = joined({c: v[own < 0] for c, v in decs.items()}, new)
        self._store(groups, decs, timer)
        yield self._rows(groups, new)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        groups, decs, timer = self._load()
        passed = max(timerValues.getCurrentWatermarkInMs() - 1, expiredTimerInfo.getExpiryTimeInMs())
        T = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()) // self.tick_ms
        due = (groups["armed"] + 1) * self.tick_ms <= passed
        # every tick after g_last up to T was idle: values as of T
        v_idle = groups["idle"] + (T - groups["g_last"])
        asked = due[decs["g"]]
        rows = {c: v[asked] for c, v in decs.items()}
        f = self.gamma ** (v_idle[rows["g"]] - rows["idle_at"]).astype(np.float64)
        rows |= dict(s=rows["s"] * f, n=rows["n"] * f, idle_at=v_idle[rows["g"]])
        groups["armed"] = np.where(due, T, groups["armed"])
        self._store(groups, decs, timer)
        if len(rows["g"]):
            yield self._rows({**groups, "g_last": np.where(due, T, groups["g_last"]), "idle": v_idle}, rows)

    @staticmethod
    def _rows(groups: dict, decs: dict) -> pd.DataFrame:
        g = decs["g"]
        return pd.DataFrame({"group_id": groups["group_id"][g], "decision": decs["decision"], "score_sum": decs["s"],
                             "n": decs["n"], "last_tick": decs["d_last"], "idle_at": decs["idle_at"],
                             "group_tick": groups["g_last"][g], "group_idle": groups["idle"][g], "late": groups["late"][g]})

    def close(self) -> None:
        pass


def decision_stream_timed(updates: DataFrame, gamma: float, tick_s: int, lateness_ticks: int = 4) -> DataFrame:
    """T1 + T8: like ``decision_stream_lazy`` plus idle emission driven by
    timers on an event-time watermark.  The watermark stays ``lateness_ticks``
    (at least one) behind the newest tick: a tick may spread over several
    micro-batches, and updates up to that late still count (in their group's
    current tick); Spark drops what is later still, so choose the lateness
    above the longest delay of the source."""
    if lateness_ticks < 1:
        raise ValueError("a tick may span several micro-batches: lateness_ticks must be at least 1")
    src = (combine(updates).withColumn("ts_tick", F.timestamp_seconds(F.col("tick") * tick_s))
           .withWatermark("ts_tick", f"{lateness_ticks * tick_s} seconds"))
    return src.withColumn("page", page_of("group_id")).groupBy("page").transformWithStateInPandas(
        TimedDecayProcessor(gamma, tick_s), OUT_SCHEMA, "Update", "EventTime")


def decision_stream_lazy(updates: DataFrame, gamma: float, initial: DataFrame | None = None) -> DataFrame:
    """Updates stream (group_id, decision, cost, tick) -> the decisions
    each micro-batch wrote, with the group's tick and idle count.  ``initial``
    (see ``initial_state``): the state to start from, of a stream that begins
    behind its tick."""
    start = None if initial is None else initial.groupBy("group_id")
    return (combine(updates).groupBy("group_id")
            .transformWithStateInPandas(LazyDecayProcessor(gamma), OUT_SCHEMA, "Update", "None", initialState=start))


class StatePolicyProcessor(StatefulProcessor):
    """A user's ``StatePolicy`` in the state store: for the groups of a page
    (``pages``) the tick of their last data, and the policy's fields by decision.
    Input: parcels of (group_id, decision, tick, s, c)."""

    def __init__(self, policy):
        self.policy = policy

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.page = handle.getValueState("page", "groups binary, decisions binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        names, whole, fields = np.empty(0, object), np.empty(0, np.int64), self.policy.names
        held = self.page.get()
        groups, decs = (unpack(x) for x in held) if held is not None else (
            dict(group_id=names, g_last=whole),
            dict(g=whole, decision=names, **{f"_{c}": np.empty(0) for c in fields}))
        values = np.stack([decs.pop(f"_{c}") for c in fields])
        new = pd.concat([pd.DataFrame(unpack(v)) for p in rows for v in p["parcel"]], ignore_index=True)
        x = PageTicks(groups["group_id"], groups["g_last"], new)
        if x.split:
            raise ValueError("a tick was split: feed whole ticks (decision_stream_policy closes them)")
        # the rows of the groups with new ticks: decisions known before, then those that appear
        own = x.pairs_in(decs["g"], decs["decision"])
        n_steps = np.zeros(len(x.groups), np.int64)
        n_steps[x.touched] = np.diff([*x.group_at, len(x.step_g)])
        mine = np.flatnonzero(n_steps[decs["g"]] > 0)
        fresh = np.ones(len(x.pair_g), bool)
        fresh[own[own >= 0]] = False
        g = np.concatenate([decs["g"][mine], x.pair_g[fresh]])
        d = np.concatenate([decs["decision"][mine], x.pair_d[fresh]])
        row_of = np.full(len(x.pair_g), -1)
        row_of[own[mine][own[mine] >= 0]] = np.flatnonzero(own[mine] >= 0)
        row_of[fresh] = len(mine) + np.arange(fresh.sum())
        rank = x.step_rank[x.step]
        born = np.concatenate([np.full(len(mine), -1), rank[x.pair_at[fresh]]])
        old = np.concatenate([values[:, mine], np.full((len(fields), int(fresh.sum())), np.nan)], axis=1)
        # groups with more ticks first
        place = np.empty(len(x.groups), np.int64)
        place[np.argsort(-n_steps, kind="stable")] = np.arange(len(x.groups))
        order = np.argsort(place[g], kind="stable")
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        g, d = g[order], d[order]
        by_rank = np.lexsort((place[x.step_g], x.step_rank))
        cut = np.flatnonzero(np.diff(x.step_rank[by_rank])) + 1
        idle = np.split(x.step_idle[by_rank], cut)
        entry = np.argsort(rank, kind="stable")
        ends = np.searchsorted(rank[entry], np.arange(1, len(idle)))
        active = [(back[row_of[x.pair[e]]], x.s[e], x.c[e]) for e in np.split(entry, ends)]
        state = self.policy.fold_groups(dict(zip(fields, old[:, order])), born[order], place[g], idle, active)
        last = x.last
        last[x.touched] = x.now
        rest = n_steps[decs["g"]] == 0
        decs = dict(g=decs["g"], decision=decs["decision"], **{f"_{c}": v for c, v in zip(fields, values)})
        decs = joined({c: v[rest] for c, v in decs.items()}, dict(g=g, decision=d, **{f"_{c}": state[c] for c in fields}))
        self.page.update((pack(dict(group_id=x.groups, g_last=last)), pack(decs)))
        yield pd.DataFrame({"group_id": x.groups[g], "decision": d, **{c: state[c] for c in fields}, "tick": last[g]})

    def close(self) -> None:
        pass


def closed_ticks(updates: DataFrame, tick_s: int, lateness_ticks: int) -> DataFrame:
    """Updates stream (group_id, decision, cost, ts) -> sums (s, c) per
    (group, decision, tick) of every tick that the watermark has closed."""
    ticks = (updates.where("cost is not null and ts is not null")
             .withWatermark("ts", f"{lateness_ticks * tick_s} seconds")
             .groupBy(F.window("ts", f"{tick_s} seconds").alias("w"), "group_id", "decision")
             .agg(F.sum(-F.col("cost").cast("double")).alias("s"), F.count(F.lit(1)).cast("double").alias("c")))
    return ticks.select("w", "group_id", "decision",
                        F.floor(F.unix_timestamp("w.start") / tick_s).cast("bigint").alias("tick"), "s", "c")


def decision_stream_policy(updates: DataFrame, policy, tick_s: int, lateness_ticks: int) -> DataFrame:
    """U1 streamed: closed ticks folded by a ``StatePolicy``; emits the state of
    every group that a closed tick touched (``policy.current`` reads it)."""
    closed = closed_ticks(updates, tick_s, lateness_ticks).withColumn("page", page_of("group_id"))
    return (parcels(closed, ["group_id", "decision", "tick", "s", "c"]).groupBy("page")
            .transformWithStateInPandas(StatePolicyProcessor(policy), policy.state_schema, "Append", "None"))


def initial_state(state: DataFrame, at_tick: int) -> DataFrame:
    """A batch state (``stats.discounted_state`` at ``at_tick``) as the state
    that a stream starts from."""
    return state.select("group_id", "decision", F.col("score_sum").cast("double").alias("score_sum"),
                        F.col("n").cast("double").alias("n"), F.col("last_tick").cast("bigint").alias("last_tick"),
                        F.lit(at_tick).cast("bigint").alias("at_tick"))


def decision_stream_chained(updates: DataFrame, gamma: float, tick_s: int, lateness_ticks: int) -> DataFrame:
    """T2 -> T1: updates stream (group_id, decision, cost, ts) -> tumbling ticks
    by event time -> the decision state, two stateful operators in one query.

    The first closes a tick when the watermark, ``lateness_ticks`` behind the
    newest update, has passed its end, and passes the sums of closed ticks on;
    the second folds them.  Closed ticks come in order and whole, so the result
    does not depend on the order in which updates arrive within the lateness
    (the other streams count a late update in its group's current tick).  What
    comes later than that is dropped (``metrics`` counts it)."""
    return closed_ticks(updates, tick_s, lateness_ticks).groupBy("group_id").transformWithStateInPandas(
        LazyDecayProcessor(gamma), OUT_SCHEMA, "Append", "None")


def read_store(spark: SparkSession, checkpoint: str, gamma: float, at_tick: int) -> DataFrame:
    """State of every (group, decision) at tick T as the state store of a
    query on ``checkpoint`` has it (``statestore`` data source): idle groups are
    in it like any other, and no emitted row is read."""
    def var(name: str) -> DataFrame:
        return spark.read.format("statestore").option("stateVarName", name).load(checkpoint)
    d = var("dec").select(F.col("key.group_id").alias("group_id"), F.col("user_map_key.decision").alias("decision"),
                          F.col("user_map_value.*"))
    g = var("grp").select(F.col("key.group_id").alias("group_id"), F.col("value.g_last").alias("group_tick"),
                          F.col("value.idle").alias("group_idle"))
    f = F.pow(F.lit(gamma), (F.col("group_idle") - F.col("idle_at")) + (F.lit(at_tick) - F.col("group_tick")))
    return d.join(g, "group_id").select("group_id", "decision", (F.col("s") * f).alias("score_sum"),
                                        (F.col("n") * f).alias("n"), F.col("d_last").alias("last_tick"), "group_tick")


def read_state(rows: DataFrame, gamma: float, at_tick: Column, batch: str = "batch_id") -> DataFrame:
    """State of every (group, decision) at tick T from the emitted rows:
    newest row per decision, the group's newest tick and idle count, then
    gamma^(idle since the write + idle ticks after the group's last tick)."""
    cols = ["score_sum", "n", "last_tick", "idle_at"]
    lastd = (rows.groupBy("group_id", "decision")
             .agg(F.max_by(F.struct(*cols), F.struct(batch, "last_tick")).alias("x"))
             .select("group_id", "decision", *[F.col(f"x.{c}").alias(c) for c in cols]))
    lastg = (rows.groupBy("group_id")
             .agg(F.max_by(F.struct("group_tick", "group_idle"), F.struct(batch, "group_tick")).alias("y"))
             .select("group_id", F.col("y.group_tick").alias("group_tick"),
                     F.col("y.group_idle").alias("group_idle")))
    j = lastd.join(lastg, "group_id")
    f = F.pow(F.lit(gamma), (F.col("group_idle") - F.col("idle_at")) + (at_tick - F.col("group_tick")))
    return j.select("group_id", "decision", (F.col("score_sum") * f).alias("score_sum"),
                    (F.col("n") * f).alias("n"), "last_tick", "group_tick")


__all__ = ["LazyDecayProcessor", "TimedDecayProcessor", "decision_stream_chained", "decision_stream_lazy",
           "decision_stream_policy", "decision_stream_timed", "initial_state", "read_state", "read_store", "ROCKSDB"]

"""Policies with a state of their own.

A ``StatePolicy`` says what it keeps for each (group, decision) and how a tick
changes it; the same two functions run in the batch, in the decision loop and in
a state-store stream:

* ``fields``: the state's columns (doubles), as DDL;
* ``merge(old, score_sum, n, idle)``: the state after a tick in which the group
  was active, over arrays of (group, decision) rows.  ``old`` maps each field to
  its values (nan: none yet), ``score_sum`` and ``n`` are the tick's sums (0 for
  a decision that was not active), ``idle`` the group's idle ticks since ``old``;
* ``read(state, idle)``: the state after ``idle`` further ticks without data
  (default: as it is);
* ``decide(state)``: decisions from the columns group_id, decision and the fields.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qoeflow.operators.policy.base import Policy

Rows = dict[str, np.ndarray]


class StatePolicy(Policy):
    fields: str = "weight double"

    # ------------------------------------------------- to be written by a user
    def merge(self, old: Rows, score_sum: np.ndarray, n: np.ndarray, idle: np.ndarray) -> Rows:
        raise NotImplementedError

    def read(self, state: Rows, idle: np.ndarray) -> Rows:
        return state

    # ----------------------------------------------------------------- derived
    @property
    def names(self) -> list[str]:
        return [f.split()[0] for f in self.fields.split(",")]

    @property
    def state_schema(self) -> str:
        return f"group_id string, decision string, {self.fields}, tick bigint"

    def _arrays(self, pdf: pd.DataFrame) -> Rows:
        return {c: pdf[c].to_numpy(np.float64) for c in self.names}

    def fold(self, known: dict[str, tuple], last: int | None, ticks: dict[tuple[int, str], list]) -> tuple[dict, int | None]:
        """A group's state after some ticks: ``known`` decision -> field values
        as of tick ``last``, ``ticks`` (tick, decision) -> [score_sum, n]."""
        by_tick: dict[int, dict[str, list]] = {}
        for (t, d), x in ticks.items():
            by_tick.setdefault(t, {})[d] = x
        for t in sorted(by_tick):
            names = sorted({*known, *by_tick[t]})
            none = (np.nan,) * len(self.names)
            old = dict(zip(self.names, np.array([known.get(d, none) for d in names], np.float64).T))
            sums = np.array([by_tick[t].get(d, (0.0, 0.0)) for d in names], np.float64)
            idle = np.full(len(names), 0 if last is None else t - last - 1, np.float64)
            new = self.merge(old, sums[:, 0], sums[:, 1], idle)
            known = dict(zip(names, zip(*(np.asarray(new[c], np.float64).tolist() for c in self.names))))
            last = t
        return known, last

    def fold_groups(self, old: Rows, born: np.ndarray, group: np.ndarray, idle: list[np.ndarray],
                    rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Rows:
        """``fold`` for many groups at once, one ``merge`` for all groups' k-th
        ticks.  Rows are (group, decision), ordered so that groups with more
        ticks come first: ``old`` their fields (nan: none yet), ``born`` the k they
        appear in (-1: known before), ``group`` their group's number in this
        order.  ``idle[k]``: the idle ticks before the k-th tick, of the groups that
        have one; ``rows[k]``: row, score_sum and n of the decisions active in it."""
        state = {c: np.array(old[c], np.float64) for c in self.names}
        for k, (at, s, c) in enumerate(rows):
            n = int(np.searchsorted(group, len(idle[k])))
            here = np.flatnonzero(born[:n] <= k)
            sums = np.zeros((2, n))
            sums[0, at], sums[1, at] = s, c
            new = self.merge({f: state[f][here] for f in self.names}, sums[0, here], sums[1, here],
                             idle[k][group[here]].astype(np.float64))
            for f in self.names:
                state[f][here] = new[f]
        return state

    def state(self, stats: DataFrame, at_tick=None) -> DataFrame:
        """Batch: the state of every (group, decision) at a tick (default: the
        last one); a group's ticks are folded in one task, as sums."""
        T = at_tick if at_tick is not None else stats.agg(F.max("tick")).first()[0]
        rows = stats.where(F.col("tick") <= T).select(
            "group_id", "decision", "tick", F.col("score_sum").cast("double").alias("s"), F.col("n").cast("double").alias("c"))

        def group(pdf: pd.DataFrame) -> pd.DataFrame:
            ticks = {(t, d): [s, c] for t, d, s, c in zip(pdf["tick"], pdf["decision"], pdf["s"], pdf["c"])}
            known, last = self.fold({}, None, ticks)
            out = pd.DataFrame(list(known.values()), columns=self.names)
            return out.assign(group_id=pdf["group_id"].iloc[0], decision=list(known), tick=last)[
                ["group_id", "decision", *self.names, "tick"]]
        return self.current(rows.groupBy("group_id").applyInPandas(group, self.state_schema), T)

    def advance(self, new: DataFrame, old: DataFrame | None, tick: int) -> DataFrame:
        """Decision loop: the rows of the groups that a tick touches."""
        touched = old.join(new.select("group_id").distinct(), "group_id", "left_semi")
        both = (new.select("group_id", "decision", F.col("score_sum").cast("double").alias("s"),
                           F.col("n").cast("double").alias("c"))
                .join(touched, ["group_id", "decision"], "full"))
        # a decision that is new to a known group: the idle ticks are its group's
        last = touched.groupBy("group_id").agg(F.max("tick").alias("_last"))
        both = both.join(last, "group_id", "left").select(
            "group_id", "decision", F.coalesce("s", F.lit(0.0)).alias("s"), F.coalesce("c", F.lit(0.0)).alias("c"),
            *self.names, F.coalesce(F.lit(tick) - 1 - F.col("_last"), F.lit(0)).alias("idle"))

        def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in pdfs:
                got = self.merge(self._arrays(p), p["s"].to_numpy(), p["c"].to_numpy(), p["idle"].to_numpy(np.float64))
                yield p[["group_id", "decision"]].assign(**got, tick=tick)
        return both.mapInPandas(run, self.state_schema)

    def current(self, state: DataFrame, tick: int) -> DataFrame:
        """group_id, decision and the fields as of ``tick``."""
        def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in pdfs:
                got = self.read(self._arrays(p), tick - p["tick"].to_numpy(np.float64))
                yield p[["group_id", "decision"]].assign(**got)
        return state.mapInPandas(run, f"group_id string, decision string, {self.fields}")

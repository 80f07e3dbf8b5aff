"""Keyed state in pages: many small groups under one key of a Python state operator.

Each key of ``transformWithStateInPandas`` costs a round trip to the state store
for every value that it reads, writes or arms, and a pandas frame for what it
emits: a few milliseconds whatever it holds.  With hundreds of thousands of
groups that is nearly all the time a stream takes.  Groups are therefore dealt
to ``PAGES`` pages by a hash.  A page is the operator's key; its groups are the
rows of small tables, which are read and written as one value each and worked on
as arrays.  A micro-batch touches only the pages of the groups it carries, at
most as many as these groups.

The number of pages is fixed when a stream first starts (a group's state stays
where it is).  A page's tables and its rows of one micro-batch are in memory at a
time: take more pages for many millions of groups.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGES = 1024
#: Rows of a task that are dealt to pages at once.
DEAL_ROWS = 1 << 18


def page_of(*cols: Column | str, pages: int = PAGES) -> Column:
    """The page of a key; null is a key like others."""
    return F.pmod(F.xxhash64(*cols), F.lit(pages)).cast("int").alias("page")


def pack(table: dict[str, np.ndarray]) -> bytes:
    """Columns of equal length as one compressed Arrow stream; object arrays are strings."""
    import pyarrow as pa
    batch = pa.RecordBatch.from_arrays(
        [pa.array(x, pa.string()) if x.dtype == object else pa.array(x) for x in table.values()], names=list(table))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(value: bytes) -> dict[str, np.ndarray]:
    """The columns of ``pack``."""
    import pyarrow as pa
    with pa.ipc.open_stream(pa.py_buffer(value)) as r:
        t = r.read_all()
    return {c: t[c].to_numpy() for c in t.column_names}


def joined(a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The rows of two tables with the same columns."""
    return {c: np.concatenate([a[c], b[c]]) for c in a}


def codes_of(*parts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Codes of the strings in each part, numbered as they first appear (null is
    a value), and the strings by code."""
    codes, names = pd.factorize(np.concatenate([np.asarray(p, object) for p in parts]), use_na_sentinel=False)
    names = np.where(pd.isna(names), None, names).astype(object)
    return np.split(codes.astype(np.int64), np.cumsum([len(p) for p in parts])[:-1]), names


def starts_of(*keys: np.ndarray) -> np.ndarray:
    """Where a new value of the keys begins, in rows that are sorted by them."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def parcels(rows: DataFrame, cols: list[str], when: str | None = None, keep: str = "") -> DataFrame:
    """A page's rows as values: ``cols`` of the rows of a page, among the
    ``DEAL_ROWS`` that a task has read, become one ``parcel`` (``unpack``), since the
    operator takes its input row by row.  Rows that are not ``when`` (a boolean
    column) stay as they are; ``keep`` names their further columns as DDL.
    Stateless: it may stand before a stateful operator."""
    names = [c.split()[0] for c in keep.split(",") if c]

    def blank(n, kind):
        import pyarrow as pa
        # whole numbers without nulls, which pandas would turn into doubles
        return pa.array(np.zeros(n, np.int64), kind) if pa.types.is_integer(kind) else pa.nulls(n, kind)

    def cut(held):
        import pyarrow as pa
        from pyarrow import compute
        t = pa.Table.from_batches(held)
        out = pa.schema([("page", pa.int32()), *((c, t.schema.field(c).type) for c in names), ("parcel", pa.binary())])
        if when is not None:
            other = t.filter(compute.invert(t[when]))
            plain = [other["page"], *(other[c] for c in names), pa.nulls(len(other), pa.binary())]
            yield from pa.Table.from_arrays(plain, schema=out).to_batches()
            t = t.filter(t[when])
        page = t["page"].to_numpy()
        order = np.argsort(page, kind="stable")
        at = starts_of(page[order])
        t = t.select(cols).take(pa.array(order)).combine_chunks()
        ends = np.append(at[1:], len(page))
        for some in range(0, len(at), 4096):
            values = []
            for i, j in zip(at[some:some + 4096].tolist(), ends[some:some + 4096].tolist(), strict=True):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                    w.write_table(t.slice(i, j - i))
                values.append(sink.getvalue().to_pybytes())
            whole = [pa.array(page[order][at[some:some + 4096]], pa.int32()), *(blank(len(values), out.field(c).type) for c in names)]
            yield pa.RecordBatch.from_arrays([*whole, pa.array(values, pa.binary())], schema=out)

    def run(batches):
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= DEAL_ROWS:
                yield from cut(held)
                held, n = [], 0
        if n:
            yield from cut(held)

    given = rows.select("page", *cols, *[c for c in names if c not in cols], *([] if when is None else [when]))
    return given.mapInArrow(run, ", ".join(["page int", *([keep] if keep else []), "parcel binary"]))


class PageTicks:
    """The partial sums (group_id, decision, tick, s, c) that a micro-batch has
    for a page, whose groups so far are ``known`` and were last active at
    ``last``; a tick before that counts as that tick (``late`` updates by group).

    ``groups``: the known groups, then the new ones.  One row per (group,
    decision): ``pair_g``, ``pair_d`` (group and name).  One row per (pair, tick),
    ordered by them: ``pair``, ``tick``, ``s``, ``c``, ``step`` (the row's tick
    among the group's ticks, ``step_*``).  One row per (group, tick):
    ``step_g``, ``step_tick``, ``step_rank`` and ``step_idle``, the group's idle
    ticks right before it.  ``touched``: groups with rows, ``now``: their newest tick."""

    def __init__(self, known: np.ndarray, last: np.ndarray, rows: pd.DataFrame):
        (_, g), self.groups = codes_of(known, rows["group_id"])
        (d,), names = codes_of(rows["decision"])
        t, c = rows["tick"].to_numpy(np.int64), rows["c"].to_numpy(np.float64)
        n_new = len(self.groups) - len(known)
        self.known = np.arange(len(self.groups)) < len(known)
        self.last = np.concatenate([last, np.zeros(n_new, np.int64)])
        behind = self.known[g] & (t < self.last[g])
        self.split = bool((self.known[g] & (t <= self.last[g])).any())
        self.late = np.bincount(g[behind], c[behind], len(self.groups)).astype(np.int64)
        t = np.where(behind, self.last[g], t)
        key = g * len(names) + d
        order = np.lexsort((t, key))
        key, t = key[order], t[order]
        at = starts_of(key, t)
        self.s = np.add.reduceat(rows["s"].to_numpy(np.float64)[order], at)
        self.c = np.add.reduceat(c[order], at)
        key, self.tick = key[at], t[at]
        self.pair_at = starts_of(key)
        self.pair = np.repeat(np.arange(len(self.pair_at)), np.diff([*self.pair_at, len(key)]))
        self.pair_g, self.pair_d = key[self.pair_at] // len(names), names[key[self.pair_at] % len(names)]
        row_g = self.pair_g[self.pair]
        order = np.lexsort((self.tick, row_g))
        at = starts_of(row_g[order], self.tick[order])
        self.step = np.empty(len(order), np.int64)
        self.step[order] = np.repeat(np.arange(len(at)), np.diff([*at, len(order)]))
        self.step_g, self.step_tick = row_g[order][at], self.tick[order][at]
        self.group_at = starts_of(self.step_g)
        self.touched = self.step_g[self.group_at]
        n_steps = np.diff([*self.group_at, len(self.step_g)])
        self.now = self.step_tick[self.group_at + n_steps - 1]
        self.step_rank = np.arange(len(self.step_g)) - np.repeat(self.group_at, n_steps)
        before = np.concatenate([[0], self.step_tick[:-1]])
        before[self.group_at] = np.where(self.known[self.touched], self.last[self.touched], self.step_tick[self.group_at] - 1)
        self.step_idle = np.maximum(self.step_tick - before - 1, 0)

    def pairs_in(self, g: np.ndarray, d: np.ndarray) -> np.ndarray:
        """For rows of a state table (group, decision name): their pair, -1 if
        the micro-batch has none of it."""
        (mine, theirs), names = codes_of(self.pair_d, d)
        mine, theirs = self.pair_g * len(names) + mine, g.astype(np.int64) * len(names) + theirs
        order = np.argsort(mine, kind="stable")
        at = np.minimum(np.searchsorted(mine[order], theirs), len(mine) - 1)
        return np.where(mine[order][at] == theirs, order[at], -1)

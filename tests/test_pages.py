"""Streams whose state is kept in pages of groups, against the same streams kept
group by group; a state store in memory counts the calls."""

import random

import numpy as np
import pandas as pd
import pytest


class Store:
    """Value, map and timer calls of one key, as a processor makes them."""

    def __init__(self):
        self.values, self.maps, self.timers, self.calls = {}, {}, set(), 0

    def getValueState(self, name, schema):
        return Value(self, name)

    def getMapState(self, name, key_schema, schema):
        return Map(self, name)

    def listTimers(self):
        self.calls += 1
        return sorted(self.timers)

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.discard(at)


class Value:
    def __init__(self, store, name):
        self.store, self.name = store, name

    def exists(self):
        self.store.calls += 1
        return self.name in self.store.values

    def get(self):
        self.store.calls += 1
        return self.store.values.get(self.name)

    def update(self, value):
        self.store.calls += 1
        self.store.values[self.name] = value


class Map:
    def __init__(self, store, name):
        self.store, self.held = store, store.maps.setdefault(name, {})

    def getValue(self, key):
        self.store.calls += 1
        return self.held.get(key)

    def updateValue(self, key, value):
        self.store.calls += 1
        self.held[key] = value

    def removeKey(self, key):
        self.store.calls += 1
        del self.held[key]

    def iterator(self):
        self.store.calls += 1
        return iter(list(self.held.items()))


class Clock:
    """Both of the arguments that tell a processor the time (ms)."""

    def __init__(self, watermark, expiry=None):
        self.getCurrentWatermarkInMs, self.getExpiryTimeInMs = (lambda: watermark), (lambda: expiry)


def opened(processor):
    store = Store()
    processor.init(store)
    return processor, store


def batch(processor, store, frames, watermark=0):
    """The rows emitted by a micro-batch: its input, then the timers that the watermark passed."""
    out = list(processor.handleInputRows((0,), iter(frames), Clock(watermark))) if frames else []
    for at in [t for t in sorted(store.timers) if t < watermark]:
        out += processor.handleExpiredTimer((0,), Clock(watermark), Clock(watermark, at))
        store.timers.discard(at)
    return [tuple(x) for f in out for x in f.astype(object).where(f.notna(), None).itertuples(index=False)]


def near(got, want):
    key = lambda x: repr([v for v in x if not isinstance(v, float)])
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a == pytest.approx(b), (a, b)


def sums(r, groups, ticks, n):
    rows = [(r.choice(groups), r.choice("abc"), r.choice(ticks), -r.randint(1, 90) / 10, float(r.randint(1, 3))) for _ in range(n)]
    return pd.DataFrame(rows, columns=["group_id", "decision", "tick", "s", "c"])


def test_timed_pages_emit_what_each_group_would():
    from qoeflow.streaming.keyed_state import LazyDecayProcessor, TimedDecayProcessor
    tick_s, gamma, groups, r = 10, 0.8, [f"g{i}" for i in range(40)] + [None], random.Random(3)
    page, store = opened(TimedDecayProcessor(gamma, tick_s))
    alone = {g: opened(LazyDecayProcessor(gamma)) for g in groups}
    due = {}                                              # group -> the tick it is due after
    for k in range(8):
        some = r.sample(groups, 15)
        x = sums(r, some, range(1000 + 3 * k, 1005 + 4 * k), 150)      # some are late, some ticks go on
        wm = (999 + 4 * k) * tick_s * 1000
        want = []
        for g in x["group_id"].unique():
            mine = x[x["group_id"].isna() if g is None else x["group_id"] == g]
            for f in alone[g][0].handleInputRows((g,), iter([mine]), Clock(wm)):
                want += f.itertuples(index=False, name=None)
            due[g] = alone[g][1].values["grp"][0]
        for g, at in due.items():
            if (at + 1) * tick_s * 1000 < wm:
                T = wm // (tick_s * 1000)
                g_last, idle, late = alone[g][1].values["grp"]
                now = idle + T - g_last
                for (d,), (s, n, last, i) in alone[g][1].maps["dec"].items():
                    want.append((g, d, s * gamma ** (now - i), n * gamma ** (now - i), last, now, T, now, late))
                due[g] = T
        near(batch(page, store, [x[:70], x[70:]], wm), want)
    assert store.timers == {(min(due.values()) + 1) * tick_s * 1000}


def test_a_page_of_groups_costs_a_few_state_calls():
    from qoeflow.streaming.keyed_state import TimedDecayProcessor
    r = random.Random(4)
    page, store = opened(TimedDecayProcessor(0.8, 10))
    for k in range(3):
        out = batch(page, store, [sums(r, [f"g{i}" for i in range(500)], [1000 + k], 3000)])
        assert len({x[0] for x in out}) > 400
    assert store.calls <= 3 * 4


def frame(rows):
    """Rows (group, since, version, payload) and (group, None, req_id, at) as ``serve_asof`` sends them."""
    from qoeflow.streaming.pages import pack
    out = [(g, s, v, p, None) for g, s, v, p in rows if s is not None]
    req = [x for x in rows if x[1] is None]
    for part in (req[:len(req) // 2], req[len(req) // 2:]):
        if part:
            names, _, ids, at = zip(*part)
            out.append((None, 0, 0, None, pack(dict(group_id=np.array(names, object), req_id=np.array(ids), at=np.array(at),
                                                    body=np.array([f"body {i}" for i in ids], object)))))
    return pd.DataFrame(out, columns=["group_id", "since", "version", "payload", "parcel"])


@pytest.mark.parametrize("chunk", [7, 16384])
def test_a_page_of_groups_serves_as_of_each_request(chunk, monkeypatch):
    from qoeflow.streaming import serving
    monkeypatch.setattr(serving, "CHUNK", chunk)
    r, groups = random.Random(6), [f"g{i}" for i in range(30)] + [None]
    page, store = opened(serving.AsofServer(10**9))
    known, waiting, n_req, calls = {}, [], 0, []
    for k in range(10):
        wm = 1000 + 50 * k
        dec = [(g, s, 10 * k + s, f"{g}/{k}/{s}") for g in r.sample(groups, 20) for s in r.sample(range(wm + 1, wm + 90), 2)]
        req = [(r.choice([*groups, "nobody"]), None, n_req + i, wm + r.randint(-200, 150)) for i in range(200)]
        n_req += 200
        for g, s, v, p in dec:
            known[g, s] = (v, p)

        def answer(g, q, at, late):
            since = max((s for x, s in known if x == g and s <= at), default=None)
            return (g, q, at, f"body {q}", *(known[g, since] if since is not None else (None, None)), late)

        now = [x for x in req if x[3] <= wm]
        waiting += [x for x in req if x[3] > wm]
        want = [answer(g, q, at, True) for g, _, q, at in now]
        if any(x[3] < wm for x in waiting):
            want += [answer(g, q, at, False) for g, _, q, at in waiting if at <= wm]
            waiting = [x for x in waiting if x[3] > wm]
        rows = dec + req
        order = sorted(range(len(rows)), key=lambda i: (rows[i][1] is None) * r.random())
        before = store.calls
        got = batch(page, store, [frame([rows[i] for i in order[:90]]), frame([rows[i] for i in order[90:]])], wm * 1000)
        calls.append(store.calls - before)
        assert sorted(got, key=repr) == sorted(want, key=repr)
        assert store.timers == {min(x[3] for x in waiting) * 1000}
    assert chunk == 7 or max(calls) < 30


def test_versions_behind_the_kept_time_go_but_the_valid_one():
    from qoeflow.streaming.serving import AsofServer
    page, store = opened(AsofServer(100))
    batch(page, store, [frame([("g", 10, 1, "a"), ("g", 20, 2, "b"), ("g", 950, 3, "c"), ("h", 15, 4, "d"), ("g", None, 1, 990)])])
    batch(page, store, [], 1000 * 1000)
    got = batch(page, store, [frame([("g", None, 2, 15), ("g", None, 3, 30), ("g", None, 4, 960), ("h", None, 5, 40)])], 1000 * 1000)
    assert [x[4:6] for x in sorted(got, key=lambda x: x[1])] == [(None, None), (2, "b"), (3, "c"), (4, "d")]


def test_a_page_of_groups_folds_a_user_state_like_each_group():
    from qoeflow.operators.policy import StatePolicy
    from qoeflow.streaming.keyed_state import StatePolicyProcessor
    from qoeflow.streaming.pages import pack

    class Fade(StatePolicy):
        fields = "total double, ticks double"

        def merge(self, old, score_sum, n, idle):
            return {"total": np.nan_to_num(old["total"]) * 0.5 ** idle * 0.9 + score_sum,
                    "ticks": np.nan_to_num(old["ticks"]) + (n > 0) + 10 * np.isnan(old["total"])}

    policy, r, groups = Fade(), random.Random(7), [f"g{i}" for i in range(60)] + [None]
    page, store = opened(StatePolicyProcessor(policy))
    alone = {g: ({}, None) for g in groups}
    for k in range(5):
        x = sums(r, r.sample(groups, 30), range(1000 + 20 * k, 1010 + 20 * k), 400)
        want = []
        for g in x["group_id"].unique():
            mine = x[x["group_id"].isna() if g is None else x["group_id"] == g]
            ticks = {}
            for t, d, s, c in zip(mine["tick"], mine["decision"], mine["s"], mine["c"]):
                old = ticks.setdefault((t, d), [0.0, 0.0])
                ticks[t, d] = [old[0] + s, old[1] + c]
            alone[g] = policy.fold(*alone[g], ticks)
            want += [(g, d, *v, alone[g][1]) for d, v in alone[g][0].items()]
        frames = [pd.DataFrame({"parcel": [pack({c: part[c].to_numpy() for c in x}) for part in parts]})
                  for parts in ([x[:50], x[50:130]], [x[130:]])]
        near(batch(page, store, frames), want)
    assert store.calls <= 5 * 2
    again = pd.DataFrame({"parcel": [pack({c: x[:1][c].to_numpy() for c in x})]})
    with pytest.raises(ValueError, match="split"):
        batch(page, store, [again])


def test_parcels_hold_the_rows_of_a_page(spark):
    from pyspark.sql import functions as F

    from qoeflow.streaming.pages import parcels, unpack
    df = spark.range(1000).select(
        F.when(F.col("id") % 9 > 0, F.concat(F.lit("k"), F.col("id") % 9)).alias("g"), (F.col("id") % 5).cast("int").alias("page"),
        (F.col("id") * 2**53 + 1).alias("n"), (F.col("id") % 3 > 0).alias("asked"), F.timestamp_seconds("id").alias("t"))
    rows = parcels(df, ["g", "n"], "asked", "t timestamp, n bigint").collect()
    plain = [x for x in rows if x.parcel is None]
    held = [(x.page, g, n) for x in rows if x.parcel is not None
            for g, n in zip(*(c.tolist() for c in unpack(x.parcel).values()), strict=True)]
    assert all(x.n == 0 and x.t is None for x in rows if x.parcel is not None)
    assert sorted((x.page, x.n, x.t) for x in plain) == sorted((x.page, x.n, x.t) for x in df.where("not asked").collect())
    assert sorted(held, key=repr) == sorted(((x.page, x.g, x.n) for x in df.where("asked").collect()), key=repr)
    assert len(rows) - len(plain) <= 5 * df.rdd.getNumPartitions()

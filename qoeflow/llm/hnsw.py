"""Nearest neighbours by largest inner product: one hierarchical navigable
small-world graph per shard, kept as flat neighbour arrays, results merged.

Index.  Equal vectors are one node (its members: the smallest ``vec_id``s that
a result can need).  Nodes fall into groups of one length and one band of norms
(halves of the largest norm; the last of ``BANDS`` holds all shorter ones), groups
into cells around centroids, cells by a hash into shards; a shard is one task's
graph, its rows sized by the table and by memory (``rows_of_shard``).  Centroids
are fitted on about ``FIT_ROWS`` nodes drawn by hash; every node is indexed.
A node gets a geometric level from a hash.  The nodes of a level are inserted in
blocks, those of higher levels first: a block searches the graph that has grown so
far (nodes of its own block are compared directly), links to a diversified choice
of what it found (a candidate is skipped when it lies nearer to one already
chosen), and where links back exceed the degree, the same rule prunes them.  A
link list is a row of an integer array, -1 where it is short.  One row per node
goes to a written table.

For the largest inner product a vector x is indexed as (x, sqrt(M^2 - |x|^2))
with M the largest norm of its band, so that nearness in the graph's Euclidean
distance orders like the inner product; bands keep that coordinate from being
much larger than the others.  A distance to the query is then M^2 - 2 x.q up to
the query's norm, so that the search compares x.q alone.

Search.  A query visits, in each group, the cells nearest to it: as many as hold
the share ``REACH`` of the nearest neighbours among the drawn nodes, which are
searched exhaustively for that.  A task reads a shard's nodes once and then its
queries in blocks; a shard that many queries visit is read by several tasks.  All
queries of a block walk together: greedily down the upper levels, then best-first
with a beam of ``ef`` on the lowest.  Scores of what is found are computed in
double precision on the original vectors; the shards' results are merged per
query and nodes expanded to their members.

Defined results: vectors that are null, zero, empty or hold null or non-finite
components, and rows without vec_id, take no part; a row repeated with the same
id and vector counts once; an id with two vectors asks with both and gets one
ranking; rows with the query's own id are never returned; ties go to the smaller
vec_id; vectors of another length than most are indexed only among their own
length; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qoeflow.llm.common import materialise, mix64, release

SHARD_ROWS = 16384
SHARD_BYTES = 64 << 20
SHARDS = 64
FIT_ROWS = 32768
BANDS = 8
REACH = 0.98
DEGREE = 16
CANDIDATES = 64
EF = 192
BLOCK = 512
QUERY_BLOCK = 64
TASK_QUERIES = 2048


def levels(ids: np.ndarray, degree: int) -> np.ndarray:
    """Geometric level of each node, from a hash of its id."""
    u = ((mix64(ids.astype(np.int64).view(np.uint64) ^ np.uint64(0x5EED)) >> np.uint64(11)).astype(float) + 1) / 2.0 ** 53
    return np.minimum(-np.log(u) / math.log(degree), 31).astype(np.int64)


def _between(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of the last two axes."""
    s, t = (x * x).sum(-1), (y * y).sum(-1)
    return np.maximum(s[..., :, None] + t[..., None, :] - 2 * np.matmul(x, np.swapaxes(y, -1, -2)), 0)


def _diverse(x: np.ndarray, near: np.ndarray, cand: np.ndarray, keep: int) -> np.ndarray:
    """For each node (row) at most ``keep`` of its candidates (ascending by
    distance ``near``, -1 for none), skipping one that lies nearer to a chosen
    one than to the node."""
    n, width = cand.shape
    out = np.full((n, keep), -1, np.int32)
    rows = np.arange(n)
    at = x[np.maximum(cand, 0)]
    between = _between(at, at)
    place = np.zeros((n, keep), np.int64)                # the chosen ones' columns
    count = np.zeros(n, np.int64)
    taken = np.zeros((n, width), bool)
    blocked = np.zeros((n, width), bool)                 # nearer to a chosen one
    for j in range(width):
        ok = (cand[:, j] >= 0) & (count < keep) & ~blocked[:, j]
        r = rows[ok]
        out[r, count[r]], place[r, count[r]], taken[r, j] = cand[r, j], j, True
        count[r] += 1
        blocked[r] |= between[r, j] < near[r]
    # room that is left goes to the nearest skipped ones, as links keep a graph whole
    spare = ~taken & (cand >= 0)
    spare &= np.cumsum(spare, axis=1) <= (keep - count)[:, None]
    r, j = np.nonzero(spare)
    out[r, count[r] + np.cumsum(spare, axis=1)[r, j] - 1] = cand[r, j]
    return out


def _nearest(near: np.ndarray, cand: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` nearest candidates of each row in order, -1 where there are fewer."""
    if near.shape[1] > k:
        pick = np.argpartition(near, k - 1, axis=1)[:, :k]
        near, cand = np.take_along_axis(near, pick, 1), np.take_along_axis(cand, pick, 1)
    order = np.argsort(near, axis=1, kind="stable")
    near, cand = np.take_along_axis(near, order, 1), np.take_along_axis(cand, order, 1)
    return near, np.where(np.isfinite(near), cand, -1)


def _link_back(x: np.ndarray, nbr: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Adds the links v -> u to the neighbour array; lists that overflow are pruned."""
    full = nbr.shape[1]
    order = np.argsort(v, kind="stable")
    u, v = u[order], v[order]
    nodes, first, new = np.unique(v, return_index=True, return_counts=True)
    held = (nbr[nodes] >= 0).sum(1)
    fits = np.repeat(held + new <= full, new)
    place = np.repeat(held, new) + np.arange(len(v)) - np.repeat(first, new)
    nbr[v[fits], place[fits]] = u[fits]
    over = np.flatnonzero(held + new > full)
    over = over[np.argsort(new[over], kind="stable")]    # lists of like width together
    for s in range(0, len(over), BLOCK):
        at = over[s:s + BLOCK]
        wide = np.full((len(at), int(new[at].max())), -1, np.int64)
        r = np.repeat(np.arange(len(at)), new[at])
        c = np.arange(len(r)) - np.repeat(np.cumsum(new[at]) - new[at], new[at])
        wide[r, c] = u[np.repeat(first[at], new[at]) + c]
        cand = np.concatenate([nbr[nodes[at]], wide], 1)
        for t in range(0, len(at), 64):                  # a hub's list may be wide
            part = cand[t:t + 64]
            y = x[nodes[at[t:t + 64]]]
            near = _between(y[:, None, :], x[np.maximum(part, 0)])[:, 0]
            near, part = _nearest(np.where(part >= 0, near, np.inf), part, CANDIDATES)
            nbr[nodes[at[t:t + 64]]] = _diverse(x, near, part, full)


def link(x: np.ndarray, degree: int, above: list[np.ndarray] = (), candidates: int = CANDIDATES) -> np.ndarray:
    """Neighbour array (n, 2 * degree) of one level's nodes, in their order;
    ``above``: those of the levels above, whose nodes come first."""
    n = len(x)
    nbr = np.full((n, 2 * degree), -1, np.int32)
    for s in range(0, n, BLOCK):
        e = min(s + BLOCK, n)
        q = x[s:e]
        own = _between(q, q)
        near = np.where(np.tri(e - s, k=-1, dtype=bool), own, np.inf)        # those before it
        cand = np.broadcast_to(np.arange(s, e), near.shape)
        if s:
            grown = Shard(x[:s], [nbr[:s], *(u for u in above if len(u) <= s)])
            found = grown.search(q, candidates, candidates)
            d = (q * q).sum(1)[:, None] + grown._dist(q, np.maximum(found, 0))
            near = np.concatenate([np.where(found >= 0, np.maximum(d, 0), np.inf), near], 1)
            cand = np.concatenate([found, cand], 1)
        near, cand = _nearest(near, cand, candidates)
        mine = _diverse(x, near, cand, degree)
        nbr[s:e, :degree] = mine
        r, c = np.nonzero(mine >= 0)
        _link_back(x, nbr, s + r, mine[r, c].astype(np.int64))
    return nbr


class Shard:
    """A shard's graph: ``x`` (n, d) vectors in node order (highest level
    first), ``links[l]`` the neighbour array of the first nodes, those of level
    l and above.  ``inner``: search by inner product instead of distance."""

    def __init__(self, x: np.ndarray, links: list[np.ndarray], inner: bool = False):
        self.x, self.links = x, links
        self.s = np.zeros(len(x), x.dtype) if inner else (x * x).sum(1)

    def _dist(self, q: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Squared distances (up to the query's own norm) of nodes ``at`` (Q, k),
        or -2 x.q: the augmented norm is the same for all nodes."""
        return self.s[at] - 2 * np.matmul(self.x[at], q[:, :, None])[:, :, 0]

    def search(self, q: np.ndarray, k: int, ef: int) -> np.ndarray:
        """(Q, k) node numbers, -1 where there are fewer."""
        n, rows = len(self.x), np.arange(len(q))
        ef = min(max(ef, k), n)
        at = np.zeros(len(q), np.int64)
        best = self._dist(q, at[:, None])[:, 0]
        for nbr in self.links[:0:-1]:                     # upper levels: greedy
            moving = rows
            while len(moving):
                near = nbr[at[moving]]
                d = np.where(near >= 0, self._dist(q[moving], np.maximum(near, 0)), np.inf)
                j = d.argmin(1)
                dj = d[np.arange(len(moving)), j]
                better = dj < best[moving]
                moving, near, j, dj = moving[better], near[better], j[better], dj[better]
                at[moving], best[moving] = near[np.arange(len(moving)), j], dj
        seen = np.zeros((len(q), n + 1), bool)            # column n: no neighbour
        seen[:, n] = True
        seen[rows, at] = True
        ids = np.full((len(q), ef), n, np.int64)
        dist = np.full((len(q), ef), np.inf, self.x.dtype)
        done = np.ones((len(q), ef), bool)
        ids[:, 0], dist[:, 0], done[:, 0] = at, best, False
        nbr = self.links[0]
        active = rows
        while len(active):
            todo = np.where(done[active], np.inf, dist[active])
            j = todo.argmin(1)
            some = np.isfinite(todo[np.arange(len(active)), j])
            active, j = active[some], j[some]
            if not len(active):
                break
            done[active, j] = True
            near = nbr[ids[active, j]].astype(np.int64)
            near[near < 0] = n
            new = ~seen[active[:, None], near]
            seen[active[:, None], near] = True
            near = np.where(new, near, n)
            d = np.where(new, self._dist(q[active], np.minimum(near, n - 1)), np.inf)
            all_d = np.concatenate([dist[active], d], 1)
            pick = np.argpartition(all_d, ef - 1, axis=1)[:, :ef]
            dist[active] = np.take_along_axis(all_d, pick, 1)
            ids[active] = np.take_along_axis(np.concatenate([ids[active], near], 1), pick, 1)
            done[active] = np.take_along_axis(np.concatenate([done[active], ~new], 1), pick, 1)
        order = np.argsort(dist, axis=1, kind="stable")[:, :k]
        out = np.take_along_axis(ids, order, 1)
        return np.where(out < n, out, -1)


def build(x: np.ndarray, level: np.ndarray, degree: int = DEGREE) -> tuple[np.ndarray, list[np.ndarray]]:
    """Node order (highest level first) and neighbour arrays by level."""
    order = np.argsort(-level, kind="stable")
    level, x = level[order], x[order]
    out: list[np.ndarray] = []
    for l in range(int(level.max(initial=0)), -1, -1):
        out.insert(0, link(x[:int((level >= l).sum())], degree, out))
    return order, out


def clean(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id and v (doubles) of the rows that take part."""
    v = F.transform(F.col(vec_col), lambda c: c.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter("vec_id is not null")
    return rows.filter("v is not null and size(v) > 0 "
                       "and forall(v, c -> c is not null and not isnan(c) and abs(c) < double('infinity')) "
                       "and exists(v, c -> c <> 0)").withColumn("v", F.transform("v", lambda c: c + F.lit(0.0)))


def _unpack(column, kind, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def rows_of_shard(n: int, size: int) -> int:
    """Rows of a shard of ``n`` vectors of ``size`` components: a ``SHARDS``-th of
    them, but no fewer than ``SHARD_ROWS`` and no more bytes than ``SHARD_BYTES``."""
    return max(min(max(SHARD_ROWS, n // SHARDS), SHARD_BYTES // (8 * size)), 1024)


def _augmented(v: np.ndarray, largest: float) -> np.ndarray:
    """Vectors over ``largest``, with the coordinate that makes their norms one."""
    x = v / largest
    return np.concatenate([x, np.sqrt(np.maximum(1 - (x * x).sum(1), 0))[:, None]], 1)


def _ordered_cells(q: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Cells of each query (in the scale of the centres), nearest first."""
    c = centres[:, :q.shape[1]]
    return np.argsort((centres * centres).sum(1) - 2 * q @ c.T, axis=1, kind="stable")


def _cell(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    s = (centres * centres).sum(1)
    return np.concatenate([(s - 2 * x[i:i + BLOCK] @ centres.T).argmin(1) for i in range(0, len(x), BLOCK)])


def fit_cells(v: np.ndarray, largest: float, cells: int, n: int, k: int, reach: float = REACH) -> tuple[np.ndarray, int]:
    """Centroids of a group from its drawn vectors ``v`` (of ``n``), and the cells a
    query visits: as many as hold the share ``reach`` of the drawn vectors that
    are among the ``k`` nearest of all, or of the nearest drawn one."""
    x = _augmented(v, largest)
    centres = x[:cells].copy()
    for _ in range(10):
        at = _cell(x, centres)
        count = np.bincount(at, minlength=cells)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        centres[count > 0] = sums[count > 0] / count[count > 0, None]
    at = _cell(x, centres)
    k = min(max(1, round(k * len(x) / n)), len(x) - 1)
    hits = np.zeros(cells)
    for s in range(0, min(len(x), 2 * BLOCK), 64):
        q = x[s:s + 64, :-1]
        q = q / np.maximum(np.linalg.norm(q, axis=1), 1e-300)[:, None]
        score = q @ x[:, :-1].T
        score[np.arange(len(q)), np.arange(s, s + len(q))] = -np.inf
        near = at[np.argpartition(-score, k - 1, axis=1)[:, :k]]
        place = np.argsort(_ordered_cells(q, centres), axis=1)
        hits += np.bincount(np.take_along_axis(place, near, 1).reshape(-1), minlength=cells)
    share = np.cumsum(hits) / hits.sum()
    return centres, int(np.searchsorted(share, reach) + 1)


_NODE = "shard long, size int, place int, rep long, vec binary, links array<binary>"


def index(nodes: DataFrame, degree: int = DEGREE) -> DataFrame:
    """One row per node (shard, size, rep, vec) with its neighbour lists."""
    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        size = t.column("size")[0].as_py()
        rep = t.column("rep").to_numpy()
        at = np.argsort(rep, kind="stable")
        rep = rep[at]
        v = np.array(t.column("v").combine_chunks().flatten()).reshape(-1, size)[at]
        x = _augmented(v, t.column("bound")[0].as_py()).astype(np.float32)
        order, links = build(x, levels(rep, degree), degree)
        rows = [[l[i].tobytes() for l in links if i < len(l)] for i in range(len(order))]
        out = pa.table({"shard": np.full(len(order), key[0].as_py(), np.int64),
                        "size": np.full(len(order), size, np.int32), "place": np.arange(len(order), dtype=np.int32),
                        "rep": rep[order], "vec": [r.tobytes() for r in v[order]],
                        "links": pa.array(rows, pa.list_(pa.binary()))})
        release()
        return out
    return nodes.select("shard", "size", "bound", "rep", "v").groupBy("shard").applyInArrow(run, _NODE)


def _routed(rows: DataFrame, groups: dict, asked: bool) -> DataFrame:
    """``rows`` (vec_id, size, v, and band where not ``asked``) with the shards of
    each: a node's one, or all that a query visits."""
    by_size: dict = {}
    for (size, _), g in groups.items():
        by_size.setdefault(size, []).append(g)

    def shards(size, band, v, ids):
        if not asked:
            g = groups[size, band]
            cell = _cell(_augmented(v, g["bound"]), g["centres"]) if len(g["first"]) > 1 else np.zeros(len(v), int)
            place = (mix64(ids.view(np.uint64)) % g["parts"][cell].astype(np.uint64)).astype(np.int64)
            return (g["first"][cell] + place)[:, None].tolist()
        out = [[] for _ in ids]
        for g in by_size.get(size, []):
            if len(g["first"]) == 1:
                near = np.zeros((len(v), 1), int)
            else:
                scale = np.maximum(np.linalg.norm(v / np.abs(v).max(1)[:, None], axis=1) * np.abs(v).max(1), 1e-300)
                near = _ordered_cells(v / scale[:, None], g["centres"])[:, :g["probes"]]
            for i, cells in enumerate(near.tolist()):
                for c in cells:
                    out[i].extend(range(g["first"][c], g["first"][c] + g["parts"][c]))
        return out

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                t = b.slice(at, BLOCK)
                size, band, ids = (t.column(c).to_numpy() for c in ("size", "band", "vec_id"))
                out: list = [None] * len(ids)
                for s, n in {*zip(size.tolist(), band.tolist())}:
                    on = np.flatnonzero((size == s) & (band == n))
                    v = np.array(t.column("v").take(pa.array(on)).flatten()).reshape(-1, s)
                    for i, x in zip(on, shards(s, n, v, ids[on])):
                        out[i] = x
                yield pa.record_batch([t.column("vec_id"), t.column("size"), t.column("band"), t.column("v"),
                                       pa.array(out, pa.list_(pa.int64()))],
                                      names=["vec_id", "size", "band", "v", "shards"])
    return rows.select("vec_id", "size", "band", "v").mapInArrow(
        run, "vec_id long, size int, band int, v array<double>, shards array<long>")


def _groups(nodes: DataFrame, largest: float, k: int, shard_rows: int | None) -> dict:
    """Cells and shards of each group (size, band): bound, centres, probes, and
    the number of the first shard and of shards of each cell."""
    sizes = {(r["size"], r["band"]): r["count"] for r in nodes.groupBy("size", "band").count().collect()}
    total = sum(sizes.values())
    drawn: dict = {}
    if any(n > (shard_rows or rows_of_shard(n, size)) for (size, _), n in sizes.items()):
        u = F.pmod(F.xxhash64("vec_id", F.lit("cells")), F.lit(total))
        for r in nodes.filter(u < FIT_ROWS).orderBy("vec_id").select("size", "band", "v").toLocalIterator():
            drawn.setdefault((r["size"], r["band"]), []).append(r["v"])
    out = {}
    for (size, band), n in sizes.items():
        rows = shard_rows or rows_of_shard(n, size)
        v = drawn.get((size, band), [])
        cells = max(1, min(-(-n // rows), len(v) // 16))
        g = {"bound": largest / 2.0 ** band, "rows": rows, "probes": 1, "centres": None}
        if cells > 1:
            g["centres"], g["probes"] = fit_cells(np.array(v), g["bound"], cells, n, k)
        g["first"], g["parts"] = np.arange(cells), np.ones(cells, np.int64)
        out[size, band] = g
    # cells are counted over all nodes; a large one is several shards
    counted = {(r["size"], r["band"], r["cell"]): r["count"] for r in
               _routed(nodes, out, False).groupBy("size", "band", F.get("shards", F.lit(0)).alias("cell")).count().collect()}
    first = 0
    for (size, band), g in out.items():
        held = np.array([counted.get((size, band, c), 0) for c in range(len(g["first"]))])
        g["parts"] = np.maximum(-(-held // (g["rows"] * 5 // 4)), 1)
        g["first"] = first + np.cumsum(g["parts"]) - g["parts"]
        first += int(g["parts"].sum())
    return out


def search(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 20, k: int = 20,
           shard_rows: int | None = None, degree: int = DEGREE, ef: int = EF) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each row whose
    id is divisible by ``every``."""
    spark = vectors.sparkSession
    rows = materialise(clean(vectors, id_col, vec_col).dropDuplicates(["vec_id", "v"]), "vectors")
    # the smallest ids of each distinct vector; row limits of a window run before its shuffle
    top = Window.partitionBy("v").orderBy("vec_id")
    members = (rows.withColumn("n", F.row_number().over(top)).filter(F.col("n") <= k + 1)
               .withColumn("rep", F.min("vec_id").over(Window.partitionBy("v"))))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c))
    longest = F.array_max(F.transform("v", F.abs))       # only where squares leave the range of doubles
    scaled = longest * F.sqrt(F.aggregate(F.transform("v", lambda c: c / longest), F.lit(0.0), lambda a, c: a + c * c))
    norm = F.when((norm > 1e-140) & (norm < 1e140), norm).otherwise(scaled)
    members = materialise(members.select("rep", "vec_id", "v", "n", F.when(F.col("n") == 1, norm).alias("norm")),
                          "vector-members")
    nodes = members.filter("n = 1")
    largest = nodes.agg(F.max("norm")).first()[0]
    if largest is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    band = F.least(F.floor(F.greatest(F.log2(F.lit(largest)) - F.log2("norm"), F.lit(0.0))), F.lit(BANDS - 1))
    nodes = nodes.select("vec_id", F.size("v").alias("size"), band.cast("int").alias("band"), "v")
    groups = _groups(nodes, largest, k, shard_rows)
    bound = F.lit(largest) / F.pow(F.lit(2.0), F.col("band"))
    nodes = _routed(nodes, groups, False).select(F.get("shards", F.lit(0)).alias("shard"), "size", bound.alias("bound"),
                                                 F.col("vec_id").alias("rep"), "v")
    graph = materialise(index(nodes, degree), "hnsw")

    asked = rows.filter(F.col("vec_id") % every == 0).withColumn("size", F.size("v")).withColumn("band", F.lit(0))
    routes = materialise(_routed(asked, groups, True).select(F.explode("shards").alias("shard"), "vec_id", "v"), "routes")
    # a shard that many queries visit is read by several tasks, each with a number of its own
    slots, tasks = [], 0
    for r in routes.groupBy("shard").count().orderBy("shard").collect():
        slots.append((r["shard"], tasks, -(-r["count"] // TASK_QUERIES)))
        tasks += slots[-1][2]
    if not slots:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    slots = spark.createDataFrame(slots, "shard long, slot0 int, copies int")
    copy = F.pmod(F.xxhash64("vec_id"), F.col("copies")).cast("int")
    both = (graph.join(slots, "shard")
            .select(F.explode(F.sequence("slot0", F.col("slot0") + F.col("copies") - 1)).alias("slot"),
                    F.lit(0).alias("part"), "size", "place", "rep", "vec", "links",
                    F.lit(None).cast("array<double>").alias("qv"))
            .unionByName(routes.join(slots, "shard")
                         .select((F.col("slot0") + copy).alias("slot"), F.lit(1).alias("part"), F.size("v").alias("size"),
                                 F.lit(0).alias("place"), F.col("vec_id").alias("rep"), F.lit(None).cast("binary").alias("vec"),
                                 F.lit(None).cast("array<binary>").alias("links"), F.col("v").alias("qv"))))

    def run(batches):
        slot, held, graph, rep, v = None, [], None, None, None
        for b in batches:
            ids, part = b.column("slot").to_numpy(), b.column("part").to_numpy()
            cut = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (part[1:] != part[:-1])]))
            for at, end in zip(cut, [*cut[1:], len(ids)]):
                rows = b.slice(at, end - at)
                if part[at] == 0:
                    if ids[at] != slot:
                        slot, held = ids[at], []
                    held.append(rows.select(["size", "rep", "vec", "links"]))
                    graph = None
                    continue
                if ids[at] != slot:
                    continue                        # a shard without nodes
                if graph is None:
                    t = pa.Table.from_batches(held)
                    size = t.column("size")[0].as_py()
                    rep = t.column("rep").to_numpy()
                    v = _unpack(t.column("vec"), np.float64, size)
                    lists = t.column("links").to_pylist()
                    links = [_unpack(pa.array([x[l] for x in lists if l < len(x)]), np.int32, 2 * degree)
                             for l in range(max(map(len, lists)))]
                    scale = max(np.abs(v).max(), 1e-300)
                    graph, held = Shard((v / scale).astype(np.float32), links, inner=True), []
                for first in range(0, rows.num_rows, QUERY_BLOCK):
                    t = rows.slice(first, QUERY_BLOCK)
                    qid = t.column("rep").to_numpy()
                    q = np.array(t.column("qv").flatten()).reshape(len(qid), -1)
                    found = graph.search((q / np.abs(q).max(1)[:, None]).astype(np.float32), k + 1, ef)
                    who, col = np.nonzero(found >= 0)
                    node = found[who, col]
                    yield pa.record_batch({"query_id": qid[who], "rep": rep[node],
                                           "score": np.einsum("ij,ij->i", q[who], v[node])})
        release()

    hits = (both.repartitionById(tasks, F.col("slot")).sortWithinPartitions("slot", "part", "place")
            .mapInArrow(run, "query_id long, rep long, score double"))
    near = Window.partitionBy("query_id").orderBy(F.desc("score"), "rep")
    hits = hits.dropDuplicates().withColumn("r", F.row_number().over(near)).filter(F.col("r") <= k + 1)
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (hits.join(members.select("rep", "vec_id"), "rep").filter("vec_id <> query_id")
            .withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))

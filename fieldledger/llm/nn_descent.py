"""Nearest neighbours by a graph that NN-descent builds and greedy search walks.

Build. Equal vectors become one point. Points are numbered along a random hyperplane order (signs of some projections,
then one more projection) and dealt to homes, which are runs of that order. Several such orders are cut into equal
blocks, and the nearest points inside a block are a point's first neighbours. Then come rounds of NN-descent: each
point's neighbours, and up to as many points that have it as neighbour, are joined to one another at the point's home;
a pair of which one end is new there is measured, and each end keeps its nearest. A home sends at most `k` entries for a
point, which loses nothing, since only the `k` nearest of all are kept, and one row to each other home. Rounds end when under 5 % of the entries change.

Search. A query keeps its `beam` nearest points so far. In a round it asks the homes of the neighbours of its nearest
points not yet opened; a home measures them on the original vectors in double precision and sends those that are near
enough, with their neighbours. A query ends when all points of its beam are opened. Queries that are rows of the index
start at their own point and at evenly spread ones, others at the spread ones only.

Homes, blocks and states are bounded by parameters, whatever is hot: copies are one point, blocks are equal runs, a
point's list and the list of points that have it are bounded by `k` (the graph is an approximation; recall is measured).

Odd rows. Vectors that are null, empty, zero, of another length than most, or hold null, NaN or infinity take no part;
nor do rows without an id. Rows equal in id and vector count once. Copies have distance 0 and are ranked by id. Fewer
candidates than asked for are all returned, since each query starts at 64 points or all. Empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldledger.llm.common import numbered, pieces, saved
from fieldledger.llm.keyed import lists
from fieldledger.llm.vectors import finite, usual_length

#: Neighbours of a point; points of a home; points of a block; orders that are cut into blocks.
K, HOME, LEAF, ORDERS = 32, 4_096, 384, 4
#: Nearest points a query keeps; points it opens in a round; points at which every query starts.
BEAM, OPENED, STARTS = 256, 48, 64
#: Descent ends when a smaller share of all entries changed in a round.
SETTLED = 0.05


def matrix(column) -> np.ndarray:
    """A list column of one length as rows of doubles."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    arr = pa.concat_arrays(arr.chunks) if isinstance(arr, pa.ChunkedArray) else arr
    return np.asarray(arr.flatten(), dtype=np.float64).reshape(len(arr), -1)


def _column(rows: pa.Table, name: str) -> np.ndarray:
    return np.asarray(rows.column(name))


def _anew(df: DataFrame) -> DataFrame:
    """The same columns under new names of Spark's own, so that a cogroup can tell its two sides apart."""
    return df.select([F.col(c).alias(c) for c in df.columns])


def _pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One integer for each pair, in the order of the pairs."""
    if not len(a):
        return np.empty(0, np.int64)
    a, b = a - a.min(), b - b.min()
    if (int(a.max()) + 1) * (int(b.max()) + 1) >= 1 << 62:
        a, b = np.unique(a, return_inverse=True)[1], np.unique(b, return_inverse=True)[1]
    return a * (int(b.max()) + 1) + b


def _nearest(target: np.ndarray, other: np.ndarray, d: np.ndarray, k: int, old: np.ndarray | None = None):
    """For each target its k nearest distinct others, as (targets, ends, others, distances, from the old list or not)."""
    old = np.zeros(len(d), bool) if old is None else old
    pair = _pair_keys(target, other)
    order = np.argsort(pair * 2 + ~old, kind="stable")  # of equal pairs the old one stays
    pair = pair[order]
    order = order[np.concatenate([[True], pair[1:] != pair[:-1]])] if len(order) else order
    t = target[order]
    near = d[order].astype(np.float32).view(np.uint32).astype(np.int64)  # the bits of numbers from 0 on keep their order
    order = order[np.argsort(_pair_keys(t, near), kind="stable")]
    t = target[order]
    first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]])) if len(t) else np.empty(0, np.int64)
    place = np.arange(len(t)) - np.repeat(first, np.diff(np.append(first, len(t))))
    order = order[place < k]
    t = target[order]
    ends = np.append(np.flatnonzero(t[1:] != t[:-1]) + 1, len(t)) if len(t) else np.empty(0, np.int64)
    return t[ends - 1], ends, other[order], d[order], old[order]


_SENT = "home int, nodes array<long>, sizes array<int>, nbrs array<long>, ds array<double>"


def _sent(home_size: int, t, ends, other, d) -> pa.Table:
    """Lists for points `t` (rising), a row for each home they belong to: points, lengths of their lists, and the lists."""
    homes, first = np.unique(t // home_size, return_index=True)
    upto = np.append(first[1:], len(t)).astype(np.int64)[: len(homes)]
    flat = ends[upto - 1]
    sizes = np.diff(np.concatenate([[0], ends])).astype(np.int32)
    return pa.table({"home": pa.array(homes.astype(np.int32)), "nodes": lists(t, upto), "sizes": lists(sizes, upto), "nbrs": lists(other, flat), "ds": lists(d, flat)})


_LISTS = "home int, node long, nbrs array<long>, ds array<double>"


def _flat(rows: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    arr = rows.column(name).combine_chunks()
    return np.asarray(arr.flatten()), np.repeat(np.arange(len(arr)), np.asarray(arr.value_lengths()))


def _within(rows: pa.Table, k: int, home_size: int) -> pa.Table:
    """Nearest points inside a block."""
    node, v = _column(rows, "node"), matrix(rows.column("vector"))
    norm = (v * v).sum(1)
    out: list[list] = [[], [], []]
    take = min(k, len(node) - 1)
    for a in range(0, len(node) if take else 0, 1024):
        d = np.maximum(norm[a : a + 1024, None] + norm[None, :] - 2 * (v[a : a + 1024] @ v.T), 0)
        d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
        near = np.argpartition(d, take - 1, axis=1)[:, :take]
        for column, values in zip(out, (np.repeat(node[a : a + 1024], take), node[near].ravel(), np.take_along_axis(d, near, 1).ravel()), strict=True):
            column.append(values)
    t, o, d = (np.concatenate(c) if c else np.empty(0, np.float64 if c is out[2] else np.int64) for c in out)
    return _sent(home_size, *_nearest(t, o, d, k)[:4])


def _merged(home: int, now: pa.Table | None, sent: pa.Table, k: int) -> pa.Table:
    """A home's lists put together with what was sent to it; `fresh` marks entries that the lists did not have."""
    t, o, d, old = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)], [np.empty(0, bool)]
    if now is not None and now.num_rows:
        flat, at = _flat(now, "nbrs")
        t, o, d, old = [_column(now, "node")[at]], [flat], [_flat(now, "ds")[0]], [np.ones(len(flat), bool)]
    if sent.num_rows:
        t.append(np.repeat(_flat(sent, "nodes")[0], _flat(sent, "sizes")[0]))
        o.append(_flat(sent, "nbrs")[0])
        d.append(_flat(sent, "ds")[0])
        old.append(np.zeros(len(d[-1]), bool))
    t, ends, other, d, old = _nearest(*(np.concatenate(x) for x in (t, o, d)), k, np.concatenate(old))
    return pa.table({"home": pa.array(np.full(len(t), home), pa.int32()), "node": pa.array(t), "nbrs": lists(other, ends), "ds": lists(d, ends), "fresh": lists(~old, ends)})


def _given(asks: pa.Table, points: pa.Table) -> pa.Table:
    """The points of a home that other homes ask for, a row for each asking home."""
    ids = _column(points, "node")
    order = np.argsort(ids)
    ids, v, worst = ids[order], matrix(points.column("vector"))[order], _column(points, "worst")[order]
    xs, row = _flat(asks, "xs")
    at = np.searchsorted(ids, xs)
    ends = np.cumsum(np.bincount(row, minlength=asks.num_rows))
    return pa.table({"home": asks.column("home"), "nodes": lists(xs, ends), "vectors": lists(v[at].ravel().astype(points.column("vector").type.value_type.to_pandas_dtype()), ends * v.shape[1]), "worst": lists(worst[at], ends)})


def _joined(members: pa.Table, points: pa.Table, k: int, home_size: int) -> pa.Table:
    """Neighbours of each point of a home joined to one another: nearer pairs than either end has."""
    ids = _flat(points, "nodes")[0]
    order = np.argsort(ids)
    v = _flat(points, "vectors")[0].astype(np.float64).reshape(len(ids), -1)[order]
    ids, worst = ids[order], _flat(points, "worst")[0][order]
    norm = (v * v).sum(1)
    at, x, fresh = _column(members, "v"), np.searchsorted(ids, _column(members, "x")), _column(members, "fresh").astype(bool)
    order = np.lexsort((~fresh, x, at))
    at, x, fresh = at[order], x[order], fresh[order]
    keep = np.concatenate([[True], (at[1:] != at[:-1]) | (x[1:] != x[:-1])])
    at, x, fresh = at[keep], x[keep], fresh[keep]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    size = np.diff(np.append(first, len(at)))
    wide = int(size.max())
    out = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    step = max(1, (4 << 20) // (wide * max(wide, v.shape[1])))
    for a in range(0, len(first), step):
        f, s = first[a : a + step], size[a : a + step]
        place = np.minimum(f[:, None] + np.arange(wide), len(x) - 1)
        real = np.arange(wide) < s[:, None]
        i = x[place]
        new = fresh[place] & real
        d = np.maximum(norm[i][:, :, None] + norm[i][:, None, :] - 2 * (v[i] @ v[i].transpose(0, 2, 1)), 0)
        ok = real[:, :, None] & real[:, None, :] & (new[:, :, None] | new[:, None, :]) & (d < worst[i][:, :, None])
        ok[:, np.arange(wide), np.arange(wide)] = False
        g, p, q = np.nonzero(ok)
        out = (np.concatenate([out[0], i[g, p]]), np.concatenate([out[1], i[g, q]]), np.concatenate([out[2], d[g, p, q]]))
        if len(out[0]) > 4 << 20:
            t, ends, o, dd, _ = _nearest(*out, k)
            count = np.diff(np.concatenate([[0], ends]))
            out = (np.repeat(t, count), o, dd)
            full = count == k
            worst[t[full]] = np.minimum(worst[t[full]], dd[ends[full] - 1])  # from here on only what is nearer than these
    t, ends, o, d, _ = _nearest(*out, k)
    return _sent(home_size, ids[t], ends, ids[o] if len(o) else o, d)


class Graph:
    """points (home, node, vector), members (node, id) and lists (home, node, nbrs, ds): all written in the shared folder."""

    def __init__(self, points: DataFrame, members: DataFrame, lists_: DataFrame, n: int, home: int, rounds: int):
        self.points, self.members, self.lists, self.n, self.home, self.rounds = points, members, lists_, n, home, rounds


def _keys(points: DataFrame, mean: list[float], orders: list[int], bits: int) -> DataFrame:
    """Each point's place in each order: `side`, the signs of `bits` projections, and `along`, one projection."""
    size = len(mean)

    def work(batches):
        for b in batches:
            v = matrix(b.column("vector")) - np.array(mean)
            for t in orders:
                p = v @ np.random.default_rng(t).normal(size=(size, bits + 1))
                side = ((p[:, :bits] > 0) << np.arange(bits)).sum(1) if bits else np.zeros(len(v), np.int64)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(v), t), pa.int32()), pa.array(side.astype(np.int64)), pa.array(p[:, bits])], names=[*b.schema.names, "tree", "side", "along"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema)
    return points.mapInArrow(work, f"{kinds}, tree int, side long, along double")


def participants(vectors: DataFrame) -> DataFrame:
    """id, vector of the rows that take part."""
    base = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("vector"))
    base = base.where(F.col("id").isNotNull() & finite(F.col("vector")) & F.exists("vector", lambda x: x != 0))
    return base.where(F.size("vector") == usual_length(base))


def build(vectors: DataFrame, k: int = K, home: int = HOME, leaf: int = LEAF, orders: int = ORDERS, copies: int = 11) -> Graph | None:
    """The graph over id, vector. Of equal vectors the `copies` smallest ids are kept: no query returns more of them."""
    kept = vectors.distinct().withColumn("rank", F.row_number().over(Window.partitionBy("vector").orderBy("id"))).where(F.col("rank") <= copies)
    kept = saved(kept, "vectors")
    one = kept.where("rank = 1").select("vector", F.col("id").alias("first"))
    n = one.count()
    if not n:
        return None
    size = len(one.select("vector").first()[0])
    mean = [x or 0.0 for x in one.agg(*[F.avg(F.col("vector")[i].cast("double")).alias(f"m{i}") for i in range(size)]).first()]
    bits = max(0, math.ceil(math.log2(n / leaf)))
    points = numbered(_keys(one, mean, [0], bits), ["side", "along", "first"], "node", slices=pieces(n, home))
    points = saved(points.select(F.floor(F.col("node") / home).cast("int").alias("home"), "node", "vector", "first"), "points")
    members = saved(kept.join(points.select("vector", "node"), "vector").select("node", "id"), "members")
    points = points.drop("first")
    blocks = points.select(F.floor(F.col("node") / leaf).alias("block"), "node", "vector")
    if orders > 1 and n > leaf:
        rest = numbered(_keys(points.select("node", "vector"), mean, list(range(1, orders)), bits), ["tree", "side", "along", "node"], "at", slices=pieces(n * (orders - 1), home))
        blocks = blocks.unionByName(rest.select((-F.floor(F.col("at") / leaf) - 1).alias("block"), "node", "vector"))
    start = blocks.groupBy("block").applyInArrow(lambda rows: _within(rows, k, home), _SENT)
    kinds = f"{_LISTS}, fresh array<boolean>"
    kind = points.schema["vector"].dataType.elementType.simpleString()
    now, rounds = saved(start.groupBy("home").applyInArrow(lambda key, sent: _merged(key[0].as_py(), None, sent, k), kinds), "lists"), 0
    while n > leaf:
        told = now.select(F.col("node").alias("v"), F.explode(F.arrays_zip("nbrs", "ds", "fresh")).alias("e"))
        there = told.select("v", F.col("e.nbrs").alias("x"), F.col("e.fresh").alias("fresh"), F.col("e.ds").alias("d"))
        back = there.select(F.col("x").alias("v"), F.col("v").alias("x"), "fresh", "d").withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("d", "x"))).where(F.col("r") <= k)
        met = there.drop("d").unionByName(back.select("v", "x", "fresh")).withColumn("home", F.floor(F.col("v") / home).cast("int"))
        met = saved(met, "met")
        worst = now.select("node", F.when(F.size("ds") < k, F.lit(float("inf"))).otherwise(F.array_max("ds")).alias("worst"))
        # Homes ask homes: at most HOME points in a row.
        asks = met.select("home", F.floor(F.col("x") / home).cast("int").alias("to"), "x").groupBy("home", "to").agg(F.collect_set("x").alias("xs"))
        there = points.select("home", "node", "vector").join(worst, "node")
        given = asks.groupBy("to").cogroup(_anew(there).groupBy("home")).applyInArrow(_given, f"home int, nodes array<long>, vectors array<{kind}>, worst array<double>")
        nearer = met.groupBy("home").cogroup(given.groupBy("home")).applyInArrow(lambda m, p: _joined(m, p, k, home), _SENT)
        now = now.select("home", "node", "nbrs", "ds").groupBy("home").cogroup(nearer.groupBy("home"))
        now = saved(now.applyInArrow(lambda key, lists_, sent: _merged(key[0].as_py(), lists_, sent, k), kinds), "lists")
        rounds += 1
        changed = now.agg(F.sum(F.size(F.filter("fresh", lambda x: x)))).first()[0]
        if changed < SETTLED * n * k:
            break
    return Graph(points, members, now.drop("fresh"), n, home, rounds)


def _measured(asks: pa.Table, points: pa.Table) -> pa.Table:
    """Distances from queries to the points of a home they asked for, and these points' neighbours."""
    ids = _column(points, "node")
    order = np.argsort(ids)
    ids, v = ids[order], matrix(points.column("vector"))[order]
    nbrs = matrix(points.column("nbrs"))[order].astype(np.int64)
    q = matrix(asks.column("vector"))
    flat, row = _flat(asks, "xs")
    at = np.searchsorted(ids, flat)
    d = np.empty(len(flat))
    for a in range(0, len(flat), 1 << 16):
        gap = v[at[a : a + (1 << 16)]] - q[row[a : a + (1 << 16)]]
        d[a : a + (1 << 16)] = np.sqrt((gap * gap).sum(1))
    near = d < _column(asks, "bound")[row]
    return pa.table({"lane": asks.column("lane").combine_chunks().take(pa.array(row[near])), "qid": asks.column("qid").combine_chunks().take(pa.array(row[near])), "x": pa.array(flat[near]), "d": pa.array(d[near]), "nbrs": lists(nbrs[at[near]].ravel(), np.arange(1, near.sum() + 1) * nbrs.shape[1])})


_STATE = "lane int, qid long, vector array<double>, xs array<long>, seen array<long>, ids array<long>, ds array<double>, nbrs array<long>"
#: Among a point's neighbours: no neighbour; and, in first place, that the point was opened.
_NONE, _OPENED = -1, -2


def _stepped(states: pa.Table, told: pa.Table, beam: int, opened: int, k: int) -> pa.Table:
    """New states: answers put into the beams, the nearest unopened points opened, their unseen neighbours to be asked (xs)."""
    who = _column(told, "qid") if told.num_rows else np.empty(0, np.int64)
    by = np.argsort(who, kind="stable")
    who = who[by]
    x, d, near = (_column(told, "x")[by], _column(told, "d")[by], matrix(told.column("nbrs"))[by].astype(np.int64)) if told.num_rows else (who, np.empty(0), np.empty((0, k), np.int64))
    flat = {n: np.split(_flat(states, n)[0], np.cumsum(np.asarray(states.column(n).combine_chunks().value_lengths()))[:-1]) for n in ("seen", "ids", "ds", "nbrs")}
    out: dict[str, list] = {n: [] for n in ("xs", "seen", "ids", "ds", "nbrs")}
    for i, qid in enumerate(_column(states, "qid")):
        a, b = np.searchsorted(who, [qid, qid + 1])
        ids, ds = np.concatenate([flat["ids"][i], x[a:b]]), np.concatenate([flat["ds"][i], d[a:b]])
        nbrs = np.concatenate([flat["nbrs"][i].reshape(-1, k), near[a:b]])
        best = np.lexsort((ids, ds))[:beam]
        ids, ds, nbrs = ids[best], ds[best], nbrs[best]
        open_now = np.flatnonzero(nbrs[:, 0] != _OPENED)[:opened]
        ask = np.setdiff1d(nbrs[open_now].ravel(), np.append(flat["seen"][i], _NONE))
        nbrs[open_now, 0] = _OPENED
        for name, values in zip(out, (ask, np.sort(np.concatenate([flat["seen"][i], ask])), ids, ds, nbrs.ravel()), strict=True):
            out[name].append(values)
    kept = {n: states.column(n).combine_chunks() for n in ("lane", "qid", "vector")}
    return pa.table(kept | {n: lists(np.concatenate(v), np.cumsum([len(e) for e in v])) for n, v in out.items()})


def search(graph: Graph, queries: DataFrame, beam: int = BEAM, opened: int = OPENED, starts: int = STARTS, lanes: int = 64) -> DataFrame:
    """qid, node, d: the nearest points found for queries (qid long, vector array<double>, start array<long>: points to start at)."""
    spread = sorted({i * graph.n // starts for i in range(starts)})
    home = graph.home
    none = F.array().cast("array<long>")
    lists_ = graph.points.join(graph.lists.select("node", "nbrs"), "node", "left").withColumn("nbrs", F.coalesce("nbrs", none))
    k = max(1, lists_.agg(F.max(F.size("nbrs"))).first()[0])
    nodes = saved(lists_.withColumn("nbrs", F.concat("nbrs", F.array_repeat(F.lit(_NONE).cast("long"), F.lit(k) - F.size("nbrs")))), "nodes")
    first = F.array_distinct(F.concat(F.array(*[F.lit(i).cast("long") for i in spread]), F.col("start")))
    n = pieces(queries.count(), lanes)
    state = queries.select(F.pmod(F.xxhash64("qid"), F.lit(n)).cast("int").alias("lane"), "qid", F.col("vector").cast("array<double>").alias("vector"), first.alias("xs"), first.alias("seen"))
    state = saved(state.withColumns({"ids": none, "ds": F.array().cast("array<double>"), "nbrs": none}), "beams")
    while state.where(F.size("xs") > 0).limit(1).count():
        bound = F.when(F.size("ds") < beam, F.lit(float("inf"))).otherwise(F.array_max("ds"))
        asks = state.select("lane", "qid", "vector", bound.alias("bound"), F.explode("xs").alias("x"))
        asks = asks.withColumn("home", F.floor(F.col("x") / home).cast("int")).groupBy("home", "lane", "qid").agg(F.first("vector").alias("vector"), F.first("bound").alias("bound"), F.collect_list("x").alias("xs"))
        there = nodes.join(asks.select("home").distinct(), "home", "left_semi")
        told = asks.groupBy("home").cogroup(_anew(there).groupBy("home")).applyInArrow(_measured, "lane int, qid long, x long, d double, nbrs array<long>")
        state = saved(state.groupBy("lane").cogroup(told.groupBy("lane")).applyInArrow(lambda s, t: _stepped(s, t, beam, opened, k), _STATE), "beams")
    return state.select("qid", F.explode(F.arrays_zip(F.col("ids").alias("node"), F.col("ds").alias("d"))).alias("e")).select("qid", F.col("e.node").alias("node"), F.col("e.d").alias("d"))


def nearest(embeddings: DataFrame, step: int = 100, top: int = 10, **graph_options) -> DataFrame:
    """The query: the `top` nearest other rows of every row whose id is divisible by `step`."""
    rows = saved(participants(embeddings), "rows")
    graph = build(rows, copies=top + 1, **graph_options)
    if graph is None:
        return embeddings.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asked = rows.where(F.col("id") % step == 0).distinct()
    own = graph.points.select("vector", "node")
    asked = asked.join(own, "vector").select(F.xxhash64("id", "node").alias("qid"), "id", F.col("vector").cast("array<double>").alias("vector"), F.array("node").alias("start"))
    asked = saved(asked, "asked")
    found = search(graph, asked.drop("id")).withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy("d", "node"))).where(F.col("r") <= top + 1)
    hits = found.join(asked.select("qid", "id"), "qid").join(graph.members.withColumnRenamed("id", "vec_id"), "node").where(F.col("vec_id") != F.col("id"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("d", "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= top).select(F.col("id").alias("query_id"), F.col("rank").cast("int").alias("rank"), "vec_id", F.col("d").alias("score"))

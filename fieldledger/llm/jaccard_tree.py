"""Near-duplicate documents by word-shingle Jaccard, with an R-tree over count vectors.

A document is the set of its 5-word shingles. Shingles are hashed into `GROUPS` groups; the counts per group make the
document a point. For two points the summed coordinate minima bound the overlap of the sets from above, and for a point
and a box the minima with the box's upper corner bound it for all points inside. A pair can only be linked if the bound
reaches what the similarity asks of the two set sizes, so boxes and points that fall short are never looked at.

One tree over everything would let no box be pruned for typical prose (boxes in 64 dimensions are wide), so the points are
dealt out first, exactly: with shingles in one global order, two sets this similar share a shingle among the first
`n - ceil(0.8 n) + 1` of each. Every shingle that heads two different sets gets a tree of its own, with the points of
these sets. The order puts shingles that many documents have last (the order changes the work, never the result).

Equal sets are one node from the start. Then, in turn: each tree links its points with a few of them, picked by hash, so
large groups of near copies fall together without listing their pairs; the trees are searched for nodes that have a
partner in a different component, and these nodes get their whole sets, are searched once more and verified on the spot.
Each task gives nodes and then links that join components, at most one per node, never pairs. Components of the verified
links are exact: a pair is left out only if it is linked already or cannot be linked. Another bound counts the trees in
which a pair meets: of what two sets share, all but the rest behind one of the heads shows up there.

A text of 1 to 4 words is one shingle; a null, empty or blank text has none and is linked with nothing. Null ids are
members but never name a component (a component of null ids only has a null id). Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldledger.llm.common import Words, pieces, portions, saved, text_bytes, windows
from fieldledger.llm.components import components
from fieldledger.llm.keyed import BATCH, Dealt, answer, ask, ask_again, flat, in_batches, lists, reply

GROUPS = 64
OFTEN = 0.002  #: shingles in a larger share of documents come last in the order
LEAF = 32
CENTRES = 3
TREE = 8_000  #: points of a tree that is dealt out by itself
HELD = 3_000_000  #: shingles a task verifies at once; more of one bucket are dealt out as pairs of blocks
_FULL = np.iinfo(np.uint16).max
_LATE = 1 << 62  #: places of the shingles that come last, behind all hashes (shifted to 62 bits; ties are safe)


def shingle_sets(column, words: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    w = Words(column, fold=True)
    h = w.hashes()
    grams = windows(h, words, 3)
    out = []
    for a, n in zip(w.first[:-1].tolist(), w.count.tolist(), strict=True):
        if n >= words:
            g = np.sort(grams[a : a + n - words + 1])
            out.append(g[np.append([True], g[1:] != g[:-1])])
        else:
            out.append(windows(h[a : a + n], n, 5) if n else np.empty(0, np.uint64))
    return out


def needed(a, b, percent: int = 80):
    """Least overlap of two linked sets of sizes a and b: 100 * i >= percent * (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


def head_length(n: int, percent: int = 80) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


def _node(grams: np.ndarray) -> int:
    """Name of a set: a 63-bit hash of its sorted shingles."""
    import xxhash

    return xxhash.xxh3_64_intdigest(grams.tobytes()) >> 1


def point(grams: np.ndarray) -> np.ndarray:
    """Counts per group; a full coordinate stands for any number."""
    return np.minimum(np.bincount((grams >> np.uint64(58)).astype(np.int64), minlength=GROUPS), _FULL).astype(np.uint16)


def _wide(points: np.ndarray) -> np.ndarray:
    out = points.astype(np.int64)
    out[points == _FULL] = 1 << 40
    return out


def partners(points: np.ndarray, size: np.ndarray, part: np.ndarray, percent: int = 80, heads: tuple[np.ndarray, np.ndarray] | None = None, rows: np.ndarray | None = None, done: np.ndarray | None = None):
    """(i, js) for pairs of rows in different parts whose bound reaches what a link needs, each pair once; a packed R-tree.

    heads: for each point, in how many trees it is, and where its head ends in the global order. Of two sets, let X be the
    one whose head ends first: what they share up to there meets in trees, behind it lies at most the rest of X.
    rows: the points to search (all). `part` may be merged, and points may be marked `done`, between two results: pairs of
    one part, or of two points that are done, are left out from there on."""
    rows = np.arange(len(size)) if rows is None else rows
    order = rows[np.lexsort((*points[rows].T[:3], size[rows], part[rows]))]  # one part, then near sizes and counts, share a leaf
    p, n, c = _wide(points[order]), size[order].astype(np.int64), part[order]
    met, last = (x[order] for x in heads) if heads else (n, np.zeros(len(n), np.int64))
    rest = -(-percent * n // 100) - 1
    starts = np.arange(0, len(p), LEAF)
    top, low, high = np.maximum.reduceat(p, starts), np.minimum.reduceat(n, starts), np.maximum.reduceat(n, starts)
    one = np.minimum.reduceat(c, starts)
    single = one == np.maximum.reduceat(c, starts)
    for a in range(0, len(p), LEAF):
        b, box = min(a + LEAF, len(p)), a // LEAF
        # boxes whose sizes are near enough, but for those of this leaf's only part
        boxes = box + np.flatnonzero((percent * low[box:] <= 100 * high[box]) & (percent * low[box] <= 100 * high[box:]))
        if single[box]:
            boxes = boxes[~(single[boxes] & (one[boxes] == one[box]))]
        # the least overlap is smallest for the smallest sizes of both
        boxes = boxes[np.minimum(top[box], top[boxes]).sum(axis=1) >= needed(low[box], low[boxes], percent)]
        if not len(boxes):
            continue
        near = (boxes[:, None] * LEAF + np.arange(LEAF)).ravel()
        near = near[near < len(p)]
        for i in range(a, b):
            j = near[near > i]
            if done is not None and done[order[i]]:
                j = j[~done[order[j]]]
            j = j[(c[j] != c[i]) & (percent * np.maximum(n[j], n[i]) <= 100 * np.minimum(n[j], n[i]))]
            behind = np.where(last[j] == last[i], np.maximum(rest[i], rest[j]), np.where(last[j] < last[i], rest[j], rest[i]))
            j = j[np.minimum(met[i], met[j]) + behind >= needed(n[i], n[j], percent)]
            j = j[np.minimum(p[i], p[j]).sum(axis=1) >= needed(n[i], n[j], percent)]
            j = order[j]
            j = j[part[j] != part[order[i]]]
            if len(j):
                yield order[i], j


def search(points: np.ndarray, size: np.ndarray, part: np.ndarray, percent: int = 80, heads: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All pairs that `partners` gives."""
    found = list(partners(points, size, part, percent, heads))
    none = [np.empty(0, np.int64)]
    return np.concatenate([np.full(len(j), i) for i, j in found] or none), np.concatenate([j for _, j in found] or none)


class Overlaps:
    """Sizes of intersections of lists of small numbers."""

    def __init__(self, lists_of: list[np.ndarray]):
        self.lists, self.size = lists_of, np.array([len(x) for x in lists_of], np.int64)
        self.held = np.zeros(max((int(x.max()) + 1 for x in lists_of if len(x)), default=0), bool)

    def of(self, i: int, js: np.ndarray) -> np.ndarray:
        """Intersection of list i with each of js (none of which is empty)."""
        self.held[self.lists[i]] = True
        same = np.add.reduceat(self.held[np.concatenate([self.lists[j] for j in js])].astype(np.int64), np.cumsum(self.size[js]) - self.size[js])
        self.held[self.lists[i]] = False
        return same


def joining(points: np.ndarray, sets: list[np.ndarray], part: np.ndarray, percent: int, heads: tuple[np.ndarray, np.ndarray], trees: list[np.ndarray]) -> list[tuple[int, int]]:
    """Pairs of rows whose whole sets are similar enough, as few as join the parts that such pairs connect in some tree
    (rows of each). Sets are lists of small numbers; `part` is merged on the way."""
    shared, out = Overlaps(sets), []
    for rows in trees:
        for i, j in partners(points, shared.size, part, percent, heads, rows):
            while len(j):
                some, j = j[:LEAF], j[LEAF:]
                same = shared.of(i, some)
                for x in some[100 * same >= percent * (shared.size[i] + shared.size[some] - same)].tolist():
                    if part[x] != part[i]:
                        out.append((int(i), x))
                        part[part == part[x]] = part[i]
                j = j[part[j] != part[i]]
    return out


def _often(docs: DataFrame, words: int, share: float) -> list[int]:
    """Shingles in more than `share` of the documents, rarest first: each batch reports those it sees that often.

    A shingle over the share is over it in some batch. Their number is bounded by the mean set size over the share."""

    def count(batches):
        for batch in portions(batches):
            sets = shingle_sets(batch.column("text"), words)
            u, n = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.empty(0, np.uint64), np.empty(0, int))
            some = n >= max(3, share * len(sets))
            yield pa.RecordBatch.from_pydict({"gram": pa.array(u[some].view(np.int64)), "n": pa.array(n[some].astype(np.int64))})

    rows = docs.count()
    found = docs.select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") > max(share * rows, 3)).collect()
    return [r["gram"] for r in sorted(found, key=lambda r: (r["n"], r["gram"]))]


def _features(docs: DataFrame, words: int, percent: int, often: list[int]) -> DataFrame:
    """doc_id, n, node (hash of the set), point, head: the shingles that come first in the global order, last: where the
    head ends in that order."""
    late = docs.sparkSession.sparkContext.broadcast(np.array(often, dtype=np.int64).view(np.uint64))

    def work(batches):
        ranks = late.value
        by_hash = np.argsort(ranks)
        held = ranks[by_hash]
        for batch in portions(batches):
            ids, n, node, points, heads, sizes, last = batch.column("doc_id"), [], [], [], [], [], []
            for grams in shingle_sets(batch.column("text"), words):
                k = head_length(len(grams), percent)
                if len(held) and len(grams):
                    at = np.minimum(np.searchsorted(held, grams), len(held) - 1)
                    common = held[at] == grams
                    first = grams[~common][:k]
                    end = int(first[-1] >> np.uint64(2)) if len(first) else 0
                    if len(first) < k:
                        some = np.sort(by_hash[at[common]])[: k - len(first)]
                        first, end = np.append(first, ranks[some]), _LATE + int(some[-1])
                else:
                    first = grams[:k]
                    end = int(first[-1] >> np.uint64(2)) if len(first) else 0
                last.append(end)
                n.append(len(grams))
                node.append(_node(grams))
                points.append(point(grams).tobytes())
                heads.append(first)
                sizes.append(len(first))
            flat_heads = np.concatenate(heads) if heads else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(points, pa.binary()), lists(flat_heads.view(np.int64), np.cumsum(sizes)), pa.array(last, pa.int64())], names=["doc_id", "n", "node", "point", "head", "last"])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, n long, node long, point binary, head array<bigint>, last long")


def _shared_heads(features: DataFrame, batches: int, buckets: int) -> DataFrame:
    """gram, node for every head shingle that two different sets have."""
    dealt = in_batches(features.where("n > 0").select("doc_id", "node", "head"), batches)

    def read(rows: pa.Table):
        grams, row = flat(rows.column("head"))
        node = np.asarray(rows.column("node"))[row]
        order = np.lexsort((node, grams))
        grams, node = grams[order].view(np.uint64), node[order]
        new = np.append([True], (grams[1:] != grams[:-1]) | (node[1:] != node[:-1]))[: len(grams)]
        grams, node = grams[new], node[new]
        keys, first, which = np.unique(grams, return_index=True, return_inverse=True)
        return grams, node, keys, first, which, np.bincount(which, minlength=len(keys)) > 1

    def entries(batch: int, rows: pa.Table) -> pa.Table:
        _, node, keys, first, _, several = read(rows)
        return Dealt(keys, buckets).table(batch, keys=keys, owner=np.where(several, -1, node[first]))

    def shared(rows: pa.Table) -> pa.Table:
        (keys, row), owner = flat(rows.column("keys")), flat(rows.column("owner"))[0]
        _, which = np.unique(keys, return_inverse=True)
        low, high = np.full(which.max(initial=-1) + 1, np.iinfo(np.int64).max), np.full(which.max(initial=-1) + 1, -2)
        np.minimum.at(low, which, owner)
        np.maximum.at(high, which, owner)
        return reply(rows, row, (low < high)[which] | (low == -1)[which])

    def chosen(batch: int, rows: pa.Table, told: pa.Table) -> pa.Table:
        grams, node, keys, _, which, several = read(rows)
        several[Dealt(keys, buckets).answers(told)[0]] = True
        use = several[which]
        return pa.table({"gram": pa.array(grams[use].view(np.int64)), "node": pa.array(node[use])})

    told = answer(ask(dealt, entries, "keys array<bigint>, owner array<bigint>"), shared, "")
    return ask_again(dealt, told, chosen, "gram long, node long").distinct()


def _groups(keys: np.ndarray) -> list[np.ndarray]:
    """Rows of each key."""
    order = np.argsort(keys, kind="stable")
    return np.split(order, np.flatnonzero(keys[order][1:] != keys[order][:-1]) + 1) if len(keys) else []


def _with_partners(trees: DataFrame, buckets: int, percent: int) -> DataFrame:
    """bucket, node, homes, part, met, last: the nodes that have a partner in another component in some tree, one row for
    each bucket; homes: which groups of trees of the bucket."""

    def work(rows: pa.Table) -> pa.Table:
        gram, home, node, n, part, met, last = (np.asarray(rows.column(c)) for c in ("gram", "home", "node", "n", "part", "met", "last"))
        points = np.frombuffer(b"".join(rows.column("point").to_pylist()), np.uint16).reshape(-1, GROUPS)
        done = np.zeros(len(node), bool)
        for tree in _groups(gram):
            for i, j in partners(points, n, part, percent, (met, last), tree, done):
                done[i] = done[j] = True
        use = np.flatnonzero(done)
        use = use[np.lexsort((home[use], node[use]))]
        use = use[np.append([True], (node[use][1:] != node[use][:-1]) | (home[use][1:] != home[use][:-1]))[: len(use)]]
        first = np.flatnonzero(np.append([True], node[use][1:] != node[use][:-1])[: len(use)])
        own = use[first]
        bucket = np.asarray(rows.column("bucket"))[own]
        return pa.table({"bucket": pa.array(bucket, pa.int64()), "node": pa.array(node[own]), "homes": lists(home[use], np.append(first[1:], len(use))[: len(first)]), "part": pa.array(part[own]), "met": pa.array(met[own]), "last": pa.array(last[own])})

    # trees of one group of near copies go together, so that their pairs come up once; very large trees go one by one
    home = F.when(F.col("size") > TREE, F.col("gram")).otherwise(F.col("l"))
    dealt = trees.withColumn("home", home).withColumn("bucket", F.pmod(F.xxhash64("home"), F.lit(buckets)))
    return dealt.groupBy("bucket").applyInArrow(lambda rows: work(rows), "bucket long, node long, homes array<bigint>, part long, met long, last long")


def _in_blocks(rows: DataFrame, count: str) -> DataFrame:
    """Adds `low`, `high`: what is verified in one task. A bucket whose lists (`count` long each) are too large for one is
    dealt into blocks, and each two blocks meet."""
    sizes = rows.groupBy("bucket").agg(F.ceil(F.sum(count) / HELD).alias("blocks"))
    of = rows.join(sizes, "bucket").withColumn("x", F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")))
    met = of.withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return met.select(*rows.columns, F.least("x", "y").alias("low"), F.greatest("x", "y").alias("high"))


def _homes(rows: pa.Table) -> list[np.ndarray]:
    """Rows of each group of trees."""
    homes, at = flat(rows.column("homes"))
    return [at[r] for r in _groups(homes)]


def _coded(column: pa.ChunkedArray | pa.ListArray) -> list[np.ndarray]:
    """The lists of a column with small numbers for their values."""
    values, row = flat(column)
    return np.split(np.unique(values, return_inverse=True)[1], np.cumsum(np.bincount(row, minlength=len(column)))[:-1])


def _meeting(some: DataFrame, heads: DataFrame, in_trees: DataFrame, percent: int) -> DataFrame:
    """Of the nodes `_with_partners` gives, those with a partner that is met in as many trees as a link needs: how many
    trees two nodes share is counted from all head shingles of both."""

    def work(rows: pa.Table) -> pa.Table:
        n, part, met, last = (np.asarray(rows.column(c)) for c in ("n", "part", "met", "last"))
        points = np.frombuffer(b"".join(rows.column("point").to_pylist()), np.uint16).reshape(-1, GROUPS)
        shared, rest, done = Overlaps(_coded(rows.column("grams"))), -(-percent * n // 100) - 1, np.zeros(len(n), bool)
        for home in _homes(rows):
            for i, js in partners(points, n, part, percent, (met, last), home, done):
                for k in range(0, len(js), 8 * LEAF):
                    j = js[k : k + 8 * LEAF]
                    j = j[~(done[i] & done[j])]
                    if not len(j):
                        continue
                    behind = np.where(last[j] == last[i], np.maximum(rest[i], rest[j]), np.where(last[j] < last[i], rest[j], rest[i]))
                    j = j[shared.of(i, j) + behind >= needed(n[i], n[j], percent)]
                    if len(j):
                        done[i] = done[j] = True
        return rows.select(["bucket", "node", "homes", "part", "met", "last", "n"]).filter(pa.array(done))

    wanted = some.select("node").distinct()
    of = heads.join(wanted, "node", "left_semi").groupBy("node").agg(F.collect_list("gram").alias("grams"))
    known = _in_blocks(some.join(in_trees.select("node", "n", "point"), "node"), "met").join(of, "node")
    return known.groupBy("bucket", "low", "high").applyInArrow(lambda rows: work(rows), "bucket long, node long, homes array<bigint>, part long, met long, last long, n long").dropDuplicates(["bucket", "node"])


def _joined_in_trees(some: DataFrame, docs: DataFrame, features: DataFrame, words: int, percent: int) -> DataFrame:
    """a, b: verified links that join components, at most one for each node a task holds."""

    def work(rows: pa.Table) -> pa.Table:
        node, part, met, last = (np.asarray(rows.column(c)) for c in ("node", "part", "met", "last"))
        sets = [x for batch in portions(rows.select(["text"]).to_batches()) for x in shingle_sets(batch.column("text"), words)]
        points = np.stack([point(x) for x in sets])
        found = joining(points, _coded(lists(np.concatenate(sets), np.cumsum([len(x) for x in sets]))), part.copy(), percent, (met, last), _homes(rows))
        a, b = np.array(found, np.int64).reshape(-1, 2).T
        return pa.table({"a": pa.array(node[a]), "b": pa.array(node[b])})

    # texts take less room on the way than sets of hashes
    held = _in_blocks(some, "n").join(_sets(some.select("node").distinct(), docs, features, words, texts=True), "node")
    return held.groupBy("bucket", "low", "high").applyInArrow(lambda rows: work(rows), "a long, b long")


def _sets(wanted: DataFrame, docs: DataFrame, features: DataFrame, words: int, texts: bool = False) -> DataFrame:
    """node, grams: the whole set of each wanted node, read from one of its documents (or, if asked, node and its text)."""

    def sets(batches):
        for batch in portions(batches):
            found = shingle_sets(batch.column("text"), words)
            node = [_node(x) for x in found]
            held = batch.column("text") if texts else lists((np.concatenate(found) if found else np.empty(0, np.uint64)).view(np.int64), np.cumsum([len(x) for x in found]))
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), held], names=["node", "text" if texts else "grams"])

    owner = features.join(wanted, "node").groupBy("node").agg(F.min("doc_id").alias("doc_id")).select("doc_id").where("doc_id is not null").distinct()
    rows = docs.select("doc_id", "text").join(owner, "doc_id").unionByName(docs.select("doc_id", "text").where("doc_id is null"))
    # rows may share an id, so the node is worked out from the text once more
    return rows.select("text").mapInArrow(sets, f"node long, {'text string' if texts else 'grams array<bigint>'}").join(wanted, "node", "left_semi").dropDuplicates(["node"])


def _verified(pairs: DataFrame, docs: DataFrame, features: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs of nodes whose whole sets are similar enough."""
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    held = saved(_sets(wanted, docs, features, words), "sets")
    a, b = held.select(F.col("node").alias("a"), F.col("grams").alias("x")), held.select(F.col("node").alias("b"), F.col("grams").alias("y"))
    same = F.size(F.array_intersect("x", "y")).cast("long")
    return pairs.join(a, "a").join(b, "b").withColumn("i", same).where(100 * F.col("i") >= percent * (F.size("x") + F.size("y") - F.col("i"))).select("a", "b")


def near_components(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    total = text_bytes(docs)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    often = _often(base, words, OFTEN)
    features = saved(_features(base, words, percent, often), "features")
    nodes = features.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("point").alias("point"), F.first("last").alias("last"))
    heads = saved(_shared_heads(features, pieces(total, 4 << 20), pieces(total, 16 << 20, 8)), "heads")

    in_trees = saved(nodes.join(heads.groupBy("node").agg(F.count("*").alias("met")), "node").select("node", "n", "point", "last", "met"), "points")
    x, y = (in_trees.select(F.col("node").alias(k), F.col("n").alias(f"n{k}"), F.col("point").alias(f"p{k}"), F.col("last").alias(f"l{k}")) for k in ("a", "b"))

    def plausible(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b, met) whose sizes, points and heads let them be linked."""
        sized = pairs.join(x, "a").join(y, "b").where((100 * F.col("na") >= percent * F.col("nb")) & (100 * F.col("nb") >= percent * F.col("na")))
        rest = lambda n: F.ceil(percent * F.col(n) / 100) - 1  # noqa: E731  behind the head
        least = F.ceil(percent * (F.col("na") + F.col("nb")) / (100 + percent))
        behind = F.when(F.col("la") < F.col("lb"), rest("na")).when(F.col("la") > F.col("lb"), rest("nb")).otherwise(F.greatest(rest("na"), rest("nb")))
        return sized.where(F.col("met") + behind >= least).mapInArrow(_surviving(percent), "a long, b long")

    # first turn: every tree's points against some of them; which pairs it takes matters for the work of the second only
    centres = heads.groupBy("gram").agg(*[F.min_by("node", F.xxhash64("node", F.lit(k))).alias(f"c{k}") for k in range(CENTRES)])
    star = heads.join(centres, "gram").select("gram", "node", F.explode(F.array_distinct(F.array(*[f"c{k}" for k in range(CENTRES)]))).alias("centre")).where("node <> centre")
    counted = star.groupBy(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).agg(F.count_distinct("gram").alias("met"))
    links = saved(_verified(saved(plausible(counted), "pairs"), base, features, words, percent), "links")

    # second turn: pairs of different components
    part = components(links)
    marked = heads.join(part, "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component")
    open_trees = marked.groupBy("gram").agg(F.min("part").alias("l"), F.max("part").alias("h"), F.count("*").alias("size")).where("l < h").select("gram", "l", "size")
    trees = marked.join(open_trees, "gram").join(in_trees, "node")
    some = saved(_with_partners(trees, pieces(total, 8 << 20, 8), percent), "partners")
    some = saved(_meeting(some, heads, in_trees, percent), "partners")
    more = saved(_joined_in_trees(some, base, features, words, percent), "links")
    joined = components(part.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)) if more.take(1) else part

    named = nodes.select("node", "least").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of = named.join(smallest, "component").select("node", "component_id")
    return features.select("doc_id", "n", "node").join(of, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _surviving(percent: int):
    def work(batches):
        for batch in batches:
            p, q = (_wide(np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, GROUPS)) for c in ("pa", "pb"))
            n, m = np.asarray(batch.column("na")), np.asarray(batch.column("nb"))
            keep = pa.array(np.minimum(p, q).sum(axis=1) >= needed(n, m, percent))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    return work

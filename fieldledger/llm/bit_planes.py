"""Hard negatives by exact integer scores, looked up in subset-sum tables (the method of the Four Russians).

Candidates are packed once: their integer components in two's complement, a byte per eight dimensions and bit plane. For
each anchor and group of eight dimensions a table holds the sums of all 256 subsets of its eight components. A score is
then one lookup per plane and group, shifted by the plane and added up; the sign plane counts negatively. Scores are
exact in 64 bits; a table whose scores could pass 63 bits raises an error, since the result's columns are long.

Anchors meet candidates in blocks: parts of candidates by chunks of anchors, both of bounded size, dealt by hash of the
id. A task sees one part and one chunk and returns at most `positives` rows (first pass) or `positives * negatives` rows
(second pass) for each anchor; windows over these give the first of all. Nothing is broadcast or collected.

Odd rows. Null ids, labels and vectors, vectors with a null, NaN or infinite component, empty ones and those of another
length than most take no part. Rows equal in id, label and vector count once; an anchor's own id is no candidate of it. Ties go to the
smaller id, then to the smaller vector. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldledger.llm.common import pieces, saved
from fieldledger.llm.vectors import finite, usual_length

#: Dimensions of a lookup table: one byte of a bit plane.
GROUP = 8
#: Candidates of a part and anchors of a chunk, on average.
PART, CHUNK = 8_192, 512


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """Tables (anchor, group, 256): entry m is the sum of the components whose bit is set in m."""
    n, d = anchors.shape
    groups = -(-d // GROUP)
    wide = np.zeros((n, groups * GROUP), np.int64)
    wide[:, :d] = anchors
    wide = wide.reshape(n, groups, GROUP)
    out = np.zeros((n, groups, 1 << GROUP), np.int64)
    for k in range(GROUP):  # entries with highest bit k are those below, plus component k
        out[:, :, 1 << k : 2 << k] = out[:, :, : 1 << k] + wide[:, :, k : k + 1]
    return out


def planes(rows: np.ndarray, bits: int) -> np.ndarray:
    """Bytes (plane, group, row) of integers that fit into `bits` bits of two's complement."""
    n, d = rows.shape
    groups = -(-d // GROUP)
    wide = np.zeros((n, groups * GROUP), np.int64)
    wide[:, :d] = rows
    out = np.empty((bits, groups, n), np.uint8)
    for b in range(bits):
        out[b] = np.packbits(((wide >> b) & 1).astype(np.uint8).reshape(n, groups, GROUP), axis=2, bitorder="little")[:, :, 0].T
    return out


def scores(table: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """Inner products of one anchor (its tables) with all packed rows."""
    bits, groups, n = packed.shape
    total = np.zeros(n, np.int64)
    for b in range(bits):
        plane = table[0].take(packed[b, 0])
        for g in range(1, groups):
            plane += table[g].take(packed[b, g])
        total += (plane << b) if b < bits - 1 else -(plane << b)
    return total


def _block(rows: pa.Table, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    v = rows.column("vector").combine_chunks()
    return np.asarray(rows.column("vec_id")), np.asarray(rows.column("label")), np.asarray(v.flatten(), dtype=np.int64).reshape(rows.num_rows, size)


_FOUND = "anchor_id long, anchor_label long, anchor_row long, id long, row long, score long"


def _positives(anchors: pa.Table, part: pa.Table, size: int, bits: int, first: int) -> pa.Table:
    ids, labels, rows = _block(part, size)
    a_ids, a_labels, a_rows = _block(anchors, size)
    a_at, at = np.asarray(anchors.column("row")), np.asarray(part.column("row"))
    packed = planes(rows, bits)
    out = [[] for _ in range(6)]
    for k in range(len(a_ids)):
        s = scores(subset_sums(a_rows[k : k + 1])[0], packed)
        mine = np.flatnonzero((labels == a_labels[k]) & (ids != a_ids[k]))
        best = mine[np.lexsort((at[mine], ids[mine], -s[mine]))[:first]]
        for column, values in zip(out, (np.full(len(best), a_ids[k]), np.full(len(best), a_labels[k]), np.full(len(best), a_at[k]), ids[best], at[best], s[best]), strict=True):
            column.append(values)
    names = [x.split()[0] for x in _FOUND.split(", ")]
    return pa.table({n: pa.array(np.concatenate(c) if c else np.empty(0), pa.int64()) for n, c in zip(names, out, strict=True)})


_MINED = "anchor_id long, anchor_row long, positive_id long, positive_row long, negative_id long, negative_row long, positive_score long, negative_score long"


def _negatives(anchors: pa.Table, part: pa.Table, size: int, bits: int, first: int, low: int, high: int) -> pa.Table:
    ids, labels, rows = _block(part, size)
    a_ids, a_labels, a_rows = _block(anchors, size)
    a_at, at = np.asarray(anchors.column("row")), np.asarray(part.column("row"))
    packed = planes(rows, bits)
    out: list[list] = [[] for _ in range(8)]
    for k, chosen in enumerate(anchors.column("chosen").to_pylist()):
        bounds = [(p, -(-low * p["score"] // 100), high * p["score"] // 100) for p in chosen]
        bounds = [b for b in bounds if b[1] <= b[2]]
        if not bounds:
            continue
        s = scores(subset_sums(a_rows[k : k + 1])[0], packed)
        other = np.flatnonzero((labels != a_labels[k]) & (ids != a_ids[k]) & (s >= min(b[1] for b in bounds)) & (s <= max(b[2] for b in bounds)))
        other = other[np.lexsort((at[other], ids[other], -s[other]))]
        falling = -s[other]
        for p, least, most in bounds:
            a = int(np.searchsorted(falling, -most, "left"))
            best = other[a : min(a + first, int(np.searchsorted(falling, -least, "right")))]
            n = len(best)
            values = (np.full(n, a_ids[k]), np.full(n, a_at[k]), np.full(n, p["id"]), np.full(n, p["row"]), ids[best], at[best], np.full(n, p["score"]), s[best])
            for column, v in zip(out, values, strict=True):
                column.append(v)
    names = [x.split()[0] for x in _MINED.split(", ")]
    return pa.table({n: pa.array(np.concatenate(c) if c else np.empty(0), pa.int64()) for n, c in zip(names, out, strict=True)})


def _first(df: DataFrame, group: list[str], order: list, n: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= n)


def mine(vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, part: int = PART, chunk: int = CHUNK) -> DataFrame:
    """For every row of `anchors` (vec_id, label, vector of integers) and each of its first `positives` same-label rows of
    `vectors`: the first `negatives` rows of another label with low % to high % of the positive's score."""
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    facts = vectors.agg(F.count("*"), F.max(F.array_max(F.transform("vector", lambda x: F.abs(x)))), F.max(F.size("vector"))).first()
    n, most, size = int(facts[0]), int(facts[1] or 0), int(facts[2] or 0)
    if not n:
        return empty
    if most * most * size >= 1 << 62:
        raise ValueError("scores of these vectors do not fit into 64 bits")
    bits = most.bit_length() + 1
    parts, chunks = pieces(n, part), pieces(anchors.count(), chunk)
    deal = lambda by, k, salt: F.pmod(F.xxhash64(by, F.lit(salt)), F.lit(k)).cast("int")
    rows = vectors.withColumn("part", deal("row", parts, 1)).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))

    def against(asked: DataFrame, work, schema: str) -> DataFrame:
        names = [x.split()[0] for x in schema.split(", ")]

        def fn(a: pa.Table, c: pa.Table) -> pa.Table:  # either side may have no rows
            return work(a, c) if a.num_rows and c.num_rows else pa.table({n: pa.array([], pa.int64()) for n in names})

        theirs = asked.withColumn("chunk", deal("row", chunks, 2)).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        theirs = theirs.select([F.col(c).alias(c) for c in theirs.columns])  # both sides may stem from one table
        return theirs.groupBy("part", "chunk").cogroup(rows.groupBy("part", "chunk")).applyInArrow(fn, schema)

    found = against(anchors, lambda a, c: _positives(a, c, size, bits, positives), _FOUND)
    chosen = _first(found, ["anchor_row"], [F.desc("score"), "id", "row"], positives)
    chosen = chosen.groupBy(F.col("anchor_row").alias("row")).agg(F.collect_list(F.struct("id", "row", "score")).alias("chosen"))  # at most `positives` entries
    mined = against(saved(anchors.join(chosen, "row"), "anchors"), lambda a, c: _negatives(a, c, size, bits, negatives, low, high), _MINED)
    best = _first(mined, ["anchor_row", "positive_row"], [F.desc("negative_score"), "negative_id", "negative_row"], negatives)
    return best.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def scaled(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """The rows that take part: vec_id, label, vector of floor(scale * x), and `row`, a number of its own for each."""
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").alias("vector"))
    base = base.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite(F.col("vector")))
    base = base.where(F.size("vector") == usual_length(base))
    base = base.withColumn("vector", F.transform("vector", lambda x: F.floor(x.cast("double") * scale).cast("long")))
    return saved(base.distinct().withColumn("row", F.monotonically_increasing_id()), "vectors")


def hard_negatives(embeddings: DataFrame, anchor_step: int = 100, relabel_step: int = 7, labels: int = 10) -> DataFrame:
    """The query: anchors are the ids divisible by `anchor_step`; ids divisible by `relabel_step` take the next label first."""
    own = F.when(F.col("vec_id") % relabel_step == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    rows = scaled(embeddings).withColumn("label", own)
    return mine(rows, rows.where(F.col("vec_id") % anchor_step == 0))

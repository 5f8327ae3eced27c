"""Ordered work inside groups that may be huge.

`row_number() <= n` filters are left to Spark, which cuts each group inside every partition before the shuffle
(WindowGroupLimit). Work that needs a whole ordered group (exact positions, values carried down, exact medians) is
split: a `bucket` column that never falls along the order cuts each group into pieces, the pieces are summarised,
the few summaries per group are accumulated, and each row is finished inside its own piece. One key may hold a
third of the table and still spreads over all its pieces. Where no such column is at hand, `placed` cuts the table by
range over the whole order, at points Spark samples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import saver

#: Spark cuts `row_number() <= n` before the shuffle up to this n (spark.sql.optimizer.windowGroupLimitThreshold).
GROUP_LIMIT = 1000


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str | None = None) -> DataFrame:
    """The first `n` rows of each group; with no keys, of the table. Beyond Spark's own group limit no task holds a whole
    group: positions are then found by range."""
    if not keys:
        return df.orderBy(*order).limit(n)
    if n > GROUP_LIMIT:
        out = placed(df, keys, order, rank or "_rn").filter(F.col(rank or "_rn") <= n)
        return out if rank else out.drop("_rn")
    out = df.withColumn(rank or "_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col(rank or "_rn") <= n)
    return out if rank else out.drop("_rn")


def first_per_group(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return top_per_group(df, keys, order, 1)


def rejoin(df: DataFrame, small: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """`df` with the other columns of `small`; a null key is a key like any other."""
    own = {k: f"_on{i}" for i, k in enumerate(on)}
    other = small.select(*[F.col(k).alias(a) for k, a in own.items()], *[c for c in small.columns if c not in own])
    cond = F.lit(True)
    for k, a in own.items():
        cond = cond & df[k].eqNullSafe(other[a])
    return df.join(other, cond, how).drop(*own.values())


def _before(pieces: DataFrame, keys: list[str], by: str, n: str, out: str) -> DataFrame:
    """Rows in the pieces in front of each piece."""
    w = W.partitionBy(*keys).orderBy(by).rowsBetween(W.unboundedPreceding, -1)
    return pieces.withColumn(out, F.coalesce(F.sum(n).over(w), F.lit(0)))


def numbered(df: DataFrame, keys: list[str], order: list[Column], bucket: Column, out: str = "pos", fine: Column | None = None) -> DataFrame:
    """Exact 1-based position in the group's order.

    `fine` cuts each bucket again (it must not fall along the order inside a bucket): for buckets that may themselves
    hold a large share of the rows, such as rows without a date.
    """
    df = df.withColumn("_b", bucket).withColumn("_f", fine if fine is not None else F.lit(0))
    small = df.groupBy(*keys, "_b", "_f").agg(F.count("*").alias("_n"))
    small = _before(small, [*keys, "_b"], "_f", "_n", "_in")
    large = _before(small.groupBy(*keys, "_b").agg(F.sum("_n").alias("_bn")), keys, "_b", "_bn", "_out").drop("_bn")
    offsets = rejoin(small, large, [*keys, "_b"]).select(*keys, "_b", "_f", (F.col("_in") + F.col("_out")).alias("_off")) if fine is not None else large.select(
        *keys, "_b", F.lit(0).alias("_f"), F.col("_out").alias("_off")
    )
    joined = rejoin(df, offsets, [*keys, "_b", "_f"])
    own = W.partitionBy(*keys, "_b", "_f").orderBy(*order)
    return joined.withColumn(out, F.row_number().over(own) + F.col("_off")).drop("_b", "_f", "_off")


def slices(df: DataFrame, order: list[Column], parts: int | None = None) -> DataFrame:
    """The rows dealt by range over the whole order into slices, written once in order: `_slice`, and `_row`, the place
    in the slice from 0. Rows equal in all of the order share a slice."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The number counts from 0 in every partition; its low 33 bits are the row's place there.
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    cut = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_slice", F.spark_partition_id()).withColumn("_row", row)
    return saver(df.sparkSession, "slices")(cut, "rows")


def _carry(sums: DataFrame, keys: list[str]) -> DataFrame:
    """What a group has in the slices before; only the first group of a slice can have any, so a row per slice at most."""
    before = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    return sums.select("_slice", *keys, F.sum("_n").over(before).alias("_off")).filter("_off > 0")


def counted(df: DataFrame, keys: list[str], order: list[Column], flag: Column, out: str, parts: int | None = None) -> DataFrame:
    """How many flagged rows stand at or before each row in its group's order, for groups of any size.

    The rows are dealt by range over keys and order; sums run inside a group's rows of one slice, and what the group has
    in the slices before is added. Rows equal in all of the order count in the order they were written.
    """
    cut = slices(df.withColumn("_flag", flag.cast("long")), [*[F.col(k).asc_nulls_first() for k in keys], *order], parts)
    carry = _carry(cut.groupBy("_slice", *keys).agg(F.sum("_flag").alias("_n")), keys)
    own = W.partitionBy("_slice", *keys).orderBy("_row").rowsBetween(W.unboundedPreceding, 0)
    joined = rejoin(cut.withColumn("_own", F.sum("_flag").over(own)), F.broadcast(carry), ["_slice", *keys], "left")
    return joined.withColumn(out, F.col("_own") + F.coalesce("_off", F.lit(0))).drop("_slice", "_row", "_off", "_flag", "_own")


def placed(df: DataFrame, keys: list[str], order: list[Column], out: str = "pos", parts: int | None = None) -> DataFrame:
    """Exact 1-based position in the order of each group (with no keys: of the table); `order` should be total."""
    if keys:
        return counted(df, keys, order, F.lit(1), out, parts)
    cut = slices(df, order, parts)
    carry = _carry(cut.groupBy("_slice").agg(F.count("*").alias("_n")), [])
    joined = cut.join(F.broadcast(carry), "_slice", "left")
    return joined.withColumn(out, F.col("_row") + F.coalesce("_off", F.lit(0)) + 1).drop("_slice", "_row", "_off")


def carried_down(df: DataFrame, keys: list[str], order: str, bucket: Column, value: Column, out: str) -> DataFrame:
    """The last non-null `value` at or before each row; `order` is one column, unique in the group."""
    df = df.withColumn("_b", bucket).withColumn("_v", value)
    last_here = F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col(order)))
    pieces = df.groupBy(*keys, "_b").agg(last_here.alias("_l"))
    before = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    pieces = pieces.withColumn("_in", F.last("_l", ignorenulls=True).over(before)).drop("_l")
    own = W.partitionBy(*keys, "_b").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    joined = rejoin(df, pieces, [*keys, "_b"])
    return joined.withColumn(out, F.coalesce(F.last("_v", ignorenulls=True).over(own), F.col("_in"))).drop("_b", "_v", "_in")


def value_bucket(value: Column, per_fold: int = 64) -> Column:
    """A bucket that never falls as the value rises, of one relative width at every size of double: log steps either
    side of zero, moved so that the smallest positive double is still above it."""
    size = F.floor(F.log(F.abs(value)) * per_fold) + 750 * per_fold
    return F.when(value == 0, 0).otherwise(F.signum(value) * size).cast("long")


def exact_median(df: DataFrame, keys: list[str], value: str, out: str = "median", upper: bool = False) -> DataFrame:
    """Mean of the two middle values per group (or the upper one of them), nulls left out.

    Equal values are counted first (map-side). A histogram per group finds the one or two buckets the middle ranks fall
    in, a finer one within these does so again, and only the values of what is left are ranked. A null key is a group.
    """
    near = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    total = near.groupBy(*keys).agg(F.sum("_n").alias("_tot"))
    ranks = total.select(*keys, F.floor((F.col("_tot") + 1) / 2).alias("_lo"), (F.floor(F.col("_tot") / 2) + 1).alias("_hi"), F.lit(0).cast("long").alias("_off"))
    near = rejoin(near, ranks, keys)
    holds = lambda rank, cum, n: (rank > cum - n) & (rank <= cum)
    for per_fold in (64, 64 << 14):
        near = near.withColumn("_b", value_bucket(F.col("_v"), per_fold))
        upto = W.partitionBy(*keys, "_off").orderBy("_b").rowsBetween(W.unboundedPreceding, 0)
        hist = near.groupBy(*keys, "_off", "_b").agg(F.sum("_n").alias("_bn"), F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"))
        hist = hist.withColumn("_cum", F.sum("_bn").over(upto) + F.col("_off"))
        hist = hist.filter(holds(F.col("_lo"), F.col("_cum"), F.col("_bn")) | holds(F.col("_hi"), F.col("_cum"), F.col("_bn")))
        hist = hist.select(*keys, "_off", "_b", (F.col("_cum") - F.col("_bn")).alias("_next"))
        near = rejoin(near, hist, [*keys, "_off", "_b"]).drop("_off", "_b").withColumnRenamed("_next", "_off")
    inside = W.partitionBy(*keys, "_off").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    near = near.withColumn("_at", F.sum("_n").over(inside) + F.col("_off"))
    pick = lambda r: F.max(F.when(holds(F.col(r), F.col("_at"), F.col("_n")), F.col("_v")))
    return near.groupBy(*keys).agg((pick("_hi") if upper else (pick("_lo") + pick("_hi")) / 2).alias(out))


def struct_list(df: DataFrame, keys: list[str], rank: str, fields: list[Column], out: str) -> DataFrame:
    """Rows already cut to a few per group, as one ordered array of structs."""
    s = F.sort_array(F.collect_list(F.struct(F.col(rank).alias("_r"), F.struct(*fields).alias("_s"))))
    return df.groupBy(*keys).agg(F.transform(s, lambda x: x["_s"]).alias(out))

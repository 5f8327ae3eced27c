"""The published index: sorted shards, their statistics, the manifest, text chunks, publishing, search in waves.

Layout: ``{base}/{stamp}/shards/shard=N/*.json.gz``, ``{base}/{stamp}/manifest`` and a pointer ``{base}/CURRENT``.
The shard number is a partition column, so a reader that joins to the filtered manifest reads the surviving shards
only (dynamic partition pruning) and no list of paths passes through the driver.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.groups import placed, top_per_group
from ..operators.order import newest_first
from ..session import cut

# Rows per shard, texts per chunk.
SHARD_ROWS, CHUNK_ROWS = 40_000, 4_000


def read_shards(spark: SparkSession, paths: str | list[str], schema: T.StructType | str) -> DataFrame:
    """JSON lines, gzip or plain; blank lines give no rows. One gzip file is one task."""
    return spark.read.schema(schema).json(paths)


def with_shards(df: DataFrame, order: list[Column] | None = None, rows: int = SHARD_ROWS) -> DataFrame:
    """Exact shard numbers in the sort order (newest first, undated last): every shard but the last holds `rows` rows."""
    return placed(df, [], order or newest_first(), "_pos").withColumn("shard", F.floor((F.col("_pos") - 1) / rows).cast("int"))


def write_shards(df: DataFrame, path: str, order: list[Column] | None = None, rows: int = SHARD_ROWS) -> DataFrame:
    """Newest first, undated last. Shards are dealt to tasks in turn, and each is sorted and written by one task.
    Returns the rows with their shards, from the working table they were placed in."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbered = with_shards(df, order, rows)
    dealt = numbered.repartitionById(parts, F.pmod("shard", F.lit(parts)).cast("int"))
    dealt.sortWithinPartitions("shard", "_pos").drop("_pos").write.mode("overwrite").partitionBy("shard").option("compression", "gzip").json(path)
    return numbered


def shard_stats(df: DataFrame, posted: str = "posted_at", seen: str = "first_seen") -> DataFrame:
    """S05."""
    return df.groupBy("shard").agg(
        F.count("*").alias("count"),
        F.max(posted).alias("newest"),
        F.min(posted).alias("oldest"),
        F.count(F.when(F.col(posted).isNull(), True)).alias("undated"),
        F.max(seen).alias("newest_first_seen"),
        F.min(seen).alias("oldest_first_seen"),
    )


def surviving(manifest: DataFrame, cutoff: Column | None = None, seen_after: Column | None = None) -> DataFrame:
    """Shards a query must read. A shard with undated rows cannot be ruled out by date, and one without a
    first-seen statistic not by that.

    The tests are plain comparisons: those Spark counts as selective, which is what makes it prune partitions by them.
    """
    if cutoff is not None:
        manifest = manifest.filter((F.col("undated") > 0) | (F.col("newest") >= cutoff))
    if seen_after is not None:
        always = F.lit("9999-01-01 00:00:00").cast("timestamp_ntz")
        manifest = manifest.filter(F.coalesce("newest_first_seen", always) > seen_after)
    return manifest


def read_index(spark: SparkSession, path: str, schema: T.StructType | str, manifest: DataFrame, cutoff: Column | None = None, seen_after: Column | None = None) -> DataFrame:
    """Rows of the surviving shards. The manifest is one row per 40,000 rows; Spark broadcasts it if it is small."""
    keep = surviving(manifest, cutoff, seen_after).select("shard")
    return read_shards(spark, path, schema).join(keep, "shard")


def read_store_index(spark: SparkSession, path: str, schema: T.StructType | str, manifest: DataFrame, seen_after: Column) -> DataFrame:
    """Store shards lie newest-found first, so the first old shard ends the read; by statistics this is the same filter."""
    return read_index(spark, path, schema, manifest, seen_after=seen_after)


def build_manifest(df: DataFrame, source: str = "source", company: list[str] | None = None) -> DataFrame:
    """Totals, companies and counts by source in one row. Sources are few by nature (a fixed list)."""
    totals = df.agg(F.count("*").alias("total"), F.countDistinct(*(company or ["source", "company"])).alias("companies"))
    by = df.groupBy(source).agg(F.count("*").alias("n")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.coalesce(source, F.lit("unknown")), "n")))).alias("by_source"))
    return totals.withColumn("by_source", by.scalar())


def append_chunks(df: DataFrame, day: str, size: int = CHUNK_ROWS, start: int = 0, live: Column | None = None) -> DataFrame:
    """Rows with text and no chunk yet get one, `size` rows each; the caller appends the result by chunk."""
    todo = df.filter(F.col("chunk").isNull() & F.col("text").isNotNull() & (live if live is not None else F.lit(True)))
    number = (F.floor((F.col("_pos") - 1) / size) + start).cast("string")
    return placed(todo, [], [F.col("id")], "_pos").withColumn("chunk", F.concat(F.lit(f"desc-{day}-"), F.lpad(number, F.greatest(F.lit(3), F.length(number)), F.lit("0")))).drop("_pos")


# ---------------------------------------------------------------- S08 publish

def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file by way of a new file and a rename, so that readers see the old or the new one."""
    fs, p = _fs(spark, path)
    tmp = spark._jvm.org.apache.hadoop.fs.Path(path + ".new")
    out = fs.create(tmp, True)
    out.write(bytearray(text.encode()))
    out.close()
    ctx = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    opts = spark._jvm.org.apache.hadoop.fs.Options.Rename
    arr = spark.sparkContext._gateway.new_array(opts, 1)
    arr[0] = opts.OVERWRITE
    ctx.rename(tmp, p, arr)


def read_text(spark: SparkSession, path: str) -> str | None:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    text = bytes(bytearray(stream.readAllBytes())).decode().strip()
    stream.close()
    return text


def current(spark: SparkSession, base: str) -> str | None:
    return read_text(spark, f"{base}/CURRENT")


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def next_chunk(rows: DataFrame, day: str) -> int:
    """The number after the last chunk of that day among the rows."""
    last = rows.filter(F.col("chunk").startswith(f"desc-{day}-")).agg(F.max(F.substring_index("chunk", "-", -1).cast("int"))).first()[0]
    return 0 if last is None else last + 1


def publish(spark: SparkSession, df: DataFrame, base: str, stamp: str, rows: int = SHARD_ROWS, order: list[Column] | None = None, totals: DataFrame | None = None, posted: str = "posted_at") -> str:
    """New shards, then their manifest (and the row of totals), then the pointer; only then the directory the
    pointer named before goes."""
    old = current(spark, base)
    root = f"{base}/{stamp}"
    numbered = write_shards(df, f"{root}/shards", order, rows)
    # The shards are not parsed again: of the rows as they were placed, the two dates as JSON keeps them.
    dates = T.StructType([f for f in df.schema.fields if f.name in (posted, "first_seen")])
    kept = F.from_json(F.to_json(F.struct(*dates.names)), dates)
    stored = numbered.select("shard", kept.alias("_d")).select("shard", "_d.*")
    shard_stats(stored, posted).write.mode("overwrite").parquet(f"{root}/manifest")
    if totals is not None:
        totals.write.mode("overwrite").parquet(f"{root}/totals")
    write_text(spark, f"{base}/CURRENT", stamp)
    if old and old != stamp:
        remove(spark, f"{base}/{old}")
    return root


def read_manifest(spark: SparkSession, root: str) -> DataFrame:
    """One row per shard, as `publish` saved it."""
    return spark.read.parquet(f"{root}/manifest")


def published_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunks that hold texts, by their folder names: no text is read."""
    return spark.read.parquet(path).select("chunk").distinct()


def drop_chunk_folders(spark: SparkSession, path: str, used: DataFrame) -> None:
    """Chunks no published row names any more lose their folder. One row per unused chunk passes the driver."""
    for r in published_chunks(spark, path).join(used.select("chunk"), "chunk", "left_anti").toLocalIterator():
        remove(spark, f"{path}/chunk={r['chunk']}")


# ---------------------------------------------------------------- search in waves

class Found(NamedTuple):
    """What a search gives: its rows, how many rows matched in the shards it read, and how many shards these are."""

    rows: DataFrame
    matched: int
    shards: int


def in_waves(spark: SparkSession, root: str, schema: T.StructType | str, cutoff: Column | None = None, seen_after: Column | None = None, first: int | None = None, whole: bool = False):
    """(rows, shards) of the surviving shards in publish order: `first` shards (one for each core), then twice as many, and
    so on; all at once where `whole` is set. The saved manifest decides each wave; only its last shard number passes the driver."""
    left = surviving(read_manifest(spark, root), cutoff, seen_after).select("shard")
    done, size = -1, None if whole else first or spark.sparkContext.defaultParallelism
    while True:
        ahead = left.filter(F.col("shard") > done)
        last, n = (ahead.orderBy("shard").limit(size) if size else ahead).agg(F.max("shard"), F.count("*")).first()
        if last is None:
            return
        inside = (F.col("shard") > done) & (F.col("shard") <= last)
        # The bounds prune folders at once; the join leaves out the shards between them that the manifest ruled out.
        yield read_shards(spark, f"{root}/shards", schema).filter(inside).join(left.filter(inside), "shard").drop("shard"), n
        if not size:
            return
        done, size = last, size * 2


def first_in_waves(spark: SparkSession, waves, hits, caps: list[tuple[list[str], int]], order: list[Column], n: int, schema: T.StructType | None = None) -> Found:
    """The first `n` of `hits(rows)` in publish order, after each cap (keys, rows per group) in turn.

    Later shards hold later rows, so what the first waves leave is final: reading ends as soon as `n` rows are left.
    Between waves only rows under the first cap (or the first `n`) are kept.
    """
    kept = out = None
    matched = shards = 0
    for wave, size in waves:
        count = Observation()
        new = hits(wave).observe(count, F.count(F.lit(1)).alias("n"))
        if caps:
            new = top_per_group(new, caps[0][0], order, caps[0][1])
        new = cut(new.orderBy(*order).limit(n) if len(caps) < 2 else new)
        matched, shards = matched + count.get["n"], shards + size
        if kept is not None:
            new = kept.unionByName(new)
            new = cut(top_per_group(new, caps[0][0], order, caps[0][1]) if caps else new)
        kept = out = new
        for keys, each in caps[1:]:
            out = top_per_group(out, keys, order, each)
        out = out.orderBy(*order).limit(n)
        if out.count() >= n:
            break
    if out is None:
        out = hits(spark.createDataFrame([], schema)).limit(0)
    return Found(out, matched, shards)


def drop_unused_chunks(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunk references of chunks that are gone become null."""
    c = chunks.select(F.col("chunk"), F.lit(True).alias("_has")).distinct()
    return rows.join(c, "chunk", "left").withColumn("chunk", F.when(F.col("_has"), F.col("chunk"))).drop("_has")

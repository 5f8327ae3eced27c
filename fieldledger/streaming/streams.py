"""Structured Streaming forms of the incremental work.

Every stream runs with a checkpoint and `availableNow`, so a restart goes on where it stopped. Batch writers name
their output by batch number: a batch that is replayed after a failure writes the same folder again.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.windows import DROP_ACCEPT_RUNS, DROP_MIN
from ..sources.files import domain
from ..sources.index import current, read_text, remove, write_text


def finish(writer, checkpoint: str) -> None:
    """Run a stream over what is there and stop."""
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def file_stream(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "parquet", per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.format(fmt).schema(schema)
    if per_trigger:
        r = r.option("maxFilesPerTrigger", per_trigger)
    return r.load(path)


def ingest_stream(spark: SparkSession, path: str, kind: str, out: str, checkpoint: str, per_trigger: int | None = None) -> None:
    """Ranked list files to valid domains; files read before are not read again."""
    lines = file_stream(spark, path, "value string", "text", per_trigger)
    found = lines.select(domain(F.col("value"), kind).alias("domain")).filter("domain IS NOT NULL")
    finish(found.writeStream.format("parquet").outputMode("append").option("path", out), checkpoint)


# ---------------------------------------------------------------- R05

#: Key buckets of a table, and how many segments of a bucket are read together before they are merged into one.
BUCKETS, SEGMENTS = 64, 6


def _spans(rows: DataFrame, attrs: list[str]) -> DataFrame:
    """One row per id: first and last sight, and the attributes of the newest one."""
    g = rows.groupBy("id").agg(F.max(F.struct("last_seen", *attrs)).alias("_n"), F.min("first_seen").alias("first_seen"))
    return g.select("id", *[F.col("_n")[a].alias(a) for a in attrs], "first_seen", F.col("_n.last_seen").alias("last_seen"))


def segments(spark: SparkSession, base: str, version: str | None) -> dict[int, list[str]]:
    """The folders that make up each bucket in a version; as many lines as buckets times segments at most."""
    text = read_text(spark, f"{base}/versions/{version}") if version else None
    out: dict[int, list[str]] = {}
    for line in (text or "").split():
        out.setdefault(int(line.rsplit("bucket=", 1)[1]), []).append(line)
    return out


def _read_segments(spark: SparkSession, base: str, parts: dict[int, list[str]]) -> DataFrame:
    return spark.read.option("basePath", f"{base}/rows").parquet(*[f"{base}/rows/{s}" for own in parts.values() for s in own])


def scd_table(spark: SparkSession, base: str, attrs: list[str]) -> DataFrame:
    """The table as of the newest complete batch: segments merged while they are read."""
    return _spans(_read_segments(spark, base, segments(spark, base, current(spark, base))), attrs)


def scd_stream(stream: DataFrame, base: str, checkpoint: str, day: str, attrs: list[str], buckets: int = BUCKETS, most: int = SEGMENTS) -> None:
    """Snapshots merged into a table of key buckets. A batch writes one segment for each bucket it touches; a bucket
    with more than `most` segments has them merged into one; untouched buckets are not written.

    Each id spans the days of its own rows, so a batch of several days or a late one dates nothing wrongly; the
    attributes are those of the newest day. A version names its segments; the pointer moves once they are written. A batch
    that is replayed starts from the version before its own. Segments of neither of the last two versions are removed.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        snap = batch.groupBy("id").agg(F.min(day).alias("first_seen"), F.max(day).alias("last_seen"), *[F.max_by(a, day).alias(a) for a in attrs])
        snap = snap.select("id", *attrs, "first_seen", "last_seen", F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int").alias("bucket"))
        old = current(spark, base)
        if old == f"v{number}":
            old = f"v{number - 1}" if number else None
        snap.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{base}/rows/batch={number}")
        touched = [r["bucket"] for r in spark.read.schema(snap.schema).parquet(f"{base}/rows/batch={number}").select("bucket").distinct().collect()]  # at most `buckets`
        before = segments(spark, base, old)
        now = {b: list(s) for b, s in before.items()}
        for b in touched:
            now.setdefault(b, []).append(f"batch={number}/bucket={b}")
        long = {b: s for b, s in now.items() if b in touched and len(s) > most}
        if long:
            merged = _read_segments(spark, base, long)
            merged = _spans(merged, attrs).withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int"))
            merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{base}/rows/batch={number}m")
            now |= {b: [f"batch={number}m/bucket={b}"] for b in long}
        write_text(spark, f"{base}/versions/v{number}", "\n".join(s for own in now.values() for s in own))
        write_text(spark, f"{base}/CURRENT", f"v{number}")
        older = segments(spark, base, f"v{number - 2}") if number > 1 else {}
        keep = {s for part in (before, now) for own in part.values() for s in own}
        for s in (s for own in older.values() for s in own if s not in keep):
            remove(spark, f"{base}/rows/{s}")

    finish(stream.writeStream.foreachBatch(merge), checkpoint)


def _updates(counts: DataFrame, out: str, checkpoint: str) -> None:
    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    finish(counts.writeStream.outputMode("update").foreachBatch(keep), checkpoint)


def last_update(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """The newest version of every row an update stream wrote."""
    u = spark.read.parquet(out)
    cols = [c for c in u.columns if c not in (*keys, "batch")]
    return u.groupBy(*keys).agg(F.max_by(F.struct(*cols), "batch").alias("_u")).select(*keys, "_u.*")


def rate_stream(stream: DataFrame, ts: str, client: str, out: str, checkpoint: str, late: str = "10 minutes") -> None:
    """Requests per client in hour windows that start every five minutes."""
    s = stream.withWatermark(ts, late)
    counts = s.groupBy(F.window(ts, "1 hour", "5 minutes").alias("w"), client).agg(F.count("*").alias("requests"))
    _updates(counts.select(F.col("w.start").alias("start"), client, "requests"), out, checkpoint)


def daily_stream(stream: DataFrame, ts: str, amount: str, out: str, checkpoint: str, late: str = "1 day") -> None:
    """Calls and spend per day."""
    s = stream.withWatermark(ts, late)
    counts = s.groupBy(F.window(ts, "1 day").alias("w")).agg(F.count("*").alias("calls"), F.sum(amount).alias("amount"))
    _updates(counts.select(F.col("w.start").alias("day"), "calls", "amount"), out, checkpoint)


# ---------------------------------------------------------------- R08

#: Days a company's verdicts can still change: a load that comes later than that is kept apart as `late`.
REVISED_DAYS = 60
_VERDICT = "company string, day string, note string, ok boolean, last_good string"


class OutageGuard(StatefulProcessor):
    """State per company: its loads of the last `revised` days, and what stood before them (drops in a row, last good load).

    A load that comes late or again takes its place by day, and the days from there on are judged anew. Of drops in a row
    each seventh is accepted, which ends the row.
    """

    def __init__(self, revised: int):
        self.revised = revised

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.loads = handle.getListState("loads", "day string, loaded boolean, short boolean")
        self.before = handle.getValueState("before", "streak int, last_good string, upto string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802,N803 - Spark's names
        new = pd.concat(list(rows), ignore_index=True)
        new["day"] = new["day"].astype(str)
        new["short"] = new["loaded"] & (new["expected"] >= DROP_MIN) & (new["open"] < new["expected"] / 2)
        streak, good, upto = self.before.get() if self.before.exists() else (0, None, "")
        late = new["day"] <= upto
        held = pd.DataFrame(list(self.loads.get()), columns=["day", "loaded", "short"])
        # Of two loads of one day the one that came last stands.
        days = pd.concat([held, new.loc[~late, ["day", "loaded", "short"]]], ignore_index=True).drop_duplicates("day", keep="last").sort_values("day", ignore_index=True)
        days = days.astype({"loaded": bool, "short": bool})
        # Place in the row of short days: the rows of the table and, for the first of them, the days before the table.
        rowno = (~days["short"]).cumsum()
        place = days["short"].astype(int).groupby(rowno).cumsum() + streak * ((rowno == 0) & days["short"])
        note = pd.Series(None, index=days.index, dtype=object)
        note[days["short"]] = "drop"
        note[days["short"] & (place % DROP_ACCEPT_RUNS == 0)] = "drop accepted"
        note[~days["loaded"]] = "error"
        days = days.assign(note=note, ok=~note.isin(["error", "drop"]))
        # The newest good day so far: days sort as texts, and one that was not good counts as the empty text.
        last = np.maximum.accumulate(np.where(days["ok"], days["day"], good or "")) if len(days) else []
        days["last_good"] = pd.Series(last, index=days.index, dtype=object).replace("", None)
        if len(days):
            edge = str((pd.Timestamp(days["day"].iloc[-1]) - pd.Timedelta(days=self.revised)).date())
            gone = days["day"] <= edge
            if gone.any():
                last = days[gone].iloc[-1]
                streak = int(place[gone].iloc[-1]) % DROP_ACCEPT_RUNS if last["short"] else 0
                self.before.update((streak, last["last_good"], last["day"]))
            self.loads.put(list(days.loc[~gone, ["day", "loaded", "short"]].itertuples(index=False, name=None)))
        told = days[days["day"] >= new.loc[~late, "day"].min()] if (~late).any() else days.iloc[:0]
        out = pd.concat([told[["day", "note", "ok", "last_good"]], pd.DataFrame({"day": new.loc[late, "day"], "note": "late", "ok": False, "last_good": None})])
        out = out.astype(object).where(out.notna(), None)
        yield out.assign(company=key[0], ok=out["ok"].astype(bool))[["company", "day", "note", "ok", "last_good"]]


@contextmanager
def rocks_state(spark: SparkSession) -> Iterator[None]:
    """Keyed state with lists needs the RocksDB store; a stream keeps the store it starts with."""
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, old)


def guard_stream(stream: DataFrame, out: str, checkpoint: str, revised: int = REVISED_DAYS) -> None:
    """The outage guard as keyed state. Verdicts are updates: of a company and day the newest batch's holds (`last_update`)."""
    with rocks_state(stream.sparkSession):
        judged = stream.groupBy("company").transformWithStateInPandas(OutageGuard(revised), _VERDICT, "Update", "None")
        _updates(judged, out, checkpoint)


# ---------------------------------------------------------------- R03, R09

def seen_stream(stream: DataFrame, ts: str, out: str, checkpoint: str, keep: str = "180 days") -> None:
    """Each id once within the time a delivered row is remembered."""
    once = stream.withWatermark(ts, keep).dropDuplicatesWithinWatermark(["id"])
    finish(once.writeStream.format("parquet").outputMode("append").option("path", out), checkpoint)


def effective_date(posted: Column, first_seen: Column) -> Column:
    """A re-dated row is no newer than its first sighting."""
    return F.when(posted < first_seen, posted).otherwise(first_seen)


def late_policy(stream: DataFrame, out: str, checkpoint: str, late: str = "7 days") -> None:
    """New rows per day by effective date; the watermark is on the first sighting, which only moves forward."""
    s = stream.withWatermark("first_seen", late).withColumn("day", F.to_date(effective_date(F.col("posted_at"), F.col("first_seen"))))
    counts = s.groupBy(F.window("first_seen", "30 days").alias("w"), "day").agg(F.count("*").alias("n"))
    _updates(counts.select(F.col("w.start").alias("start"), "day", "n"), out, checkpoint)

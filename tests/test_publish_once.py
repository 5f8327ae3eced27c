"""The manifest is made from the rows as they were placed: the shards just written are not parsed again."""

from pyspark.sql.readwriter import DataFrameReader

from fieldledger.sources import index as I


def test_manifest_without_reading_the_shards(spark, tmp_path, monkeypatch):
    rows = [(f"j{k}", None if k % 5 == 0 else f"2001-01-{k % 28 + 1:02d} 00:00:00.{k:06d}", f"2001-02-{k % 28 + 1:02d} 01:02:03.{k * 7:06d}") for k in range(50)] + [(None, None, None)]
    jobs = spark.createDataFrame(rows, "id string, a string, b string").selectExpr("id", "cast(a as timestamp_ntz) AS posted_at", "cast(b as timestamp_ntz) AS first_seen")

    def refuse(*_, **__):
        raise AssertionError("the shards were parsed again")

    with monkeypatch.context() as m:
        m.setattr(DataFrameReader, "json", refuse)
        root = I.publish(spark, jobs, str(tmp_path), "run1", 7)
    stored = I.read_shards(spark, f"{root}/shards", "id string, posted_at timestamp_ntz, first_seen timestamp_ntz, shard int")
    assert {r.shard: r.asDict() for r in I.read_manifest(spark, root).collect()} == {r.shard: r.asDict() for r in I.shard_stats(stored).collect()}

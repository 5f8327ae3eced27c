"""Placement by range, and searches that read a published index shard by shard."""

import contextlib
import datetime as dt
import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from fieldledger.functions.predicates import job_filter
from fieldledger.operators import groups as G
from fieldledger.operators.order import newest_first
from fieldledger.plans import hospitals as PH
from fieldledger.plans import jobs as PJ
from fieldledger.plans import stores as PS
from fieldledger.sources import index as I

SCHEMA = "id string, source string, company string, company_name string, title string, location string, country string, additional array<string>, remote boolean, department string, posted_at timestamp_ntz, first_seen timestamp_ntz, pay_min double, pay_max double, currency string"
NOW = "2026-06-30 00:00:00"


def ts(text):
    return F.lit(text).cast("timestamp_ntz")


def postings(n=600, undated=0.1, seed=3):
    r = random.Random(seed)
    day = dt.datetime(2026, 6, 30)
    rows = []
    for i in range(n):
        posted = None if r.random() < undated else day - dt.timedelta(days=r.randrange(300))
        rows.append((f"{i:05d}", "lever", f"c{r.randrange(9)}", "C", r.choice(["RN", "Engineer", "Cook"]), "NY", "US", [], False, "d", posted, day - dt.timedelta(days=r.randrange(200)), 1.0, 2.0, "USD"))
    return rows


def test_positions_of_mostly_undated_rows_are_spread(spark):
    df = spark.createDataFrame([(i, None if i % 10 else dt.datetime(1980 + i % 40, 1, 1)) for i in range(20_000)], "id int, posted_at timestamp_ntz")
    cut = G.slices(df.repartition(7), newest_first(), 8)
    sizes = [r["count"] for r in cut.groupBy("_slice").count().collect()]
    assert sum(sizes) == 20_000 and max(sizes) <= 2 * 20_000 / 8
    got = {r.id: r.pos for r in G.placed(df, [], newest_first(), parts=8).collect()}
    dated = sorted((i for i in range(20_000) if i % 10 == 0), key=lambda i: (-(1980 + i % 40), i))
    assert [got[i] for i in dated + [i for i in range(20_000) if i % 10]] == list(range(1, 20_001))


def test_old_rows_come_before_undated_ones(spark):
    rows = [("a", "k", dt.datetime(1980, 1, 1)), ("b", "k", None), ("c", "k", dt.datetime(1996, 1, 1)), ("d", None, None), ("e", None, dt.datetime(1980, 1, 1))]
    df = spark.createDataFrame(rows, "id string, k string, posted_at timestamp_ntz")
    got = {r.id: r.pos for r in G.placed(df, ["k"], newest_first(), parts=3).collect()}
    assert got == {"c": 1, "a": 2, "b": 3, "e": 1, "d": 2}


def test_a_hot_group_beyond_sparks_limit(spark, monkeypatch):
    monkeypatch.setattr(G, "GROUP_LIMIT", 10)
    rows = [(i, "hot" if i % 4 else f"k{i % 40}") for i in range(3000)]
    got = G.top_per_group(spark.createDataFrame(rows, "i int, k string"), ["k"], [F.col("i").desc()], 700, "rn").collect()
    want = sorted(i for i, k in rows if k == "hot")[-700:]
    assert sorted(r.i for r in got if r.k == "hot") == want and len(got) == 700 + 750
    assert {r.rn for r in got if r.k == "hot"} == set(range(1, 701))


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    df = spark.createDataFrame(postings(), SCHEMA)
    return df, I.publish(spark, df, str(tmp_path_factory.mktemp("index")), "one", 30)


def direct(df, q):
    hits = df.filter(job_filter(q, ts(NOW)))
    if q.get("per_company"):
        hits = G.top_per_group(hits, PJ.KEYS, newest_first(), q["per_company"])
    return [r.id for r in hits.orderBy(*newest_first()).limit(q["max_jobs"]).collect()]


QUERIES = [
    dict(title=["RN"], max_jobs=5),
    dict(title=["RN"], max_jobs=25, per_company=4),
    dict(title=["RN", "cook"], posted_within=60, max_jobs=1000),
    dict(posted_within=20, per_company=3, max_jobs=1000),
    dict(seen_after="2026-06-20 00:00:00", max_jobs=40),
    dict(title=["nobody"], max_jobs=3),
]


@pytest.mark.parametrize("q", QUERIES)
def test_waves_give_what_the_whole_table_gives(spark, index, q):
    df, root = index
    found = PJ.job_search_index(spark, root, df.schema, q, ts(NOW))
    assert [r.id for r in found.rows.collect()] == direct(df, q)
    assert found.matched >= found.rows.count() and found.shards <= 20


def test_fewer_files_are_read_where_the_filter_allows(spark, index, tmp_path):
    df, _ = index
    root = I.publish(spark, df, str(tmp_path / "own"), "one", 30)
    few = PJ.job_search_index(spark, root, df.schema, dict(title=["RN"], max_jobs=5), ts(NOW))
    dated = PJ.job_search_index(spark, root, df.schema, dict(posted_within=60, max_jobs=10_000), ts(NOW))
    every = PJ.job_search_index(spark, root, df.schema, dict(title=["RN"], max_jobs=10_000), ts(NOW))
    assert few.shards < dated.shards < every.shards == 20
    # Shards the manifest rules out may even be unreadable.
    old = {r.shard for r in I.read_manifest(spark, root).filter("undated = 0 AND newest < '2026-05-01'").collect()}
    for path in glob.glob(f"{root}/shards/shard=*/*.gz"):
        if int(path.split("shard=")[1].split("/")[0]) in old:
            with open(path, "wb") as f:
                f.write(b"not gzip")
            folder, name = os.path.split(path)
            with contextlib.suppress(FileNotFoundError):
                os.unlink(f"{folder}/.{name}.crc")
    assert old and PJ.job_search_index(spark, root, df.schema, dict(posted_within=60, max_jobs=10_000), ts(NOW)).matched == dated.matched


def test_hospital_caps_in_waves(spark, index):
    df, root = index
    systems = spark.createDataFrame([(f"h{k}", f"h{k}", "NY", k, [f"lever:c{j}" for j in range(9) if j % 3 == k]) for k in range(2)], "system string, system_name string, system_state string, system_beds int, keys array<string>")
    for q in (dict(families=["Registered nurse"], per_system=9, per_company=4, max_jobs=14), dict(per_system=30, max_jobs=1000), dict(max_jobs=7)):
        found = PH.hospital_search_index(spark, root, df.schema, systems, q, ts(NOW))
        want = [r.id for r in PH.hospital_search(df, systems, q, ts(NOW)).collect()]
        assert want and [r.id for r in found.rows.collect()] == want


def test_store_search_counts_matches(spark, tmp_path):
    rows = [(f"s{i:03d}.com", i % 17, ["USD", "EUR"][i % 2], dt.datetime(2026, 1, 1) + dt.timedelta(days=i % 90)) for i in range(200)]
    df = spark.createDataFrame(rows, "domain string, product_count int, currency string, first_seen timestamp_ntz")
    root = I.publish(spark, df, str(tmp_path / "stores"), "one", 20, PS.newest_found(), posted="first_seen")
    by_size = PS.store_search_index(spark, root, df.schema, dict(currencies=["usd"], sort_by="most_products", max_results=6), ts(NOW))
    assert by_size.matched == 100 and by_size.shards == 10
    assert [r.domain for r in by_size.rows.collect()] == [r[0] for r in sorted((r for r in rows if r[2] == "USD"), key=lambda r: (-r[1], r[0]))[:6]]
    newest = PS.store_search_index(spark, root, df.schema, dict(currencies=["usd"], max_results=6), ts(NOW))
    assert newest.shards < 10 and [r.domain for r in newest.rows.collect()] == [r[0] for r in sorted((r for r in rows if r[2] == "USD"), key=lambda r: (-r[3].toordinal(), r[0]))[:6]]
    late = PS.store_search_index(spark, root, df.schema, dict(seen_after="2026-03-30 00:00:00", max_results=100), ts(NOW))
    assert late.matched == sum(r[3] > dt.datetime(2026, 3, 30) for r in rows) and late.shards == 1
    none = PS.store_search_index(spark, root, df.schema, dict(seen_after="2027-03-30 00:00:00", max_results=100), ts(NOW))
    assert (none.matched, none.shards, none.rows.collect()) == (0, 0, [])

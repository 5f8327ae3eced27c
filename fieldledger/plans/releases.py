"""Release analysis: Q10 migration deltas, Q11 package checks, Q12 manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.notes import breaking_changes, changelog_section, is_pointer
from ..functions.versions import jump, majors_crossed, valid_name, valid_version, version_key
from ..operators import joins as J
from ..operators.groups import first_per_group
from ..operators.order import rank_changes
from ..operators.windows import dedupe_near

# Fixed value: signals of a squatted name needed to call it suspicious.
SIGNALS = 2


def notes_in_range(requests: DataFrame, releases: DataFrame, changelogs: DataFrame, save=lambda df, name: df) -> DataFrame:
    """Notes of each upgrade (`req`) with what breaks; a missing or pointer-only target note gives way to the changelog's
    section. A package's `pos` names a note.

    The range join sees no bodies. Each note some upgrade reaches is read once, however many upgrades reach it.
    """
    slim = releases.select("pkg", "version", "tag", "url", "pos")
    found = J.in_range(slim, requests).select("req", "pkg", "version", "tag", "url", "pos", (version_key("version") == version_key("to_version")).alias("is_target"))
    # A tag once per upgrade.
    found = found.withColumn("_p", F.col("pos"))
    found = save(first_per_group(found, ["req", "tag"], [F.col("_p")]).drop("_p"), "found")
    used = releases.join(found.select("pkg", "pos").distinct(), ["pkg", "pos"], "left_semi")
    read = save(used.select("pkg", "pos", is_pointer("body").alias("_pointer"), breaking_changes("body").alias("changes")), "read")
    found = found.join(read, ["pkg", "pos"])
    good = found.filter("is_target").groupBy("req").agg(F.max((~F.col("_pointer")).cast("int")).alias("good"))
    need = requests.join(good, "req", "left").filter("coalesce(good, 0) = 0")
    section = need.join(changelogs, "pkg").select(
        "req", "pkg", F.col("to_version").alias("version"), F.concat(F.lit("changelog "), "to_version").alias("tag"), F.col("changelog_url").alias("url"),
        F.lit(0).alias("pos"), F.lit(True).alias("is_target"), changelog_section("text", "to_version").alias("body"),
    ).filter("body IS NOT NULL")
    section = section.withColumn("changes", breaking_changes("body")).drop("body")
    replaced = found.join(section.select("req", F.lit(True).alias("_s")), "req", "left").filter("NOT (is_target AND coalesce(_s, false))").drop("_s", "_pointer")
    return replaced.unionByName(section)


def changes(notes: DataFrame) -> DataFrame:
    """Breaking changes per upgrade: near-identical ones once, ranked."""
    order = F.struct(version_key("version").alias("v"), F.col("tag").alias("t"))
    flat = notes.select("req", "version", "tag", "url", order.alias("o"), F.posexplode("changes").alias("i", "c"))
    flat = flat.select("req", "version", "tag", "url", F.struct("o", "i").alias("pos"), "c.*")
    return rank_changes(dedupe_near(flat, ["req"]), ["req"])


def migration_delta(requests: DataFrame, packages: DataFrame, releases: DataFrame, changelogs: DataFrame, advisories: DataFrame, save=lambda df, name: df) -> DataFrame:
    """Q10: one row per upgrade (`req, pkg, from_version, to_version`): kind of jump, what breaks, what it fixes, and how well it is documented."""
    notes = save(notes_in_range(requests, releases, changelogs, save), "notes")  # read for coverage and for changes
    cover = notes.groupBy("req").agg(F.count("*").alias("notes_found"), F.max("is_target").alias("target_documented"))
    found = changes(notes)
    what = found.groupBy("req").agg(
        F.count("*").alias("breaking"), F.transform(F.sort_array(F.collect_list(F.struct("rank", "summary"))), lambda x: x["summary"]).alias("changes")
    )
    fixes = advisories.groupBy("pkg").agg(F.count("*").alias("advisories"), F.count(F.when(F.col("fixed_by_upgrade"), True)).alias("fixed"))
    span = requests.select("req", "pkg", version_key("from_version").alias("_f"), version_key("to_version").alias("_t"))
    keyed = packages.select("pkg", F.transform("versions", version_key).alias("_v"))  # a package's versions are one row as they come
    inside = F.filter("_v", lambda v: (v > F.col("_f")) & (v <= F.col("_t")))
    vers = span.join(keyed, "pkg").select("req", F.size(inside).cast("bigint").alias("releases_in_range"))
    r = requests.withColumns({"kind": jump("from_version", "to_version"), "majors": majors_crossed("from_version", "to_version")})
    for side, key in ((vers, "req"), (cover, "req"), (what, "req"), (fixes, "pkg")):
        r = r.join(side, key, "left")
    r = r.fillna(0, ["releases_in_range", "notes_found", "breaking", "advisories", "fixed"]).withColumn("target_documented", F.coalesce("target_documented", F.lit(False)))
    return r.withColumn("major_undocumented", (F.col("kind") == "major") & ~F.col("target_documented"))


def package_check(names: DataFrame, packages: DataFrame, popular: DataFrame) -> DataFrame:
    """Q11: does a package exist, what known name is it near, and does it look like a squat."""
    p = packages.select("name", F.lit(True).alias("_has"), "latest", "repository", "description", F.size("versions").alias("_n"))
    r = J.near_names(names, "name", popular, "name").join(p, "name", "left")
    near = F.transform("near", lambda x: x["name"])
    signal = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    signals = signal(F.col("repository").isNull()) + signal(F.col("description").isNull()) + signal(F.col("_n") <= 2) + signal(F.col("latest").rlike(r"^0\.0\.[0-9]+$"))
    close = F.coalesce(F.size("near") > 0, F.lit(False))
    exists = F.coalesce("_has", F.lit(False))
    return r.select(
        "name", exists.alias("exists"), F.coalesce(near, F.array().cast("array<string>")).alias("did_you_mean"), "latest",
        F.when(~exists, close).otherwise(close & (signals >= SIGNALS)).alias("suspicious"),
    )


def manifest_delta(requests: DataFrame, packages: DataFrame, *tables) -> DataFrame:
    """Q12: a batch of upgrades; a row that cannot be answered says why and stops no other."""
    bad = ~(valid_name("pkg_name") & valid_version("from_version") & valid_version("to_version"))
    r = requests.join(packages.select("pkg", F.lit(True).alias("_has")), "pkg", "left")
    status = F.when(bad, "bad_request").when(F.col("_has").isNull(), "not_found").otherwise("ok")
    r = r.withColumn("status", status).drop("_has")
    done = migration_delta(r.filter("status = 'ok'").drop("status"), packages, *tables).drop("pkg", "pkg_name", "from_version", "to_version")
    return r.join(done, "req", "left")

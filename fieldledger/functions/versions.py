"""Version strings as sortable values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c, let


def tag_version(col: Column | str) -> Column:
    """Release tag to version: two parts are padded, a fourth number is dropped, suffixes stay."""
    p = r"(\d+)\.(\d+)(?:\.(\d+))?([-+.]?[0-9A-Za-z][0-9A-Za-z.-]*)?"
    part = [F.regexp_extract(_c(col), p, i) for i in range(5)]
    patch = F.when(part[3] == "", "0").otherwise(part[3])
    suffix = F.when(part[4].rlike(r"^\.\d+$"), "").otherwise(part[4])
    return F.when(part[0] != "", F.concat(part[1], F.lit("."), part[2], F.lit("."), patch, suffix))


def _bare(col: Column | str) -> Column:
    return F.regexp_replace(_c(col), r"^[^\d]*", "")


def version_key(col: Column | str) -> Column:
    """``struct<major, minor, patch, release, suffix>``: structs compare field by field, a pre-release before its release."""
    p = r"^(\d+(?:\.\d+)*)[-+]?(.*)$"
    nums = F.split(F.regexp_extract(_bare(col), p, 1), r"\.")
    n = [F.coalesce(F.get(nums, i).try_cast("bigint"), F.lit(0).cast("bigint")) for i in range(3)]
    pre = F.regexp_extract(_bare(col), p, 2)
    return F.struct(n[0].alias("major"), n[1].alias("minor"), n[2].alias("patch"), F.when(pre == "", 1).otherwise(0).alias("release"), pre.alias("suffix"))


def loose_key(col: Column | str) -> Column:
    """All numeric parts, trailing zeros dropped, so that arrays compare as padded versions do."""
    nums = F.transform(F.split(_bare(col), r"[.\-+]"), lambda x: F.coalesce(F.regexp_extract(x, r"^\d+", 0).try_cast("bigint"), F.lit(0).cast("bigint")))
    last = lambda a: F.array_max(F.transform(a, lambda x, i: F.when(x != 0, i + 1).otherwise(0)))
    return let(nums, lambda a: F.slice(a, F.lit(1), last(a)))


def _nums(col: Column | str) -> list[Column]:
    parts = F.split(_bare(col), r"[.\-+]")
    return [F.coalesce(F.regexp_extract(F.get(parts, i), r"^\d+", 0).try_cast("bigint"), F.lit(0).cast("bigint")) for i in range(2)]


def jump(old: Column | str, new: Column | str) -> Column:
    a, b = version_key(old), version_key(new)
    (amaj, amin), (bmaj, bmin) = _nums(old), _nums(new)
    return (
        F.when(a == b, "same").when(a > b, "downgrade").when(bmaj > amaj, "major").when(bmin > amin, "minor").otherwise("patch")
    )


def majors_crossed(old: Column | str, new: Column | str) -> Column:
    return F.greatest(F.lit(0).cast("bigint"), _nums(new)[0] - _nums(old)[0])


def repo(col: Column | str) -> Column:
    """Any spelling of a repository address to ``owner/name``."""
    p = r"(?i)github\.com[/:]([^/]+)/([^/#?]+?)(?:\.git)?(?:[/#?]|$)"
    owner, name = F.regexp_extract(_c(col), p, 1), F.regexp_extract(_c(col), p, 2)
    return F.when(owner != "", F.concat(owner, F.lit("/"), name))


def severity(named: Column | str, score: Column | str) -> Column:
    """The named value, else the band of a plain score; vectors carry no score."""
    number = F.when(~_c(score).contains("/AV:"), F.regexp_extract(_c(score), r"^\s*(\d+(\.\d+)?)", 1).try_cast("double"))
    band = let(number, lambda s: F.when(s >= 9, "critical").when(s >= 7, "high").when(s >= 4, "moderate").when(s.isNotNull(), "low"))
    known = _c(named).rlike(r"(?i)^(?:critical|high|moderate|low)\z")
    return F.when(known, F.lower(_c(named))).otherwise(F.coalesce(band, F.lit("unknown")))


def edit_distance(a: Column | str, b: Column | str, limit: int | None = None) -> Column:
    return F.levenshtein(_c(a), _c(b), limit) if limit is not None else F.levenshtein(_c(a), _c(b))


def valid_name(col: Column | str) -> Column:
    """Package names a registry could hold: legal characters, no path tricks, one slash only behind a scope."""
    c = F.trim(_c(col))
    slashes = F.length(c) - F.length(F.replace(c, F.lit("/"), F.lit("")))
    ok = c.rlike(r"^[@a-zA-Z0-9._/-]+$") & (F.length(c) <= 214) & ~c.contains("..") & ~c.rlike(r"^[/.]")
    return ok & ((slashes == 0) | ((slashes == 1) & c.startswith("@")))


def valid_version(col: Column | str) -> Column:
    c = F.trim(_c(col))
    return c.rlike(r"^[0-9A-Za-z.+_-]+$") & (F.length(c) <= 64)

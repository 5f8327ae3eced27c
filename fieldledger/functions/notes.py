"""Release notes: breaking-change lines, changelog sections.

A note is one row and its lines never leave it: the text is split at its headings, and each section's heading then
decides about the section's own lines. No line table, no shuffle, linear in the text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .regex import ascii_words
from .text import _c, replace_all, trimmed

# Headings, markers, phrases, symbols, words of internal changes, line lengths.
BREAKING_HEADING = r"(?im)^#{1,6}\s*(?:.*\b(?:breaking|BREAKING)\b.*(?:changes?|)|⚠\s*breaking.*|💥.*)$"
MARKER = r"(?:^|\n)\s*[-*]?\s*(?:\*\*)?(?:BREAKING[ -]CHANGE(?:S)?|BREAKING)(?:\*\*)?\s*[:!]?\s*(.+)"
PHRASES = "|".join(
    [
        r"\bremoved?\s+(?:the\s+)?[`'\"]?([A-Za-z_$][\w.$]*)[`'\"]?",
        r"\brenamed?\s+[`'\"]?([A-Za-z_$][\w.$]*)[`'\"]?\s+to\s+[`'\"]?([A-Za-z_$][\w.$]*)[`'\"]?",
        r"\bdropped?\s+support\s+for\s+(.+?)(?:\.|$)",
        r"\bno\s+longer\s+(?:supports?|accepts?|exports?|returns?)\s+(.+?)(?:\.|$)",
        r"\breplaced?\s+[`'\"]?([A-Za-z_$][\w.$]*)[`'\"]?\s+with\s+[`'\"]?([A-Za-z_$][\w.$]*)[`'\"]?",
        r"\bmust\s+now\s+(.+?)(?:\.|$)",
        r"\bmoved?\s+[`'\"]?([A-Za-z_$][\w.$]*)[`'\"]?\s+(?:to|into)\s+(.+?)(?:\.|$)",
    ]
)
SYMBOL = r"`([A-Za-z_$][\w.$]{1,60})`"
INTERNAL = (
    r"\b(xfail|pytest|tox|mypy|ruff|flake8|lint|linting|codecov|coverage|benchmark|typo|docstring|changelog|readme|pre-commit"
    r"|dependabot|workflow|makefile|gitignore)\b"
)
INTERNAL_SYMBOL = r"^_|^(?i:tests?\.)|^(?i:(docs|scripts|ci|benchmarks?)\.)"
SECTION_ITEM_MIN, PHRASE_LINE_MIN, SUMMARY_MIN = 10, 12, 12
SECTION_MIN = 20
POINTER = r"(?i)refer to .{0,40}CHANGELOG|see .{0,40}CHANGELOG|full changelog"


def _item(line: Column) -> Column:
    return trimmed(F.regexp_replace(line, r"^\s*[-*+]\s*", ""))


def _lines(col: Column) -> Column:
    return F.split(col, "\n")


def sections(body: Column | str) -> Column:
    """``array<struct<heading, lines>>``: the text cut in front of every Markdown heading (the first part may have none)."""
    parts = F.split(_c(body), r"(?:^|\n)(?=#{1,6}[^\S\n])")

    def cut(p: Column) -> Column:
        lines = _lines(p)
        headed = F.get(lines, 0).rlike(r"^#{1,6}\s")
        return F.struct(
            F.when(headed, F.get(lines, 0)).alias("heading"),
            F.when(headed, F.slice(lines, F.lit(2), F.size(lines))).otherwise(lines).alias("lines"),
        )

    return F.transform(parts, cut)


def candidate_lines(body: Column | str) -> Column:
    """``array<struct<text, confidence>>``: lines under a breaking heading, marked lines, then phrases that name a symbol."""
    b = F.coalesce(_c(body), F.lit(""))
    rate = lambda conf: lambda t: F.struct(t.alias("text"), F.lit(conf).alias("confidence"))
    secs = F.filter(sections(b), lambda s: s["heading"].rlike(BREAKING_HEADING))
    under = F.filter(F.flatten(F.transform(secs, lambda s: F.transform(s["lines"], _item))), lambda t: F.length(t) > SECTION_ITEM_MIN)
    marked = F.transform(F.regexp_extract_all(b, F.lit(MARKER), F.lit(1)), trimmed)
    phrased = F.filter(
        F.transform(_lines(b), _item),
        lambda t: (F.length(t) >= PHRASE_LINE_MIN) & t.rlike(SYMBOL) & t.rlike("(?m)" + ascii_words(PHRASES)),
    )
    return F.concat(F.transform(under, rate("high")), F.transform(marked, rate("high")), F.transform(phrased, rate("medium")))


def clean_line(col: Column | str) -> Column:
    return trimmed(
        replace_all(
            _c(col),
            (r"\(\[#?\d+\]\([^)]*\)\)", ""),
            (r"(?i)\bby @[\w-]+ in https?://\S+", ""),
            (r"(?i)\bin https?://\S+/pull/\d+", ""),
            (r"\[([^\]]+)\]\([^)]*\)", "$1"),
            (r"^\*\*|\*\*$", ""),
            (r"\s+", " "),
        )
    )


def symbols(col: Column | str) -> Column:
    """Distinct code names in backticks; one to three lower-case letters are prose."""
    found = F.regexp_extract_all(_c(col), F.lit(SYMBOL), F.lit(1))
    return F.array_distinct(F.filter(found, lambda s: ~s.rlike(r"^[a-z]{1,3}$")))


def near_key(summary: Column | str) -> Column:
    """Findings that share all letters and digits are the same finding."""
    return F.regexp_replace(F.lower(_c(summary)), "[^a-z0-9]", "")


def breaking_changes(body: Column | str) -> Column:
    """``array<struct<summary, confidence, symbols, key>>`` of one note, in the order found, internal changes left out."""
    c = F.transform(
        candidate_lines(body),
        lambda x: F.struct(clean_line(x["text"]).alias("summary"), x["confidence"].alias("confidence"), symbols(x["text"]).alias("symbols")),
    )

    def keep(x: Column) -> Column:
        internal = x["summary"].rlike(ascii_words(INTERNAL)) | ((F.size(x["symbols"]) > 0) & F.forall(x["symbols"], lambda s: s.rlike(INTERNAL_SYMBOL)))
        return (F.length(x["summary"]) >= SUMMARY_MIN) & ((x["confidence"] == "high") | ~internal)

    return F.transform(F.filter(c, keep), lambda x: F.struct(x["summary"].alias("summary"), x["confidence"].alias("confidence"), x["symbols"].alias("symbols"), near_key(x["summary"]).alias("key")))


def confidence_score(col: Column | str) -> Column:
    return F.when(_c(col) == "high", 3).when(_c(col) == "medium", 2).otherwise(1)


def is_pointer(body: Column | str) -> Column:
    """A release body that only points elsewhere."""
    b = trimmed(body)
    return (F.length(b) < 400) | (b.rlike(POINTER) & (F.length(b) < 1500))


def _escaped(version: Column) -> Column:
    return F.regexp_replace(version, r"([.*+?^${}()|\[\]\\])", r"\\$1")


def _long_enough(col: Column) -> Column:
    return F.when(F.length(col) > SECTION_MIN, col)


def changelog_section(text: Column | str, version: Column | str) -> Column:
    """The changelog text of one version; an empty section falls back to the version's pre-releases."""
    v = _escaped(_c(version))
    blocks = F.split(_c(text), r"(?:^|\n)(?=[ \t]*#{1,4}\s*\[?v?\d+\.\d+)")
    head = lambda b: trimmed(F.regexp_extract(b, r"^([^\n]*)", 1))
    body = lambda b: trimmed(F.regexp_replace(b, r"^[^\n]*(\n|$)", ""))
    own = F.filter(blocks, lambda b: F.rlike(head(b), F.concat(F.lit(r"(?i)^#{1,4}\s*\[?v?"), v, F.lit(r"\]?(?![\d.])"))))
    ruled = F.split(_c(text), r"(?:^|\n)(?=[^\n]*\d+\.\d+[^\n]*\n[ \t]*[-=~]{3,}[ \t\r]*(?:\n|$))")
    under = lambda b: trimmed(F.regexp_replace(b, r"^[^\n]*\n[^\n]*(\n|$)", ""))
    own_ruled = F.filter(
        ruled,
        lambda b: F.rlike(head(b), F.concat(F.lit(r"(?i)^(?:version\s+)?v?"), v, F.lit(r"(?![\d.])"))) & b.rlike(r"^[^\n]*\n[ \t]*[-=~]{3,}[ \t\r]*(?:\n|$)"),
    )
    direct = F.when(F.size(own) > 0, _long_enough(body(F.get(own, 0)))).when(F.size(own_ruled) > 0, _long_enough(under(F.get(own_ruled, 0))))
    pre = F.filter(
        blocks,
        lambda b: F.rlike(head(b), F.concat(F.lit(r"(?i)^#{1,4}\s*\[?v?"), v, F.lit(r"-[0-9A-Za-z.]+"))) & (F.length(body(b)) > SECTION_MIN),
    )
    joined = F.array_join(F.transform(pre, lambda b: F.concat(head(b), F.lit("\n"), body(b))), "\n\n")
    return F.coalesce(direct, _long_enough(joined))

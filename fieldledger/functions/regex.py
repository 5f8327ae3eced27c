r"""Patterns are written with ``\b`` and mean ASCII word boundaries; Java's ``\b`` also counts accented letters.

A boundary in front of a word is one look-behind and one behind a word is one look-ahead, which Java runs much faster
than the general two-sided form; the general form is kept where the side cannot be told.
"""

from __future__ import annotations

import re

EITHER = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
BEFORE, AFTER = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"


def _side(m: re.Match) -> str:
    rest = m.string[m.end() :]
    if rest.startswith(r"0?\."):
        return EITHER
    if not rest or rest[0] in "|) $" or rest.startswith(("(?!", "(?=", "[^", r"\s")):
        return AFTER
    return BEFORE


def ascii_words(pattern: str, ignore_case: bool = True) -> str:
    flags = ("(?i)" if pattern.isascii() else "(?iu)") if ignore_case else ""
    return flags + re.sub(r"\\b", _side, pattern)

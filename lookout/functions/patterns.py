"""Wildcard search patterns.

Search text is turned into a SQL LIKE pattern whose escape character is the
backslash (Spark's default):  every whitespace-separated part is prefixed with
``%`` and one ``%`` closes the pattern, so ``"my query"`` -> ``"%my%query%"``
and the parts must occur in that order.  Blank text gives ``"%"``.

Each function exists twice: for one Python string (single search) and as a
Column expression (batch search over a column of texts).  Both give the same
pattern for the same text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal Python ``str.split()`` behaviour).
# Python's str.split() separates on Unicode White_Space plus the four ASCII
# information separators U+001C..U+001F; Java's (?U)\s covers the former only.
SPLIT_REGEX = r"(?U)[\s\x1c-\x1f]+"
# Characters that are special in a LIKE pattern with backslash escape.
LIKE_SPECIALS = ("\\", "%", "_")
# Default row limit when the configured limit is not a number.
DEFAULT_LIMIT = 1000
# Minimum number of raw characters before a search runs.
MIN_SEARCH_LENGTH = 3
# ---------------------------------------------------------------------------

_ESCAPE_PART = re.compile(r"([\\%_])")
_NORMALISE_BACKSLASH = re.compile(r"(\\[%_\\])|\\(.)", re.S)
_BACKSLASH_MODES = ("escape", "literal")


def _check_backslash(backslash: str) -> None:
    if backslash not in _BACKSLASH_MODES:
        raise ValueError(f"backslash must be one of {_BACKSLASH_MODES}, got {backslash!r}")


# --------------------------------------------------------------------------- literal form


def split_parts(text: str) -> list[str]:
    return text.split()


def escape_like(part: str) -> str:
    """Make ``part`` match literally inside a LIKE pattern (DEC-1)."""
    return _ESCAPE_PART.sub(r"\\\1", part)


def normalise_backslashes(pattern: str, backslash: str = "escape") -> str:
    """Bring user backslashes to a form Spark's LIKE accepts.

    ``escape``: backslash escapes the next character, as in PostgreSQL, so
    ``\\x`` is a literal ``x``; Spark only accepts ``\\%``, ``\\_``, ``\\\\``,
    so the backslash in front of any other character is dropped.
    ``literal``: the backslash is an ordinary character (SQL Server, Oracle
    without ESCAPE), so every backslash is doubled.
    """
    _check_backslash(backslash)
    if backslash == "literal":
        return pattern.replace("\\", "\\\\")
    return _NORMALISE_BACKSLASH.sub(lambda m: m.group(1) or m.group(2), pattern)


def wildcard_pattern_text(text: str, escape: bool = False, backslash: str = "escape") -> str:
    """``"my query"`` -> ``"%my%query%"`` (B1), optionally escaped."""
    parts = split_parts(text)
    if escape:
        return "".join("%" + escape_like(p) for p in parts) + "%"
    return normalise_backslashes("".join("%" + p for p in parts) + "%", backslash)


def literal_runs_text(pattern: str) -> list[str]:
    """Literal stretches of a LIKE pattern, unescaped, for one Python string."""
    return [re.sub(r"(?s)\\(.)", r"\1", run) for run in re.findall(r"(?s)(?:\\.|[^%_\\])+", pattern)]


# --------------------------------------------------------------------------- column form


def split_parts_col(text: Column) -> Column:
    return F.filter(F.split(text, SPLIT_REGEX), lambda p: p != F.lit(""))


def escape_like_col(part: Column) -> Column:
    return F.regexp_replace(part, r"([\\%_])", r"\\$1")


def normalise_backslashes_col(pattern: Column, backslash: str = "escape") -> Column:
    _check_backslash(backslash)
    if backslash == "literal":
        return F.regexp_replace(pattern, r"\\", r"\\\\")
    return F.regexp_replace(pattern, r"(?s)(\\[%_\\])|\\(.)", "$1$2")


def wildcard_pattern(text: Column | str, escape: bool = False, backslash: str = "escape") -> Column:
    """Column form of :func:`wildcard_pattern_text`."""
    text = F.col(text) if isinstance(text, str) else text
    parts = split_parts_col(text)
    if escape:
        return F.concat(F.array_join(F.transform(parts, lambda p: F.concat(F.lit("%"), escape_like_col(p))), ""), F.lit("%"))
    raw = F.concat(F.array_join(F.transform(parts, lambda p: F.concat(F.lit("%"), p)), ""), F.lit("%"))
    return normalise_backslashes_col(raw, backslash)


def literal_runs(pattern: Column) -> Column:
    """Literal stretches of a LIKE pattern, unescaped: ``%ab\\%c_d%`` -> [``ab%c``, ``d``].

    Every row matching the pattern contains each run, which is what n-gram
    blocking (B15) relies on.
    """
    runs = F.regexp_extract_all(pattern, F.lit(r"(?s)((?:\\.|[^%_\\])+)"), 1)
    return F.transform(runs, lambda r: F.regexp_replace(r, r"(?s)\\(.)", "$1"))


# --------------------------------------------------------------------------- limits


def resolve_limit(limit, mode: str = "top_k") -> int | None:
    """Row limit as the reference applies it (B13, B13b, B13c, DEC-9).

    Database modes fall back to 1000 when the setting is not a (finite) number;
    the unordered (GeoPackage) mode treats a non-number or 0 as "no limit".
    ``None`` always means no limit in this API.
    """
    if limit is None:
        return None
    try:
        n = int(float(limit))
    except (TypeError, ValueError, OverflowError):  # no number, NaN, infinity
        n = None
    if mode == "unordered":
        return n or None
    if n is None:
        return DEFAULT_LIMIT
    if n < 0:
        raise ValueError(f"limit must not be negative: {limit!r}")
    return n

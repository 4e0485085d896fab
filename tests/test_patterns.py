"""Wildcard patterns, escapes, backslashes; literal and column forms agree."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lookout.functions.patterns import (
    literal_runs,
    normalise_backslashes,
    resolve_limit,
    wildcard_pattern,
    wildcard_pattern_text,
)

TEXTS = [
    "my query",
    "  leading and trailing  ",
    "   ",
    "",
    "tab\tand\nnewline",
    "nbsp\u00a0split",
    "sep\x1cinfo",
    "100%",
    "a_b",
    "ring\\",
    "\\ring",
    "a\\\\b",
    "ÉCOLE Straße",
]


def test_docstring_example():
    assert wildcard_pattern_text("my query") == "%my%query%"


def test_blank_text_matches_everything():
    assert wildcard_pattern_text("   ") == "%"
    assert wildcard_pattern_text("") == "%"


def test_postcode_note(spark):
    # 'dl10 4dq' and 'dl104dq' both find the stored 'DL104DQ'
    df = spark.createDataFrame([("DL104DQ",)], "pc string")
    for text in ("dl10 4dq", "dl104dq"):
        assert df.where(F.col("pc").ilike(wildcard_pattern_text(text))).count() == 1


def test_escape_makes_text_literal():
    assert wildcard_pattern_text("100% a_b", escape=True) == "%100\\%%a\\_b%"
    assert wildcard_pattern_text("c:\\x", escape=True) == "%c:\\\\x%"


def test_backslash_rules():
    # PostgreSQL: backslash escapes the next character
    assert normalise_backslashes("%\\ring%") == "%ring%"
    assert normalise_backslashes("%a\\%b%") == "%a\\%b%"
    assert normalise_backslashes("%a\\\\b%") == "%a\\\\b%"
    # SQL Server / Oracle: backslash is an ordinary character
    assert normalise_backslashes("%\\ring%", "literal") == "%\\\\ring%"


def test_column_form_equals_literal_form(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    for escape in (False, True):
        for backslash in ("escape", "literal"):
            got = [
                r.p
                for r in df.select(wildcard_pattern(F.col("t"), escape, backslash).alias("p")).collect()
            ]
            want = [wildcard_pattern_text(t, escape, backslash) for t in TEXTS]
            assert got == want, (escape, backslash)


def test_literal_runs(spark):
    df = spark.createDataFrame([("%ab\\%c_d%",), ("%",), ("%x%",)], "p string")
    got = [r.r for r in df.select(literal_runs(F.col("p")).alias("r")).collect()]
    assert got == [["ab%c", "d"], [], ["x"]]


def test_limits():
    assert resolve_limit("abc") == 1000
    assert resolve_limit(None) is None
    assert resolve_limit(0) == 0
    assert resolve_limit("12") == 12
    assert resolve_limit(0, "unordered") is None
    assert resolve_limit("x", "unordered") is None
    assert resolve_limit(7, "unordered") == 7


def ordered_parts_match(text: str, query: str) -> bool:
    """Plain-Python meaning of the pattern: parts occur in order, case-folded."""
    pos = 0
    low = text.lower()
    for part in query.split():
        i = low.find(part.lower(), pos)
        if i < 0:
            return False
        pos = i + len(part)
    return True


ALPHABET = "abAB c%_\\"


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.text(ALPHABET, max_size=8), st.text("abAB c", max_size=5)), min_size=1, max_size=20))
def test_property_ilike_equals_ordered_substrings(spark, pairs):
    rows = [(i, t, q, wildcard_pattern_text(q, escape=True)) for i, (t, q) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "i int, t string, q string, p string")
    got = {r.i for r in df.where(F.expr("t ilike p")).select("i").collect()}
    want = {i for i, t, q, _ in rows if ordered_parts_match(t, q)}
    assert got == want


def test_regex_split_matches_python_whitespace():
    from lookout.functions.patterns import SPLIT_REGEX

    java_like = re.compile(SPLIT_REGEX.replace("(?U)", ""))
    for cp in range(0, 0x3100):
        ch = chr(cp)
        assert bool(java_like.fullmatch(ch)) == ch.isspace(), hex(cp)

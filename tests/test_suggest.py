"""The three suggestion policies and their null / empty / separator rules."""

import pytest

from lookout.functions.suggest import parse_display_columns, suggestion

ROWS = [
    ("a", "x", 1),
    ("b", None, 2),
    ("c", "", 0),
    ("d", None, None),
    ("e", "y", None),
]
SCHEMA = "s string, d1 string, d2 int"


def lines(spark, **kw):
    df = spark.createDataFrame(ROWS, SCHEMA)
    return [r.l for r in df.select(suggestion(df, "s", ["d1", "d2"], **kw).alias("l")).orderBy("s").collect()]


def test_coalesce_sep_echo(spark):
    assert lines(spark, policy="coalesce_sep") == ["a, x, 1", "b, 2", "c, , 0", "d", "e, y"]


def test_coalesce_sep_no_echo_keeps_leading_separator(spark):
    assert lines(spark, policy="coalesce_sep", echo=False) == ["x, 1", ", 2", ", 0", "", "y"]


def test_coalesce_sep_empty_is_null(spark):
    assert lines(spark, policy="coalesce_sep", echo=False, empty_is_null=True) == ["x, 1", ", 2", ", 0", None, "y"]


def test_concat_all(spark):
    assert lines(spark, policy="concat_all") == ["a, x, 1", "b, , 2", "c, , 0", "d, , ", "e, y, "]


def test_concat_all_single_and_none(spark):
    df = spark.createDataFrame([("a" * 40, None)], "s string, d string")
    one = df.select(suggestion(df, "s", [], policy="concat_all", truncate30=True).alias("l")).first().l
    assert one == "a" * 30
    null_one = df.select(suggestion(df, "s", ["d"], policy="concat_all", echo=False).alias("l")).first().l
    assert null_one is None
    none = df.select(suggestion(df, "s", [], policy="concat_all", echo=False).alias("l")).first().l
    assert none == ""


def test_skip_falsy(spark):
    assert lines(spark, policy="skip_falsy") == ["a, x, 1", "b, 2", "c, 0", "d", "e, y"]
    assert lines(spark, policy="skip_falsy", drop_zero=True) == ["a, x, 1", "b, 2", "c", "d", "e, y"]


def test_skip_falsy_keeps_falsy_echo(spark):
    df = spark.createDataFrame([("", "x")], "s string, d string")
    assert df.select(suggestion(df, "s", ["d"]).alias("l")).first().l == ", x"


def test_numbers_and_booleans_as_text(spark):
    df = spark.createDataFrame([(5, True, 2.5)], "s long, b boolean, f double")
    line = df.select(suggestion(df, "s", ["b", "f"], policy="coalesce_sep").alias("l")).first().l
    assert line == "5, true, 2.5"


def test_display_list_parsing():
    assert parse_display_columns("column1,column2") == ["column1", "column2"]
    assert parse_display_columns("") == []
    assert parse_display_columns(None) == []


def test_unknown_policy(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    with pytest.raises(ValueError):
        suggestion(df, "s", [], policy="nope")

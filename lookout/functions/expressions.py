"""User expressions evaluated per row with a default.

The reference evaluates a user expression (zoom scale, bounding box text)
against the extra columns of the picked hit, and falls back to a default when
the text is empty or evaluation fails.  Here the expression is Spark SQL text
evaluated over all hits at once.

Per-row failures (bad cast, division by zero) must give the default instead of
failing the job.  The projection is therefore analysed while
``spark.sql.ansi.enabled`` is off; the evaluation mode is fixed in the analysed
plan, so restoring the setting afterwards keeps the lenient behaviour for this
column only.  A parse error or unknown column gives a warning and the default
for every row, as the reference does when it rejects an expression.
"""

from __future__ import annotations

import contextlib
import threading
import warnings

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


_MODE_LOCK = threading.Lock()


@contextlib.contextmanager
def lenient_mode(spark):
    """ANSI off while a projection is analysed; one caller at a time, since the
    setting is session-wide."""
    with _MODE_LOCK:
        previous = spark.conf.get("spark.sql.ansi.enabled")
        spark.conf.set("spark.sql.ansi.enabled", "false")
        try:
            yield
        finally:
            spark.conf.set("spark.sql.ansi.enabled", previous)


def with_expression(
    df: DataFrame,
    name: str,
    expr_text: str | None,
    default=None,
    data_type: str | None = None,
) -> DataFrame:
    """``df`` plus column ``name`` = ``expr_text`` evaluated per row.

    Empty text, a rejected expression, a per-row error and a null result all
    give ``default`` (DEC-7).  ``data_type`` casts the result (leniently).
    """
    fallback = F.lit(default)
    if data_type:
        fallback = fallback.cast(data_type)
    if expr_text is None or len(expr_text.strip()) == 0:
        return df.withColumn(name, fallback)
    spark = df.sparkSession
    with lenient_mode(spark):
        try:
            value = F.expr(expr_text)
            if data_type:
                value = value.cast(data_type)
            return df.withColumn(name, F.coalesce(value, fallback))
        except (AnalysisException, ParseException) as exc:
            warnings.warn(f"expression {expr_text!r} rejected, using default: {str(exc).splitlines()[0]}")
            return df.withColumn(name, fallback)

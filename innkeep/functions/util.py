"""Small Column combinators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and pass it to ``body``.

    A single-element array fed to ``transform`` binds the value to a lambda
    variable; expressions referring to it several times (or inside another
    lambda) then do not recompute it.
    """
    return F.transform(F.array(value), body)[0]


def in_short_methods(array: Column) -> Column:
    """An array as it is; the projection that holds it is worked out in many short generated methods.

    Spark makes one method of all that a stage does with a row, and the JVM does not compile methods beyond 8,000
    bytes: it interprets them, several times slower.  A projection with a lambda in it is generated apart, in short
    methods; the lambda here looks at nothing (a slice of no elements), the array is not part of it.
    """
    none = F.filter(F.slice(F.array(F.spark_partition_id()), 1, 0), lambda x: x < 0)
    return F.slice(array, F.size(none) + 1, F.lit(2**31 - 1))


def printed(x: Column) -> Column:
    """A value as ``format_string`` prints it (``null`` when missing), without parsing a format for every row."""
    return F.coalesce(x.cast("string"), F.lit("null"))


def spread(struct_col: Column) -> Column:
    """Generator turning one struct per row into its fields as columns.

    Selecting ``struct.*`` lets the optimizer copy the struct's expression into
    every output column; a generator evaluates it once per row.
    """
    return F.inline(F.array(struct_col))


def session_cached(fn):
    """Cache a builder of unresolved Columns per Spark application.

    Expression builders that depend only on their (hashable) arguments, such as
    the ninety-column typed view of the legacy export, are assembled once per
    session; the Columns are unresolved expressions and can be reused in any
    DataFrame of that session.
    """
    import functools

    cache: dict = {}

    @functools.wraps(fn)
    def wrapper(*args):
        from pyspark.sql import SparkSession
        spark = SparkSession.getActiveSession()
        try:
            app = spark.sparkContext.applicationId if spark is not None else None
        except Exception:  # noqa: BLE001 - sessions without a SparkContext
            app = id(spark)
        key = (app, args)
        if key not in cache:
            cache[key] = fn(*args)
        return cache[key]

    return wrapper

"""Range joins as equi-joins: points in intervals of any width, without comparing all pairs.

Each interval gets the level k of the smallest power of two that is no less than its width, so it
touches at most two blocks of 2^k. A point lies in one block of each level. There are at most 63
levels, whatever the data, and only those that intervals have are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _level(width: Column) -> Column:
    return F.when(width <= 1, 0).otherwise(F.length(F.bin(width - 1)))


def _block(place: Column, level: str) -> Column:
    return F.call_function("shiftright", place, F.col(level))


def interval_join(points: DataFrame, intervals: DataFrame, point: str, start: str, stop: str) -> DataFrame:
    """Rows of both sides with start <= point < stop.

    The columns are numbers below 2^62 in magnitude; give instants as microseconds. Null and NaN match
    nothing, and neither do intervals that end before they start. Column names of the sides differ.
    """
    whole = (F.ceil(stop) - F.floor(start)).cast("long")
    spans = intervals.where((F.col(start) < F.col(stop)) & ~F.isnan(F.col(stop).cast("double")))
    spans = spans.withColumn("__level", _level(whole))
    first, last = (_block(c, "__level") for c in (F.floor(start).cast("long"), (F.ceil(stop) - 1).cast("long")))
    spans = spans.withColumn("__block", F.explode(F.sequence(first, last)))
    levels = sorted(r[0] for r in spans.select("__level").distinct().collect())
    places = points.where(F.col(point).isNotNull() & ~F.isnan(F.col(point).cast("double")))
    places = places.withColumn("__level", F.explode(F.array(*[F.lit(k) for k in levels]).cast("array<int>")))
    places = places.withColumn("__block", _block(F.floor(point).cast("long"), "__level"))
    inside = (F.col(point) >= F.col(start)) & (F.col(point) < F.col(stop))
    return places.join(spans, ["__level", "__block"]).where(inside).drop("__level", "__block")

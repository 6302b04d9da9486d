"""Rows at a time inside spans of time, joined by bins so that a key's rows spread over tasks.

A span goes into the two or three bins that it touches, of a width that doubles until it holds the span, cut to
each; of the parts of a key in one bin that start together the longest stays, so a bin holds no more parts than
it has seconds. The equal key of the join is key, width and bin: a key with half of all rows is as many groups
as it has bins.

Defined results: a span includes its start and not its end; a null key, time, start or end matches nothing, nor
does a span that ends where it starts or earlier; rows that repeat are each kept, once, whatever number of spans
they are in; empty tables give empty results; columns of the rows may have any names that do not start with two
underscores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetrail.sources.scratch import written

#: Width in seconds of the narrowest bins.
WIDTH = 3600
LEVELS = 40


def level(start: Column, end: Column, width: int = WIDTH) -> Column:
    """How often the width doubles until it holds the span; bins cover a span whatever this says."""
    doubled = F.ceil(F.log2((end - start).cast("double") / width)).cast("int")
    return F.least(F.greatest(doubled, F.lit(0)), F.lit(LEVELS))


def bin_of(at: Column, wide: Column) -> Column:
    """Start of the bin of a time."""
    return at - F.pmod(at, wide)


def parts(spans: DataFrame, key: str, start: str, end: str, width: int = WIDTH) -> DataFrame:
    """__key, __level, __bin, __from, __to: spans cut to the bins that they touch."""
    s = spans.select(F.col(key).alias("__key"), F.col(start).cast("long").alias("__start"), F.col(end).cast("long").alias("__end"))
    s = s.filter("__key IS NOT NULL AND __start < __end").withColumn("__level", level(F.col("__start"), F.col("__end"), width))
    s = s.withColumn("__wide", F.expr(f"shiftleft({width}L, __level)"))
    bins = F.sequence(bin_of(F.col("__start"), F.col("__wide")), bin_of(F.col("__end") - 1, F.col("__wide")), F.col("__wide"))
    s = s.withColumn("__bin", F.explode(bins))
    cut = s.select("__key", "__level", "__bin", F.greatest("__start", "__bin").alias("__from"), F.least(F.col("__end"), F.col("__bin") + F.col("__wide")).alias("__to"))
    return cut.groupBy("__key", "__level", "__bin", "__from").agg(F.max("__to").alias("__to"))


def inside(rows: DataFrame, spans: DataFrame, key: str, at: str, span_key: str, start: str, end: str, width: int = WIDTH) -> DataFrame:
    """rows whose time lies in some span of their key."""
    cut = written(parts(spans, span_key, start, end, width), "parts")
    levels = sorted(r[0] for r in cut.select("__level").distinct().collect())  # at most LEVELS + 1
    place = F.array(*[F.struct(F.lit(n).alias("level"), bin_of(F.col(at).cast("long"), F.lit(width << n)).alias("bin")) for n in levels or [0]])
    one = len(levels) < 2
    numbered = rows if one else written(rows.withColumn("__row", F.monotonically_increasing_id()), "rows")
    asked = numbered.withColumn("__place", place[0] if one else F.explode(place))
    met = (F.col(key) == F.col("__key")) & (F.col("__place.level") == F.col("__level")) & (F.col("__place.bin") == F.col("__bin"))
    found = asked.join(cut, met & (F.col(at) >= F.col("__from")) & (F.col(at) < F.col("__to")), "left_semi")
    if one:
        return found.select(*rows.columns)
    return numbered.join(found.select("__row").distinct(), "__row", "left_semi").select(*rows.columns)

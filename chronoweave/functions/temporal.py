"""Range algebra over releases. Ranges are rows (node, start, end), inclusive; a NULL end is open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import OPEN


def closed(end: Column) -> Column:
    return F.coalesce(end, F.lit(OPEN))


def opened(end: Column) -> Column:
    return F.when(end < OPEN, end)


def _numbered(df: DataFrame, key: list[str]) -> DataFrame:
    return df.withColumn("seq", F.row_number().over(W.partitionBy(*key).orderBy("start")))


def to_ranges(points: DataFrame, key: list[str], at: str = "release") -> DataFrame:
    """Runs of consecutive releases: (key, seq, start, end)."""
    w = W.partitionBy(*key).orderBy(at)
    p = points.select(*key, at).withColumn("__g", F.col(at) - F.dense_rank().over(w))  # copies are in the same run
    return _numbered(p.groupBy(*key, "__g").agg(F.min(at).alias("start"), F.max(at).alias("end")).drop("__g"), key).select(*key, "seq", "start", "end")


def to_points(ranges: DataFrame, key: list[str], last: int) -> DataFrame:
    """All releases of the ranges, an open end reaching to `last`."""
    return ranges.select(*key, F.explode(F.sequence("start", F.least(F.coalesce("end", F.lit(last)), F.lit(last)))).alias("release")).distinct()


def compact(ranges: DataFrame, key: list[str]) -> DataFrame:
    """Merges ranges that touch or overlap."""
    w = W.partitionBy(*key).orderBy("start", closed(F.col("end")))
    reach = F.max(closed(F.col("end"))).over(w.rowsBetween(W.unboundedPreceding, -1))
    r = ranges.withColumn("__r", reach)
    r = r.withColumn("__g", F.sum(F.when(F.col("__r").isNull() | ((F.col("__r") < OPEN) & (F.col("start") > F.col("__r") + 1)), 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    out = r.groupBy(*key, "__g").agg(F.min("start").alias("start"), opened(F.max(closed(F.col("end")))).alias("end"))
    return _numbered(out.drop("__g"), key).select(*key, "seq", "start", "end")


def intersect(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Common parts of two range tables of the same nodes: an equi-join on the node, the overlap as its condition."""
    r = right.select(*key, F.col("start").alias("__s"), F.col("end").alias("__e"))
    j = left.join(r, key).filter((F.col("start") <= closed(F.col("__e"))) & (F.col("__s") <= closed(F.col("end"))))
    return j.select(*key, F.greatest("start", "__s").alias("start"), opened(F.least(closed(F.col("end")), closed(F.col("__e")))).alias("end"))


def contains(start: Column, end: Column, point: Column) -> Column:
    return (start <= point) & (point <= closed(end))


def backbone(events: DataFrame, key: list[str]) -> DataFrame:
    """Ranges from (key, release, is_birth) events, open ends as OPEN: each island is birth+ end+, closed by its last
    end; births sort before ends of one release."""
    w = W.partitionBy(*key).orderBy("release", F.desc("is_birth"))
    e = events.select(*key, "release", "is_birth").distinct()
    e = e.withColumn("__new", (F.col("is_birth") & ~F.coalesce(F.lag("is_birth").over(w), F.lit(False))).cast("int"))
    e = e.withColumn("__g", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    out = e.groupBy(*key, "__g").agg(F.min(F.when(F.col("is_birth"), F.col("release"))).alias("start"), F.max(F.when(~F.col("is_birth"), F.col("release"))).alias("end"))
    return _numbered(out.withColumn("end", opened(F.col("end"))).drop("__g"), key).select(*key, "seq", "start", "end")


def entry_points(ranges: DataFrame, point: str, mode: str = "closest") -> DataFrame:
    """Where a walk from each range enters towards `point`: adds (entry, reverse), two rows where it lies inside."""
    p, s, e = F.col(point), F.col("start"), closed(F.col("end"))
    at = lambda x, back: F.struct(x.alias("entry"), F.lit(back).alias("reverse"))
    if mode == "closest":
        rows = F.when(p == s, F.array(at(s, False))).when(p < s, F.array(at(s, True))).when(e <= p, F.array(at(e, False))).otherwise(F.array(at(s, True), at(e, False)))
    elif mode == "distant":
        rows = F.when(p <= s, F.array(at(e, True))).when(e <= p, F.array(at(s, False))).otherwise(F.array(at(e, True), at(s, False)))
    else:
        raise ValueError(mode)
    return ranges.withColumn("__x", F.explode(rows)).select(*ranges.columns, F.col("__x.entry").alias("entry"), F.col("__x.reverse").alias("reverse"))


def direction(entries: DataFrame, key: list[str]) -> DataFrame:
    """(key, direction, forward_from, reverse_from): both, forward or reverse, with the nearest entry of each."""
    g = entries.groupBy(*key).agg(F.min(F.when(~F.col("reverse"), F.col("entry"))).alias("forward_from"), F.max(F.when(F.col("reverse"), F.col("entry"))).alias("reverse_from"))
    way = F.when(F.col("forward_from").isNotNull() & F.col("reverse_from").isNotNull(), "both").when(F.col("reverse_from").isNotNull(), "reverse").otherwise("forward")
    return g.select(*key, way.alias("direction"), "forward_from", "reverse_from")

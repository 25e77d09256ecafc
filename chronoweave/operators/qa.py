"""Invariants of a graph as counts that must be 0, and metrics of conversions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import SENTINEL, versioned
from ..functions.temporal import closed, contains, to_points
from ..session import cut


def invariants(ids: DataFrame, history: DataFrame, ranges: DataFrame) -> DataFrame:
    """(name, violations)."""
    node = versioned(F.col("stable_id"), F.col("version"))
    last = ids.agg(F.max("release")).first()[0] or 0
    have = cut(ids.select(node.alias("node"), "release").distinct(), "have")
    ranges = cut(ranges, "ranges")
    said = to_points(ranges, ["node"], last)
    a, b = ranges, ranges.select("node", F.col("seq").alias("q2"), F.col("start").alias("s2"))
    checks = {
        "ids_without_range": have.join(said, ["node", "release"], "left_anti"),
        "range_without_ids": said.join(have, ["node", "release"], "left_anti"),
        "overlapping_ranges": a.join(b, "node").filter((F.col("q2") == F.col("seq") + 1) & (F.col("s2") <= closed(F.col("end")))),
        "empty_ranges": ranges.filter(F.col("start") > closed(F.col("end"))),
        "edges_back_in_time": history.filter("new_release < old_release"),
        "unknown_nodes": history.select("src").distinct().filter(~F.col("src").rlike(SENTINEL)).join(have.select(F.col("node").alias("src")).distinct(), "src", "left_anti"),
    }
    out = None
    for name, df in checks.items():
        one = df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("name"), "violations")
        out = one if out is None else out.unionByName(one)
    return out


def path_density(queries: DataFrame, paths: DataFrame) -> DataFrame:
    """(query_id, n_paths), NULL where there is none."""
    return queries.select("query_id").distinct().join(paths.groupBy("query_id").agg(F.count("*").alias("n_paths")), "query_id", "left")


def travel(converted: DataFrame, truth: DataFrame) -> DataFrame:
    """Counts over queries: lost, one_to_one, one_to_many, and inaccurate: a target that truth (id) does not have."""
    t = truth.toDF("target").distinct().withColumn("known", F.lit(True))
    per = converted.join(t, "target", "left").groupBy("query_id").agg(F.count_distinct("target").alias("n"), F.max(F.col("target").isNotNull() & F.col("known").isNull()).alias("bad"))
    c = lambda x: F.coalesce(F.sum(x.cast("long")), F.lit(0))
    return per.agg(F.count("*").alias("queries"), c(F.col("n") == 0).alias("lost"), c(F.col("n") == 1).alias("one_to_one"), c(F.col("n") > 1).alias("one_to_many"), c(F.col("bad")).alias("inaccurate"))


def draw(df: DataFrame, key: str, n: int, seed: int = 1) -> DataFrame:
    """Exactly n rows (all, if there are fewer), the same for the same seed: a sample is the feature here."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def lived(ranges: DataFrame, release: int) -> DataFrame:
    return ranges.filter(contains(F.col("start"), F.col("end"), F.lit(release))).select("node").distinct()


def travel_report(row) -> str:
    return " | ".join(f"{k}: {row[k]}" for k in ("queries", "lost", "one_to_one", "one_to_many", "inaccurate"))

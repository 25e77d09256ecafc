"""Harmonising the feature axes of several datasets. matches: (dataset, query, target, gene); matrix: COO rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ids import is_numeric, missing_to
from ..schema import ContractError, assert_subset, assert_unique
from . import prep
from .summary import text_set


def presence(matches: DataFrame) -> DataFrame:
    return matches.groupBy("query").agg(F.count_distinct("dataset").alias("n_datasets"))


def n_to_one(matches: DataFrame) -> DataFrame:
    """(dataset, query, target) of queries that share their target with another one of the same dataset; a query that is
    its own target is not at fault."""
    d = matches.filter("target is not null").select("dataset", "query", "target").distinct()
    return prep.only_copies(d, ["dataset", "target"]).filter("query <> target")


def reasons(matches: DataFrame) -> DataFrame:
    """(dataset, query, reason): n-to-1, 1-to-0 and 1-to-n, joined by _ where several hold."""
    per = matches.groupBy("dataset", "query").agg(F.count_distinct("target").alias("n"))
    d = per.join(n_to_one(matches).select("dataset", "query").distinct().withColumn("__n1", F.lit(True)), ["dataset", "query"], "left")
    why = F.array_join(F.array_compact(F.array(F.when(F.col("__n1"), "n-to-1"), F.when(F.col("n") == 0, "1-to-0"), F.when(F.col("n") > 1, "1-to-n"))), "_")
    return d.select("dataset", "query", why.alias("reason")).filter("reason <> ''")


def failures(matches: DataFrame) -> DataFrame:
    """(query, consistent): failed in some dataset; consistent where it fails in all that the collection has."""
    n = matches.agg(F.count_distinct("dataset").alias("all"))
    f = reasons(matches).groupBy("query").agg(F.count_distinct("dataset").alias("n"))
    return f.join(F.broadcast(n)).select("query", (F.col("n") == F.col("all")).alias("consistent"))  # one row


def inconsistencies(mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(queries to drop: their gene has several names), (name, gene: the smallest gene of a name that has several)."""
    names = mapping.select("gene", "target").distinct()
    many = names.groupBy("gene").count().filter("count > 1").select("gene")
    chosen = names.groupBy("target").agg(F.min("gene").alias("gene"), F.count("*").alias("n")).filter("n > 1").select("target", "gene")
    return mapping.join(many, "gene", "left_semi").select("query").distinct(), chosen


def mapping_table(matches: DataFrame) -> DataFrame:
    """(query, name): the target where a query has exactly one everywhere and is in no failure; consistent failures keep
    their own name."""
    f = failures(matches)
    good = matches.join(f.select("query"), "query", "left_anti").filter("target is not null").select("query", F.col("target").alias("name")).distinct()
    own = f.filter("consistent").select("query", F.col("query").alias("name"))
    return prep.drop_all_copies(good.unionByName(own), ["query"])


def apply_mapping(matrix: DataFrame, mapping: DataFrame) -> DataFrame:
    return matrix.join(mapping.withColumnRenamed("query", "feature"), "feature").select("dataset", "obs", F.col("name").alias("feature"), "value")


def in_all(matrix: DataFrame) -> DataFrame:
    """(feature, intersection): 1 where every dataset has the feature."""
    n = matrix.agg(F.count_distinct("dataset").alias("all"))
    return matrix.groupBy("feature").agg(F.count_distinct("dataset").alias("n")).join(F.broadcast(n)).select("feature", (F.col("n") == F.col("all")).cast("int").alias("intersection"))


def combine(matrix: DataFrame, mode: str = "union", fill: bool = False) -> DataFrame:
    """union keeps all features, intersect those of all datasets. Absent cells are zero, as COO leaves them out; fill
    writes them, for every observation and feature of the result."""
    if mode == "intersect":
        matrix = matrix.join(in_all(matrix).filter("intersection = 1").select("feature"), "feature", "left_semi").select(*matrix.columns)
    elif mode != "union":
        raise ValueError(mode)
    if not fill:
        return matrix
    # Dense by request: observations times features, dealt by observation.
    features = matrix.select("feature").distinct().agg(F.array_sort(F.collect_list("feature")).alias("f"))
    every = matrix.select("dataset", "obs").distinct().crossJoin(F.broadcast(features)).select("dataset", "obs", F.explode("f").alias("feature"))
    return every.join(matrix, ["dataset", "obs", "feature"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def annotations(parts: dict[str, DataFrame], keep: list[str], numeric: list[str] = (), key: str = "obs") -> DataFrame:
    """Columns of observations (or features) of all datasets: those named in keep, absent ones and spellings of missing
    values as the placeholder; numeric ones as numbers, where a value that is none is an error."""
    out = None
    for name, df in parts.items():
        if bad := [c for c in numeric if c in df.columns and not df.filter(~is_numeric(F.col(c).cast("string"))).isEmpty()]:
            raise ContractError(f"not numeric in {name}: {bad}")
        col = lambda c: (F.col(c) if c in df.columns else F.lit(None)).cast("double" if c in numeric else "string")  # noqa: B023, E731
        d = df.select(F.lit(name).alias("dataset"), key, *[(col(c) if c in numeric else missing_to(col(c))).alias(c) for c in keep])
        out = d if out is None else out.unionByName(d)
    return out


def unified(features: DataFrame, converted: DataFrame) -> DataFrame:
    """matches (dataset, query, target, gene) of features (dataset, feature): each distinct name was converted once
    (query_id, target: its gene, final: its name), and comes back to every dataset that has it."""
    c = converted.select(F.col("query_id").alias("query"), F.col("final").alias("to"), F.col("target").alias("gene"), "confidence")
    known = c.filter("confidence is not null").select("query", F.col("to").alias("target"), "gene").distinct()
    return features.select("dataset", F.col("feature").alias("query")).distinct().join(known, "query", "left").select("dataset", "query", "target", "gene")


def harmonise(matrix: DataFrame, matches: DataFrame, dataset: str) -> DataFrame:
    """One dataset under the names of mapping_table(); two features that come to one name are an error."""
    own = apply_mapping(matrix.filter(F.col("dataset") == dataset), mapping_table(matches))
    return assert_unique(own, "dataset", "obs", "feature")


def clashes(converted: DataFrame) -> DataFrame:
    """(target, n_queries, one_to_one, one_to_many) of targets that several queries reach."""
    d = converted.select("query_id", "target").filter("target is not null").distinct().withColumn("n", F.count("*").over(W.partitionBy("query_id")))
    g = d.groupBy("target").agg(F.count("*").alias("n_queries"), F.bool_or(F.col("n") == 1).alias("one_to_one"), F.bool_or(F.col("n") > 1).alias("one_to_many"))
    return g.filter("n_queries > 1")


def genes_of_names(matches: DataFrame) -> DataFrame:
    """(target, genes): the genes behind each name, as sorted text."""
    return matches.filter("target is not null").groupBy("target").agg(text_set("gene").alias("genes"))


def aligned(df: DataFrame, order: DataFrame, key: str) -> DataFrame:
    """Rows of df in the order of another table (key, place), every key of which must be there once."""
    assert_subset(order.select(key), df, [key])
    return order.join(assert_unique(df, key), key).orderBy("place").select(*df.columns)

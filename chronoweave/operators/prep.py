"""Relational preparation: ids, relations, history, cross-references, version policy, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ids import DELIMITER, versioned, zero_to_null
from ..schema import assert_absent, assert_unique


def release_ids(raw: DataFrame, association: DataFrame | None = None, key: str = "gene_id") -> DataFrame:
    """Ids of one form with a known stable_id, once each; a legacy shape takes stable_id and version from a side table."""
    if "stable_id" not in raw.columns:
        if association is None:
            raise ValueError("raw has no stable_id and there is no side table")
        raw = raw.join(assert_unique(association, key), key, "left")
    return assert_absent(raw.filter(F.col("stable_id").isNotNull()).dropDuplicates(), "stable_id", DELIMITER)


def relation(transcript: DataFrame, gene: DataFrame, translation: DataFrame) -> DataFrame:
    """transcript -> gene (m:1) and translation (1:1), text with "" where absent."""
    out = transcript.join(gene, "gene_id", "left").join(translation, "transcript_id", "left")
    return out.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("gene", "transcript", "translation")]).dropDuplicates()


def history(events: DataFrame, sessions: DataFrame, first: int, last: int) -> DataFrame:
    """Events with their session's releases (full outer, so neither side's rows are lost), raw score 0 as unknown."""
    out = events.join(sessions, "mapping_session_id", "full_outer")
    window = F.col("old_release").between(first, last) & F.col("new_release").between(first, last)
    return out.withColumn("score", zero_to_null(F.col("score"))).filter(window).dropDuplicates()


def external(ids: DataFrame, object_xref: DataFrame, xref: DataFrame, external_db: DataFrame, identity: DataFrame) -> DataFrame:
    """The star of left joins from ids to their names in other databases."""
    out = ids.join(object_xref, "ensembl_id", "left").join(xref, "xref_id", "left")
    out = out.join(external_db, "external_db_id", "left").join(identity, "object_xref_id", "left")
    return out.dropna(subset=["graph_id", "id_db", "name_db"]).dropDuplicates()


def allow_list(df: DataFrame, column: str, allowed: DataFrame) -> DataFrame:
    return df.join(allowed.select(F.col(allowed.columns[0]).alias(column)).distinct(), column, "left_semi").select(*df.columns)


def absent_from(df: DataFrame, column: str, allowed: DataFrame) -> DataFrame:
    """Allowed values that df lacks; a build that needs all of them checks that this is empty."""
    a = allowed.select(F.col(allowed.columns[0]).alias(column)).distinct()
    return a.join(df.select(column).distinct(), column, "left_anti")


def labels_and_accessions(x: DataFrame) -> DataFrame:
    """Each cross-reference under both of its names: columns to rows."""
    return x.select("release", "graph_id", "name_db", F.explode(F.array("id_db", "label")).alias("id_db")).dropna(subset=["id_db"]).dropDuplicates()


def keep_first(df: DataFrame, key: list[str], order: list) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).filter("__n = 1").drop("__n")


def _copies(df: DataFrame, key: list[str]) -> DataFrame:
    return df.withColumn("__c", F.count("*").over(W.partitionBy(*key)))


def drop_all_copies(df: DataFrame, key: list[str]) -> DataFrame:
    return _copies(df, key).filter("__c = 1").drop("__c")


def only_copies(df: DataFrame, key: list[str]) -> DataFrame:
    return _copies(df, key).filter("__c > 1").drop("__c")


def version_summary(ids: DataFrame) -> DataFrame:
    """(release, all_missing, any_missing) of the version column."""
    null = F.col("version").isNull()
    return ids.groupBy("release").agg(F.bool_and(null).alias("all_missing"), F.bool_or(null).alias("any_missing"))


def version_policy(ids: DataFrame, policy: str) -> DataFrame:
    """add: every version is 1; drop: none has one; keep: whole numbers."""
    v = {"add": F.lit(1), "drop": F.lit(None), "keep": F.col("version")}[policy].cast("int")
    return ids.withColumn("version", v)


def across_assemblies(x: DataFrame, priority: DataFrame, mode: str = "all") -> DataFrame:
    """Cross-references of all assemblies: all, unique (each once, from its best assembly) or duplicated (in several)."""
    key = ["release", "graph_id", "id_db", "name_db"]
    if mode == "all":
        return x.dropDuplicates()
    if mode == "duplicated":
        return only_copies(x.dropDuplicates(), key)
    return keep_first(x.join(F.broadcast(priority), "assembly"), key, ["priority"]).select(*x.columns)  # one row an assembly


def prefer(df: DataFrame, key: str, low: Column) -> DataFrame:
    """Drops rows of low priority from groups that have others."""
    return df.withColumn("__any", F.max(~low).over(W.partitionBy(key))).filter(~low | ~F.col("__any")).drop("__any")


def archive_relation(archive: DataFrame) -> DataFrame:
    """(gene, transcript, translation) as versioned names from an archive of ids (gene_stable_id, gene_version, …), once
    each; an absent one is ""."""
    of = {"gene": "gene", "transcript": "transcript", "translation": "translation"}
    return archive.select(*[F.coalesce(versioned(F.nullif(f"{c}_stable_id", F.lit("")), F.col(f"{c}_version")), F.lit("")).alias(k) for k, c in of.items()]).dropDuplicates()


def any_member(df: DataFrame, sets: dict[str, DataFrame]) -> DataFrame:
    """Rows of which some column (key of sets) is in that column's set."""
    out = df
    for i, (c, names) in enumerate(sets.items()):
        out = out.join(names.select(F.col(names.columns[0]).alias(c)).distinct().withColumn(f"__in{i}", F.lit(True)), c, "left")
    some = F.lit(False)
    for i in range(len(sets)):
        some = some | F.coalesce(f"__in{i}", F.lit(False))
    return out.filter(some).select(*df.columns)


def last_active_version(events: DataFrame) -> DataFrame:
    """Events (stable_id, release, version or NULL) with the version that was last known before or at each."""
    w = W.partitionBy("stable_id").orderBy("release").rowsBetween(W.unboundedPreceding, 0)
    return events.withColumn("active_version", F.last("version", ignorenulls=True).over(w))


def beside(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Columns of both, by key: rows that either has."""
    return left.join(assert_unique(right, key), key, "full_outer")


def every_combination(parts: dict[tuple, DataFrame], names: tuple[str, ...]) -> DataFrame:
    """All parts in one table with what tells them apart, such as form, assembly and release, as columns."""
    out = None
    for key, df in parts.items():
        d = df.select(*[F.lit(v).alias(n) for n, v in zip(names, key, strict=True)], *df.columns)
        out = d if out is None else out.unionByName(d)
    return out

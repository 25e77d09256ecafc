"""Exact dedup: group by a 128-bit content hash, keep one stable id, compare bytes inside groups.

Texts are equal when their bytes agree after A-Z are lower-cased; null counts as empty. Rows are grouped by hash; where
a hash has several rows, their texts are grouped by the bytes themselves, pre-aggregated in each task, so a group of
any size is one text of each. A hash with one text, which is every hash but for collisions, names its rows' group;
rows of a collision are joined by text. Texts that have no equal are never shuffled unless there are more repeated
hashes than `broadcast_rows`. A null doc_id never stays unless its whole group has null ids; rows of one doc_id count
each, and where they stay, all of them do. Texts are taken whole, however long; an empty table gives an empty one; other
columns are not read, so their names do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: The most repeated hashes that are broadcast: 16 MB of them.
BROADCAST_ROWS = 1_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", content_hash=F.md5, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs. keep: "min" or "max" id stays.
    content_hash is a parameter so that tests can make collisions."""
    best = {"min": F.min, "max": F.max}[keep]
    d = docs.select(F.col(id_col).alias("__id"), normalised(F.col(text_col)).alias("__t"))
    d = d.withColumn("__h", F.unhex(content_hash(F.col("__t"))))
    rows = materialise(d.select("__id", "__h", F.unhex(F.sha2("__t", 256)).alias("__s")), "hashes")
    found = [best("__id").alias("keep_id"), F.count("*").alias("group_size")]
    groups = materialise(rows.groupBy("__h").agg(*found), "groups")
    many = groups.filter("group_size > 1").select("__h")
    few = many.count() <= broadcast_rows  # 16 bytes each; beyond that the texts are shuffled to the hashes
    inside = d.select("__id", "__t", "__h").join(F.broadcast(many) if few else many, "__h", "left_semi")
    texts = inside.groupBy("__h", "__t").agg(F.count("*").alias("n"))  # the bytes are compared here
    mixed = materialise(texts.groupBy("__h").count().filter("count > 1").select("__h"), "collisions")
    cols = ["__id", "keep_id", "group_size", "__s"]
    if mixed.isEmpty():
        out = rows.join(groups, "__h").select(*cols)
    else:
        out = rows.join(groups.join(mixed, "__h", "left_anti"), "__h").select(*cols)
        apart = d.join(mixed, "__h", "left_semi")
        by_text = apart.groupBy("__t").agg(*found)
        out = out.unionByName(apart.withColumn("__s", F.unhex(F.sha2("__t", 256))).join(by_text, "__t").select(*cols))
    out = out.withColumn("text_sha256", F.lower(F.hex("__s")))
    return out.select(F.col("__id").alias("doc_id"), "keep_id", "group_size", F.col("__id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")

"""A pipeline over `documents`: language, repeated lines, near copies, source mix, tokens.

Each stage takes (spark, docs, sf_dir), gets all that the one before kept, and is written as Parquet and read again;
all but the last return the columns of documents, and any others that docs have, whatever their names.

Null, empty and letterless texts go in the first stage. A document of which every line repeats earlier ones goes in the
second; of a group of near copies the smallest doc_id stays (rows equal in id and text are one document, rows without
an id are in no group); a document that the mix draws twice is two rows from there on. Ties are broken by id and by
hashes of ids and texts, so reruns agree. Texts are worked on whole, however long. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronoweave.llm import bpe, langid, line_dedup, mixing, simhash
from chronoweave.llm.common import materialise, read
from chronoweave.llm.queries import vocabulary_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters or of unclear language go."""
    return langid.stage(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated three-line windows go, and documents that are nothing else."""
    return line_dedup.stage(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose five-word shingles have a similarity of 0.8 or more, linked also by way of others, one stays."""
    return simhash.stage(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target mix takes them."""
    return mixing.stage(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each drawn document."""
    return bpe.bpe(docs, spark.conf.get("spark.chronoweave.vocabulary", None) or vocabulary_path())


STAGES = [("language_id", language_id), ("line_dedup", lines), ("simhash", near_copies), ("mixing", mix), ("bpe", encode)]

#: SQL can express neither the network nor the fingerprints; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs

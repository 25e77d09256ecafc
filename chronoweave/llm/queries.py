"""The queries of this subpackage, over their whole tables, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embedding_dedup, exact_dedup, langid, license_scan, line_dedup, mixing, quality, simhash, toxicity
from .common import read


def vocabulary_path() -> str:
    """Where the installed public tokenizers hold the vocabulary; spark.chronoweave.vocabulary names another file."""
    try:
        import public_tokenizers
    except ImportError as e:
        raise FileNotFoundError("no public_tokenizers here: name a vocabulary file in spark.chronoweave.vocabulary") from e
    return public_tokenizers.path("byte_bpe_50k.json")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("__n_lines").alias("n_lines"), F.size("__removed").cast("long").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_dedup(read(spark, sf_dir, "embeddings"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = spark.conf.get("spark.chronoweave.vocabulary", None) or vocabulary_path()
    return bpe.bpe(read(spark, sf_dir, "documents"), path)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.simhash_dedup(read(spark, sf_dir, "documents"))
    ident = F.when(~F.col("__kn"), F.col("__kd")).alias("doc_id")
    return out.select(ident, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(read(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read(spark, sf_dir, "documents"), keep="max")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.quality(docs, quality.train(docs, read(spark, sf_dir, "labels")))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return langid.language_id(docs, langid.train(docs))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.toxicity(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.dealt(read(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    fns = [op1_line_dedup, op2_embedding_dedup, op3_bpe, op4_simhash, op5_license_scan, op6_exact_dedup, op7_quality, op8_language_id, op9_toxicity, op10_mixing, pipeline]
    return {f.__name__: f for f in fns}


OP1_SQL = """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
w AS (SELECT doc_id, p, [l[p], l[p + 1], l[p + 2]] AS k FROM (SELECT *, unnest(range(1, len(l) - 1)) AS p FROM d WHERE len(l) >= 3)),
v AS (SELECT * FROM w WHERE trim(k[1], ' ') <> '' OR trim(k[2], ' ') <> '' OR trim(k[3], ' ') <> ''),
f AS (SELECT k, min((doc_id, p)) AS first FROM v GROUP BY k HAVING count(*) > 1),
g AS (SELECT DISTINCT doc_id, unnest([p, p + 1, p + 2]) AS p FROM v JOIN f USING (k) WHERE (doc_id, p) <> first),
x AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS p FROM d),
y AS (SELECT x.doc_id, count(*) AS n_lines, count(g.p) AS n_removed,
             coalesce(string_agg(line, chr(10) ORDER BY x.p) FILTER (WHERE g.p IS NULL), '') AS text
      FROM x LEFT JOIN g ON x.doc_id = g.doc_id AND x.p = g.p GROUP BY x.doc_id)
SELECT doc_id, n_lines, n_removed, sha256(text) AS text_sha256 FROM y
"""

OP2_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a, u b
      WHERE a.vec_id <> b.vec_id AND a.n > 0 AND b.n > 0 AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT c.vec_id, coalesce(n_links, 0) AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""

OP6_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": OP1_SQL, "op2_embedding_dedup": OP2_SQL, "op6_exact_dedup": OP6_SQL, "op10_mixing": mixing.sql()}

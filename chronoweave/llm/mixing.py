"""Mixing sources to target weights: a multivariate-hypergeometric splitting tree over disjoint permuted blocks.

DataFrame functions only. Sources in order of code point, null last, weigh 3, 1, 2, repeating, and share 150 % of all
words; a target stops at twice its source's words, and the excess goes to the others by weight until none is above.
In one formula: target = least(2 x words, level x weight), the level being found by prefix sums over the sources in
order of words per weight. Prefix sums over any number of sources are taken in ranges (running()), not in one task.

Each document falls by a hash of its id into one of `blocks` blocks of its source. A source gives all its blocks once
or twice where its target asks for it, and for the rest a permuted prefix of blocks that fits, then in further rounds
the next blocks that still fit; the miss is less than the smallest block left, a few thousandths of a source or less
once it has thousands of documents.

A source's quota is how many blocks are drawn of it. The tree splits these counts: all quotas' draws, told apart by
source and number only, are put into one uniform order, and each node halves its stretch of it, down to 2^levels
leaves. Given a node's counts by source, its left child's are thus multivariate hypergeometric, and children add up to
their parent. Then each source's drawn blocks, permuted on their own, are dealt to the leaves in disjoint runs as long
as the leaves' counts. Leaves are output shards; inside them rows are shuffled by hash.

Nulls: a null text has no words and is drawn with its block; a null source is a source; a row with a null doc_id falls
by its text's hash. Rows of one doc_id and source share a block and so are drawn alike, as do rows without an id that
have one text and source. Empty tables give empty mixes. Very long texts count whole. Other columns pass through
whatever their names. Only block sums, at most `blocks` rows a source, meet in a source's windows, so a hot source is
many blocks and never one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import KEY, materialise, own_names, row_key

BLOCKS, ROUNDS, SEED = 4096, 8, "mix"
#: Words of one output task, about 50 MB of text, and the tree's least and greatest depth. A shard of a mix that is too
#: large for 2^12 shards of so many words is dealt by hash to several tasks.
TASK_WORDS, LEVELS = 8_000_000, (7, 12)
WORD = r"[^\x20\x09-\x0D]+"
#: The most drawn blocks that are broadcast, of some 100 bytes each: those of 73 sources with thousands of documents.
FEW_BLOCKS = 300_000
#: Ranges in which prefix sums over sources and draws are taken.
RANGES = 8


def _number(x: Column) -> Column:
    return F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("long")


def _tag(*parts) -> Column:
    return F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])


def running(df: DataFrame, order: list[str], sums: dict[str, str], ranges: int = RANGES) -> DataFrame:
    """df with __rank, a row's place in `order` (which must tell all rows apart), and for each of sums (name: column) the
    column's sum over all rows before it. Rows are dealt in ranges of the order; each range sums its own, and one row a
    range gives what lies before it."""
    part = F.spark_partition_id().alias("__part")
    d = materialise(df.repartitionByRange(ranges, *order).select("*", part), "ranges")  # written, so a range keeps its number
    own = d.groupBy("__part").agg(F.count("*").alias("__n"), *[F.sum(c).alias(f"__of_{name}") for name, c in sums.items()])
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)  # one row a range
    zero = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    base = own.select("__part", zero("__n", before).alias("__base"), *[zero(f"__of_{name}", before).alias(f"__of_{name}") for name in sums])
    within = W.partitionBy("__part").orderBy(*order)
    upto = within.rowsBetween(W.unboundedPreceding, -1)
    d = d.join(F.broadcast(base), "__part")
    new = {"__rank": F.col("__base") + F.row_number().over(within)} | {name: F.col(f"__of_{name}") + zero(c, upto) for name, c in sums.items()}
    return d.withColumns(new).drop("__part", "__base", *[f"__of_{name}" for name in sums])


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", blocks: int = BLOCKS) -> DataFrame:
    """docs with __size (words), __sn and __sv (the source, never null), __ih (a hash of its id) and __blk (its block)."""
    ident = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("~"), F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    size = F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long")
    return docs.withColumns({"__sn": F.col(source_col).isNull(), "__sv": F.coalesce(F.col(source_col).cast("string"), F.lit("")), "__size": size, "__ih": _number(_tag(SEED, ident))}).withColumn("__blk", F.col("__ih") % blocks)


def targets(sums: DataFrame) -> DataFrame:
    """Of (__sn, __sv, __size) by source: adds __target."""
    s = running(sums, ["__sn", "__sv"], {})
    s = s.withColumn("__weight", F.element_at(F.array(F.lit(3), F.lit(1), F.lit(2)), ((F.col("__rank") - 1) % 3 + 1).cast("int")).cast("long"))
    s = s.withColumn("__cap", F.col("__size") * 2).withColumn("__per", F.col("__cap").cast("double") / F.col("__weight"))
    s = materialise(running(s.withColumnRenamed("__rank", "__no"), ["__per", "__no"], {"__caps": "__cap", "__before": "__weight"}), "levels")
    everything = F.broadcast(s.agg(F.sum("__size").alias("__all"), F.sum("__weight").alias("__weights")))  # one row
    level = (F.col("__all").cast("double") * 1.5 - F.col("__caps").cast("double")) / (F.col("__weights") - F.col("__before"))
    open_ = s.crossJoin(everything).withColumn("__level", level).filter(F.col("__cap") > F.col("__level") * F.col("__weight"))
    found = F.broadcast(open_.agg(F.min_by("__level", "__rank").alias("__level")))  # one row, null where no source is open
    cap = F.col("__cap").cast("double")
    return s.crossJoin(found).select("__sn", "__sv", "__size", F.coalesce(F.least(cap, F.col("__level") * F.col("__weight")), cap).alias("__target"))


def quotas(rows: DataFrame) -> DataFrame:
    """(__sn, __sv, __blk, __bsize, __source_size, __target, __draws) of every block of rows that measured() made."""
    block = materialise(rows.groupBy("__sn", "__sv", "__blk").agg(F.sum("__size").alias("__bsize")), "blocks")
    per_source = block.groupBy("__sn", "__sv").agg(F.sum("__bsize").alias("__size"))
    t = targets(per_source).withColumnRenamed("__size", "__source_size")
    full = F.when(F.col("__source_size") > 0, F.floor(F.col("__target") / F.col("__source_size"))).otherwise(F.lit(1)).cast("long")
    b = block.join(t, ["__sn", "__sv"])
    b = b.withColumns({"__draws": full, "__left": F.col("__target") - full * F.col("__source_size"), "__key": _number(_tag(SEED, "b", F.col("__sv"), F.col("__blk")))})
    source = W.partitionBy("__sn", "__sv")
    upto = source.orderBy("__key", "__blk").rowsBetween(W.unboundedPreceding, 0)
    b = b.withColumn("__more", F.lit(False))
    for _ in range(ROUNDS):
        fits = ~F.col("__more") & (F.col("__bsize") <= F.col("__left"))
        run = F.sum(F.when(fits, F.col("__bsize")).otherwise(F.lit(0))).over(upto)
        b = b.withColumn("__run", run).withColumn("__new", fits & (F.col("__run") <= F.col("__left")))
        b = b.withColumn("__left", F.col("__left") - F.sum(F.when(F.col("__new"), F.col("__bsize")).otherwise(F.lit(0))).over(source))
        b = b.withColumn("__more", F.col("__more") | F.col("__new"))
    draws = (F.col("__draws") + F.col("__more").cast("long")).alias("__draws")
    return b.select("__sn", "__sv", "__blk", "__bsize", "__source_size", "__target", draws)


def split_counts(quota: DataFrame, levels: int) -> DataFrame:
    """Of (__sn, __sv, __q: draws) by source: the leaves' counts (__sn, __sv, __shard, __c), __shard in 0 .. 2^levels - 1.
    A node of a higher level has the counts of the leaves with its number as their first bits."""
    d = quota.select("__sn", "__sv", F.explode(F.sequence(F.lit(1), F.col("__q"))).alias("__no"))
    d = d.withColumn("__key", _number(_tag(SEED, "t", F.col("__sn"), F.col("__sv"), F.col("__no"))))
    d = running(d, ["__key", "__sn", "__sv", "__no"], {})
    every = F.broadcast(quota.agg(F.sum("__q").alias("__every")))  # one row
    # The floor of place x leaves / draws: halving a stretch at the floor of its middle, again and again.
    leaf = F.expr(f"(__rank - 1) * {1 << levels} div __every").cast("int")
    return d.crossJoin(every).groupBy("__sn", "__sv", leaf.alias("__shard")).agg(F.count("*").alias("__c"))


def split_tree(drawn: DataFrame, levels: int) -> DataFrame:
    """One row for each draw of a block (__sn, __sv, __blk, __draw), with its __shard."""
    source = W.partitionBy("__sn", "__sv")
    counts = split_counts(drawn.groupBy("__sn", "__sv").agg(F.sum("__draws").alias("__q")), levels)
    last = F.sum("__c").over(source.orderBy("__shard").rowsBetween(W.unboundedPreceding, 0))
    counts = counts.withColumn("__last", last)
    places = counts.select("__sn", "__sv", "__shard", F.explode(F.sequence(F.col("__last") - F.col("__c") + 1, F.col("__last"))).alias("__place"))
    d = drawn.select("__sn", "__sv", "__blk", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__draws"))).alias("__draw"))
    key = _number(_tag(SEED, "d", F.col("__sv"), F.col("__blk"), F.col("__draw")))
    d = d.withColumn("__place", F.row_number().over(source.orderBy(key, "__blk", "__draw")).cast("long"))
    return d.join(places, ["__sn", "__sv", "__place"]).select("__sn", "__sv", "__blk", "__draw", "__shard")


@own_names
def mix(docs: DataFrame, levels: int | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", blocks: int = BLOCKS, few_blocks: int = FEW_BLOCKS) -> DataFrame:
    """docs' rows as the mix takes them, repeats as further rows, with __shard and __draw; 2^levels output shards, each
    shuffled in the tasks that write it. Without levels these follow the size of the mix. Up to few_blocks drawn blocks
    are broadcast; beyond that rows are shuffled to their blocks."""
    cols = ["__sn", "__sv", "__blk"]
    m = measured(docs, id_col, text_col, source_col, blocks)
    q = materialise(quotas(m).filter("__draws > 0"), "quotas")
    words = q.agg(F.sum(F.col("__bsize") * F.col("__draws"))).first()[0] or 0
    if levels is None:
        levels = min(max(LEVELS[0], math.ceil(math.log2(max(1, words / TASK_WORDS)))), LEVELS[1])
    tasks = math.ceil(words / (TASK_WORDS << levels)) or 1
    draws = split_tree(q, levels).groupBy(*cols).agg(F.collect_list(F.struct("__shard", "__draw")).alias("__at"))  # two at most
    draws = materialise(draws, "draws")
    if draws.count() <= few_blocks:  # then texts are not shuffled to the blocks
        draws = F.broadcast(draws)
    out = m.join(draws, cols).withColumn("__at", F.explode("__at"))
    order = _number(_tag(SEED, "o", F.col("__ih"), F.col("__at.__draw")))
    out = out.select(*docs.columns, F.col("__at.__shard").alias("__shard"), F.col("__at.__draw").alias("__draw"), order.alias("__order"))
    by = ["__shard"] if tasks == 1 else ["__shard", F.col("__order") % tasks]
    return out.repartition(*by).sortWithinPartitions("__shard", "__order").drop("__order")


def taken(docs: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row of docs."""
    cols = ["__sn", "__sv", "__blk"]
    narrow = docs.select(F.col("doc_id").alias("__id"), F.col("text").alias("__t"), F.col("source").alias("__s"))
    m = materialise(measured(narrow, "__id", "__t", "__s", blocks).select("__id", *cols, "__size"), "sizes")
    q = materialise(quotas(m), "quotas")
    return m.join(q, cols).select(F.col("__id").alias("doc_id"), F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("__size") * F.col("__draws")).alias("taken"))


def dealt(docs: DataFrame) -> DataFrame:
    """What taken() foretells, counted in the shards: mix() deals all rows, the shards are written and read again, and
    the words of a row's copies in them are its taken; 0 where there is none. The shards hold each row's key and words
    in place of its text, which the result does not need. Rows equal in id, source and text share theirs."""
    key = [*KEY, "__sn", "__sv"]
    d = measured(docs.select("doc_id", "text", "source")).withColumns(dict(zip(KEY, row_key("doc_id", "text"), strict=True))).drop("__blk", "__ih")
    rows = materialise(d.select("doc_id", *key, "__size"), "sizes")
    shards = materialise(mix(d).select("__shard", "__draw", *key, "__size"), "shards")
    drawn = materialise(shards.groupBy(*key).agg(F.sum("__size").alias("__drawn")), "drawn")
    t = targets(rows.groupBy("__sn", "__sv").agg(F.sum("__size").alias("__size"))).withColumnRenamed("__size", "__source_size")
    per = materialise(rows.groupBy(*key).agg(F.count("*").alias("__n")).join(drawn, key, "left"), "per_row")
    out = rows.join(per, key).join(t, ["__sn", "__sv"])
    share = F.coalesce(F.expr("__drawn div __n"), F.lit(0)).cast("long")
    return out.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), share.alias("taken"))


@own_names
def stage(docs: DataFrame) -> DataFrame:
    """The pipeline's form: the mix's rows, repeats as rows of their own, in the columns of docs."""
    return mix(docs).select(*docs.columns)


def sql(blocks: int = BLOCKS, rounds: int = ROUNDS) -> str:
    """The same result as taken(), for DuckDB."""
    number = lambda x: f"CAST('0x' || substr(md5({x}), 1, 8) AS BIGINT)"
    text = f"""
WITH d AS (
  SELECT doc_id, source IS NULL AS sn, coalesce(source, '') AS sv,
         CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         {number(f"'{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '~' || md5(coalesce(text, '')))")} % {blocks} AS blk
  FROM documents),
b AS (SELECT sn, sv, blk, CAST(sum(size) AS BIGINT) AS bsize FROM d GROUP BY ALL),
s0 AS (SELECT sn, sv, CAST(sum(bsize) AS BIGINT) AS source_size FROM b GROUP BY ALL),
s1 AS (SELECT *, row_number() OVER (ORDER BY sn, sv) AS rk FROM s0),
s2 AS (SELECT *, CASE (rk - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM s1),
s3 AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5
        - coalesce(CAST(sum(2 * source_size) OVER o AS DOUBLE), 0))
        / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS lv
       FROM s2 WINDOW o AS (ORDER BY CAST(2 * source_size AS DOUBLE) / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s4 AS (SELECT *, (SELECT arg_min(lv, (CAST(2 * source_size AS DOUBLE) / weight, rk)) FROM s3 WHERE 2 * source_size > lv * weight) AS level FROM s3),
s AS (SELECT sn, sv, source_size, coalesce(least(CAST(2 * source_size AS DOUBLE), level * weight), CAST(2 * source_size AS DOUBLE)) AS target FROM s4),
r0 AS (
  SELECT sn, sv, blk, bsize, source_size, target, draws, target - draws * source_size AS rest, false AS more,
         {number(f"'{SEED}|b|' || sv || '|' || CAST(blk AS VARCHAR)")} AS k
  FROM (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 1 END AS draws
        FROM b JOIN s USING (sn, sv)))"""
    for i in range(rounds):
        text += f""",
x{i} AS (SELECT *, NOT more AND bsize <= rest AS fits,
    sum(CASE WHEN NOT more AND bsize <= rest THEN bsize ELSE 0 END) OVER (PARTITION BY sn, sv ORDER BY k, blk ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM r{i}),
r{i + 1} AS (SELECT sn, sv, blk, bsize, source_size, target, draws,
    rest - CAST(sum(CASE WHEN fits AND run <= rest THEN bsize ELSE 0 END) OVER (PARTITION BY sn, sv) AS BIGINT) AS rest,
    more OR (fits AND run <= rest) AS more, k FROM x{i})"""
    return text + f"""
SELECT d.doc_id, d.size, q.source_size, q.target, d.size * (q.draws + CAST(q.more AS BIGINT)) AS taken
FROM d JOIN r{rounds} q USING (sn, sv, blk)"""

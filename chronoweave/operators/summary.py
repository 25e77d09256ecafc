"""Summaries of connections: sets, trios, degrees, modal forms, availability, source inference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import SENTINEL
from ..functions.temporal import to_points, to_ranges
from ..schema import FORMS, ContractError
from ..session import cut
from . import prep



def text_set(c: str) -> Column:
    """A set as sorted text."""
    return F.array_join(F.sort_array(F.collect_set(c)).cast("array<string>"), ",")


def by_database(conn: DataFrame, node: str = "src") -> DataFrame:
    """(node, db, assembly, releases): what a node is connected by."""
    return conn.groupBy(F.col(node).alias("node"), "db", "assembly").agg(text_set("release").alias("releases"))


def genes_by_assembly(conn: DataFrame) -> DataFrame:
    """The gene side: reversed edges, relabelled by assembly."""
    label = F.concat(F.lit("assembly_"), F.col("assembly").cast("string"), F.lit("_gene"))
    return conn.groupBy(F.col("dst").alias("node"), label.alias("db"), "assembly").agg(text_set("release").alias("releases"))


def hubs(conn: DataFrame, more_than: int = 50) -> DataFrame:
    d = conn.select("src", "dst").distinct()
    return d.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree")).filter(F.col("degree") > more_than)


def modal_form(conn: DataFrame, form_of: DataFrame) -> DataFrame:
    """(db, form): the form that most of a database's edges reach; the smaller name on a tie."""
    c = conn.join(form_of.withColumnRenamed("node", "dst"), "dst").groupBy("db", "form").agg(F.count("*").alias("n"))
    return prep.keep_first(c, ["db"], [F.desc("n"), "form"])


def _gene_db(assembly: Column) -> Column:
    return F.concat(F.lit("assembly_"), assembly.cast("string"), F.lit("_gene"))


def trios(conn: DataFrame, ranges: DataFrame | None = None, last: int | None = None, main: int = 38) -> DataFrame:
    """(node, db, assembly, release): names by their databases, genes by the assemblies that connect them. With ranges
    (node, start, end) of sentinels, these have a trio for each release in which they hold, to `last` where open."""
    gene = _gene_db(F.col("assembly")).alias("db")
    out = conn.select(F.col("src").alias("node"), "db", "assembly", "release").unionByName(conn.select(F.col("dst").alias("node"), gene, "assembly", "release"))
    if ranges is not None:
        held = to_points(ranges.filter(F.col("node").rlike(SENTINEL)), ["node"], last)
        out = out.unionByName(held.select("node", F.lit(f"assembly_{main}_gene").alias("db"), F.lit(main).alias("assembly"), "release"))
    return out.distinct()


def id_list(t: DataFrame, db: str, assembly: int, release: int) -> DataFrame:
    """Nodes of a source; the forms' own names stand for those of the assembly, sentinels are left out."""
    if db in FORMS:
        db = f"assembly_{assembly}_gene" if db == "gene" else {"transcript": "form_gene", "translation": "form_transcript"}[db]
    f = t.filter((F.col("db") == db) & (F.col("assembly") == assembly) & (F.col("release") == release))
    return f.select("node").filter(~F.col("node").rlike(SENTINEL)).distinct()


def external_nodes(conn: DataFrame, db: str) -> DataFrame:
    """All names that a database ever had."""
    return conn.filter(F.col("db") == db).select(F.col("src").alias("node")).distinct()


def ranges_of_all(conn: DataFrame, ranges: DataFrame) -> DataFrame:
    """(node, seq, start, end) of every node: genes by their history, others by the releases of their connections."""
    genes = ranges.select("node").distinct()
    others = conn.select(F.col("src").alias("node"), "release").unionByName(conn.select(F.col("dst").alias("node"), "release")).join(genes, "node", "left_anti")
    return ranges.select("node", "seq", "start", "end").unionByName(to_ranges(others, ["node"]))


def ranges_all_inclusive(conn: DataFrame, ranges: DataFrame, last: int, main: int = 38) -> DataFrame:
    """Ranges of genes over all assemblies: their own, and the releases at which others know them. That the main
    assembly's connections lie inside a gene's own ranges is an error where it does not hold."""
    own = to_points(ranges, ["node"], last)
    seen = conn.select(F.col("dst").alias("node"), "assembly", "release").distinct().join(ranges.select("node").distinct(), "node", "left_semi")
    if bad := seen.filter(F.col("assembly") == main).join(own, ["node", "release"], "left_anti").take(3):
        raise ContractError(f"connected outside their ranges: {bad}")
    return to_ranges(own.unionByName(seen.filter(F.col("assembly") != main).select("node", "release")), ["node"])


_BY = {"complete": ["db", "assembly", "release"], "release": ["release"], "assembly": ["assembly"], "assembly_release": ["assembly", "release"]}


def _counted(d: DataFrame, by: list[str]) -> DataFrame:
    return d.groupBy(*by).agg(F.count("*").alias("n_ids")).orderBy(F.desc("n_ids"), *by)


def infer_source(t: DataFrame, names: DataFrame, mode: str = "complete") -> DataFrame:
    """How many of the names each source has: by (db, assembly, release), or fewer of these, most first. Ties are
    ordered by the source itself."""
    by = _BY[mode]
    d = t.join(names.select(F.col(names.columns[0]).alias("node")).distinct(), "node", "left_semi").select("node", *by).distinct()
    return _counted(d, by)


def infer_source_of(conn: DataFrame, names: DataFrame, mode: str = "complete") -> DataFrame:
    """infer_source() of trios(conn), which are not made: either end of the connections meets the names on its own."""
    by = _BY[mode]
    n = names.select(F.col(names.columns[0]).alias("node")).distinct()
    ends = (conn.select(F.col("src").alias("node"), "db", "assembly", "release"), conn.select(F.col("dst").alias("node"), _gene_db(F.col("assembly")).alias("db"), "assembly", "release"))
    a, b = (e.select("node", *by).join(n, "node", "left_semi").distinct() for e in ends)
    return _counted(a.unionByName(b).distinct(), by)


def availability(conn: DataFrame) -> DataFrame:
    return conn.groupBy("db", "assembly").agg(text_set("release").alias("releases"), F.count_distinct("src").alias("n_names"))


def richness_at(conn: DataFrame, by: tuple[str, ...] = ("release",)) -> DataFrame:
    """(node, *by, externals, transcripts, translations) distinct neighbours of each gene, at each release: translations
    by its transcripts, externals also by both of these."""
    form = F.when(F.col("db") == "form_gene", "transcript").when(F.col("db") == "form_transcript", "translation").when(F.col("db") == "base", "base").otherwise("external")
    c = cut(conn.select("src", "dst", form.alias("form"), *by).distinct().filter("form <> 'base'"), "richness")
    gene = c.filter("form = 'transcript'").select(F.col("dst").alias("gene"), F.col("src").alias("dst"), *by)
    translated = c.filter("form = 'translation'").join(gene, ["dst", *by]).select("gene", "src", "form", *by)
    above = gene.withColumn("deep", F.lit(False)).unionByName(translated.select("gene", F.col("src").alias("dst"), *by).withColumn("deep", F.lit(True)))
    upper = c.filter("form <> 'translation'").join(above, ["dst", *by]).filter("not deep or form = 'external'").select("gene", "src", "form", *by)
    others = c.filter("form in ('transcript', 'translation')").select(F.col("src").alias("dst")).distinct()
    direct = c.filter("form <> 'translation'").join(others, "dst", "left_anti").select(F.col("dst").alias("gene"), "src", "form", *by)
    # Each neighbour once, dealt by its gene: counts need no further shuffle.
    every = direct.unionByName(translated).unionByName(upper).repartition("gene").distinct()
    n = lambda x: F.sum((F.col("form") == x).cast("long"))
    return every.groupBy(F.col("gene").alias("node"), *by).agg(n("external").alias("externals"), n("transcript").alias("transcripts"), n("translation").alias("translations"))


def richness(conn: DataFrame) -> DataFrame:
    """(node, externals, transcripts, translations) over all releases."""
    return richness_at(conn, ())


def frequency(df: DataFrame, column: str) -> DataFrame:
    """(column, n), most frequent first."""
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def richness_sets(conn: DataFrame) -> DataFrame:
    """(kind, db): the databases and forms whose names count towards a gene's richness."""
    kind = F.when(F.col("db") == "form_gene", "transcript").when(F.col("db") == "form_transcript", "translation").otherwise("external")
    return conn.filter("db <> 'base'").select(kind.alias("kind"), "db").distinct()

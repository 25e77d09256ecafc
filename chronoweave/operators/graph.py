"""Release differences to a temporal multigraph: edges and nodes as rows.

hist_edges (src, dst, old_release, new_release, weight, kind): new_release NULL is open, weight NULL unknown.
conn_edges (src, dst, db, assembly, release): one row for each fact. Direction: external -> gene, transcript -> gene,
translation -> transcript, base -> versioned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ids import SENTINEL, split_id, uppercase_count, versioned
from ..functions.temporal import to_ranges
from ..schema import FORMS, OPEN, assert_unique
from ..session import cut
from . import prep

EDGE = ["src", "dst", "old_release", "new_release", "weight", "kind"]


def calendar(ids: DataFrame) -> DataFrame:
    """(release, idx, prev, next): one row a release; the only window without a key runs over these few rows."""
    w = W.orderBy("release")
    r = ids.select("release").distinct()
    return r.select("release", F.row_number().over(w).alias("idx"), F.lag("release").over(w).alias("prev"), F.lead("release").over(w).alias("next"))


def _steps(ids: DataFrame) -> DataFrame:
    """ids beside their neighbours in time."""
    w = W.partitionBy("stable_id").orderBy("release")
    i = ids.join(F.broadcast(calendar(ids)), "release")  # a row a release
    return i.withColumns({"p_idx": F.lag("idx").over(w), "p_version": F.lag("version").over(w), "n_idx": F.lead("idx").over(w), "node": versioned(F.col("stable_id"), F.col("version"))})


def _edges(df: DataFrame, src, dst, old, new, kind: str, weight=None) -> DataFrame:
    w = F.lit(None) if weight is None else weight
    return df.select(src.alias("src"), dst.alias("dst"), old.cast("int").alias("old_release"), new.cast("int").alias("new_release"), w.cast("double").alias("weight"), F.lit(kind).alias("kind"))


def _sentinel(which: str):
    return F.concat("stable_id", F.lit(f".{which}"))


#: Kinds of edges between one row of ids and its neighbours in time: condition, source, target, releases.
_KINDS = {
    "version": ("p_idx = idx - 1 and p_version <> version", lambda: versioned(F.col("stable_id"), F.col("p_version")), lambda: F.col("node"), "prev", "release"),
    "birth": ("p_idx is null", lambda: _sentinel("Void"), lambda: F.col("node"), "coalesce(prev, release)", "release"),
    "rebirth": ("p_idx < idx - 1", lambda: _sentinel("Retired"), lambda: F.col("node"), "prev", "release"),
    "retirement": ("next is not null and (n_idx is null or n_idx > idx + 1)", lambda: F.col("node"), lambda: _sentinel("Retired"), "release", "next"),
}


def step_edges(ids: DataFrame, *kinds: str) -> DataFrame:
    """Edges of the given kinds (all, if none is named) from one pass over ids: one shuffle and one sort by id."""
    def edge(k: str):
        when, src, dst, old, new = _KINDS[k]
        return F.when(F.expr(when), F.struct(src().alias("src"), dst().alias("dst"), F.expr(old).cast("int").alias("old_release"), F.expr(new).cast("int").alias("new_release"), F.lit(None).cast("double").alias("weight"), F.lit(k).alias("kind")))

    found = F.array_compact(F.array(*[edge(k) for k in kinds or _KINDS]))
    return _steps(ids).select(F.explode(found).alias("e")).select("e.*")


def weighted(edges: DataFrame, events: DataFrame) -> DataFrame:
    """Version edges with the weight of the one event of their step, if any; other edges as they are."""
    e = prep.drop_all_copies(events.filter("old_id = new_id"), ["old_id", "old_release", "new_release", "new_version"])
    e = e.select(versioned(F.col("old_id"), F.col("old_version")).alias("src"), versioned(F.col("new_id"), F.col("new_version")).alias("dst"), "old_release", "new_release", F.lit("version").alias("kind"), F.col("score").alias("s"))
    return edges.join(e, ["src", "dst", "old_release", "new_release", "kind"], "left").withColumn("weight", F.coalesce("weight", "s")).select(*EDGE)


def version_edges(ids: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """id.v -> id.w where adjacent releases differ."""
    d = step_edges(ids, "version")
    return d if events is None else weighted(d, events)


def birth_edges(ids: DataFrame) -> DataFrame:
    return step_edges(ids, "birth")


def rebirth_edges(ids: DataFrame) -> DataFrame:
    return step_edges(ids, "rebirth")


def retirement_edges(ids: DataFrame) -> DataFrame:
    return step_edges(ids, "retirement")


def latest_runs(ids: DataFrame) -> DataFrame:
    """(node, run_start) of what lives in the last release: where its last unbroken run began."""
    cal = calendar(ids)
    i = ids.join(F.broadcast(cal), "release").select(versioned(F.col("stable_id"), F.col("version")).alias("node"), "idx")
    runs = to_ranges(i, ["node"], "idx")
    last = cal.agg(F.max("idx").alias("end"))
    live = runs.join(F.broadcast(last), "end")  # one row
    return live.join(F.broadcast(cal), live["start"] == cal["idx"]).select("node", F.col("release").alias("run_start"))


def lossy_loops(events: DataFrame) -> DataFrame:
    e = events.filter("old_id = new_id and old_version = new_version and score < 1.0")
    node = versioned(F.col("old_id"), F.col("old_version"))
    return _edges(e, node, node, F.col("old_release"), F.col("new_release"), "loop", F.col("score"))


def branch_edges(events: DataFrame, first: int) -> DataFrame:
    e = events.filter((F.col("old_id") != F.col("new_id")) & (F.col("old_version") != 0) & (F.col("new_version") != 0) & (F.col("old_release") >= first))
    return _edges(e, versioned(F.col("old_id"), F.col("old_version")), versioned(F.col("new_id"), F.col("new_version")), F.col("old_release"), F.col("new_release"), "branch", F.col("score"))


def open_loops(ids: DataFrame, events: DataFrame) -> DataFrame:
    loops = lossy_loops(events).groupBy(F.col("src").alias("node")).agg(F.max("new_release").alias("looped"))
    d = latest_runs(ids).join(loops, "node", "left")
    return _edges(d, F.col("node"), F.col("node"), F.greatest("run_start", "looped"), F.lit(None), "open", F.lit(1.0))


def history_edges(ids: DataFrame, events: DataFrame, first: int = 0) -> DataFrame:
    """All seven kinds; nodes that no release's ids have are problems and lose their edges. Steps between releases name
    known nodes only, so just what events name is tested."""
    e = branch_edges(events, first).unionByName(lossy_loops(events)).distinct()
    known = ids.select(versioned(F.col("stable_id"), F.col("version")).alias("src")).distinct()
    e = e.join(known, "src", "left_semi").join(known.withColumnRenamed("src", "dst"), "dst", "left_semi").select(*EDGE)
    return e.unionByName(weighted(step_edges(ids), events)).unionByName(open_loops(ids, events))


def problem_nodes(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Nodes of edges that are neither ids of any release nor sentinels."""
    n = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    known = ids.select(versioned(F.col("stable_id"), F.col("version")).alias("node")).distinct()
    return n.filter(~F.col("node").rlike(SENTINEL)).join(known, "node", "left_anti")


def connection_edges(xref: DataFrame, relation: DataFrame, main: int = 38) -> DataFrame:
    """External names, transcripts and translations to what they name; kinds cannot clash, so each is made distinct on
    its own."""
    x = xref.select(F.col("id_db").alias("src"), F.col("graph_id").alias("dst"), F.col("name_db").alias("db"), "assembly", "release").distinct()
    r = relation.filter("transcript is not null").select(F.col("transcript").alias("src"), F.col("gene").alias("dst"), F.lit("form_gene").alias("db"), F.lit(main).alias("assembly"), "release").distinct()
    t = relation.filter("translation is not null").select(F.col("translation").alias("src"), F.col("transcript").alias("dst"), F.lit("form_transcript").alias("db"), F.lit(main).alias("assembly"), "release").distinct()
    return x.unionByName(r).unionByName(t)


def connections_of(rows: DataFrame, main: int = 38) -> DataFrame:
    """connection_edges() of rows that hold a cross-reference and a relation each (id_db, name_db, assembly, gene,
    transcript, translation, release): one pass, one shuffle."""
    edge = lambda src, dst, db, assembly: F.when(F.col(src).isNotNull(), F.struct(F.col(src).alias("src"), F.col(dst).alias("dst"), db.alias("db"), assembly.alias("assembly"), "release"))
    own = F.array_compact(F.array(edge("id_db", "gene", F.col("name_db"), F.col("assembly")), edge("transcript", "gene", F.lit("form_gene"), F.lit(main)), edge("translation", "transcript", F.lit("form_transcript"), F.lit(main))))
    return rows.select(F.explode(own).alias("e")).select("e.*").distinct()


def checked(facts: DataFrame) -> DataFrame:
    """facts to be added to a graph; the same fact twice is an error."""
    return assert_unique(facts, "src", "dst", "db", "assembly", "release")


def nodes(ids: DataFrame) -> DataFrame:
    last = ids.agg(F.max("release").alias("last"))
    n = ids.groupBy("stable_id", "version").agg(F.max("release").alias("r"))
    n = n.join(F.broadcast(last))  # one row
    return n.select(versioned(F.col("stable_id"), F.col("version")).alias("node"), F.col("stable_id").alias("id"), F.col("version").cast("string").alias("version"), F.lit("gene").alias("node_type"), (F.col("r") == F.col("last")).alias("is_latest"))


def base_edges(ids: DataFrame, assembly: int = 38) -> DataFrame:
    return ids.select(F.col("stable_id").alias("src"), versioned(F.col("stable_id"), F.col("version")).alias("dst"), F.lit("base").alias("db"), F.lit(assembly).alias("assembly"), "release").distinct()


def assembly_only(xref: DataFrame, main: int = 38) -> DataFrame:
    """Genes that only other assemblies know."""
    m = xref.filter(F.col("assembly") == main).select("graph_id").distinct()
    return xref.filter(F.col("assembly") != main).select("graph_id", "assembly").distinct().join(m, "graph_id", "left_anti")


def misplaced_external(xref: DataFrame, gene_nodes: DataFrame) -> DataFrame:
    """External names that are gene nodes already: recorded, given no edge."""
    return xref.select(F.col("id_db").alias("node")).distinct().join(gene_nodes.select("node"), "node", "left_semi")


def compose(parts: dict[str, DataFrame]) -> DataFrame:
    """Node tables of several forms; on a clash the later form wins."""
    out = None
    for form, df in parts.items():
        d = df.withColumn("__f", F.lit(FORMS.index(form)))
        out = d if out is None else out.unionByName(d)
    return prep.keep_first(out, ["node"], [F.desc("__f")]).drop("__f")


def prune_history(edges: DataFrame, types: DataFrame, drop: list[str]) -> DataFrame:
    """Without history between nodes of the given types."""
    a, b = types.select(F.col("node").alias("src"), F.col("node_type").alias("__a")), types.select(F.col("node").alias("dst"), F.col("node_type").alias("__b"))
    e = edges.join(a, "src", "left").join(b, "dst", "left")
    return e.filter(~(F.coalesce(F.col("__a") == F.col("__b"), F.lit(False)) & F.coalesce(F.col("__a").isin(drop), F.lit(False)))).drop("__a", "__b").select(*edges.columns)


def case_winners(conn: DataFrame) -> DataFrame:
    """(lowered, winner) of names that differ in case only: fewest edges, fewest capitals, smallest name wins."""
    d = conn.groupBy("src").agg(F.count("*").alias("n")).withColumn("lowered", F.lower("src"))
    many = prep.only_copies(d, ["lowered"])
    return prep.keep_first(many, ["lowered"], ["n", uppercase_count(F.col("src")), "src"]).select("lowered", F.col("src").alias("winner"))


def _case(conn: DataFrame) -> tuple[DataFrame, DataFrame]:
    """conn dealt by its lowered names, and (lowered, winner) of all of these: counts and winners need no further shuffle."""
    c = conn.withColumn("lowered", F.lower("src")).repartition("lowered")
    d = c.groupBy("lowered", "src").agg(F.count("*").alias("n"))
    return c, d.groupBy("lowered").agg(F.min(F.struct("n", uppercase_count(F.col("src")).alias("caps"), "src")).alias("w")).select("lowered", F.col("w.src").alias("winner"))


def merge_case(conn: DataFrame) -> DataFrame:
    """Names that differ in case only are one: that of case_winners()."""
    c, w = _case(conn)
    j = c.join(w, "lowered", "left")
    columns = [F.coalesce("winner", "src").alias("src"), *conn.columns[1:]]
    return j.select("lowered", *columns).distinct().drop("lowered")


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(*[F.col({"src": "dst", "dst": "src"}.get(c, c)).alias(c) for c in edges.columns])


def edge_events(edges: DataFrame) -> DataFrame:
    """Births and ends of every node, for functions.temporal.backbone; self-loops other than the open one say nothing."""
    e = edges.filter("src <> dst or new_release is null")
    births = e.filter("src <> dst").select(F.col("dst").alias("node"), F.col("new_release").alias("release"), F.lit(True).alias("is_birth"))
    ends = e.select(F.col("src").alias("node"), F.when(F.col("src") == F.col("dst"), F.lit(OPEN)).otherwise(F.col("old_release")).alias("release"), F.lit(False).alias("is_birth"))
    return births.unionByName(ends).filter(~F.col("node").rlike(SENTINEL))


def full(ids: DataFrame, relation: DataFrame, xref: DataFrame, main: int = 38) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of all forms. relation and xref may cover several assemblies (relation: a column `assembly`, else
    the main one). Nodes (node, node_type): genes, their bases, genes that other assemblies only know
    (assembly_<a>_gene), transcripts, translations, externals; a name of several kinds has the first of these. Edges
    (src, dst, db, assembly, release): names that are genes get none, names that differ in case only are one."""
    gene = ids.select(versioned(F.col("stable_id"), F.col("version")).alias("node")).distinct()
    rel = relation if "assembly" in relation.columns else relation.withColumn("assembly", F.lit(main))
    wrong = cut(misplaced_external(xref, gene), "misplaced").withColumnRenamed("node", "id_db")  # few, if any: their size is known
    named = xref.join(wrong, "id_db", "left_anti").select(F.col("id_db").alias("src"), F.col("graph_id").alias("dst"), F.col("name_db").alias("db"), "assembly", "release").distinct()
    form = lambda src, dst, db: rel.filter(F.col(src).isNotNull() & (F.col(src) != "")).select(F.col(src).alias("src"), F.col(dst).alias("dst"), F.lit(db).alias("db"), "assembly", "release").distinct()
    edges = merge_case(named).unionByName(form("transcript", "gene", "form_gene")).unionByName(form("translation", "transcript", "form_transcript")).unionByName(base_edges(ids, main))
    other = assembly_only(xref, main).withColumnRenamed("graph_id", "node").join(gene, "node", "left_anti")
    kinds = [
        gene.withColumn("node_type", F.lit("gene")),
        ids.select(F.col("stable_id").alias("node"), F.lit("base").alias("node_type")).distinct(),
        other.select("node", F.concat(F.lit("assembly_"), F.col("assembly").cast("string"), F.lit("_gene")).alias("node_type")),
        rel.filter("transcript <> ''").select(F.col("transcript").alias("node"), F.lit("transcript").alias("node_type")).distinct(),
        rel.filter("translation <> ''").select(F.col("translation").alias("node"), F.lit("translation").alias("node_type")).distinct(),
        _case(named)[1].select(F.col("winner").alias("node"), F.lit("external").alias("node_type")),
    ]
    out = None
    for i, df in enumerate(kinds):
        d = df.withColumn("__o", F.lit(i))
        out = d if out is None else out.unionByName(d)
    return prep.keep_first(out, ["node"], ["__o", "node_type"]).drop("__o"), edges


def with_sessions(edges: DataFrame, sessions: DataFrame) -> DataFrame:
    """Edges of history beside the attributes of the one session that led from old_release to new_release."""
    return edges.join(assert_unique(sessions, "old_release", "new_release"), ["old_release", "new_release"], "left")


def sentinel_ranges(edges: DataFrame) -> DataFrame:
    """(node, start, end) in which ids are retired: from each retirement to the next rebirth, open where there is none."""
    ends = edges.filter(F.col("dst").endswith(".Retired")).select(F.col("dst").alias("node"), F.col("new_release").alias("start"))
    back = edges.filter(F.col("src").endswith(".Retired")).select(F.col("src").alias("node"), F.col("old_release").alias("until"))
    j = ends.join(back, "node", "left").filter("until is null or until >= start").groupBy("node", "start").agg(F.min("until").alias("end"))
    alone = ends.join(j.select("node", "start"), ["node", "start"], "left_anti").withColumn("end", F.lit(None).cast("int"))
    return j.unionByName(alone)


def forms_history(forms: dict[str, tuple[DataFrame, DataFrame]], keep: str = "gene") -> tuple[DataFrame, DataFrame]:
    """(edges, types) of the histories of several forms (ids, events), of which only that of `keep` stays: nodes of the
    others keep their type, and lose their edges to each other and their sentinels."""
    edges, types = None, {}
    for form, (ids, events) in forms.items():
        h = history_edges(ids, events)
        edges = h if edges is None else edges.unionByName(h)
        own = ids.select(versioned(F.col("stable_id"), F.col("version")).alias("node")).distinct()
        types[form] = own.withColumn("form", F.lit(form))
    types = compose(types).withColumnRenamed("form", "node_type")
    # A sentinel has the type of the id that it stands for.
    ends = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct().filter(F.col("node").rlike(SENTINEL))
    bare = types.select(split_id(F.col("node"))[0].alias("id"), "node_type").distinct()
    ends = ends.withColumn("id", split_id(F.col("node"))[0]).join(bare, "id").select("node", "node_type")
    return prune_history(edges, types.unionByName(ends), [f for f in forms if f != keep]), types

"""From a name at one release to what it is at another, in a target database: batches of queries as one plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.temporal import backbone, direction, entry_points, to_ranges
from ..operators import graph, search
from ..operators.prep import prefer
from ..operators.summary import richness_at
from ..schema import PRIORITY
from ..session import cut
from ..sources.store import Store


@dataclass
class Tables:
    """The graph: history, connections, nodes and active ranges."""

    history: DataFrame
    connections: DataFrame
    nodes: DataFrame
    ranges: DataFrame


def build(ids: DataFrame, events: DataFrame, xref: DataFrame, relation: DataFrame) -> Tables:
    """Genes by history and all names of genes, transcripts and translations, with bases (ids without their version)."""
    return connected(ids, events, graph.connection_edges(xref, relation))


def connected(ids: DataFrame, events: DataFrame, conn: DataFrame) -> Tables:
    """build() with connection_edges() that are at hand."""
    h = cut(graph.history_edges(ids, events), "history")
    c = conn.unionByName(graph.base_edges(ids))
    return Tables(h, cut(c, "connections"), graph.nodes(ids), backbone(graph.edge_events(h), ["node"]))


def save(t: Tables, store: Store, prefix: str = "graph", overwrite: bool = False) -> None:
    for name in ("history", "connections", "nodes", "ranges"):
        store.write(f"{prefix}_{name}", getattr(t, name), overwrite=overwrite)


def load(store: Store, prefix: str = "graph") -> Tables:
    return Tables(*[store.read(f"{prefix}_{name}") for name in ("history", "connections", "nodes", "ranges")])


def get_graph(store: Store, make: Callable[[], Tables], prefix: str = "graph", create: bool = False, keep: bool = True, overwrite: bool = False) -> Tables:
    """The stored graph, or what make() gives, stored; create makes it even where one is stored."""
    if not create and all(f"{prefix}_{name}" in store for name in ("history", "connections", "nodes", "ranges")):
        return load(store, prefix)
    made = make()
    if not keep:
        return made
    save(made, store, prefix, overwrite or create)
    return load(store, prefix)


INT_MAX = 2147483647
NODE = ("gene", "transcript", "translation", "base", "external")


def node_types(t: Tables) -> DataFrame:
    """(node, node_type) of all that has a connection or a history; a gene is a gene, whatever else bears its name."""
    a, b = search._kinds(t.connections)
    place = {k: i for i, k in enumerate(NODE)}
    at = lambda x: F.create_map(*[F.lit(v) for kv in place.items() for v in kv])[x]
    ends = t.connections.select(F.explode(F.array(F.struct(F.col("src").alias("node"), at(a).alias("i")), F.struct(F.col("dst").alias("node"), at(b).alias("i")))).alias("e")).select("e.*")
    genes = t.nodes.select("node", F.lit(0).alias("i"))
    best = ends.unionByName(genes).groupBy("node").agg(F.min("i").alias("i"))
    return best.select("node", F.element_at(F.array(*map(F.lit, NODE)), F.col("i") + 1).alias("node_type"))


def all_ranges(t: Tables) -> DataFrame:
    """(node, start, end): genes as they live in history, others as they are connected."""
    genes = t.nodes.select("node").distinct()
    others = t.connections.select(F.col("src").alias("node"), "release").join(genes, "node", "left_anti")
    return t.ranges.select("node", "start", "end").unionByName(to_ranges(others, ["node"]).select("node", "start", "end"))


def started(t: Tables, queries: DataFrame) -> DataFrame:
    """(qid, query_id, node, node_type, release, to_release, reverse) for queries (query_id, from_release, to_release):
    names are resolved; a query without from_release begins where its node lives nearest to to_release, both ways if
    that lies inside its life. Queries without a node are left out."""
    types = cut(node_types(t), "types")
    last = F.broadcast(t.connections.agg(F.max("release").alias("__last")))  # one row
    q = queries.select("query_id", F.col("from_release").cast("int").alias("from_release"), F.col("to_release").cast("int").alias("to_release")).distinct().crossJoin(last)
    q = q.withColumn("to_release", F.coalesce("to_release", "__last")).drop("__last")
    q = q.withColumn("qid", F.concat_ws("|", "query_id", F.coalesce(F.col("from_release").cast("string"), F.lit("")), F.col("to_release").cast("string")))
    names = search.resolve(q.select("query_id"), types.select("node")).filter("node is not null").select(F.col("query").alias("query_id"), "node")
    q = cut(q.join(names, "query_id").join(types, "node"), "known")
    given = q.filter("from_release is not null").select("qid", "query_id", "node", "node_type", F.col("from_release").alias("release"), "to_release", (F.col("from_release") > F.col("to_release")).alias("reverse"))
    open_ = q.filter("from_release is null")
    points = entry_points(open_.join(all_ranges(t), "node"), "to_release")
    way = direction(points, ["qid", "query_id", "node", "node_type", "to_release"])
    both = F.array_compact(F.array(F.when(F.col("forward_from").isNotNull(), F.struct(F.col("forward_from").alias("release"), F.lit(False).alias("reverse"))), F.when(F.col("reverse_from").isNotNull(), F.struct(F.col("reverse_from").alias("release"), F.lit(True).alias("reverse")))))
    inferred = way.withColumn("w", F.explode(both)).select("qid", "query_id", "node", "node_type", "w.release", "to_release", "w.reverse")
    return given.unionByName(inferred)


def _paths(t: Tables, rows: DataFrame, any_release: bool, jump, depth: int, hub: int | None, jump_limit: int) -> DataFrame:
    """(qid, target, path) of started() rows: genes walk from where they are, others from the genes that they name at
    their release (with any_release, or where that gives none, at any)."""
    genes = rows.filter("node_type = 'gene'").select(F.col("qid").alias("query_id"), "node", "release", "to_release", "reverse", F.array().cast(f"array<{search.STEP}>").alias("path"), F.array().cast("array<string>").alias("via"))
    others = rows.filter("node_type <> 'gene'")
    starts = genes
    if not others.isEmpty():
        own = others.withColumn("rid", F.concat_ws("|", "qid", F.col("reverse").cast("string")))
        ask = own.select(F.col("rid").alias("query_id"), "node", "node_type", "release")
        parts, rest = [], own
        if not any_release:
            found = cut(search.synonyms(ask, t.connections, "gene", depth, hub, ranges=t.ranges), "strict")
            parts.append(found.withColumnRenamed("query_id", "rid").join(own, "rid").select("qid", "node", F.col("target").alias("entry"), "release", "to_release", (F.col("release") > F.col("to_release")).alias("reverse"), "steps"))
            rest = own.join(found.select(F.col("query_id").alias("rid")).distinct(), "rid", "left_anti")
        if not rest.isEmpty():
            found = search.synonyms(rest.select(F.col("rid").alias("query_id"), "node", "node_type", F.lit(None).cast("int").alias("release")), t.connections, "gene", depth, hub)
            found = cut(found.join(rest.select(F.col("rid").alias("query_id"), "node", "to_release"), "query_id"), "any")
            at = search.entries(found, t.ranges, backbone=False)
            parts.append(at.withColumnRenamed("query_id", "rid").join(rest.select("rid", "qid"), "rid").select("qid", "node", "entry", "release", "to_release", "reverse", "steps"))
        for part in parts:
            names = F.array_union(F.array("node"), search.names_of())
            starts = starts.unionByName(part.select(F.col("qid").alias("query_id"), F.col("entry").alias("node"), "release", "to_release", "reverse", F.col("steps").alias("path"), names.alias("via")))
    if jump is not None:
        return search.walk(starts.distinct(), t.history, jump, jump_limit).withColumnRenamed("query_id", "qid")
    # Without jumps a way through history does not depend on who asks: each start is walked once.
    key = F.concat_ws("|", "node", *[F.col(c).cast("string") for c in ("release", "to_release", "reverse")])
    starts = cut(starts.select(F.col("query_id").alias("qid"), key.alias("query_id"), "node", "release", "to_release", "reverse", F.col("path").alias("before")).distinct(), "starts")
    went = search.walk(starts.select("query_id", "node", "release", "to_release", "reverse").distinct(), t.history)
    return starts.select("qid", "query_id", "before").join(went, "query_id").select("qid", "target", F.concat("before", "path").alias("path")).distinct()


def possible_paths(t: Tables, rows: DataFrame, go_external: bool = True, depth: int = 2, deeper: int = 2, jump_limit: int = 2, hub: int | None = None) -> DataFrame:
    """(qid, target, path, stage) of started() rows by a ladder of ever looser searches, each for what the ones before
    left without a path: 0 history only, 1 with jumps through names, 2 and 3 the same from any release of a name."""
    out, rest = None, rows
    for stage, (any_release, jumps) in enumerate([(False, False), (False, True), (True, False), (True, True)]):
        if jumps and not go_external:
            continue
        if any_release:  # changes nothing for genes
            rest = rest.filter("node_type <> 'gene'")
        for d in range(depth, depth + deeper + 1) if jumps else [depth]:
            if rest.isEmpty():
                break
            jump = search.jumper(t.connections, t.ranges, d, hub) if jumps else None
            got = cut(_paths(t, rest, any_release, jump, d, hub, jump_limit).withColumn("stage", F.lit(stage)), "paths")
            out = got if out is None else out.unionByName(got)
            rest = cut(rest.join(got.select("qid").distinct(), "qid", "left_anti").select(*rest.columns), "rest")
    if out is None:
        out = _paths(t, rows, False, None, depth, hub, jump_limit).withColumn("stage", F.lit(0))
    return out


def to_gene(t: Tables, rows: DataFrame, reduction: str = "mean", remove_na: str = "omit", empty: float | None = None, **ladder) -> DataFrame:
    """(qid, target, path, stage, ...): the best path to each gene with its scores."""
    pri = F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])
    genes = t.connections.groupBy(F.col("dst").alias("node")).agg(F.array_sort(F.collect_set(pri[F.col("assembly")])).alias("pri"))
    paths = possible_paths(t, rows, **ladder).withColumnRenamed("qid", "query_id")
    return search.best_per_target(search.scored(paths, genes, reduction, remove_na, empty)).withColumnRenamed("query_id", "qid")


def priorities_at(connections: DataFrame) -> DataFrame:
    """(target, to_release, final_pri): assemblies that know a gene at a release, as sorted priorities."""
    pri = F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])
    return connections.groupBy(F.col("dst").alias("target"), F.col("release").alias("to_release")).agg(F.array_sort(F.collect_set(pri[F.col("assembly")])).alias("final_pri"))


def to_database(t: Tables, genes: DataFrame, db: str | None, alternative: bool = True, hub: int | None = None) -> DataFrame:
    """(target, to_release, final, confidence, pris, final_pri) for genes (target, to_release): the names in db that the
    main assembly has at to_release (confidence 0), else those that it reaches by connections of any release whose last
    is of to_release (1), else with `alternative` the gene itself (NULL). Without db the gene is the result."""
    genes = genes.select("target", "to_release").distinct()
    at = priorities_at(t.connections)
    own = genes.join(at, ["target", "to_release"], "left").withColumn("final_pri", F.coalesce("final_pri", F.array(F.lit(INT_MAX))))
    own = own.select("target", "to_release", F.col("target").alias("final"), F.array().cast("array<array<int>>").alias("pris"), "final_pri")
    if db is None:
        return own.withColumn("confidence", F.lit(0))
    key = F.concat_ws("|", "target", F.col("to_release").cast("string"))
    genes = cut(genes.withColumn("query_id", key), "genes")
    main = min(PRIORITY, key=PRIORITY.get)
    out, rest = None, genes
    for confidence, release in enumerate((F.col("to_release"), F.lit(None).cast("int"))):
        ask = rest.select("query_id", F.col("target").alias("node"), F.lit("gene").alias("node_type"), release.alias("release"))
        found = search.synonyms(ask, t.connections, "external", 2, hub, db, shallow=True).withColumnRenamed("target", "final").join(rest, "query_id")
        ends = F.exists("last", lambda f: (f["db"] == db) & (f["assembly"] == main) & (f["release"] == F.col("to_release")))
        found = found.filter(F.exists("steps", lambda x: F.array_contains(x["pri"], PRIORITY[main])) & ends)
        found = cut(found.select("query_id", "target", "to_release", "final", F.col("steps.pri").alias("pris"), F.element_at("steps.pri", -1).alias("final_pri"), F.lit(confidence).alias("confidence")), "named")
        rest = cut(rest.join(found.select("query_id").distinct(), "query_id", "left_anti").select(*rest.columns), "unnamed")
        out = found if out is None else out.unionByName(found)
    out = out.drop("query_id").distinct()
    if alternative:
        alone = own.join(rest.select("target", "to_release"), ["target", "to_release"])
        out = out.unionByName(alone.withColumn("confidence", F.lit(None).cast("int")))
    return out


def convert(t: Tables, queries: DataFrame, db: str | None = None, one: bool = False, return_path: bool = False, alternative: bool = True, low: str | None = "lrg", reduction: str = "mean", remove_na: str = "omit", empty: float | None = None, hub: int | None = None, **ladder) -> DataFrame:
    """End to end for queries (query_id, from_release or NULL, to_release or NULL for the last): names are resolved,
    names of other kinds go to genes, genes through history (possible_paths), and on to db; without db the gene is the
    result. One row for each query, target and final name; a query without a node or a path has a row with a NULL target
    and its status. `one` keeps the best targets only (choose_targets). Genes whose names begin with `low` stay only
    where there is no other. return_path adds path, stage and the scores."""
    rows = cut(started(t, queries), "started")
    best = cut(to_gene(t, rows, reduction, remove_na, empty, hub=hub, **ladder), "best")
    best = best.join(rows.select("qid", "query_id", "node", "to_release").distinct(), "qid")
    if low is not None:
        best = prefer(best, "qid", F.lower("target").startswith(low))
    best = cut(best, "targets")
    final = to_database(t, best, db, alternative, hub)
    got = best.join(final, ["target", "to_release"])
    got = got.withColumn("__hop", F.concat(F.array("last_pri"), "pris")).withColumn("__add", F.when(F.size("pris") > 0, search.jump_fold("__hop", "cur")["jumps"]).otherwise(0))
    keys = {"final_min_pri": F.array_min("final_pri"), "assembly_jump": F.col("assembly_jump") + F.col("__add"), "min_pri": F.array_min("last_pri"), "neg_pri": -F.size("last_pri"), "neg_final_pri": -F.size("final_pri")}
    got = got.withColumns(keys)
    # Two ways to one name differ in their keys only: the better one counts.
    w = W.partitionBy("qid", "target", "final").orderBy(F.coalesce("confidence", F.lit(INT_MAX)), *search.TARGET_KEYS[1:], search.path_text())
    got = got.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n", "__hop", "__add")
    if one:
        ranked = got.withColumns({"confidence": F.coalesce("confidence", F.lit(INT_MAX)), "query_id": F.col("qid"), "__q": F.col("query_id")})
        d = search.choose_targets(ranked)
        rich = richness_at(t.connections).select(F.col("node").alias("target"), F.col("release").alias("to_release"), "externals", "transcripts", "translations")
        counts = [F.coalesce(c, F.lit(0)).desc() for c in ("externals", "transcripts", "translations")]
        d = d.join(rich, ["target", "to_release"], "left").withColumn("__r", F.rank().over(W.partitionBy("qid").orderBy(*counts))).filter("__r = 1")
        got = d.withColumns({"query_id": F.col("__q"), "confidence": F.when(F.col("confidence") < INT_MAX, F.col("confidence"))}).select(*got.columns)
    extra = ["path", "stage", "score", "assembly_jump", "external_jump", "external_step", "steps"] if return_path else []
    got = got.withColumn("path", search.path_text()).select("query_id", "node", "target", "final", "confidence", *extra).distinct()
    out = queries.select("query_id").distinct().join(got, "query_id", "left")
    seen = rows.select("query_id").distinct().withColumn("__seen", F.lit(True))
    status = F.when(F.col("target").isNotNull() & F.col("confidence").isNotNull(), "converted").when(F.col("target").isNotNull(), "no_target").when(F.col("__seen"), "no_conversion").otherwise("no_corresponding")
    return out.join(seen, "query_id", "left").select("query_id", "node", "target", "final", "confidence", *extra, status.alias("status"))


def bins(converted: DataFrame) -> DataFrame:
    """(bin, n): how many queries are in each bin; bins overlap."""
    per = converted.groupBy("query_id").agg(F.count_distinct("final").alias("n"), F.max(F.col("status") == "no_target").alias("alt"), F.max(F.col("status") == "no_conversion").alias("lost"), F.max(F.col("status") == "no_corresponding").alias("unknown"), F.max(F.col("final") == F.col("query_id")).alias("same"))
    ok = ~F.col("alt") & ~F.col("lost") & ~F.col("unknown")
    rules = {
        "input_identifiers": F.lit(True), "no_corresponding": F.col("unknown"), "no_conversion": F.col("lost"),
        "matching_1_to_1": ok & (F.col("n") == 1), "matching_1_to_n": ok & (F.col("n") > 1),
        "changed_only_1_to_1": ok & (F.col("n") == 1) & ~F.col("same"), "changed_only_1_to_n": ok & (F.col("n") > 1) & ~F.col("same"),
        "alternative_target_1_to_1": F.col("alt") & (F.col("n") == 1), "alternative_target_1_to_n": F.col("alt") & (F.col("n") > 1),
    }
    names = F.array_compact(F.array(*[F.when(rule, F.lit(k)) for k, rule in rules.items()]))
    return per.select(F.explode(names).alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


def report(converted: DataFrame) -> str:
    return "\n".join(f"{r['bin']}: {r['n']}" for r in bins(converted).orderBy("bin").collect())  # nine rows at most

"""The registered queries: each operator over derived tables, with its SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import adapters
from .functions import ids as fid
from .functions import temporal as ft
from .operators import graph, harmonize, prep, qa, search, summary
from .plans import convert as plan
from .session import cut
from .sources import store
from .streaming import releases as streams

_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

V = "concat(stable_id, '.', CAST(version AS string))"
SQL = {
    "cal": (("ids",), "SELECT release, row_number() OVER (ORDER BY release) AS idx, lag(release) OVER (ORDER BY release) AS prev, lead(release) OVER (ORDER BY release) AS nxt FROM (SELECT DISTINCT release FROM ids)"),
    "st": (("ids", "cal"), f"SELECT i.*, {V} AS node, c.idx, c.prev, c.nxt, lag(idx) OVER w AS p_idx, lag(version) OVER w AS p_version, lead(idx) OVER w AS n_idx FROM ids i JOIN cal c USING (release) WINDOW w AS (PARTITION BY stable_id ORDER BY release)"),
    "hist": (("history",), "SELECT *, concat(old_id, '.', CAST(old_version AS string)) AS o, concat(new_id, '.', CAST(new_version AS string)) AS n FROM history"),
    "e_version": (("st", "hist"), "SELECT concat(stable_id, '.', CAST(p_version AS string)) AS src, node AS dst, prev AS old_release, release AS new_release, CAST(NULL AS double) AS weight, 'version' AS kind FROM st WHERE p_idx = idx - 1 AND p_version <> version"),
    "e_birth": (("st",), "SELECT concat(stable_id, '.Void') AS src, node AS dst, coalesce(prev, release) AS old_release, release AS new_release, CAST(NULL AS double) AS weight, 'birth' AS kind FROM st WHERE p_idx IS NULL"),
    "e_rebirth": (("st",), "SELECT concat(stable_id, '.Retired') AS src, node AS dst, prev AS old_release, release AS new_release, CAST(NULL AS double) AS weight, 'rebirth' AS kind FROM st WHERE p_idx < idx - 1"),
    "e_retire": (("st",), "SELECT node AS src, concat(stable_id, '.Retired') AS dst, release AS old_release, nxt AS new_release, CAST(NULL AS double) AS weight, 'retirement' AS kind FROM st WHERE nxt IS NOT NULL AND (n_idx IS NULL OR n_idx > idx + 1)"),
    "runs": (("st",), "SELECT node, min(release) AS run_start FROM (SELECT node, release, idx, max(idx) OVER (PARTITION BY node, g) AS top FROM (SELECT *, idx - row_number() OVER (PARTITION BY node ORDER BY idx) AS g FROM st)) WHERE top = (SELECT max(idx) FROM cal) GROUP BY node"),
    "e_loop": (("hist",), "SELECT o AS src, o AS dst, old_release, new_release, score AS weight, 'loop' AS kind FROM hist WHERE old_id = new_id AND old_version = new_version AND score < 1.0"),
    "e_branch": (("hist",), "SELECT o AS src, n AS dst, old_release, new_release, score AS weight, 'branch' AS kind FROM hist WHERE old_id <> new_id AND old_version <> 0 AND new_version <> 0"),
    "e_open": (("runs", "e_loop"), "SELECT node AS src, node AS dst, greatest(run_start, coalesce((SELECT max(new_release) FROM e_loop l WHERE l.src = node), run_start)) AS old_release, CAST(NULL AS int) AS new_release, 1.0 AS weight, 'open' AS kind FROM runs"),
    "edges": (("e_version", "e_birth", "e_rebirth", "e_retire", "e_loop", "e_branch", "e_open"), " UNION ".join(f"SELECT * FROM {e}" for e in ("e_version", "e_birth", "e_rebirth", "e_retire", "e_loop", "e_branch", "e_open"))),
    "ev": (("edges",), "SELECT DISTINCT * FROM (SELECT dst AS node, new_release AS release, true AS b FROM edges WHERE src <> dst UNION ALL SELECT src, CASE WHEN src = dst THEN 2147483647 ELSE old_release END, false FROM edges WHERE src <> dst OR new_release IS NULL) WHERE node NOT LIKE '%.Void' AND node NOT LIKE '%.Retired'"),
    "bb": (("ev",), "SELECT node, g, min(CASE WHEN b THEN release END) AS s, max(CASE WHEN NOT b THEN release END) AS e FROM (SELECT *, sum(nw) OVER (PARTITION BY node ORDER BY release, b DESC ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN b AND NOT coalesce(lag(b) OVER (PARTITION BY node ORDER BY release, b DESC), false) THEN 1 ELSE 0 END AS nw FROM ev)) GROUP BY node, g"),
    "ranges": (("bb",), "SELECT node, CAST(row_number() OVER (PARTITION BY node ORDER BY s) AS int) AS seq, s, nullif(e, 2147483647) AS e FROM bb"),
    "conn": (("xref", "relation"), "SELECT DISTINCT * FROM (SELECT id_db AS src, graph_id AS dst, name_db AS db, assembly, release FROM xref UNION ALL SELECT transcript, gene, 'form_gene', 38, release FROM relation WHERE transcript IS NOT NULL UNION ALL SELECT translation, transcript, 'form_transcript', 38, release FROM relation WHERE translation IS NOT NULL)"),
    "trio": (("conn",), "SELECT DISTINCT * FROM (SELECT src AS node, db, assembly, release FROM conn UNION ALL SELECT dst, concat('assembly_', CAST(assembly AS string), '_gene'), assembly, release FROM conn)"),
    "matches": (("lines", "ids"), "SELECT DISTINCT concat('D', CAST(l_suppkey % 4 AS string)) AS dataset, concat('P', CAST(l_partkey AS string)) AS query, CASE WHEN l_partkey % 11 = 0 THEN NULL WHEN l_partkey % 5 = 0 THEN concat('N', CAST(l_partkey // 10 AS string)) ELSE concat('N', CAST(l_partkey AS string)) END AS target, concat('G', CAST(l_partkey % 97 AS string)) AS gene FROM lines"),
    "matrix": (("lines",), "SELECT concat('D', CAST(l_suppkey % 4 AS string)) AS dataset, stable_id AS obs, concat('P', CAST(l_partkey AS string)) AS feature, sum(l_quantity) AS value FROM lines GROUP BY 1, 2, 3"),
}


def _with(*names: str) -> str:
    out: dict[str, str] = {}

    def add(n: str) -> None:
        if n in SQL:
            needs, text = SQL[n]
            for m in needs:
                add(m)
            out.setdefault(n, f"{n} AS ({text})")
        elif n in adapters.DERIVED:
            for c in adapters.ctes(n):
                out.setdefault(c.split(" ")[0], c)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(out.values()) if out else ""


def query(name: str, sql: str | None = None, *needs: str):
    """Registers a query; sql is the body behind the tables that it needs."""

    def keep(fn):
        _Q[name] = fn
        if sql is not None:
            _SQL[name] = f"{_with(*needs)}\n{sql}"
        return fn

    return keep


class T:
    """Tables of one folder. Ids, their events and history are written at first use, as most of a query hangs on them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return adapters.table(self.spark, self.sf, name)

    @cached_property
    def ids(self) -> DataFrame:
        return cut(adapters.ids(self.spark, self.sf), "ids")

    @cached_property
    def history(self) -> DataFrame:
        return cut(adapters.history_of(self.spark, self.ids), "events")

    @property
    def xref(self) -> DataFrame:
        return adapters.xref(self.spark, self.sf, self.ids)

    @property
    def relation(self) -> DataFrame:
        return adapters.relation(self.spark, self.sf, self.ids)

    @property
    def edges(self) -> DataFrame:
        return graph.history_edges(self.ids, self.history)

    @property
    def ranges(self) -> DataFrame:
        return ft.backbone(graph.edge_events(self.edges), ["node"])

    @property
    def conn(self) -> DataFrame:
        return adapters.connections(self.spark, self.sf, self.ids)

    @property
    def matches(self) -> DataFrame:
        p = F.col("l_partkey")
        name = lambda x: F.concat(F.lit("N"), x.cast("string"))
        target = F.when(p % 11 == 0, None).when(p % 5 == 0, name(F.floor(p / 10))).otherwise(name(p))
        once = self.lines.select(self._dataset, "l_partkey").distinct()  # what all columns hang on
        return cut(once.select("dataset", F.concat(F.lit("P"), p.cast("string")).alias("query"), target.alias("target"), F.concat(F.lit("G"), (p % 97).cast("string")).alias("gene")), "matches")

    @property
    def _dataset(self):
        return F.concat(F.lit("D"), (F.col("l_suppkey") % 4).cast("string")).alias("dataset")

    @property
    def matrix(self) -> DataFrame:
        return self.lines.groupBy(self._dataset, F.col("stable_id").alias("obs"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("feature")).agg(F.sum("l_quantity").alias("value"))


def on(fn: Callable[[T], DataFrame]):
    return lambda spark, sf: fn(T(spark, sf))


# -- projections, filters, cleaning
query("scan_project_filter", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")(on(lambda t: t.orders.filter("o_orderstatus = 'F' and o_totalprice > 100000").select("o_orderkey", "o_custkey")))
query("release_window", "SELECT release, stable_id, version FROM ids WHERE release BETWEEN 9 AND 14", "ids")(on(lambda t: t.ids.filter(F.col("release").between(9, 14))))
query("allowlist_semi", "SELECT * FROM xref WHERE name_db IN (SELECT p_brand FROM part WHERE p_size = 50)", "xref")(on(lambda t: prep.allow_list(t.xref, "name_db", t.part.filter("p_size = 50").select("p_brand"))))
query("allowlist_missing", "SELECT DISTINCT p_brand AS name_db FROM (SELECT p_brand FROM part UNION ALL SELECT concat('No', p_brand) FROM part WHERE p_size > 25) WHERE p_brand NOT IN (SELECT name_db FROM xref)", "xref")(on(lambda t: prep.absent_from(t.xref, "name_db", t.part.select("p_brand").union(t.part.filter("p_size > 25").select(F.concat(F.lit("No"), "p_brand"))))))
_SPELLINGS = ", ".join("'" + x + "'" for x in fid.MISSING)
query("missing_value_normalise", f"SELECT k, CASE WHEN s IS NULL OR list_contains([{_SPELLINGS}], s) THEN '_PLACEHOLDER_NA_' ELSE s END AS segment FROM (SELECT CAST(c_custkey AS bigint) AS k, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN ' unknown ' WHEN c_custkey % 3 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS s FROM customer UNION ALL SELECT CAST(i AS bigint), [{_SPELLINGS}][i] FROM range(1, {len(fid.MISSING) + 1}) AS u(i))")(
    on(lambda t: t.customer.select("c_custkey", F.when(F.col("c_custkey") % 5 == 0, None).when(F.col("c_custkey") % 7 == 0, " unknown ").when(F.col("c_custkey") % 3 == 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment")).alias("s")).unionByName(
        t.spark.range(1, len(fid.MISSING) + 1).select(F.col("id").alias("c_custkey"), F.element_at(F.array(*map(F.lit, fid.MISSING)), F.col("id").cast("int")).alias("s"))).select(F.col("c_custkey").alias("k"), fid.missing_to(F.col("s")).alias("segment"))))
query("numeric_check", "SELECT count(*) FILTER (WHERE try_cast(s AS double) IS NOT NULL) AS numeric, count(*) FILTER (WHERE try_cast(s AS double) IS NULL) AS other FROM (SELECT CASE WHEN p_partkey % 9 = 0 THEN p_brand ELSE CAST(p_size AS string) END AS s FROM part)")(
    on(lambda t: t.part.select(fid.is_numeric(F.when(F.col("p_partkey") % 9 == 0, F.col("p_brand")).otherwise(F.col("p_size").cast("string"))).alias("ok")).agg(F.sum(F.col("ok").cast("long")).alias("numeric"), F.sum((~F.col("ok")).cast("long")).alias("other"))))
query("null_normalise", "SELECT old_id, old_release, nullif(score, 0) AS score, coalesce(nullif(new_id, ''), 'none') AS new_id FROM history", "history")(on(lambda t: t.history.select("old_id", "old_release", fid.zero_to_null(F.col("score")).alias("score"), F.coalesce(F.nullif("new_id", F.lit("")), F.lit("none")).alias("new_id"))))
query("case_insensitive_equality", "SELECT p_partkey, b FROM (SELECT *, CASE WHEN p_partkey % 2 = 0 THEN lower(p_brand) ELSE p_brand END AS b FROM part) WHERE lower(b) = 'brand#12'")(on(lambda t: t.part.select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.lower("p_brand")).otherwise(F.col("p_brand")).alias("b")).filter(F.lower("b") == F.lower(F.lit("BRAND#12")))))
query("delimiter_absence", "SELECT stable_id FROM (SELECT DISTINCT CASE WHEN release = 9 THEN concat(stable_id, '.', CAST(version AS string)) ELSE stable_id END AS stable_id FROM ids) WHERE position('.' IN stable_id) > 0", "ids")(on(lambda t: fid.with_delimiter(t.ids.select(F.when(F.col("release") == 9, fid.versioned(F.col("stable_id"), F.col("version"))).otherwise(F.col("stable_id")).alias("stable_id")).distinct(), "stable_id")))
query("low_priority_filter", "SELECT graph_id, name_db FROM (SELECT *, max(CASE WHEN name_db NOT LIKE 'Brand#1%' THEN 1 ELSE 0 END) OVER (PARTITION BY graph_id) AS a FROM (SELECT DISTINCT graph_id, name_db FROM xref)) WHERE name_db NOT LIKE 'Brand#1%' OR a = 0", "xref")(
    on(lambda t: prep.prefer(t.xref.select("graph_id", "name_db").distinct(), "graph_id", F.col("name_db").startswith("Brand#1"))))
query("versioned_names", "SELECT DISTINCT concat(stable_id, '.', CAST(version AS string)) AS node, stable_id AS id, CAST(version AS string) AS v FROM ids", "ids")(on(lambda t: t.ids.select(fid.versioned(F.col("stable_id"), F.col("version")).alias("node")).distinct().select("node", fid.split_id(F.col("node"))[0].alias("id"), fid.split_id(F.col("node"))[1].alias("v"))))

# -- joins
query("relation_left_joins", "SELECT DISTINCT concat('T', CAST(l.l_orderkey AS string)) AS transcript, coalesce('G' || CAST(o.o_custkey AS string), '') AS gene, coalesce(c.c_name, '') AS translation FROM lineitem l LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') o ON l.l_orderkey = o.o_orderkey LEFT JOIN customer c ON c.c_custkey = l.l_orderkey")(
    on(lambda t: prep.relation(t.lineitem.select(F.col("l_orderkey").alias("gene_id"), F.col("l_orderkey").alias("transcript_id"), F.concat(F.lit("T"), F.col("l_orderkey").cast("string")).alias("transcript")).distinct(),
                               t.orders.filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("gene_id"), F.concat(F.lit("G"), F.col("o_custkey").cast("string")).alias("gene")),
                               t.customer.select(F.col("c_custkey").alias("transcript_id"), F.col("c_name").alias("translation"))).select("transcript", "gene", "translation")))
query("history_full_outer", "SELECT DISTINCT e.old_id, e.new_id, nullif(e.score, 0) AS score, s.mapping_session_id, s.old_release, s.new_release FROM (SELECT *, old_release * 100 + new_release AS k FROM history) e FULL OUTER JOIN (SELECT release * 100 + release + 1 AS mapping_session_id, release AS old_release, release + 1 AS new_release FROM (SELECT DISTINCT release FROM ids)) s ON e.k = s.mapping_session_id WHERE s.old_release BETWEEN 8 AND 19 AND s.new_release BETWEEN 8 AND 19", "history", "ids")(
    on(lambda t: prep.history(t.history.select("old_id", "new_id", "score", (F.col("old_release") * 100 + F.col("new_release")).alias("mapping_session_id")), t.ids.select("release").distinct().select((F.col("release") * 101 + 1).alias("mapping_session_id"), F.col("release").alias("old_release"), (F.col("release") + 1).alias("new_release")), 8, 19).select("old_id", "new_id", "score", "mapping_session_id", "old_release", "new_release")))
query("xref_star_join", "SELECT DISTINCT p.p_brand AS name_db, concat('P', CAST(p.p_partkey AS string)) AS id_db, n.n_name AS graph_id, s.s_name FROM lineitem l LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey LEFT JOIN part p ON l.l_partkey = p.p_partkey WHERE n.n_name IS NOT NULL AND p.p_brand IS NOT NULL")(
    on(lambda t: prep.external(t.lineitem.select(F.col("l_suppkey").alias("ensembl_id"), F.col("l_partkey").alias("external_db_id")).distinct(),
                               t.supplier.select(F.col("s_suppkey").alias("ensembl_id"), F.col("s_nationkey").alias("xref_id"), F.col("s_suppkey").alias("object_xref_id")),
                               t.nation.select(F.col("n_nationkey").alias("xref_id"), F.col("n_name").alias("graph_id")),
                               t.part.select(F.col("p_partkey").alias("external_db_id"), F.col("p_brand").alias("name_db"), F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("id_db")),
                               t.supplier.select(F.col("s_suppkey").alias("object_xref_id"), "s_name")).select("name_db", "id_db", "graph_id", "s_name").distinct()))
query("synonym_union", "SELECT DISTINCT release, graph_id, name_db, u AS id_db FROM (SELECT *, id_db AS u FROM xref UNION ALL SELECT *, concat('label_', id_db) FROM xref)", "xref")(on(lambda t: prep.labels_and_accessions(t.xref.withColumn("label", F.concat(F.lit("label_"), "id_db"))).select("release", "graph_id", "name_db", "id_db")))

# -- duplicates, aggregates
query("dedupe_keep_first", "SELECT id_db, name_db, release FROM (SELECT *, row_number() OVER (PARTITION BY id_db, name_db ORDER BY release, graph_id, assembly) AS n FROM xref) WHERE n = 1", "xref")(on(lambda t: prep.keep_first(t.xref, ["id_db", "name_db"], ["release", "graph_id", "assembly"]).select("id_db", "name_db", "release")))
query("drop_all_duplicates", "SELECT graph_id, release, name_db FROM (SELECT *, count(*) OVER (PARTITION BY graph_id, release, name_db) AS n FROM xref) WHERE n = 1", "xref")(on(lambda t: prep.drop_all_copies(t.xref, ["graph_id", "release", "name_db"]).select("graph_id", "release", "name_db")))
query("dup_groups", "SELECT graph_id, release, name_db, id_db, assembly FROM (SELECT *, count(*) OVER (PARTITION BY graph_id, release, name_db) AS n FROM xref) WHERE n > 1", "xref")(on(lambda t: prep.only_copies(t.xref, ["graph_id", "release", "name_db"])))
for _mode, _sql in {"all": "SELECT * FROM xref", "unique": "SELECT release, graph_id, id_db, name_db, max(assembly) AS assembly FROM xref GROUP BY ALL", "duplicated": "SELECT release, graph_id, id_db, name_db, assembly FROM (SELECT *, count(*) OVER (PARTITION BY release, graph_id, id_db, name_db) AS n FROM xref) WHERE n > 1"}.items():
    query(f"across_assemblies_{_mode}", _sql, "xref")(on(lambda t, m=_mode: prep.across_assemblies(t.xref, t.spark.createDataFrame([(38, 1), (37, 2)], "assembly int, priority int"), m)))
query("db_counts", "SELECT name_db, count(*) AS n FROM xref GROUP BY 1", "xref")(on(lambda t: summary.frequency(t.xref, "name_db")))
query("conn_summary", "SELECT src AS node, db, assembly, string_agg(CAST(release AS string), ',' ORDER BY release) AS releases FROM (SELECT DISTINCT src, db, assembly, release FROM conn) GROUP BY ALL", "conn")(on(lambda t: summary.by_database(t.conn)))
query("trios_of_sentinels", "SELECT node, 'assembly_38_gene' AS db, 38 AS assembly, r AS release FROM (SELECT dst AS node, new_release AS s, coalesce((SELECT min(b.old_release) FROM edges b WHERE b.src = a.dst AND b.old_release >= a.new_release), 20) AS e FROM edges a WHERE dst LIKE '%.Retired'), unnest(range(s, e + 1)) AS u(r) GROUP BY ALL", "edges")(
    on(lambda t: summary.trios(t.conn.limit(0), graph.sentinel_ranges(t.edges), 20).select("node", "db", "assembly", "release")))
query("external_nodes", "SELECT DISTINCT src AS node FROM conn WHERE db = 'Brand#23'", "conn")(on(lambda t: summary.external_nodes(t.conn, "Brand#23")))
query("id_list_of_form", "SELECT DISTINCT dst AS node FROM conn WHERE assembly = 38 AND release = 14", "conn")(on(lambda t: summary.id_list(summary.trios(t.conn), "gene", 38, 14)))
query("ranges_of_all", "SELECT node, seq, s AS start, e AS \"end\" FROM ranges UNION ALL SELECT node, CAST(row_number() OVER (PARTITION BY node ORDER BY min(release)) AS int), min(release), max(release) FROM (SELECT *, release - row_number() OVER (PARTITION BY node ORDER BY release) AS g FROM (SELECT src AS node, release FROM conn UNION SELECT dst, release FROM conn) WHERE node NOT IN (SELECT node FROM ranges)) GROUP BY node, g", "ranges", "conn")(on(lambda t: summary.ranges_of_all(t.conn, t.ranges)))
query("ranges_all_inclusive", "SELECT node, CAST(row_number() OVER (PARTITION BY node ORDER BY min(release)) AS int) AS seq, min(release) AS start, max(release) AS \"end\" FROM (SELECT *, release - row_number() OVER (PARTITION BY node ORDER BY release) AS g FROM (SELECT node, r AS release FROM ranges, unnest(range(s, least(coalesce(e, 20), 20) + 1)) AS u(r) UNION SELECT dst, release FROM conn WHERE assembly = 37 AND dst IN (SELECT node FROM ranges))) GROUP BY node, g", "ranges", "conn")(on(lambda t: summary.ranges_all_inclusive(t.conn, t.ranges, 20)))
query("archive_relation", "SELECT DISTINCT concat(stable_id, '.', CAST(version AS string)) AS gene, CASE WHEN version % 3 = 0 THEN '' ELSE concat('T', stable_id) END AS transcript, CASE WHEN version % 2 = 0 THEN '' ELSE concat('L', stable_id, '.', CAST(version AS string)) END AS translation FROM ids", "ids")(
    on(lambda t: prep.archive_relation(t.ids.select(F.col("stable_id").alias("gene_stable_id"), F.col("version").alias("gene_version"), F.when(F.col("version") % 3 != 0, F.concat(F.lit("T"), "stable_id")).alias("transcript_stable_id"), F.lit(0).alias("transcript_version"), F.when(F.col("version") % 2 != 0, F.concat(F.lit("L"), "stable_id")).otherwise("").alias("translation_stable_id"), F.col("version").alias("translation_version")))))
query("any_member", "SELECT release, gene, transcript, translation FROM relation WHERE gene LIKE '%7.1' OR transcript LIKE '%5' OR translation IN (SELECT concat('L', CAST(o_orderkey AS string), '-1') FROM orders WHERE o_orderstatus = 'P')", "relation")(
    on(lambda t: prep.any_member(t.relation, {"gene": t.relation.select("gene").filter(F.col("gene").endswith("7.1")), "transcript": t.relation.select("transcript").filter(F.col("transcript").endswith("5")), "translation": t.orders.filter("o_orderstatus = 'P'").select(F.concat(F.lit("L"), F.col("o_orderkey").cast("string"), F.lit("-1")))})))
query("last_active_version", "SELECT stable_id, release, CASE WHEN release % 3 <> 0 THEN version END AS version, last_value(CASE WHEN release % 3 <> 0 THEN version END IGNORE NULLS) OVER (PARTITION BY stable_id ORDER BY release) AS active_version FROM ids", "ids")(on(lambda t: prep.last_active_version(t.ids.select("stable_id", "release", F.when(F.col("release") % 3 != 0, F.col("version")).alias("version")))))
query("session_attributes", "SELECT e.*, 'm' || CAST(s.r AS string) AS created FROM edges e LEFT JOIN (SELECT DISTINCT release AS r FROM ids WHERE release % 2 = 0) s ON e.old_release = s.r AND e.new_release = s.r + 1", "edges", "ids")(
    on(lambda t: graph.with_sessions(t.edges, t.ids.filter("release % 2 = 0").select(F.col("release").alias("old_release"), (F.col("release") + 1).alias("new_release"), F.concat(F.lit("m"), F.col("release").cast("string")).alias("created")).distinct()).select(*graph.EDGE, "created")))
query("columns_beside", "SELECT coalesce(a.id, b.id) AS id, a.n, b.m FROM (SELECT stable_id AS id, count(*) AS n FROM ids WHERE release <= 12 GROUP BY 1) a FULL OUTER JOIN (SELECT stable_id AS id, max(version) AS m FROM ids WHERE release > 12 GROUP BY 1) b ON a.id = b.id", "ids")(
    on(lambda t: prep.beside(t.ids.filter("release <= 12").groupBy(F.col("stable_id").alias("id")).agg(F.count("*").alias("n")), t.ids.filter("release > 12").groupBy(F.col("stable_id").alias("id")).agg(F.max("version").alias("m")), "id")))
query("every_combination", "SELECT 'gene' AS form, assembly, count(DISTINCT dst) AS n FROM conn WHERE db NOT LIKE 'form_%' GROUP BY ALL UNION ALL SELECT 'name', assembly, count(DISTINCT src) FROM conn WHERE db NOT LIKE 'form_%' GROUP BY ALL", "conn")(
    on(lambda t: prep.every_combination({(f, a): t.conn.filter((F.col("assembly") == a) & ~F.col("db").startswith("form_")).agg(F.count_distinct(c).alias("n")) for f, c in (("gene", "dst"), ("name", "src")) for a in (37, 38)}, ("form", "assembly"))))
_FULL = "SELECT node, arg_min(node_type, o) AS node_type FROM (SELECT " + V + " AS node, 'gene' AS node_type, 0 AS o FROM ids UNION ALL SELECT stable_id, 'base', 1 FROM ids UNION ALL SELECT concat('Z', CAST(p_partkey AS string), '.1'), 'assembly_37_gene', 2 FROM part WHERE p_partkey % 10 = 0 UNION ALL SELECT transcript, 'transcript', 3 FROM relation UNION ALL SELECT translation, 'translation', 4 FROM relation WHERE translation IS NOT NULL UNION ALL SELECT id_db, 'external', 5 FROM xref UNION ALL SELECT concat('P', CAST(p_partkey AS string)), 'external', 5 FROM part WHERE p_partkey % 10 = 0) GROUP BY 1"


def _full(t: T) -> tuple[DataFrame, DataFrame]:
    """With genes that assembly 37 only knows, and names in lower case beside their capitals."""
    p = t.part.filter("p_partkey % 10 = 0").select(F.lit(9).alias("release"), F.concat(F.lit("Z"), F.col("p_partkey").cast("string"), F.lit(".1")).alias("graph_id"), F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("id_db"), F.lit("Old").alias("name_db"), F.lit(37).alias("assembly"))
    return graph.full(t.ids, cut(t.relation, "relation"), cut(t.xref.unionByName(p), "xref"))


query("full_graph_nodes", _FULL, "ids", "relation", "xref")(on(lambda t: _full(t)[0]))
query("full_graph_edges", f"SELECT DISTINCT * FROM (SELECT * FROM conn UNION ALL SELECT concat('P', CAST(p_partkey AS string)), concat('Z', CAST(p_partkey AS string), '.1'), 'Old', 37, 9 FROM part WHERE p_partkey % 10 = 0 UNION ALL SELECT stable_id, {V}, 'base', 38, release FROM ids)", "conn", "ids")(on(lambda t: _full(t)[1]))
query("merge_case", "SELECT DISTINCT w AS src, dst, db, assembly, release FROM (SELECT *, first_value(src) OVER (PARTITION BY lower(src) ORDER BY n, length(regexp_replace(src, '[^A-Z]', '', 'g')), src) AS w FROM (SELECT *, count(*) OVER (PARTITION BY src) AS n FROM (SELECT CASE WHEN release % 2 = 0 THEN lower(src) ELSE src END AS src, dst, db, assembly, release FROM conn)))", "conn")(
    on(lambda t: graph.merge_case(t.conn.withColumn("src", F.when(F.col("release") % 2 == 0, F.lower("src")).otherwise(F.col("src"))))))
query("conn_summary_genes", "SELECT dst AS node, concat('assembly_', CAST(assembly AS string), '_gene') AS db, assembly, count(DISTINCT release) AS n FROM conn GROUP BY ALL", "conn")(on(lambda t: summary.genes_by_assembly(t.conn).select("node", "db", "assembly", F.size(F.split("releases", ",")).cast("long").alias("n"))))
query("release_sets", "SELECT db, assembly, string_agg(r, ',' ORDER BY CAST(r AS int)) AS releases FROM (SELECT DISTINCT db, assembly, CAST(release AS string) AS r FROM conn) GROUP BY ALL", "conn")(on(lambda t: summary.availability(t.conn).select("db", "assembly", "releases")))
query("hub_nodes", "SELECT src AS node, count(DISTINCT dst) AS degree FROM conn GROUP BY 1 HAVING count(DISTINCT dst) > 20", "conn")(on(lambda t: summary.hubs(t.conn, 20)))
query("modal_form", "SELECT db, form FROM (SELECT db, form, row_number() OVER (PARTITION BY db ORDER BY count(*) DESC, form) AS n FROM (SELECT db, CASE WHEN dst LIKE 'T%' THEN 'transcript' ELSE 'gene' END AS form FROM conn) GROUP BY db, form) WHERE n = 1", "conn")(
    on(lambda t: summary.modal_form(t.conn, t.conn.select(F.col("dst").alias("node"), F.when(F.col("dst").startswith("T"), "transcript").otherwise("gene").alias("form")).distinct()).select("db", "form")))
query("node_trios", "SELECT * FROM trio", "trio")(on(lambda t: summary.trios(t.conn)))
query("id_list", "SELECT DISTINCT node FROM trio WHERE db = 'Brand#12' AND assembly = 38 AND release = 14", "trio")(on(lambda t: summary.id_list(summary.trios(t.conn), "Brand#12", 38, 14)))
for _mode, _by in {"complete": "db, assembly, release", "release": "release", "assembly": "assembly", "assembly_release": "assembly, release"}.items():
    query(f"infer_source_{_mode}", f"SELECT {_by}, count(DISTINCT node) AS n_ids FROM trio WHERE node IN (SELECT concat('P', CAST(p_partkey AS string)) FROM part) GROUP BY {_by}", "trio")(
        on(lambda t, m=_mode: summary.infer_source_of(t.conn, t.part.select(F.concat(F.lit("P"), F.col("p_partkey").cast("string"))), m)))
query("node_richness", "SELECT c.dst AS node, count(DISTINCT CASE WHEN c.db NOT LIKE 'form_%' THEN c.src END) AS externals, count(DISTINCT CASE WHEN c.db = 'form_gene' THEN c.src END) AS transcripts, coalesce(any_value(p.n), 0) AS translations FROM conn c LEFT JOIN (SELECT a.dst AS node, count(DISTINCT b.src) AS n FROM conn a JOIN conn b ON a.src = b.dst AND b.db = 'form_transcript' WHERE a.db = 'form_gene' GROUP BY 1) p ON p.node = c.dst WHERE c.db <> 'form_transcript' GROUP BY 1", "conn")(on(lambda t: summary.richness(t.conn)))
query("version_presence", "SELECT release, bool_and(v IS NULL) AS all_missing, bool_or(v IS NULL) AS any_missing FROM (SELECT release, CASE WHEN release > 15 AND version < 3 THEN NULL ELSE version END AS v FROM ids) GROUP BY 1", "ids")(on(lambda t: prep.version_summary(t.ids.withColumn("version", F.when(~((F.col("release") > 15) & (F.col("version") < 3)), F.col("version"))))))
for _p, _v in {"add": "1", "drop": "NULL", "keep": "version"}.items():
    query(f"version_policy_{_p}", f"SELECT release, stable_id, CAST({_v} AS int) AS version FROM ids", "ids")(on(lambda t, p=_p: prep.version_policy(t.ids, p)))
query("config_template", "SELECT db, assembly, string_agg(CAST(release AS string), ',' ORDER BY release) AS releases, false AS include, CAST(dense_rank() OVER (ORDER BY db) - 1 AS int) AS db_index FROM (SELECT DISTINCT db, assembly, release FROM conn) GROUP BY db, assembly", "conn")(on(lambda t: store.config_template(t.conn)))
query("config_allowed", "SELECT DISTINCT db FROM conn WHERE release = 9 AND db LIKE 'Brand#2%'", "conn")(on(lambda t: store.allowed(store.config_template(t.conn).withColumn("include", F.col("db").startswith("Brand#2")), 9)))
query("release_discovery", "SELECT concat('world_core_', CAST(r_regionkey AS string), '_1') AS database, r_regionkey AS release FROM region WHERE r_regionkey > 0")(on(lambda t: store.releases_of(t.region.select(F.explode(F.array(F.concat(F.lit("world_core_"), F.col("r_regionkey").cast("string"), F.lit("_1")), F.concat(F.lit("world_core_x_"), "r_name"))).alias("name")), "world")))

# -- ranges
query("active_ranges", "SELECT stable_id AS node, CAST(row_number() OVER (PARTITION BY stable_id ORDER BY min(release)) AS int) AS seq, min(release) AS start, max(release) AS \"end\" FROM (SELECT *, release - row_number() OVER (PARTITION BY stable_id ORDER BY release) AS g FROM ids) GROUP BY stable_id, g", "ids")(on(lambda t: ft.to_ranges(t.ids.withColumnRenamed("stable_id", "node"), ["node"])))
query("ranges_to_points", "SELECT stable_id AS node, release FROM ids", "ids")(on(lambda t: ft.to_points(ft.to_ranges(t.ids.withColumnRenamed("stable_id", "node"), ["node"]), ["node"], 20)))
query("backbone_ranges", "SELECT node, seq, s AS start, e AS \"end\" FROM ranges", "ranges")(on(lambda t: t.ranges))
query("compact_ranges", "SELECT split_part(node, '.', 1) AS node, r AS release FROM ranges, unnest(range(s, least(coalesce(e, 20), 20) + 1)) AS u(r) GROUP BY ALL", "ranges")(
    on(lambda t: ft.to_points(ft.compact(t.ranges.withColumn("node", fid.split_id(F.col("node"))[0]), ["node"]), ["node"], 20)))
query("nonbackbone_ranges", "SELECT src AS node, CAST(row_number() OVER (PARTITION BY src ORDER BY min(release)) AS int) AS seq, min(release) AS start, max(release) AS \"end\" FROM (SELECT *, release - row_number() OVER (PARTITION BY src ORDER BY release) AS g FROM (SELECT DISTINCT src, release FROM conn)) GROUP BY src, g", "conn")(on(lambda t: ft.to_ranges(t.conn.withColumnRenamed("src", "node"), ["node"])))
query("range_intersection", "SELECT a.node, greatest(a.s, 10) AS start, least(a.e, 15) AS \"end\" FROM (SELECT node, s, coalesce(e, 2147483647) AS e FROM ranges) a WHERE a.s <= 15 AND 10 <= a.e", "ranges")(on(lambda t: ft.intersect(r := t.ranges, r.select("node", F.lit(10).alias("start"), F.lit(15).alias("end")).distinct(), ["node"])))
query("coinciding_releases", "SELECT a.stable_id AS node, a.release FROM ids a JOIN (SELECT DISTINCT o_custkey, release FROM (SELECT concat('C', lpad(CAST(CAST(substr(stable_id, 2) AS int) - 1 AS string), 6, '0')) AS o_custkey, release FROM ids)) b ON a.stable_id = b.o_custkey AND a.release = b.release", "ids")(
    on(lambda t: ft.to_points(ft.intersect(ft.to_ranges(t.ids.withColumnRenamed("stable_id", "node"), ["node"]), ft.to_ranges(t.ids.select(F.concat(F.lit("C"), F.lpad((F.substring("stable_id", 2, 6).cast("int") - 1).cast("string"), 6, "0")).alias("node"), "release"), ["node"]), ["node"]), ["node"], 20)))
query("point_in_range", "SELECT DISTINCT node FROM ranges WHERE s <= 12 AND 12 <= coalesce(e, 2147483647)", "ranges")(on(lambda t: qa.lived(t.ranges, 12)))
_ENTRY = "SELECT node, seq, s AS start, e AS \"end\", x.entry, x.reverse FROM (SELECT node, seq, s, e, coalesce(e, 2147483647) AS f FROM ranges), LATERAL (SELECT unnest(CASE {} END) AS x)"
_S = lambda v, r: f"{{'entry': {v}, 'reverse': {r}}}"
_CLOSEST = f"WHEN 13 = s THEN [{_S('s', 'false')}] WHEN 13 < s THEN [{_S('s', 'true')}] WHEN f <= 13 THEN [{_S('f', 'false')}] ELSE [{_S('s', 'true')}, {_S('f', 'false')}]"
_DISTANT = f"WHEN 13 <= s THEN [{_S('f', 'true')}] WHEN f <= 13 THEN [{_S('s', 'false')}] ELSE [{_S('f', 'true')}, {_S('s', 'false')}]"
for _mode, _case in {"closest": _CLOSEST, "distant": _DISTANT}.items():
    query(f"entry_points_{_mode}", _ENTRY.format(_case), "ranges")(on(lambda t, m=_mode: ft.entry_points(t.ranges.withColumn("p", F.lit(13)), "p", m).drop("p")))
query("direction_choice", f"SELECT node, CASE WHEN f IS NOT NULL AND r IS NOT NULL THEN 'both' WHEN r IS NOT NULL THEN 'reverse' ELSE 'forward' END AS direction, f AS forward_from, r AS reverse_from FROM (SELECT node, min(entry) FILTER (WHERE NOT reverse) AS f, max(entry) FILTER (WHERE reverse) AS r FROM ({_ENTRY.format(_CLOSEST)}) GROUP BY node)", "ranges")(
    on(lambda t: ft.direction(ft.entry_points(t.ranges.withColumn("p", F.lit(13)), "p"), ["node"])))

# -- graph
query("version_edges", "SELECT * FROM e_version", "e_version")(on(lambda t: graph.version_edges(t.ids, t.history)))
query("birth_edges", "SELECT * FROM e_birth", "e_birth")(on(lambda t: graph.birth_edges(t.ids)))
query("rebirth_edges", "SELECT * FROM e_rebirth", "e_rebirth")(on(lambda t: graph.rebirth_edges(t.ids)))
query("retirement_edges", "SELECT * FROM e_retire", "e_retire")(on(lambda t: graph.retirement_edges(t.ids)))
query("latest_runs", "SELECT * FROM runs", "runs")(on(lambda t: graph.latest_runs(t.ids)))
query("lossy_loops", "SELECT * FROM e_loop", "e_loop")(on(lambda t: graph.lossy_loops(t.history)))
query("branch_edges", "SELECT * FROM e_branch", "e_branch")(on(lambda t: graph.branch_edges(t.history, 0)))
query("open_loops", "SELECT * FROM e_open", "e_open")(on(lambda t: graph.open_loops(t.ids, t.history)))
query("history_edges", "SELECT * FROM edges", "edges")(on(lambda t: t.edges))
query("connection_edges", "SELECT * FROM conn", "conn")(on(lambda t: graph.connection_edges(t.xref, t.relation)))
query("graph_nodes", f"SELECT {V} AS node, stable_id AS id, CAST(version AS string) AS version, 'gene' AS node_type, max(release) = (SELECT max(release) FROM ids) AS is_latest FROM ids GROUP BY stable_id, version", "ids")(on(lambda t: graph.nodes(t.ids)))
query("base_edges", f"SELECT DISTINCT stable_id AS src, {V} AS dst, 'base' AS db, 38 AS assembly, release FROM ids", "ids")(on(lambda t: graph.base_edges(t.ids)))
query("problem_nodes", f"SELECT DISTINCT node FROM (SELECT src AS node FROM edges UNION SELECT dst FROM edges) WHERE node NOT LIKE '%.Void' AND node NOT LIKE '%.Retired' AND node NOT IN (SELECT {V} FROM ids WHERE release < 18)", "edges")(on(lambda t: graph.problem_nodes(t.edges, t.ids.filter("release < 18"))))
query("assembly_only_nodes", "SELECT DISTINCT graph_id, assembly FROM xref WHERE assembly <> 38 AND graph_id NOT IN (SELECT graph_id FROM xref WHERE assembly = 38)", "xref")(on(lambda t: graph.assembly_only(t.xref)))
query("misplaced_external", "SELECT DISTINCT graph_id AS node FROM xref WHERE graph_id LIKE '%7.1'", "xref")(on(lambda t: graph.misplaced_external(t.xref.withColumn("id_db", F.when(F.col("graph_id").endswith("7.1"), F.col("graph_id")).otherwise(F.col("id_db"))), graph.nodes(t.ids))))
query("reverse_view", "SELECT dst AS src, src AS dst, old_release, new_release, weight, kind FROM edges", "edges")(on(lambda t: graph.reverse(t.edges)))
query("case_merge_winner", "SELECT l AS lowered, src AS winner FROM (SELECT *, row_number() OVER (PARTITION BY l ORDER BY n, length(regexp_replace(src, '[^A-Z]', '', 'g')), src) AS k, count(*) OVER (PARTITION BY l) AS c FROM (SELECT src, lower(src) AS l, count(*) AS n FROM (SELECT CASE WHEN release % 2 = 0 THEN lower(src) ELSE src END AS src, dst, db, assembly, release FROM conn) GROUP BY 1, 2)) WHERE k = 1 AND c > 1", "conn")(
    on(lambda t: graph.case_winners(t.conn.withColumn("src", F.when(F.col("release") % 2 == 0, F.lower("src")).otherwise(F.col("src"))))))
query("compose_forms", "SELECT node, form FROM (SELECT c_name AS node, CASE WHEN c_custkey % 3 = 0 THEN 'transcript' ELSE 'gene' END AS form FROM customer)")(
    on(lambda t: graph.compose({"gene": t.customer.select(F.col("c_name").alias("node"), F.lit("gene").alias("form")), "transcript": t.customer.filter("c_custkey % 3 = 0").select(F.col("c_name").alias("node"), F.lit("transcript").alias("form"))})))
query("prune_history", "SELECT * FROM edges WHERE src LIKE '%.Void' OR src LIKE '%.Retired' OR dst LIKE '%.Retired' OR CAST(substr(split_part(src, '.', 1), 2) AS int) % 2 = 0 OR CAST(substr(split_part(dst, '.', 1), 2) AS int) % 2 = 0", "edges")(
    on(lambda t: graph.prune_history(t.edges, graph.nodes(t.ids).select("node", F.when(F.substring("id", 2, 6).cast("int") % 2 == 1, "transcript").otherwise("gene").alias("node_type")), ["transcript"])))

query("forms_history", "SELECT * FROM edges", "edges")(on(lambda t: graph.forms_history({"gene": (t.ids, t.history), "transcript": (t.relation.select("release", F.col("transcript").alias("stable_id"), F.lit(1).alias("version")).distinct(), t.history.limit(0))})[0]))
query("aligned_rows", "SELECT c_custkey, c_name FROM customer", )(on(lambda t: harmonize.aligned(t.customer.select("c_custkey", "c_name"), t.customer.select("c_custkey", (-F.col("c_custkey")).alias("place")), "c_custkey")))

# -- search
query("name_resolution", "SELECT q AS query, CASE WHEN k % 4 <> 3 THEN n END AS node, CASE WHEN k % 4 <> 3 THEN n <> q END AS was_modified FROM (SELECT k, concat('part-', CAST(k AS string), '_x') AS n, CASE k % 4 WHEN 0 THEN concat('part-', CAST(k AS string), '_x') WHEN 1 THEN concat('PART-', CAST(k AS string), '_X') WHEN 2 THEN concat('part_', CAST(k AS string), '-x.2') ELSE concat('none', CAST(k AS string)) END AS q FROM (SELECT p_partkey AS k FROM part))")(
    on(lambda t: search.resolve(t.part.select(F.col("p_partkey").alias("k"), (k := F.col("p_partkey").cast("string"))).select(F.when(F.col("k") % 4 == 0, F.concat(F.lit("part-"), "p_partkey", F.lit("_x"))).when(F.col("k") % 4 == 1, F.concat(F.lit("PART-"), "p_partkey", F.lit("_X"))).when(F.col("k") % 4 == 2, F.concat(F.lit("part_"), "p_partkey", F.lit("-x.2"))).otherwise(F.concat(F.lit("none"), "p_partkey")).alias("query")), t.part.select(F.concat(F.lit("part-"), F.col("p_partkey").cast("string"), F.lit("_x")).alias("name")))))


def _walks(t: T, to: int, back: bool = False) -> DataFrame:
    """Every id of every release on this side of `to`."""
    near = F.col("release") >= to if back else F.col("release") <= to
    q = t.ids.filter(near).select(F.concat("stable_id", F.lit("@"), F.col("release").cast("string")).alias("query_id"), fid.versioned(F.col("stable_id"), F.col("version")).alias("node"), "release", F.lit(to).alias("to_release"), F.lit(back).alias("reverse"))
    return search.walk(q, t.edges).select("query_id", "target", search.path_text().alias("path"), F.size("path").alias("steps"), search.path_score().alias("score"))


def _reductions(t: T) -> DataFrame:
    q = t.ids.filter("release <= 12").select(F.concat("stable_id", F.lit("@"), F.col("release").cast("string")).alias("query_id"), fid.versioned(F.col("stable_id"), F.col("version")).alias("node"), "release", F.lit(12).alias("to_release"), F.lit(False).alias("reverse"))
    return search.walk(q, t.edges).select("query_id", "target", search.path_text().alias("path"), search.path_score(reduction="sum").alias("total"), *[F.when(F.size("path") > 0, search.path_score(remove_na=how)).alias(name) for name, how in (("as_zero", "to_0"), ("as_one", "to_1"))])


#: The most steps that SQL unrolls; more than any path of the given tables has.
_STEPS = 14


def _walk_sql(starts: str, to: int, back: bool, name: str = "paths", steps: int = _STEPS) -> str:
    """Unrolled, as window functions may not stand in a recursion; starts gives (q, node, rel)."""
    p = name
    src, dst, at, until = ("dst", "src", "new_release", "old_release") if back else ("src", "dst", "old_release", "new_release")
    open_ = " WHERE new_release IS NOT NULL" if back else ""
    ok = "w.hop <= s.rel" if back else "(w.hop >= s.rel OR w.until IS NULL)"
    reached, spans = (f"hop <= {to}", f"until <= {to}") if back else (f"hop >= {to}", f"coalesce(until >= {to}, false)")
    d = " DESC" if back else ""
    text = f""", {p}w AS (SELECT {src} AS node, {dst} AS far, {at} AS hop, {until} AS until, weight, concat(src, '>', dst, '@', CAST(old_release AS string), '-', coalesce(CAST(new_release AS string), '')) AS key FROM edges{open_}),
{p}0 AS (SELECT q, node, rel, '' AS path, 0 AS steps, CAST(0 AS double) AS sw, 0 AS nw FROM ({starts}))"""
    for i in range(steps):
        text += f""",
{p}a{i} AS (SELECT * FROM (SELECT *, rank() OVER (PARTITION BY q, node, rel, path, mv ORDER BY hop{d}) AS rk FROM (SELECT s.*, w.far, w.hop, w.until, w.weight, w.key, w.far = s.node AS lp, split_part(w.far, '.', 1) = split_part(s.node, '.', 1) AND w.far <> s.node AS mv FROM {p}{i} s JOIN {p}w w ON w.node = s.node WHERE {ok})) WHERE NOT mv OR rk = 1),
{p}b{i} AS (SELECT *, contains(concat(path, ';'), concat(';', key, ';')) AS used, lp AND count(*) OVER (PARTITION BY q, node, rel, path, hop) = 1 AS flag, {reached} AS reached, {spans} AS spans FROM {p}a{i}),
{p}c{i} AS (SELECT *, flag AND NOT used AND NOT reached AND until IS NOT NULL AND NOT spans AS passed FROM {p}b{i}),
{p}x{i} AS (SELECT * REPLACE (concat(path, coalesce(string_agg(CASE WHEN passed THEN concat(';', key) END, '') OVER o, '')) AS path, steps + coalesce(sum(CAST(passed AS int)) OVER o, 0) AS steps, sw + coalesce(sum(CASE WHEN passed THEN weight END) OVER o, 0) AS sw, nw + coalesce(sum(CASE WHEN passed AND weight IS NOT NULL THEN 1 END) OVER o, 0) AS nw) FROM {p}c{i} WINDOW o AS (PARTITION BY q, node, rel, path ORDER BY hop{d}, flag{d}, far, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{p}{i + 1} AS (SELECT DISTINCT q, far AS node, hop AS rel, concat(path, ';', key) AS path, steps + 1 AS steps, sw + coalesce(weight, 0) AS sw, nw + CAST(weight IS NOT NULL AS int) AS nw FROM {p}x{i} WHERE NOT used AND NOT reached AND NOT flag)"""
    done = " UNION ALL ".join(f"SELECT q, node, path, steps, sw, nw FROM {p}x{i} WHERE NOT used AND (reached AND node NOT LIKE '%.Void' AND node NOT LIKE '%.Retired' OR NOT reached AND flag AND until IS NULL) UNION ALL SELECT q, node, concat(path, ';', key), steps + 1, sw + coalesce(weight, 0), nw + CAST(weight IS NOT NULL AS int) FROM {p}x{i} WHERE NOT used AND NOT reached AND flag AND spans" for i in range(steps))
    return text + f",\n{name} AS (SELECT DISTINCT q AS query_id, node AS target, substr(path, 2) AS path, CAST(steps AS int) AS steps, CASE WHEN nw > 0 THEN sw / nw END AS score, sw, nw FROM ({done}))"


def _walk_query(name: str, to: int, tail: str, fn, back: bool = False) -> None:
    _Q[name] = fn
    starts = f"SELECT concat(stable_id, '@', CAST(release AS string)) AS q, {V} AS node, release AS rel FROM ids WHERE release {'>=' if back else '<='} {to}"
    _SQL[name] = _with("edges") + _walk_sql(starts, to, back) + tail


_walk_query("walk_forward", 12, " SELECT query_id, target, path, steps, score FROM paths", on(lambda t: _walks(t, 12)))
_walk_query("walk_reverse", 15, " SELECT query_id, target, path, steps, score FROM paths", on(lambda t: _walks(t, 15, back=True)), back=True)
_BEST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, target ORDER BY score DESC NULLS LAST, steps, path) AS n FROM paths) WHERE n = 1)"
_walk_query("path_score_best", 14, f" SELECT query_id, target, path, steps, score FROM {_BEST}", on(lambda t: search.best_per_target(_walks(t, 14).withColumns({k: F.lit(0) for k in ("assembly_jump", "external_jump", "external_step")})).select("query_id", "target", "path", "steps", "score")))
_walk_query("path_reductions", 12, " SELECT query_id, target, path, CASE WHEN nw > 0 THEN sw END AS total, CASE WHEN steps > 0 THEN sw / steps END AS as_zero, CASE WHEN steps > 0 THEN (sw + steps - nw) / steps END AS as_one FROM paths", on(lambda t: _reductions(t)))
_walk_query("path_density", 14, " SELECT i.q AS query_id, any_value(n) AS n_paths FROM (SELECT concat(stable_id, '@', CAST(release AS string)) AS q FROM ids) i LEFT JOIN (SELECT query_id, count(*) AS n FROM paths GROUP BY 1) p ON p.query_id = i.q GROUP BY 1", on(lambda t: qa.path_density(t.ids.select(F.concat("stable_id", F.lit("@"), F.col("release").cast("string")).alias("query_id")), _walks(t, 14))))
_walk_query("clash_stats", 14, " SELECT target, count(*) AS n_queries, bool_or(n = 1) AS one_to_one, bool_or(n > 1) AS one_to_many FROM (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM (SELECT DISTINCT query_id, target FROM paths)) GROUP BY 1 HAVING count(*) > 1", on(lambda t: harmonize.clashes(_walks(t, 14))))
query("next_edges_forward", "SELECT *, (far = node) AND count(*) OVER (PARTITION BY node, release, hop) = 1 AS is_loop FROM (SELECT node, release, far, hop, until FROM (SELECT s.node, s.release, e.dst AS far, e.old_release AS hop, e.new_release AS until, split_part(e.dst, '.', 1) = split_part(s.node, '.', 1) AND e.dst <> s.node AS mv, rank() OVER (PARTITION BY s.node, s.release, split_part(e.dst, '.', 1) = split_part(s.node, '.', 1) AND e.dst <> s.node ORDER BY e.old_release) AS rk FROM (SELECT DISTINCT " + V + " AS node, release FROM ids) s JOIN edges e ON e.src = s.node WHERE e.old_release >= s.release OR e.new_release IS NULL) WHERE NOT mv OR rk = 1)", "edges")(
    on(lambda t: search.next_edges(t.ids.select(fid.versioned(F.col("stable_id"), F.col("version")).alias("node"), "release", F.lit(False).alias("reverse")).distinct(), search.two_way(t.edges)).select("node", "release", "far", F.col("at").alias("hop"), "until", "is_loop")))


def _externals(t: T) -> DataFrame:
    return t.part.select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("query_id"))


_PART = "(SELECT concat('P', CAST(p_partkey AS string)) AS p FROM part)"
query("synonyms_to_gene", f"SELECT DISTINCT src AS query_id, dst AS target, 1 AS distance FROM conn WHERE src IN (SELECT p FROM {_PART}) AND release = 12 AND db NOT LIKE 'form_%'", "conn")(
    on(lambda t: search.synonyms(_externals(t).select("query_id", F.lit(12).alias("release"), F.col("query_id").alias("node"), F.lit("external").alias("node_type")), t.conn, "gene").select("query_id", "target", "distance")))
query("synonyms_depth2", "SELECT DISTINCT a.src AS query_id, b.src AS target, CASE WHEN a.src = b.src THEN 0 ELSE 2 END AS distance FROM conn a JOIN conn b ON a.dst = b.dst AND a.release = b.release WHERE a.release = 12 AND a.db NOT LIKE 'form_%' AND b.db = 'Brand#11'", "conn")(
    on(lambda t: search.synonyms(_externals(t).select("query_id", F.lit(12).alias("release"), F.col("query_id").alias("node"), F.lit("external").alias("node_type")), t.conn, "external", wanted_db="Brand#11").select("query_id", "target", "distance").distinct()))
query("synonyms_of_translations", "SELECT query_id, target, min(distance) AS distance FROM (SELECT translation AS query_id, gene AS target, 2 AS distance FROM relation WHERE release = 12 AND translation IS NOT NULL UNION ALL SELECT l.translation, b.dst, 4 FROM relation l JOIN conn a ON a.dst = l.gene JOIN conn b ON b.src = a.src WHERE l.release = 12 AND a.release = 12 AND b.release = 12 AND l.translation IS NOT NULL AND a.db NOT LIKE 'form_%' AND b.db NOT LIKE 'form_%') GROUP BY ALL", "relation", "conn")(
    on(lambda t: search.synonyms(t.relation.filter("translation is not null").select(F.col("translation").alias("query_id"), F.lit(12).alias("release"), F.col("translation").alias("node"), F.lit("translation").alias("node_type")).distinct(), t.conn, "gene").select("query_id", "target", "distance").distinct()))


def _tables(t: T) -> plan.Tables:
    return plan.connected(t.ids, t.history, t.conn)


def _gene_queries(t: T) -> DataFrame:
    """Every gene node, from the first release that has it."""
    node = fid.versioned(F.col("stable_id"), F.col("version"))
    return t.ids.groupBy(node.alias("query_id")).agg(F.min("release").alias("from_release")).withColumn("to_release", F.lit(14))


def _part_queries(t: T) -> DataFrame:
    return _externals(t).withColumns({"from_release": F.lit(9), "to_release": F.lit(14)})


@query("convert_gene")
def _convert_gene(spark: SparkSession, sf: str) -> DataFrame:
    t = T(spark, sf)
    return plan.convert(_tables(t), _gene_queries(t), go_external=False)


_FIRST = f"SELECT {V} AS q, {V} AS node, min(release) AS rel FROM ids GROUP BY ALL"
_GENES = _with("edges") + _walk_sql(f"SELECT * FROM ({_FIRST}) WHERE rel <= 14", 14, False, "fw") + _walk_sql(f"SELECT * FROM ({_FIRST}) WHERE rel > 14", 14, True, "bk") + f"""
, converted AS (SELECT q.q AS query_id, CASE WHEN p.target IS NOT NULL THEN q.q END AS node, p.target, p.target AS final, CASE WHEN p.target IS NOT NULL THEN 0 END AS confidence, CASE WHEN p.target IS NOT NULL THEN 'converted' ELSE 'no_conversion' END AS status
FROM ({_FIRST}) q LEFT JOIN (SELECT query_id, target FROM fw UNION SELECT query_id, target FROM bk) p ON p.query_id = q.q)"""
_SQL["convert_gene"] = _GENES + " SELECT * FROM converted"


@query("convert_external")
def _convert_external(spark: SparkSession, sf: str) -> DataFrame:
    t = T(spark, sf)
    return plan.convert(_tables(t), _part_queries(t), "Brand#11", go_external=False)


@query("convert_to_one")
def _convert_to_one(spark: SparkSession, sf: str) -> DataFrame:
    t = T(spark, sf)
    return plan.convert(_tables(t), _part_queries(t), "Brand#11", one=True, go_external=False)


@query("convert_unknown_release")
def _convert_unknown_release(spark: SparkSession, sf: str) -> DataFrame:
    """Names of parts without a release, towards the last one."""
    t = T(spark, sf)
    return plan.convert(_tables(t), _externals(t).withColumns({"from_release": F.lit(None).cast("int"), "to_release": F.lit(None).cast("int")}), go_external=False)


# Strict: genes that a part names at release 9. Loose, for parts that this leaves without a path: for each gene id that
# it ever names, where that lies nearest to 14.
_PRI = "list_sort(list_distinct(list(CASE WHEN c.assembly = 38 THEN 1 ELSE 2 END))) AS pri"
_START = "SELECT DISTINCT concat(node, '@', CAST(rel AS string)) AS q, node, rel FROM {}"


def _external_sql(begin: str, to: int) -> str:
    """What parts become at `to`: begin gives (p, rel), the release at which each is asked."""
    strict = f"""
, asked AS ({begin}), strict AS (SELECT c.src AS p, c.dst AS node, a.rel, {_PRI} FROM conn c JOIN asked a ON a.p = c.src AND a.rel = c.release JOIN ranges r ON r.node = c.dst AND r.s <= a.rel AND a.rel <= coalesce(r.e, 2147483647) WHERE c.db NOT LIKE 'form_%' GROUP BY c.src, c.dst, a.rel)"""
    loose = f"""
, solved AS (SELECT DISTINCT b.p FROM strict b JOIN sf w ON w.query_id = concat(b.node, '@', CAST(b.rel AS string))),
named AS (SELECT c.src AS p, c.dst AS node, {_PRI} FROM conn c WHERE c.db NOT LIKE 'form_%' AND c.src NOT IN (SELECT p FROM solved) GROUP BY c.src, c.dst),
points AS (SELECT n.p, n.node, n.pri, r.s, r.e, coalesce(r.e, 2147483647) AS f FROM named n JOIN ranges r USING (node)),
entered AS (SELECT p, node, pri, s AS rel, s > {to} AS rev FROM points WHERE s >= {to} UNION ALL SELECT p, node, pri, f, false FROM points WHERE s < {to} AND f <= {to} UNION ALL SELECT p, node, pri, s, true FROM points WHERE s < {to} AND f > {to} UNION ALL SELECT p, node, pri, f, false FROM points WHERE s < {to} AND f > {to}),
loose AS (SELECT DISTINCT p, node, pri, rel, rev FROM (SELECT *, rank() OVER (PARTITION BY p, split_part(node, '.', 1) ORDER BY abs(rel - {to})) AS k FROM entered) WHERE k = 1),
begin AS (SELECT p, node, pri, rel, false AS rev FROM strict WHERE p IN (SELECT p FROM solved) UNION ALL SELECT * FROM loose)"""
    return _with("ranges", "conn") + strict + _walk_sql(_START.format("strict"), to, False, "sf") + loose + _walk_sql(_START.format("begin WHERE NOT rev"), to, False, "fw") + _walk_sql(_START.format("begin WHERE rev"), to, True, "bk") + """
, went AS (SELECT b.p, w.target, w.score, w.steps, w.path, CASE WHEN w.steps = 0 THEN b.pri ELSE [1] END AS last_pri FROM begin b JOIN (SELECT *, false AS rev FROM fw UNION ALL SELECT *, true FROM bk) w ON w.rev = b.rev AND w.query_id = concat(b.node, '@', CAST(b.rel AS string))),
ever AS (SELECT DISTINCT src FROM conn)"""


_EXTERNAL = _external_sql(f"SELECT p, 9 AS rel FROM {_PART}", 14) + """,
best AS (SELECT p, target, last_pri FROM (SELECT *, row_number() OVER (PARTITION BY p, target ORDER BY score DESC NULLS LAST, steps, path, len(last_pri) DESC) AS k FROM went) WHERE k = 1),
known AS (SELECT dst AS target, list_sort(list_distinct(list(CASE WHEN assembly = 38 THEN 1 ELSE 2 END))) AS pri FROM (SELECT dst, assembly, release FROM conn UNION ALL SELECT """ + V + """, 38, release FROM ids) WHERE release = 14 GROUP BY 1),
hop AS (SELECT dst AS target, src AS final, list_sort(list_distinct(list(CASE WHEN assembly = 38 THEN 1 ELSE 2 END))) AS pri FROM conn WHERE db = 'Brand#11' AND release = 14 GROUP BY 1, 2 HAVING bool_or(assembly = 38)),
finals AS (SELECT b.*, h.final, 0 AS confidence, h.pri AS final_pri FROM best b JOIN hop h USING (target) UNION ALL SELECT b.*, b.target, NULL, coalesce(k.pri, [2147483647]) FROM best b LEFT JOIN known k USING (target) WHERE b.target NOT IN (SELECT target FROM hop))"""
_STATUS = "SELECT q.p AS query_id, CASE WHEN f.target IS NOT NULL THEN q.p END AS node, f.target, f.final, f.confidence, CASE WHEN f.confidence IS NOT NULL THEN 'converted' WHEN f.target IS NOT NULL THEN 'no_target' WHEN q.p IN (SELECT src FROM ever) THEN 'no_conversion' ELSE 'no_corresponding' END AS status"
# Where a name's own releases all end before the last, the walk begins at the first of these ends.
_ISLANDS = "SELECT p, min(e) AS rel FROM (SELECT p, max(release) AS e FROM (SELECT *, release - row_number() OVER (PARTITION BY p ORDER BY release) AS g FROM (SELECT DISTINCT src AS p, release FROM conn WHERE db NOT LIKE 'form_%')) GROUP BY p, g) GROUP BY p"
_SQL["convert_unknown_release"] = _external_sql(_ISLANDS, 20) + f" {_STATUS} FROM {_PART} q LEFT JOIN (SELECT DISTINCT p, target, target AS final, 0 AS confidence FROM went) f USING (p)"
query("richness_sets", "SELECT DISTINCT CASE db WHEN 'form_gene' THEN 'transcript' WHEN 'form_transcript' THEN 'translation' ELSE 'external' END AS kind, db FROM conn", "conn")(on(lambda t: summary.richness_sets(t.conn)))
query("gene_priorities", "SELECT dst AS target, release AS to_release, string_agg(p, ',' ORDER BY p) AS priorities FROM (SELECT DISTINCT dst, release, CASE WHEN assembly = 38 THEN '1' ELSE '2' END AS p FROM conn) GROUP BY 1, 2", "conn")(on(lambda t: plan.priorities_at(t.conn).select("target", "to_release", F.array_join(F.transform("final_pri", lambda x: x.cast("string")), ",").alias("priorities"))))


@query("relevant_synonyms", """, points AS (SELECT DISTINCT c.src AS p, r.node, r.s, coalesce(r.e, 2147483647) AS f FROM conn c JOIN ranges r ON r.node = c.dst WHERE c.db NOT LIKE 'form_%'),
entered AS (SELECT p, node, s AS rel, s > 14 AS rev FROM points WHERE s >= 14 UNION SELECT p, node, f, false FROM points WHERE s < 14 UNION SELECT p, node, s, true FROM points WHERE s < 14 AND f > 14)
SELECT p AS query_id, node AS entry, rel AS release, rev AS reverse FROM (SELECT *, rank() OVER (PARTITION BY p, split_part(node, '.', 1) ORDER BY abs(rel - 14)) AS k FROM entered) WHERE k = 1""", "conn", "ranges")
def _relevant(spark: SparkSession, sf: str) -> DataFrame:
    """Genes that parts name at any release, each id where it lies nearest to release 14."""
    t = T(spark, sf)
    q = _externals(t).select("query_id", F.col("query_id").alias("node"), F.lit("external").alias("node_type"), F.lit(None).cast("int").alias("release"))
    found = search.synonyms(q, t.conn, "gene").join(q.select("query_id", "node"), "query_id").withColumn("to_release", F.lit(14))
    return search.entries(found, t.ranges, backbone=False).select("query_id", "entry", "release", "reverse").distinct()


_SQL["convert_external"] = _EXTERNAL + f" {_STATUS} FROM {_PART} q LEFT JOIN (SELECT DISTINCT p, target, final, confidence FROM finals) f USING (p)"
_SQL["convert_to_one"] = _EXTERNAL + f""",
ranked AS (SELECT * FROM (SELECT *, rank() OVER (PARTITION BY p ORDER BY coalesce(confidence, 2147483647), list_min(final_pri), list_min(last_pri), -len(last_pri), -len(final_pri)) AS k FROM finals) WHERE k = 1),
own AS (SELECT * FROM (SELECT *, max(final = p) OVER (PARTITION BY p) AS a FROM ranked) WHERE final = p OR NOT a),
rich AS (SELECT c.dst AS target, count(DISTINCT CASE WHEN c.db NOT LIKE 'form_%' THEN c.src END) AS x, count(DISTINCT CASE WHEN c.db = 'form_gene' THEN c.src END) AS t, count(DISTINCT l.src) AS l FROM conn c LEFT JOIN conn l ON l.dst = c.src AND l.db = 'form_transcript' AND l.release = 14 WHERE c.release = 14 AND c.db <> 'form_transcript' GROUP BY 1),
f AS (SELECT * FROM (SELECT o.*, rank() OVER (PARTITION BY p ORDER BY coalesce(x, 0) DESC, coalesce(t, 0) DESC, coalesce(l, 0) DESC) AS z FROM own o LEFT JOIN rich USING (target)) WHERE z = 1)
{_STATUS} FROM {_PART} q LEFT JOIN f USING (p)"""
_BINS = """, per AS (SELECT query_id, count(DISTINCT final) AS n, bool_or(status = 'no_target') AS alt, bool_or(status = 'no_conversion') AS lost, bool_or(status = 'no_corresponding') AS unknown, coalesce(bool_or(final = query_id), false) AS same FROM converted GROUP BY 1)
SELECT bin, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN true THEN 'input_identifiers' END, CASE WHEN unknown THEN 'no_corresponding' END, CASE WHEN lost THEN 'no_conversion' END,
CASE WHEN NOT alt AND NOT lost AND NOT unknown AND n = 1 THEN 'matching_1_to_1' END, CASE WHEN NOT alt AND NOT lost AND NOT unknown AND n > 1 THEN 'matching_1_to_n' END,
CASE WHEN NOT alt AND NOT lost AND NOT unknown AND n = 1 AND NOT same THEN 'changed_only_1_to_1' END, CASE WHEN NOT alt AND NOT lost AND NOT unknown AND n > 1 AND NOT same THEN 'changed_only_1_to_n' END,
CASE WHEN alt AND n = 1 THEN 'alternative_target_1_to_1' END, CASE WHEN alt AND n > 1 THEN 'alternative_target_1_to_n' END], lambda x: x IS NOT NULL)) AS bin FROM per) GROUP BY 1"""
_Q["conversion_bins"] = lambda spark, sf: plan.bins(_convert_external(spark, sf))
_SQL["conversion_bins"] = _EXTERNAL + f", converted AS ({_STATUS} FROM {_PART} q LEFT JOIN (SELECT DISTINCT p, target, final, confidence FROM finals) f USING (p))" + _BINS
_Q["conversion_bins_gene"] = lambda spark, sf: plan.bins(_convert_gene(spark, sf))
_SQL["conversion_bins_gene"] = _GENES + _BINS
query("relaxation_ladder", f"SELECT p AS query_id, c.dst AS target, 0 AS stage FROM {_PART} q JOIN (SELECT DISTINCT src, dst FROM conn WHERE db NOT LIKE 'form_%' AND release = 9) c ON c.src = q.p UNION SELECT p, c.dst, 1 FROM {_PART} q JOIN (SELECT DISTINCT src, dst FROM conn WHERE db NOT LIKE 'form_%') c ON c.src = q.p WHERE p NOT IN (SELECT src FROM conn WHERE release = 9 AND db NOT LIKE 'form_%')", "conn")(
    on(lambda t: search.relaxed(_externals(t).select("query_id", F.col("query_id").alias("node"), F.lit("external").alias("node_type"), F.lit(9).alias("release")), t.conn, "gene").select("query_id", "target", "stage")))
query("final_hop", f"SELECT i.node AS target, 12 AS to_release, coalesce(a.src, i.node) AS final, CASE WHEN a.src IS NOT NULL THEN 0 END AS confidence FROM (SELECT DISTINCT {V} AS node FROM ids) i LEFT JOIN (SELECT DISTINCT dst, src FROM conn WHERE db = 'Brand#11' AND release = 12 AND assembly = 38) a ON a.dst = i.node", "conn", "ids")(
    on(lambda t: plan.to_database(plan.Tables(None, t.conn, None, None), t.ids.select(fid.versioned(F.col("stable_id"), F.col("version")).alias("target"), F.lit(12).alias("to_release")).distinct(), "Brand#11").select("target", "to_release", "final", "confidence")))
_Q["travel_metrics"] = lambda spark, sf: qa.travel(_convert_gene(spark, sf), T(spark, sf).ids.filter("release = 14").select(fid.versioned(F.col("stable_id"), F.col("version")).alias("node")))
_SQL["travel_metrics"] = _GENES + f""", t AS (SELECT DISTINCT {V} AS target FROM ids WHERE release = 14), per AS (SELECT query_id, count(DISTINCT target) AS n, bool_or(target IS NOT NULL AND target NOT IN (SELECT target FROM t)) AS bad FROM converted GROUP BY 1)
SELECT count(*) AS queries, count(*) FILTER (WHERE n = 0) AS lost, count(*) FILTER (WHERE n = 1) AS one_to_one, count(*) FILTER (WHERE n > 1) AS one_to_many, count(*) FILTER (WHERE bad) AS inaccurate FROM per"""
# A fold over the lines of an order: open ones are of the main assembly, closed ones of the other, every third of both.
query("assembly_jump_fold", """RECURSIVE l AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, lo, hi) AS i, count(*) OVER (PARTITION BY l_orderkey) AS n, lo, hi FROM (SELECT *, CASE WHEN l_partkey % 3 = 0 THEN 1 WHEN l_suppkey % 2 = 0 THEN 1 ELSE 2 END AS lo, CASE WHEN l_partkey % 3 = 0 THEN 2 WHEN l_suppkey % 2 = 0 THEN 1 ELSE 2 END AS hi FROM lineitem)),
f AS (SELECT k, 0 AS i, hi AS cur, 0 AS jumps FROM l WHERE i = 1 UNION ALL SELECT f.k, f.i + 1, CASE WHEN least(cur, hi) < lo THEN lo WHEN lo <> hi THEN least(cur, hi) ELSE lo END, jumps + CAST(least(cur, hi) < lo AS int) FROM f JOIN l ON l.k = f.k AND l.i = f.i + 1 WHERE l.i < l.n)
SELECT k AS l_orderkey, arg_max(jumps, i) AS jumps, arg_max(cur, i) AS cur FROM f GROUP BY 1""")(
    on(lambda t: t.lineitem.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", F.when(F.col("l_partkey") % 3 == 0, F.array(F.lit(1), F.lit(2))).when(F.col("l_suppkey") % 2 == 0, F.array(F.lit(1))).otherwise(F.array(F.lit(2))).alias("p")))), lambda x: x["p"]).alias("s")).select("l_orderkey", search.jump_fold("s")["jumps"].alias("jumps"), search.jump_fold("s")["cur"].alias("cur"))))
_SQL["assembly_jump_fold"] = "WITH " + _SQL["assembly_jump_fold"].lstrip()
query("global_choice", "SELECT query_id, target FROM (SELECT *, max(own) OVER (PARTITION BY query_id) AS a FROM (SELECT *, CASE WHEN target = 'N1' THEN 1 ELSE 0 END AS own FROM (SELECT *, rank() OVER (PARTITION BY query_id ORDER BY c, j, n DESC) AS r FROM (SELECT o_custkey AS query_id, concat('N', CAST(o_orderkey % 3 AS string)) AS target, min(o_orderkey % 2) AS c, min(o_orderkey % 5) AS j, count(*) AS n FROM orders GROUP BY ALL)) WHERE r = 1)) WHERE own = 1 OR a = 0")(
    on(lambda t: search.choose_targets(t.orders.groupBy(F.col("o_custkey").alias("query_id"), F.concat(F.lit("N"), (F.col("o_orderkey") % 3).cast("string")).alias("target")).agg(F.min(F.col("o_orderkey") % 2).alias("confidence"), F.min(F.col("o_orderkey") % 5).alias("assembly_jump"), (-F.count("*")).alias("neg_pri")).withColumns({"final_min_pri": F.lit(1), "external_jump": F.lit(0), "min_pri": F.lit(1), "neg_final_pri": F.lit(-1), "node": F.lit("N1"), "final": F.col("target")})).select("query_id", "target")))
query("qa_invariants", """SELECT 'ids_without_range' AS name, count(*) AS violations FROM (SELECT DISTINCT """ + V + """ AS node, release FROM ids WHERE release > 18)
UNION ALL SELECT 'range_without_ids', 0 UNION ALL SELECT 'overlapping_ranges', 0 UNION ALL SELECT 'empty_ranges', 0
UNION ALL SELECT 'edges_back_in_time', count(*) FROM edges WHERE kind = 'branch' UNION ALL SELECT 'unknown_nodes', 0""", "edges", "ranges")(on(lambda t: _broken(t)))


def _broken(t: T) -> DataFrame:
    """Invariants of a graph that is broken on purpose: ranges end at release 18, and branches run back in time."""
    e = t.edges
    r = ft.backbone(graph.edge_events(e), ["node"]).filter("start <= 18").withColumn("end", F.least(ft.closed(F.col("end")), F.lit(18)))
    back = e.withColumns({"old_release": F.when(F.col("kind") == "branch", F.col("new_release")).otherwise(F.col("old_release")), "new_release": F.when(F.col("kind") == "branch", F.col("old_release")).otherwise(F.col("new_release"))})
    return qa.invariants(t.ids, back, r)


query("qa_invariants_hold", "SELECT unnest(['ids_without_range', 'range_without_ids', 'overlapping_ranges', 'empty_ranges', 'edges_back_in_time', 'unknown_nodes']) AS name, 0 AS violations")(on(lambda t: qa.invariants(t.ids, (e := cut(t.edges, "edges")), ft.backbone(graph.edge_events(e), ["node"]))))

# -- harmonisation and sets
query("dataset_presence", "SELECT query, count(DISTINCT dataset) AS n_datasets FROM matches GROUP BY 1", "matches")(on(lambda t: harmonize.presence(t.matches)))
query("n_to_1", "SELECT dataset, query, target FROM (SELECT *, count(*) OVER (PARTITION BY dataset, target) AS n FROM (SELECT DISTINCT dataset, query, target FROM matches WHERE target IS NOT NULL)) WHERE n > 1 AND query <> target", "matches")(on(lambda t: harmonize.n_to_one(t.matches)))
_REASON = "(SELECT m.dataset, m.query, concat_ws('_', CASE WHEN any_value(n.query) IS NOT NULL THEN 'n-to-1' END, CASE WHEN count(DISTINCT m.target) = 0 THEN '1-to-0' END, CASE WHEN count(DISTINCT m.target) > 1 THEN '1-to-n' END) AS reason FROM matches m LEFT JOIN (SELECT DISTINCT dataset, query FROM (SELECT *, count(*) OVER (PARTITION BY dataset, target) AS k FROM (SELECT DISTINCT dataset, query, target FROM matches WHERE target IS NOT NULL)) WHERE k > 1) n ON n.dataset = m.dataset AND n.query = m.query GROUP BY 1, 2)"
query("issue_reasons", f"SELECT * FROM {_REASON} WHERE reason <> ''", "matches")(on(lambda t: harmonize.reasons(t.matches)))
query("failure_sets", f"SELECT query, count(DISTINCT dataset) = (SELECT count(DISTINCT dataset) FROM matches) AS consistent FROM {_REASON} WHERE reason <> '' GROUP BY 1", "matches")(on(lambda t: harmonize.failures(t.matches)))
query("gene_name_inconsistency", "SELECT DISTINCT query FROM matches WHERE gene IN (SELECT gene FROM matches WHERE target IS NOT NULL GROUP BY 1 HAVING count(DISTINCT target) > 1) AND target IS NOT NULL", "matches")(on(lambda t: harmonize.inconsistencies(t.matches.filter("target is not null"))[0]))
query("name_to_smallest_gene", "SELECT target, min(gene) AS gene FROM matches WHERE target IS NOT NULL GROUP BY 1 HAVING count(DISTINCT gene) > 1", "matches")(on(lambda t: harmonize.inconsistencies(t.matches.filter("target is not null"))[1]))
query("multiple_target_index", "SELECT target, string_agg(DISTINCT gene, ',' ORDER BY gene) AS genes FROM matches WHERE target IS NOT NULL GROUP BY 1", "matches")(on(lambda t: harmonize.genes_of_names(t.matches)))
query("mapping_table", f"SELECT query, any_value(name) AS name FROM (SELECT DISTINCT query, target AS name FROM matches WHERE target IS NOT NULL AND query NOT IN (SELECT query FROM {_REASON} WHERE reason <> '') UNION ALL SELECT query, query FROM {_REASON} WHERE reason <> '' GROUP BY query HAVING count(DISTINCT dataset) = (SELECT count(DISTINCT dataset) FROM matches)) GROUP BY query HAVING count(*) = 1", "matches")(on(lambda t: harmonize.mapping_table(t.matches)))
query("matrix_union", "SELECT * FROM matrix", "matrix")(on(lambda t: harmonize.combine(t.matrix)))
query("matrix_intersect", "SELECT * FROM matrix WHERE feature IN (SELECT feature FROM matrix GROUP BY 1 HAVING count(DISTINCT dataset) = (SELECT count(DISTINCT dataset) FROM matrix))", "matrix")(on(lambda t: harmonize.combine(t.matrix, "intersect")))
query("intersection_flag", "SELECT feature, CAST(count(DISTINCT dataset) = (SELECT count(DISTINCT dataset) FROM matrix) AS int) AS intersection FROM matrix GROUP BY 1", "matrix")(on(lambda t: harmonize.in_all(t.matrix)))
_BRANDS = "(SELECT concat('D', CAST(l_suppkey % 4 AS string)) AS dataset, stable_id AS obs, p_brand AS feature, sum(l_quantity) AS value FROM lines JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3)"
query("matrix_filled", f"SELECT o.dataset, o.obs, f.feature, coalesce(m.value, 0) AS value FROM (SELECT DISTINCT dataset, obs FROM {_BRANDS}) o CROSS JOIN (SELECT DISTINCT feature FROM {_BRANDS}) f LEFT JOIN {_BRANDS} m USING (dataset, obs, feature)", "lines")(
    on(lambda t: harmonize.combine(t.lines.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy(t._dataset, F.col("stable_id").alias("obs"), F.col("p_brand").alias("feature")).agg(F.sum("l_quantity").alias("value")), fill=True)))
query("obs_annotations", "SELECT concat('D', CAST(c_nationkey % 3 AS string)) AS dataset, c_name AS obs, CASE WHEN c_nationkey % 3 = 2 THEN '_PLACEHOLDER_NA_' WHEN c_custkey % 4 = 0 THEN '_PLACEHOLDER_NA_' ELSE c_mktsegment END AS segment, c_acctbal AS balance FROM customer")(
    on(lambda t: harmonize.annotations({f"D{k}": t.customer.filter(F.col("c_nationkey") % 3 == k).select(F.col("c_name").alias("obs"), *([F.when(F.col("c_custkey") % 4 == 0, "n/a").otherwise(F.col("c_mktsegment")).alias("segment")] if k < 2 else []), F.col("c_acctbal").alias("balance")) for k in range(3)}, ["segment", "balance"], ["balance"])))


def _datasets(t: T) -> DataFrame:
    """(dataset, feature): the parts that each supplier group delivers."""
    return t.lineitem.select(F.concat(F.lit("D"), (F.col("l_suppkey") % 4).cast("string")).alias("dataset"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("feature")).distinct()


_DATASETS = ", datasets AS (SELECT DISTINCT concat('D', CAST(l_suppkey % 4 AS string)) AS dataset, concat('P', CAST(l_partkey AS string)) AS feature FROM lineitem)"
_UNIFIED = _DATASETS + ", matched AS (SELECT DISTINCT d.dataset, d.feature AS query, f.final AS target, f.target AS gene FROM datasets d LEFT JOIN finals f ON f.p = d.feature AND f.confidence IS NOT NULL)"
_Q["unified_matches"] = lambda spark, sf: harmonize.unified(_datasets(T(spark, sf)), _convert_external(spark, sf))
_SQL["unified_matches"] = _EXTERNAL + _UNIFIED + " SELECT * FROM matched"
for _op, _f in {"union": lambda a, b: a.union(b).distinct(), "intersect": lambda a, b: a.intersect(b), "except": lambda a, b: a.subtract(b)}.items():
    query(f"set_{_op}", f"SELECT stable_id FROM ids WHERE release = 9 {_op.upper()} SELECT stable_id FROM ids WHERE release = 14", "ids")(on(lambda t, f=_f: f(t.ids.filter("release = 9").select("stable_id"), t.ids.filter("release = 14").select("stable_id"))))
query("reduce_mean", "SELECT old_id, round(avg(score), 6) AS score FROM history GROUP BY 1", "history")(on(lambda t: t.history.groupBy("old_id").agg(F.round(F.avg("score"), 6).alias("score"))))
query("event_windows", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")(on(lambda t: streams.id_counts(t.events)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


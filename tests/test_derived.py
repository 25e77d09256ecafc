"""Tables derived from the supplied ones: odd rows, and how often they are shuffled."""

from __future__ import annotations

import datetime

from chronoweave import catalog
from chronoweave.operators import graph, summary


def folder(spark, path) -> str:
    """Three orders; a line twice, and one whose part is not known."""
    day = datetime.datetime(1995, 3, 1)
    spark.createDataFrame([(1, 1, "O", day), (2, 1, "F", day.replace(year=1996)), (3, 2, "O", day)], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp_ntz").write.parquet(f"{path}/orders.parquet")
    spark.createDataFrame([(1, 1, 7, 1, 1.0, "O"), (1, 1, 7, 1, 1.0, "O"), (2, 9, 7, 7, 1.0, "F"), (2, 9, 7, 2, 1.0, "F"), (3, 1, 7, 1, 1.0, "F")], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_linestatus string").write.parquet(f"{path}/lineitem.parquet")
    spark.createDataFrame([(1, "B1"), (2, "B2")], "p_partkey long, p_brand string").write.parquet(f"{path}/part.parquet")
    return str(path)


def test_lines_of_unknown_parts_keep_their_forms(spark, tmp_path):
    sf = folder(spark, tmp_path)
    found = {(r.node, r.db) for r in catalog.queries()["conn_summary"](spark, sf).collect()}
    assert found == {("P1", "B1"), ("T1", "form_gene"), ("T2", "form_gene"), ("T3", "form_gene"), ("L1-1", "form_transcript"), ("L2-2", "form_transcript"), ("L3-1", "form_transcript")}


def test_summaries_by_name_are_not_shuffled_again(spark, tmp_path):
    t = catalog.T(spark, folder(spark, tmp_path))
    n = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert n(summary.by_database(t.conn)) == n(t.conn)


def test_names_that_differ_in_case_meet_once(spark):
    conn = spark.createDataFrame([("ab", "A.1", "D", 38, 1), ("AB", "A.1", "D", 38, 2), ("AB", "A.1", "D", 38, 1), ("c", "A.1", "D", 38, 1)], "src string, dst string, db string, assembly int, release int")
    merged = graph.merge_case(conn)
    assert merged._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 2
    assert {(r.src, r.release) for r in merged.collect()} == {("ab", 1), ("ab", 2), ("c", 1)} and merged.count() == 3


def test_what_is_used_often_is_written_once(spark, tmp_path):
    t = catalog.T(spark, folder(spark, tmp_path))
    assert all("/matches-" in f for f in t.matches.inputFiles())
    nodes, edges = catalog._full(t)
    assert not any("lineitem" in f for df in (nodes, edges) for f in df.inputFiles())
    assert not any("lineitem" in f for f in summary.richness(t.conn).inputFiles())

"""Searches that type only the connections that can lead to what is wanted, against searches that type all of them."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from test_search import small_graph

from chronoweave.operators import search


def answers(q, conn, wanted, **more):
    return sorted((r.query_id, r.target, r.distance, r.steps) for r in search.synonyms(q, conn, wanted, **more).withColumn("steps", search.path_text("steps")).collect())


@pytest.mark.parametrize(("wanted", "more"), [("gene", {}), ("external", {"wanted_db": "DB1"})])
def test_useful_connections_are_enough(spark, monkeypatch, wanted, more):
    t, g = small_graph(spark, 5)
    rows = [(f"{n}|{r}", n, k, r) for n, k in g.kind.items() if not n.endswith((".Void", ".Retired")) and ("." in n or k == "external" and n[0] == "X") for r in (None, 3)]
    # A transcript of two ids, so that a way may turn back from it.
    conn = t.connections.unionByName(spark.createDataFrame([("T0.1", "G1.1", "form_gene", 38, 3)], t.connections.schema))
    q = spark.createDataFrame(rows, "query_id string, node string, node_type string, release int")
    seen = []
    keep = search._mixed
    monkeypatch.setattr(search, "_mixed", lambda *a: seen.append(keep(*a)) or seen[-1])
    short = answers(q, conn, wanted, **more)
    assert seen == [False] and short
    monkeypatch.setattr(search, "_mixed", lambda *a: True)
    assert short == answers(q, conn, wanted, **more)


def test_forms_of_one_id_are_not_typed(spark):
    conn = spark.createDataFrame([("X", "A.1", "DB", 38, 1), ("T1", "A.1", "form_gene", 38, 1), ("L1", "T1", "form_transcript", 38, 1), ("T2", "A.1", "form_gene", 38, 1), ("T2", "B.1", "form_gene", 38, 1)], "src string, dst string, db string, assembly int, release int")
    joined = {*search._FORM_ENDS.values(), ("external", "gene")}
    ways = search.Ways(["external"], "gene", (2,), joined, False)
    e = search._edges_for(conn, search.typed_once(conn), ways, None, "gene", None, ["external"])
    assert {(r.src, r.dst) for r in e.collect()} == {("X", "A.1"), ("A.1", "T2"), ("B.1", "T2"), ("T2", "A.1"), ("T2", "B.1")}
    q = spark.createDataFrame([("q", "X", "external", None)], "query_id string, node string, node_type string, release int")
    assert {(r.target, r.distance) for r in search.synonyms(q, conn, "gene").select(F.col("target"), "distance").collect()} == {("A.1", 1), ("B.1", 3)}

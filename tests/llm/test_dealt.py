"""op10's result is counted in the shards that mix() deals."""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from test_vectors_and_mix import SF, brute_targets, docs_of

from chronoweave.llm import mixing, queries


def test_dealt_is_what_the_quotas_foretell(spark):
    d = docs_of(spark, 400)
    d = d.unionByName(spark.createDataFrame([(10**9, "w " * 200_000, "hot", "x", 1)], d.schema))
    d = d.unionByName(d.filter("doc_id < 20")).unionByName(d.filter("doc_id < 3").selectExpr("cast(null as long) doc_id", "text", "source", "`__size`", "draws"))
    assert sorted(map(str, mixing.dealt(d).collect())) == sorted(map(str, mixing.taken(d).collect()))
    assert mixing.dealt(d.limit(0)).count() == 0


def test_op10_shows_a_draw_that_the_tree_loses(spark, monkeypatch):
    whole = queries.op10_mixing(spark, SF).selectExpr("sum(taken)").first()[0]
    tree = mixing.split_tree
    monkeypatch.setattr(mixing, "split_tree", lambda *a: tree(*a).filter("__shard <> 5"))
    assert queries.op10_mixing(spark, SF).selectExpr("sum(taken)").first()[0] < whole


def test_counts_of_the_tree_split_each_source_and_fill_the_leaves_evenly(spark):
    quota = {"a": 5000, "b": 1, "hot": 20_000, "c": 333}
    q = spark.createDataFrame([(k == "c", k, n) for k, n in quota.items()], "__sn boolean, __sv string, __q long")
    got = {(r["__sv"], r["__shard"]): r["__c"] for r in mixing.split_counts(q, 4).collect()}
    for k, n in quota.items():
        assert sum(c for (s, _), c in got.items() if s == k) == n
    n = sum(quota.values())
    for level in range(5):  # each node holds its half of its parent, to one draw
        sizes = Counter()
        for (_, leaf), c in got.items():
            sizes[leaf >> (4 - level)] += c
        assert len(sizes) == 1 << level and all(abs(c - n / (1 << level)) <= 1 for c in sizes.values())
    # Hypergeometric: 5,000 of 25,334 in a node of a sixteenth of all has a deviation of 15.4.
    dev = np.array([got["a", leaf] for leaf in range(16)]) - 5000 / 16
    assert 5 < np.sqrt((dev**2).mean()) < 31


def test_a_hundred_thousand_sources(spark):
    n = 100_000
    d = spark.range(n).selectExpr("id doc_id", "repeat('w ', cast(id % 7 as int)) text", "if(id = 5, null, concat('s', lpad(cast(id % 99999 as string), 6, '0'))) source")
    t = {r["__sv"] if not r["__sn"] else None: r["__target"] for r in mixing.targets(mixing.measured(d).groupBy("__sn", "__sv").agg(F.sum("__size").alias("__size"))).collect()}
    sizes = Counter({(None if i == 5 else f"s{i % 99999:06d}"): 0 for i in range(n)})
    for i in range(n):
        sizes[None if i == 5 else f"s{i % 99999:06d}"] += i % 7
    assert t.keys() == sizes.keys() and all(t[s] <= 2 * sizes[s] for s in t)
    assert abs(sum(t.values()) - 1.5 * sum(sizes.values())) < 1
    few = {s: sizes[s] for s in sorted(sizes, key=str)[:2000]}
    rows = spark.createDataFrame([(s is None, s or "", n) for s, n in few.items()], "__sn boolean, __sv string, __size long")
    got = {None if r["__sn"] else r["__sv"]: r["__target"] for r in mixing.targets(rows).collect()}
    want = brute_targets(few)
    assert all(abs(got[s] - want[s]) < 1e-6 for s in want)
    out = mixing.dealt(d).selectExpr("count(*)", "sum(taken)", "max(taken - 2 * size)").first()
    assert out[0] == n and out[2] <= 0 and out[1] == mixing.taken(d).selectExpr("sum(taken)").first()[0]


def test_prefix_sums_over_ranges(spark):
    d = spark.range(1000).selectExpr("(id * 7919) % 1000 as k", "id as v")
    rows = sorted(mixing.running(d, ["k"], {"before": "v"}, ranges=7).collect(), key=lambda r: r.k)
    assert [r["__rank"] for r in rows] == list(range(1, 1001))
    assert [r.before for r in rows] == [sum(x.v for x in rows[:i]) for i in range(1000)]

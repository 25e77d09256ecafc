"""The store, sources, settings, the engine object, streams, and that each check finds what it is for."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F
from test_search import small_graph

from chronoweave import api, schema
from chronoweave.__main__ import main
from chronoweave.operators import graph, harmonize, prep, qa, search, summary
from chronoweave.plans import convert as plan
from chronoweave.sources import store as st
from chronoweave.streaming import releases as streams


def df(spark, schema_, *rows):
    return spark.createDataFrame(list(rows), schema_)


def test_store(spark, tmp_path):
    s = st.Store(spark, f"{tmp_path}/store")
    assert s.keys() == []
    made = []
    build = lambda: made.append(1) or df(spark, "a int, b string", (1, "x"), (2, "y"))
    assert s.get("t", build).count() == 2 and s.get("t", build).count() == 2 and len(made) == 1
    assert s.get("t", build, columns=["b"]).columns == ["b"] and "t__b" in s
    assert s.get("t", build, create=True).count() == 2 and len(made) == 3
    assert s.get("u", build, save=False).count() == 2 and "u" not in s
    s.compact("t")
    assert s.keys() == ["t", "t__b"] and s.read("t", ["a"]).columns == ["a"]
    # a crash after the old table was moved aside, and one before the new one was used
    s._move("t", "t__old")
    s.write("t__b__new", s.read("t__b"))
    s.recover()
    assert s.keys() == ["t", "t__b"] and s.read("t").count() == 2
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        s.write("t", build())
    for r in (3, 5, 9):
        s.write(f"ids{r}", build())
    assert s.reuse("ids", 4, build).count() == 2 and [k for k in s.keys() if k.startswith("ids")] == ["ids9"]
    assert st.table_name("idsraw", 9, "x", form="gene") == "ens9_idsraw_x_gene"


def test_indicators_and_matches(spark, tmp_path):
    s = st.Store(spark, f"{tmp_path}/store")
    asked = []
    reg = st.Indicators(s).add("ids", lambda form="gene": asked.append(form) or df(spark, "form string", (form,))).add("ids_raw", lambda: df(spark, "x int", (1,)))
    assert reg.get("ids_transcript").first().form == "transcript" and reg.get("ids_transcript").count() == 1 and asked == ["transcript"]
    assert reg.get("ids_raw").columns == ["x"]
    with pytest.raises(KeyError):
        reg.get("other")
    m, calls = st.Matches(s), []
    convert = lambda q: calls.append(1) or q.withColumn("final", F.upper("query_id"))
    names = df(spark, "n string", ("a",), ("b",))
    assert m.get("d", names, convert).count() == 2 and m.get("d", names.orderBy(F.desc("n")), convert).count() == 2 and len(calls) == 1
    assert m.get("d", names.union(df(spark, "n string", ("c",))), convert).count() == 3 and len(calls) == 2


def test_sources(spark, tmp_path):
    names = df(spark, "name string", *[(n,) for n in ("world_core_9_1", "world_core_10_2", "world_core_10_3", "world_core_1.5_1", "world_core_0_1", "moon_core_9_1", "world_core_99999999999_1")])
    assert [r.release for r in st.releases_of(names, "world").collect()] == [9, 10, 10]
    assert [r.release for r in st.releases_of(names, "world", first=10).collect()] == [10, 10] and st.database_of(names, "world", 9) == "world_core_9_1"
    for release in (10, 11):
        with pytest.raises(LookupError):
            st.database_of(names, "world", release)
    tree = {"world": {"gene": {"A": {"assembly": {"38": {"release": "9,10", "include": True}, "37": {"release": "9", "include": False}}}}}}
    (tmp_path / "c.yml").write_text(json.dumps(tree))
    config = st.read_config(spark, f"{tmp_path}/c.yml")
    assert config.count() == 2 and [r.db for r in st.allowed(config, 10).collect()] == ["A"] and st.up_to_date(config, 9) and not st.up_to_date(config, 11)
    assert st.read_config(spark, f"{tmp_path}/none.yml", f"{tmp_path}/c.yml").count() == 2
    with pytest.raises(FileNotFoundError):
        st.read_config(spark, f"{tmp_path}/none.yml")
    t = st.config_template(df(spark, "db string, assembly int, release int", ("B", 38, 9), ("B", 38, 10), ("A", 37, 9)))
    st.write_template(t, "world", "gene", st.config_paths(str(tmp_path), "world")["template"])
    again = st.read_config(spark, f"{tmp_path}/world_externals_template.yml")
    assert sorted((r.db, r.assembly, r.releases, r["include"]) for r in again.collect()) == [("A", 37, "9", False), ("B", 38, "9,10", False)]
    body = {"species": [{"name": "homo", "common_name": "human", "display_name": "Human", "aliases": ["man", "x"], "release": 9}, {"name": "mus", "common_name": "mouse", "display_name": "Mouse", "aliases": ["x"], "release": 9}]}
    (tmp_path / "s.json").write_text(json.dumps(body))
    syn, rel = st.species(st.payload(spark, f"{tmp_path}/s.json"))
    assert st.formal_name(syn, "MAN") == "homo" and rel.count() == 2
    with pytest.raises(ValueError):
        st.formal_name(syn, "x")
    with pytest.raises(KeyError):
        st.formal_name(syn, "cat")
    s = api.setup(df(spark, "name string", ("homo_core_9_1",), ("homo_core_8_1",)), syn, "human")
    assert (s.organism, s.release, s.releases) == ("homo", 9, (8, 9)) and s.change_release(8).release == 8
    for bad in (lambda: s.change_release(7), lambda: s.change_form("x"), lambda: s.change_assembly(1)):
        with pytest.raises(ValueError):
            bad()
    assert s.change_form("transcript").change_assembly(37) != s
    wide = df(spark, "obs string, A double, B double", ("o1", 1.0, 0.0), ("o2", None, 3.0))
    wide.write.parquet(f"{tmp_path}/m")
    m = st.matrix(spark, f"{tmp_path}/m", "d", wide=True)
    assert sorted(tuple(r) for r in m.collect()) == [("d", "o1", "A", 1.0), ("d", "o2", "B", 3.0)]
    m.coalesce(1).write.parquet(f"{tmp_path}/coo")
    assert [r.feature for r in st.features(spark, f"{tmp_path}/coo").orderBy("place").collect()] == ["A", "B"]
    assert st.text_columns(df(spark, "b binary", (bytearray(b"x"),))).first().b == "x"


def test_checks_find_what_they_are_for(spark):
    two = df(spark, "a int, b string", (1, "x"), (1, "x"))
    for bad in (lambda: schema.assert_unique(two, "a"), lambda: schema.assert_absent(two, "b", "x"), lambda: schema.assert_subset(two, df(spark, "a int", (2,)), ["a"]),
                lambda: schema.conform(two, "ids"), lambda: schema.assert_storable(df(spark, "a array<int>", ([1],))), lambda: graph.checked(df(spark, "src string, dst string, db string, assembly int, release int", ("a", "b", "d", 38, 1), ("a", "b", "d", 38, 1)))):
        with pytest.raises(schema.ContractError):
            bad()
    assert schema.assert_storable(two) is two
    ids = df(spark, "release string, stable_id string, version int", ("1", "A", 1))
    assert schema.conform(ids, "ids").schema["release"].dataType.typeName() == "integer"
    raw = df(spark, "gene_id int, stable_id string", (1, "A"), (1, "A"), (2, None))
    assert prep.release_ids(raw).count() == 1
    side = df(spark, "gene_id int, stable_id string, version int", (1, "A", 2))
    assert prep.release_ids(raw.select("gene_id"), side).select("version").first().version == 2
    with pytest.raises(ValueError):
        prep.release_ids(raw.select("gene_id"))
    with pytest.raises(schema.ContractError):
        summary.ranges_all_inclusive(df(spark, "src string, dst string, db string, assembly int, release int", ("x", "A.1", "d", 38, 9)), df(spark, "node string, seq int, start int, end int", ("A.1", 1, 1, 3)), 9)
    with pytest.raises(schema.ContractError):
        graph.with_sessions(df(spark, "src string, old_release int, new_release int", ("a", 1, 2)), df(spark, "old_release int, new_release int, x int", (1, 2, 1), (1, 2, 2)))


def test_each_invariant_is_found_where_it_is_broken(spark):
    ids = df(spark, "release int, stable_id string, version int", (1, "A", 1), (2, "A", 1), (3, "B", 1))
    ranges = "node string, seq int, start int, end int"
    good = df(spark, ranges, ("A.1", 1, 1, 2), ("B.1", 1, 3, None))
    edges = "src string, dst string, old_release int, new_release int"
    fine = df(spark, edges, ("A.Void", "A.1", 1, 1), ("B.1", "B.1", 3, None))
    of = lambda h, r: {x["name"]: x.violations for x in qa.invariants(ids, h, r).collect()}
    assert set(of(fine, good).values()) == {0}
    broken = {
        "ids_without_range": (fine, df(spark, ranges, ("A.1", 1, 1, 1), ("B.1", 1, 3, None))),
        "range_without_ids": (fine, df(spark, ranges, ("A.1", 1, 1, 3), ("B.1", 1, 3, None))),
        "overlapping_ranges": (fine, df(spark, ranges, ("A.1", 1, 1, 2), ("A.1", 2, 2, 2), ("B.1", 1, 3, None))),
        "empty_ranges": (fine, df(spark, ranges, ("A.1", 1, 1, 2), ("B.1", 1, 3, None), ("C.1", 1, 3, 2))),
        "edges_back_in_time": (fine.union(df(spark, edges, ("A.1", "B.1", 3, 2))), good),
        "unknown_nodes": (fine.union(df(spark, edges, ("Q.1", "B.1", 2, 3))), good),
    }
    for name, (h, r) in broken.items():
        assert of(h, r)[name] > 0, name


def test_engine(spark, tmp_path, capsys):
    t, g = small_graph(spark, 1)
    s = st.Store(spark, f"{tmp_path}/graphs")
    made = plan.get_graph(s, lambda: t)
    assert plan.get_graph(s, lambda: pytest.fail("is stored")).history.count() == made.history.count() == t.history.count()
    e = api.Engine.stored(spark, f"{tmp_path}/graphs", settings=api.Settings(release=8)).warm_up()
    assert e.forms() == ["gene", "transcript", "translation"] and e.known_databases == {"DB0", "DB1"} and "release=8" in repr(e)
    genes = sorted(n for n, k in g.kind.items() if k == "gene" and "." in n and not n.endswith((".Void", ".Retired")))
    got = e.convert_many([*genes, "nobody"], from_release=None, go_external=False).cache()
    rows = {r.query_id: r for r in got.collect()}
    assert rows["nobody"].status == "no_corresponding" and {r.status for r in rows.values()} >= {"converted"}
    ask = next(q for q, r in rows.items() if r.status == "converted")
    one = e.convert(ask, return_path=True, go_external=False)
    assert one["targets"] and one["status"] == "converted" and one["rows"][0]["path"] is not None
    assert e.convert(ask.split(".")[0], go_external=False)["node"] == ask.split(".")[0]  # a base
    to_db = e.convert_many(genes, database="DB1", go_external=False)
    assert {r.status for r in to_db.collect()} <= {"converted", "no_target", "no_conversion"}
    with pytest.raises(ValueError):
        e.convert_many(genes, database="DB9")
    assert "input_identifiers" in e.report(got) and e.bins(got).count() > 1
    source = e.infer_source(["X0", "X2", "X4"])
    assert source[0] == "DB0" and e.infer_source(["X0"], "release", winner=False).columns == ["release", "n_ids"] and e.infer_source(["?"]) is None
    (tmp_path / "names.txt").write_text("\n".join(genes[:3]))
    assert main(["convert", f"{tmp_path}/graphs", f"{tmp_path}/names.txt", "--to-release", "8", "--out", f"{tmp_path}/out"]) == 0
    assert spark.read.option("header", True).csv(f"{tmp_path}/out").select("query_id").distinct().count() == 3
    assert main([]) == 0
    with pytest.raises(SystemExit):
        main(["--version"])
    assert api.logger().name == "chronoweave" and qa.travel_report({"queries": 1, "lost": 0, "one_to_one": 1, "one_to_many": 0, "inaccurate": 0}).startswith("queries: 1")


def test_own_name_and_richness_decide_between_equal_targets(spark):
    keys = {k: 0 for k in search.TARGET_KEYS}
    row = lambda q, n, t, f, **k: (q, n, t, f, *(keys | k).values())
    d = df(spark, "query_id string, node string, target string, final string, " + ", ".join(f"{k} int" for k in search.TARGET_KEYS),
           row("a", "a", "t1", "a"), row("a", "a", "t2", "b"), row("b", "b", "t1", "x", neg_pri=-2), row("b", "b", "t2", "y", neg_pri=-1), row("c", "c", "t1", "x", confidence=1), row("c", "c", "t2", "y", assembly_jump=3))
    assert sorted((r.query_id, r.final) for r in search.choose_targets(d).collect()) == [("a", "a"), ("b", "x"), ("c", "y")]


def test_harmonise(spark):
    m = df(spark, "dataset string, query string, target string, gene string", ("d", "p", "N1", "g1"), ("d", "q", "N2", "g2"), ("e", "p", "N1", "g1"))
    x = df(spark, "dataset string, obs string, feature string, value double", ("d", "o", "p", 1.0), ("d", "o", "q", 2.0), ("e", "o", "p", 3.0))
    assert sorted((r.feature, r.value) for r in harmonize.harmonise(x, m, "d").collect()) == [("N1", 1.0), ("N2", 2.0)]
    with pytest.raises(schema.ContractError):
        harmonize.annotations({"d": df(spark, "obs string, n string", ("o", "many"))}, ["n"], ["n"])
    with pytest.raises(ValueError):
        harmonize.combine(x, "other")
    assert harmonize.combine(x, fill=True).count() == 4
    rows = df(spark, "k string, v int", ("a", 1), ("b", 2))
    assert [r.k for r in harmonize.aligned(rows, df(spark, "k string, place int", ("b", 1), ("a", 2)), "k").collect()] == ["b", "a"]
    with pytest.raises(schema.ContractError):
        harmonize.aligned(rows, df(spark, "k string, place int", ("c", 1)), "k")
    drawn = [r.obs for r in qa.draw(spark.range(100).selectExpr("cast(id as string) obs"), "obs", 7).collect()]
    assert len(drawn) == 7 and drawn == [r.obs for r in qa.draw(spark.range(100).repartition(3).selectExpr("cast(id as string) obs"), "obs", 7).collect()]


def test_a_release_may_come_in_several_batches(spark, tmp_path):
    schema_ = "release int, stable_id string, version int"
    for i, rows in enumerate([[(1, "a", 1), (1, "b", 1)], [(1, "c", 1), (2, "a", 2)], [(1, "b", 9)]]):
        df(spark, schema_, *rows).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema_).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        streams.append_releases(stream, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(60)
        if i == 0:
            assert streams.read_releases(spark, f"{tmp_path}/out").count() == 2
    got = sorted((r.release, r.stable_id, r.version) for r in streams.read_releases(spark, f"{tmp_path}/out").collect())
    assert got == [(1, "a", 1), (1, "b", 9), (1, "c", 1), (2, "a", 2)]

"""Embedding near-dedup and mixing against brute force, SQL of the registered queries, the pipeline stage by stage."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from compare import differences
from test_near_copies import brute
from test_texts import brute_components, brute_lines

import corpus_pipeline
from chronoweave.llm import embedding_dedup, mixing, queries
from chronoweave.llm.queries import vocabulary_path

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, name):
    assert differences(spark, SF, queries.queries()[name], queries.oracle_sql()[name]) == ""


def test_embeddings_like_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((300, 32))
    near = base[:80] + rng.standard_normal((80, 32)) * 0.3
    vecs = [list(map(float, v)) for v in np.concatenate([base, near, base[:40] * 3, base[:5]])]
    vecs += [None, [], [0.0] * 32, [float("nan")] + [1.0] * 31, [None] + [1.0] * 31, [float("inf")] * 32, [1.0, 2.0], [1e-30] * 32, [1e30] * 32]
    rows = [(i, v, 1, "x") for i, v in enumerate(vecs)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rep int, w string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.embedding_dedup(df).collect()}
    fine = [i for i, v in enumerate(vecs) if v and None not in v and np.isfinite(v).all() and np.abs(v).max() > 0]
    unit = {}
    for i in fine:
        x = np.array(vecs[i]) / np.abs(vecs[i]).max()
        unit[i] = x / np.sqrt((x * x).sum())
    linked = [(a, b) for n, a in enumerate(fine) for b in fine[n + 1 :] if len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95]
    n = Counter(x for p in linked for x in p)
    of = brute_components(range(len(vecs)), linked)
    assert got == {i: (n[i], of[i], of[i] == i) for i in range(len(vecs))}
    assert len(linked) > 100
    assert embedding_dedup.embedding_dedup(df.limit(0)).count() == 0


def test_rows_of_one_id_keep_their_own_links(spark):
    x, y, z = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    rows = [(1, x), (1, y), (2, [1.0, 0.01, 0.0]), (3, z), (3, z), (4, [0.0, 0.01, 1.0]), (None, x)]
    got = sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in embedding_dedup.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect())
    assert got == sorted([(1, 1, 1, True), (1, 0, 1, True), (2, 1, 1, False), (3, 2, 3, True), (3, 2, 3, True), (4, 2, 3, False), (0, 0, 0, True)])


def test_a_pair_exactly_at_the_threshold_is_decided_on_whole_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.8, 0.6]), (3, [0.8 - 1e-9, 0.6]), (4, [1.0, 0.0])]
    got = [(r.vec_id, r.n_links) for r in embedding_dedup.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), threshold=0.8).orderBy("vec_id").collect()]
    assert got == [(1, 2), (2, 3), (3, 1), (4, 2)]


@pytest.mark.parametrize("block", [64, 4096])
def test_recall_near_the_threshold(spark, monkeypatch, block):
    """Pairs at cosine 0.95 to 0.96, and one large group around a vector, dealt in blocks too."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rng = np.random.default_rng(12)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    a, z = unit(rng.standard_normal((1500, 48))), rng.standard_normal((1500, 48))
    z = unit(z - (z * a).sum(1, keepdims=True) * a)
    c = rng.uniform(0.95, 0.96, (1500, 1))
    group = a[0] + rng.standard_normal((300, 48)) * 0.03
    vecs = np.concatenate([a, c * a + np.sqrt(1 - c * c) * z, group]).astype(np.float32)
    got = embedding_dedup.embedding_dedup(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "vec_id long, embedding array<float>")).toPandas().set_index("vec_id")
    x = unit(vecs.astype(float))
    n = (x @ x.T >= 0.95).sum(axis=1) - 1
    found, want = got.n_links.sort_index().to_numpy(), n
    print("links", want.sum() // 2, "found", found.sum() / want.sum())
    assert (found <= want).all() and found.sum() >= 0.9995 * want.sum() and want.sum() > 10_000


def brute_targets(sizes: dict):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, open_, out = 1.5 * sum(sizes.values()), list(order), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not above:
            return out | share
        for s in above:
            out[s], left = 2.0 * sizes[s], left - 2 * sizes[s]
        open_ = [s for s in open_ if s not in above]
    return out


def docs_of(spark, n=4000):
    rng = np.random.default_rng(3)
    src = [None, "a", "b", "hot", "hot", "hot", "tiny"]
    rows = [(int(i), " ".join("w" for _ in range(int(rng.integers(0, 40)))) if i % 50 else None, src[int(rng.integers(0, 6))] if i else "tiny", "x", 1) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, `__size` string, draws int")


def test_mix_meets_its_targets(spark):
    d = docs_of(spark)
    rows = mixing.taken(d).join(d.select("doc_id", "source"), "doc_id").collect()
    again = mixing.taken(d.repartition(5)).collect()
    assert {(r.doc_id, r.taken) for r in rows} == {(r.doc_id, r.taken) for r in again}
    sizes, taken, of = Counter(), Counter(), {}
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        of[r.source] = r.target
        assert r.taken <= 2 * r.size
    want = brute_targets(sizes)
    for s, t in want.items():
        assert abs(of[s] - t) < 1e-6 * max(t, 1) and abs(taken[s] - t) <= max(0.01 * t, 60), s
    assert mixing.taken(d.limit(0)).count() == 0


def test_shards_hold_what_is_taken(spark):
    d = docs_of(spark)
    want = Counter({r.doc_id: r.taken // r.size for r in mixing.taken(d).collect() if r.size})
    out = mixing.mix(d, levels=3)
    far = mixing.mix(d, levels=3, few_blocks=0)  # by shuffle
    assert Counter((r.doc_id, r["__shard"], r["__draw"]) for r in out.collect()) == Counter((r.doc_id, r["__shard"], r["__draw"]) for r in far.collect())
    got = Counter(r.doc_id for r in out.filter("text is not null and text <> ''").collect())
    assert got == +want and out.columns[: len(d.columns)] == d.columns
    per = {r["__shard"]: r["count"] for r in out.groupBy("__shard").count().collect()}
    assert set(per) == set(range(8)) and max(per.values()) < 1.5 * min(per.values())
    assert mixing.stage(d.limit(0)).count() == 0


def test_many_tasks_for_one_shard(spark, monkeypatch):
    monkeypatch.setattr(mixing, "TASK_WORDS", 2000)
    monkeypatch.setattr(mixing, "LEVELS", (0, 2))
    d = docs_of(spark)
    want = mixing.taken(d).selectExpr("sum(taken)").first()[0]
    out = mixing.mix(d)
    assert out.selectExpr("sum(regexp_count(text, '[^ ]+'))").first()[0] == want and out.select("__shard").distinct().count() == 4


def test_pipeline_stage_by_stage(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    a = spark.createDataFrame(stages["language_id"](spark, docs, SF).collect(), docs.schema)
    was, kept = {r.doc_id: r for r in docs.collect()}, {r.doc_id: r for r in a.collect()}
    assert all(kept[i] == was[i] for i in kept) and len(kept) > 0.9 * len(was)
    assert not any(r.text is None or not re.search(r"[^\W\d_]", r.text) for r in kept.values())
    b = spark.createDataFrame(stages["line_dedup"](spark, a, SF).collect(), docs.schema)
    want = brute_lines({i: r.text for i, r in kept.items()})
    whole = {i: len(kept[i].text.split("\n")) for i in kept}
    lines = {r.doc_id: r.text for r in b.collect()}
    assert lines == {i: t for i, (t, gone) in want.items() if len(gone) < whole[i]}
    c = spark.createDataFrame(stages["simhash"](spark, b, SF).collect(), docs.schema)
    ids = sorted(lines)
    linked = brute(lines)  # a similarity of 0.8 by five-word shingles, as the stage is asked for
    of = brute_components(ids, linked)
    assert sorted(r.doc_id for r in c.collect()) == [i for i in ids if of[i] == i]
    d = spark.createDataFrame(stages["mixing"](spark, c, SF).collect(), docs.schema)
    took = {r.doc_id: r.taken // r.size for r in mixing.taken(c).collect() if r.size}
    assert Counter(r.doc_id for r in d.collect() if r.text.split()) == +Counter(took)
    t = Tokenizer.from_file(vocabulary_path())
    e = stages["bpe"](spark, d, SF).collect()
    assert len(e) == d.count()
    for r in e:
        got = np.array(t.encode(lines[r.doc_id], add_special_tokens=False).ids, "<u4")
        assert (r.n_tokens, r.ids_sha256) == (len(got), hashlib.sha256(got.tobytes()).hexdigest())


def test_pipeline_of_odd_and_empty_tables(spark, tmp_path):
    """Nulls, empty texts, repeated rows and ids, an extra column with a clashing name; and no rows at all."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("__t", F.lit("x"))
    odd = [(10_001, None, "en", None, 0, "x"), (10_002, "", "en", "s", 0, "x"), (10_003, "12 34", "en", "s", 5, "x"), (None, "An unnamed row of english words. " * 4, "en", "s", 9, "x"), (10_004, "One of the rows that come twice here, in english.", None, "s", 3, "x"), (10_004, "One of the rows that come twice here, in english.", None, "s", 3, "x")]
    d = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    d.write.parquet(f"{tmp_path}/odd/documents.parquet")
    d.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    ids = Counter(r.doc_id for r in out)
    assert not {10_001, 10_002, 10_003} & ids.keys() and ids[10_004] <= 2 and len(ids) > 100
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0

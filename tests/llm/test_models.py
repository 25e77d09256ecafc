"""Language, quality and toxicity: held-out accuracy, gradients, defined results for odd rows."""

from __future__ import annotations

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from chronoweave.llm import langid, quality, queries, toxicity

SF = "/root/testdata/sf0.01"
ODD = "doc_id long, text string, lang string, source string"


def auc(y, s):
    y, s = np.asarray(y), np.asarray(s, float)
    rank = s.argsort().argsort() + 1.0
    for v in np.unique(s):
        rank[s == v] = rank[s == v].mean()
    n1 = y.sum()
    return (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


def held_out(spark, df, label):
    return df.filter("held_out").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter(f"{label} is not null").select(label, "score", "predicted").toPandas()


@pytest.mark.parametrize("query, label, least", [(queries.op7_quality, "quality", 0.85), (queries.op9_toxicity, "toxic", 0.8)])
def test_held_out(spark, query, label, least):
    df = query(spark, SF)
    assert df.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    got = held_out(spark, df, label)
    print(label, len(got), auc(got[label], got.score), (got[label] == got.predicted).mean())
    assert auc(got[label], got.score) >= least
    assert got.score.between(0, 1).all()


def test_language(spark):
    df = queries.op8_language_id(spark, SF)
    got = df.filter("held_out and lang_pred <> 'und'").join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").filter("lang is not null").toPandas()
    print(len(got), (got.lang == got.lang_pred).mean())
    assert (got.lang == got.lang_pred).mean() >= 0.9


def odd(spark):
    return spark.createDataFrame([(1, None, "en", None), (2, "", "en", "s"), (3, "12 34 !!", "en", "s"), (4, "x" * 200_000, "en", "s"), (4, "x" * 200_000, "en", "s"), (None, "some words", None, "s")], ODD)


def test_odd_rows(spark):
    d = odd(spark)
    net = langid.BiGRU(2, 4)
    got = langid.language_id(d, langid.Model(["en", "de"], net)).collect()
    assert [(r.lang_pred, r.score) for r in got[:3]] == [("und", 0.0)] * 3 and got[3].lang_pred == got[4].lang_pred != "und"
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.quality(d, quality.train(d, labels)).collect()} == {0.5}
    tox = toxicity.toxicity(d, toxicity.train(d, labels)).collect()
    assert len(tox) == 6 and all(0 <= r.score <= 1 for r in tox)
    none = d.limit(0)
    assert {r.lang_pred for r in langid.language_id(d, langid.train(none)).collect()} == {"und"}
    for out in (langid.language_id(none, langid.train(none)), quality.quality(none, quality.train(none, labels)), toxicity.toxicity(none, toxicity.train(none, labels))):
        assert out.count() == 0
    unlabelled = d.withColumn("lang", F.lit(None).cast("string"))
    assert sorted(r.text for r in langid.stage(unlabelled).collect()) == ["some words", "x" * 200_000, "x" * 200_000]
    assert langid.stage(none).count() == 0


def test_trained_models_on_odd_rows(spark):
    """Nulls, empty and long texts, repeats and clashing names, scored by models that learned from real rows."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    extra = ["__id", "__t", "__l", "__lang", "__score", "label", "score", "predicted", "held_out"]
    d = odd(spark).select("*", *[F.lit("x").alias(c) for c in extra])
    models = {"lang": langid.train(docs, updates=60), "quality": quality.train(docs, labels), "toxic": toxicity.train(docs, labels)}
    got = {"lang": langid.language_id(d, models["lang"]), "quality": quality.quality(d, models["quality"]), "toxic": toxicity.toxicity(d, models["toxic"])}
    for name, out in got.items():
        rows = out.collect()
        assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows), name
        assert rows[3][1:] == rows[4][1:] and (name == "lang" or rows[0].score == rows[1].score), name
        assert rows[5].doc_id is None and rows[5].held_out, name
    kept = langid.with_language(d, models["lang"])
    assert kept.columns == [*d.columns, "__lang", "__score"] and {r[4] for r in kept.collect()} == {"x"}


def test_the_stage_keeps_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clean = docs.filter("lang is not null and text rlike '[a-zA-Z]{3}'")
    assert langid.stage(docs).join(clean, "doc_id", "left_semi").count() >= 0.995 * clean.count()


def test_gradients_of_the_network():
    net = langid.BiGRU(3, 3, seed=1)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    texts, y, w = [b"abca", b"bca", b"a"], np.array([0, 2, 1]), np.array([1.0, 2.0, 1.0])
    x, sizes = langid.padded(texts), np.array([4, 3, 1])
    grad = net.loss_gradients(x, sizes, y, w)[1]
    for k in net.w:
        for at in [np.unravel_index(i, grad[k].shape) for i in np.argsort(-np.abs(grad[k]), axis=None)[:4]]:
            old, found = net.w[k][at], []
            for to in (old + 1e-5, old - 1e-5):
                net.w[k][at] = to
                found.append(net.loss_gradients(x, sizes, y, w)[0])
            net.w[k][at] = old
            assert abs((found[0] - found[1]) / 2e-5 - grad[k][at]) < 1e-6


def plain_probabilities(net, raw, first=0, last=None):
    """Byte by byte over a whole text, without windows: the mean of places first .. last."""
    h, states = net.hidden, {}
    for d, seq in (("f", raw), ("b", raw[::-1])):
        s, own = np.zeros(h), []
        for byte in seq:
            g, us = net.w[f"E{d}"][:, byte], net.w[f"U{d}"] @ s
            a = g[:h] + us[:h]
            f = 0.5 * (1 + a / (1 + abs(a)))
            c = g[h:] + f * us[h:]
            s = s + f * (c / (1 + abs(c)) - s)
            own.append(s)
        states[d] = own if d == "f" else own[::-1]
    total = []
    for f, b in zip(states["f"], states["b"], strict=True):
        z = np.exp(net.w["Vf"] @ f + net.w["Vb"] @ b + net.w["c"][:, 0])
        total.append(z / z.sum())
    return np.mean(total[first:last], axis=0)


def test_windows_read_like_the_whole_text():
    rng = np.random.default_rng(4)
    net = langid.BiGRU(3, 4, seed=2)
    texts = [bytes(rng.integers(97, 123, n, dtype=np.uint8)) for n in (1, 7, 255, 256, 257, 700, 40, 1500)]
    got = langid.probabilities(net, texts)
    for t, p in zip(texts, got, strict=True):
        assert np.abs(plain_probabilities(net, t) - p).max() < (1e-5 if len(t) <= langid.WINDOW else 1e-3), len(t)
    assert np.abs(langid.probabilities(net, texts[::-1])[::-1] - got).max() < 1e-6  # neighbours do not matter


def test_context_decides():
    """Both languages have the same words, in another order: only a state that crosses words tells them apart."""
    rng = np.random.default_rng(5)
    def text(back):
        order = "ba ed gf" if back else "ba gf ed"
        return " ".join([order] * int(rng.integers(3, 9))).encode()
    x = [text(i % 2) for i in range(400)]
    net = langid.BiGRU(2, 8).fit(x, np.arange(400) % 2, np.ones(400, np.float32), updates=300)
    got = langid.probabilities(net, [text(i % 2) for i in range(100)]).argmax(axis=1)
    assert (got == np.arange(100) % 2).mean() > 0.95


def test_grammar():
    s = toxicity.Scorer(toxicity.Lexicon({}))
    near, alone, denied, said = (s.clause(x) for x in ("you are an idiot", "an idiot", "you are not an idiot", "he said you are an idiot"))
    assert near > alone > denied and near > said
    assert s.clause("kill the process") == 0.0 < s.clause("i will kill you and kill them")
    assert s.features(None) == s.features("")


def test_grammar_in_four_languages():
    s = toxicity.Scorer(toxicity.Lexicon({}))
    full = ["you are an idiot", "you idiot", "du bist ein idiot", "tu es un idiote", "eres un idiota", "usted es un imbécil", "kill you", "I will kill you", "I am going to hurt you and your family", "je vais te tuer", "ich werde dich töten", "voy a matarte", "te voy a matar", "you will be shot", "shut up, moron"]
    quiet = ["take out the trash", "dumb terminal", "an idiot", "he said you are an idiot", "you are not an idiot", "I will not kill you", "tu n'es pas un idiote", "kill the process", "beat the eggs", "shoot the film"]
    low, high = max(s.clause(x.lower()) for x in quiet), min(s.clause(x.lower()) for x in full)
    assert low < 2 < high
    assert s.clause("kill the process") == s.clause("beat the eggs") == 0
    curve = toxicity.train_without_labels().curve
    score = lambda t: 1 / (1 + np.exp(-np.dot([1.0, *s.features(t)], curve)))
    assert all(score(x) >= 0.5 for x in full) and all(score(f"Well. {x} today. " + "And so on it goes. " * 5) < 0.5 for x in quiet)


def test_clauses_like_a_plain_scan():
    rng = np.random.default_rng(7)
    s = toxicity.Scorer(toxicity.Lexicon({"gro*": 2.0, "word": 1.5}))
    vocabulary = ["you", "idiot", "kill", "not", "said", "the", "grown", "gro", "a word", "words", ",", ".", "?", "\n", "te", "tuer", "be", "dumb,", "x'kill"]
    for _ in range(300):
        text = " ".join(rng.choice(vocabulary, rng.integers(1, 40)))
        plain = [c for part in regex.split(r"[.!?;:\n]", text.lower()) if (c := s.clause(part)) > 0]
        assert [c for *_, c in s.clauses(text)] == plain


def test_pooling_is_monotone():
    rng = np.random.default_rng(1)
    n = rng.integers(1, 9, 50).astype(float)
    got = quality.pool(rng.random(50) * n, n)
    assert (np.diff(got) >= 0).all() and len(got) == 50


def test_quality_like_plain_ridge(spark):
    """The partition sums and their solution against numpy over all fit rows at once."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    m = quality.train(docs, labels, features=40)
    rows = quality.labelled(docs, labels, "quality", 20_000).select("__t", "__y", (F.pmod(F.xxhash64("__id", F.lit(1)), F.lit(5)) > 0).alias("fit")).collect()
    s = np.array([quality.statistics(r[0]) for r in rows])
    assert np.allclose(m.mean, s.mean(0)) and np.allclose(m.scale, s.std(0) + 1e-6, rtol=1e-3)
    fit = np.array([r[2] for r in rows])
    x, y = m.features(s[fit]), np.array([r[1] for r in rows])[fit]
    beta = np.linalg.solve(x.T @ x + 1e-3 * len(x) * np.diag([1e-9] + [1.0] * 40), x.T @ y)
    assert np.allclose(m.raw(s), m.features(s) @ beta, atol=1e-6)
    kernel = np.exp(-((s[:30, None] - s[None, :30]) ** 2 / m.scale**2).sum(2) / (2 * 4.0**2))
    wide = quality.Model(m.mean, m.scale, np.random.default_rng(1).standard_normal((quality.N_STATS, 20_000)) / 4.0, np.random.default_rng(2).uniform(0, 2 * np.pi, 20_000), None, None).features(s[:30])[:, 1:]
    assert np.abs(wide @ wide.T - kernel).max() < 0.05 or np.abs((s[:30] - m.mean) / m.scale).max() > 8  # a Gaussian kernel

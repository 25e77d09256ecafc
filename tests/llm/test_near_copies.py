"""The pipeline's near copies against brute-force Jaccard of five-word shingles."""

from __future__ import annotations

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F
from test_texts import brute_components, table

from chronoweave.llm import near_copies, simhash

SF = "/root/testdata/sf0.01"


def shingles(text):
    p = (text or "").encode().lower().split()
    k = min(5, len(p))
    return {b" ".join(p[i : i + k]) for i in range(len(p) - k + 1)} if p else set()


def brute(texts: dict):
    sets = {i: shingles(t) for i, t in texts.items()}
    alike = lambda a, b: 5 * len(a & b) >= 4 * len(a | b)  # noqa: E731  empty sets are alike
    return [(x, y) for x, y in combinations(sorted(sets), 2) if alike(sets[x], sets[y])]


def test_near_copies_of_the_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    linked = brute(texts)
    of = brute_components(texts, linked)
    assert {(56, 914), (255, 773), (643, 770)} <= set(linked)
    assert sorted(r.doc_id for r in simhash.stage(docs).collect()) == [i for i in texts if of[i] == i]


@pytest.mark.parametrize("block", [4, 1024])
def test_a_chain_of_edits_and_pairs_at_the_border(spark, monkeypatch, block):
    links = near_copies._links
    monkeypatch.setattr(near_copies, "_links", lambda docs, classes: links(docs, classes, block))
    rng = random.Random(7)
    texts, word = [], lambda: f"w{rng.randint(0, 10**6)}"
    for length in (60, 200, 900):
        for _ in range(12):
            words = [word() for _ in range(length)]
            texts.append(" ".join(words))
            for _ in range(6):  # each an edit of the one before, so the ends of the chain are not alike
                for _ in range(rng.randint(1, max(1, length // 60))):
                    words[rng.randrange(length)] = word()
                texts.append(" ".join(words))
    texts += ["one two three", "One  TWO three", "one two four", "", None]
    ids = rng.sample(range(10_000), len(texts))
    docs = dict(zip(ids, texts, strict=True))
    of = brute_components(docs, brute(docs))
    got = {r["__kd"]: r["first"] for r in near_copies.near_copies(table(spark, texts, ids)).collect()}
    assert got == of and len(set(of.values())) < len(of) / 2


@pytest.mark.parametrize("block", [8, 1024])
def test_a_group_of_edits_of_one_text(spark, monkeypatch, block):
    """Edits by which members are alike with the text or with few others only; all in the same buckets."""
    links = near_copies._links
    monkeypatch.setattr(near_copies, "_links", lambda docs, classes: links(docs, classes, block))
    rng = random.Random(8)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(150)]
    texts = []
    for _ in range(150):
        words = list(base)
        for _ in range(rng.randint(0, 8)):
            words[rng.randrange(150)] = f"e{rng.randint(0, 40)}"
        texts.append(" ".join(words))
    of = brute_components(dict(enumerate(texts)), brute(dict(enumerate(texts))))
    got = {r["__kd"]: r["first"] for r in near_copies.near_copies(table(spark, texts)).collect()}
    assert got == of and 5 < len(set(of.values())) < 100


def edits(rng, groups, copies, length=400):
    """Texts of groups that differ in few words, so in few bits of a fingerprint, and their groups' numbers."""
    texts, of = [], []
    for g in range(groups):
        base = [f"g{g}w{rng.randint(0, 10**6)}" for _ in range(length)]
        for _ in range(copies):
            words = list(base)
            words[rng.randrange(length)] = f"e{rng.randint(0, 10**6)}"
            texts.append(" ".join(words))
            of.append(g)
    return texts, of


def test_fingerprints_are_searched_and_join_near_copies_by_themselves(spark):
    """Without any band: what differs in up to 3 bits is found through the trees, and only what is similar stays linked."""
    texts, _ = edits(random.Random(9), 12, 8)
    texts += ["one two three", "", "x"]
    sets = [near_copies.shingle_set(t) for t in texts]
    fps, names = [simhash.majority(s) for s in sets], [near_copies._name(s) for s in sets]
    for s, fp in zip(sets, fps, strict=True):
        assert fp == sum((2 * sum(int(h) >> bit & 1 for h in s) > len(s)) << bit for bit in range(64))
    close = [(x, y) for x, y in combinations(range(len(texts)), 2) if (fps[x] ^ fps[y]).bit_count() <= 3]
    docs = table(spark, texts)
    classes = near_copies.sketches(docs).select("sig", "__kd", "fp", F.array().cast("array<long>").alias("bands"))
    at = {n: i for i, n in enumerate(names)}
    pairs = [(at[r.u], at[r.v]) for r in near_copies.fingerprint_pairs(classes).collect()]
    assert {tuple(sorted(p)) for p in pairs} <= set(close)
    everything = range(len(texts))
    assert brute_components(everything, pairs) == brute_components(everything, close)
    alike = set(brute(dict(enumerate(texts)))) & set(close)
    got = [(at[r.u], at[r.v]) for r in near_copies._links(docs, classes).collect()]
    assert len(alike) > 100 and {tuple(sorted(p)) for p in got} <= alike
    assert brute_components(everything, got) == brute_components(everything, alike)


def test_what_fingerprints_joined_is_not_compared_again(spark, monkeypatch):
    verified, asked = near_copies._verified, []

    def spy(pairs, sets):
        asked.append([(r.u, r.v) for r in pairs.collect()])
        return verified(pairs, sets)

    monkeypatch.setattr(near_copies, "_verified", spy)
    texts, _ = edits(random.Random(10), 5, 8, 600)
    got = {r["__kd"]: r["first"] for r in near_copies.near_copies(table(spark, texts)).collect()}
    assert got == brute_components(range(len(texts)), brute(dict(enumerate(texts))))
    by_bits, rest = asked
    of = brute_components({x for p in by_bits + rest for x in p}, by_bits)
    assert len(by_bits) >= 20 and not any(of[u] == of[v] for u, v in rest)

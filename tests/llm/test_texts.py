"""Line dedup, exact dedup, SimHash, BPE and license scans against brute force, with nulls, ties and empty tables."""

from __future__ import annotations

import hashlib
import random
from itertools import combinations
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from chronoweave.llm import bpe, exact_dedup, license_scan, line_dedup, simhash
from chronoweave.llm.queries import vocabulary_path

DOC = "doc_id long, text string, lang string, source string, n_chars long, `__t` string, `__kd` long, `count` int, rep string"


def table(spark, texts, ids=None):
    ids = ids or range(len(texts))
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 5, 1, "r") for i, t in zip(ids, texts, strict=True)], DOC)


# -- lines


def brute_lines(docs: dict[int, str | None], width=3):
    seen, gone, lines = {}, {}, {i: (t.split("\n") if t is not None else []) for i, t in docs.items()}
    for i in sorted(docs):
        for p in range(len(lines[i]) - width + 1):
            w = tuple(lines[i][p : p + width])
            if all(not x.strip(" ") for x in w):
                continue
            if seen.setdefault(w, (i, p)) != (i, p):
                gone.setdefault(i, set()).update(range(p, p + width))
    return {i: (None if docs[i] is None else "\n".join(x for p, x in enumerate(ls) if p not in gone.get(i, ())), sorted(gone.get(i, ()))) for i, ls in lines.items()}


def test_lines_like_brute_force(spark):
    rng = random.Random(1)
    docs = {i: "\n".join(rng.choice(["a", "b", "c", "", "long line " + str(i)]) for _ in range(rng.randint(0, 14))) for i in range(60)}
    docs |= {60: None, 61: "", 62: "x\ny\nz\n" * 500, 63: "x\ny\nz", 64: "\n\n\n\n"}
    got = {r.doc_id: (r.text, list(r["__removed"])) for r in line_dedup.line_dedup(table(spark, list(docs.values()), list(docs))).select("doc_id", "text", "__removed").collect()}
    assert got == brute_lines(docs)


def test_lines_of_repeated_rows_null_ids_and_empty_tables(spark):
    d = table(spark, ["a\nb\nc", "a\nb\nc", "a\nb\nc", "q"], [1, 1, None, None])
    got = sorted((r.doc_id or 0, r.text) for r in line_dedup.line_dedup(d).collect())
    assert got == [(0, ""), (0, "q"), (1, "a\nb\nc"), (1, "a\nb\nc")]
    out = line_dedup.stage(d)
    assert out.columns == d.columns and out.count() == 3 and {r["__t"] for r in out.collect()} == {"x"}
    assert line_dedup.stage(d.limit(0)).count() == 0


def test_windows_have_two_independent_hashes(spark):
    """Where the first hash of all lines is the same, the second still tells windows apart."""
    d = table(spark, ["a\nb\nc\nd"]).select(*line_dedup.row_key("doc_id", "text"), F.col("text").alias("__t2")).withColumnRenamed("__t2", "__t")
    seen = line_dedup.windows(d).select("__w.a", "__w.b").collect()
    x = [spark.sql(f"select xxhash64(1, '{c}') h").first().h for c in "abcd"]
    want = [spark.sql(f"select xxhash64(1, {x[i]}L, {x[i + 1]}L, {x[i + 2]}L) h").first().h for i in range(2)]
    assert [r.b for r in seen] == want and len({r.a for r in seen}) == 2


# -- exact copies


@pytest.mark.parametrize("crash, few", [(False, 10), (True, 10), (False, 0), (True, 0)])
def test_exact_copies(spark, crash, few):
    from pyspark.sql import functions as F

    texts = ["A b", "a B", "a b", None, "", "other", "É", "é", "a b ", "Long text " * 30_000, "long text " * 30_000]
    content = (lambda t: F.md5(F.substring(t, 1, 1))) if crash else F.md5  # collisions on purpose
    rows = exact_dedup.exact_dedup(table(spark, texts), keep="max", content_hash=content, broadcast_rows=few).collect()
    low = lambda t: (t or "").translate(str.maketrans(exact_dedup.UPPER, exact_dedup.LOWER))
    for r in rows:
        same = [i for i, t in enumerate(texts) if low(t) == low(texts[r.doc_id])]
        assert (r.keep_id, r.group_size, r.kept) == (max(same), len(same), r.doc_id == max(same))
        assert r.text_sha256 == hashlib.sha256(low(texts[r.doc_id]).encode()).hexdigest()
    assert len(rows) == len(texts)
    assert exact_dedup.exact_dedup(table(spark, [])).count() == 0


# -- SimHash


def brute_fingerprint(text, words=3):
    import re

    parts = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans(exact_dedup.UPPER, exact_dedup.LOWER)))
    if not parts:
        return 0
    sh = [" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))]
    hs = [xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def brute_components(ids, linked):
    of = {i: i for i in ids}
    for _ in ids:
        for a, b in linked:
            of[a] = of[b] = min(of[a], of[b])
    return of


def test_fingerprints():
    for t in [None, "", " \t\n", "one", "One TWO", "É x y z w", "a b c d e f " * 50, "\x1cx y\x85z", "a\x1fb c"]:
        for w in (3, 5):
            assert simhash.fingerprint(t, w) == brute_fingerprint(t, w), (t, w)


@pytest.mark.parametrize("block, shard", [(4, 1024), (2048, 1024), (2048, 4), (30, 8)])
def test_links_like_brute_force(spark, block, shard):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    fps = {int(b) for b in base}
    for b in base[:30]:
        for _ in range(4):
            fps.add(int(b) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(1, 5), replace=False)))
    fps = sorted(fps | {0, 1, 3, 7, 15})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    classes = spark.createDataFrame(list(zip(signed, range(len(fps)), strict=True)), "fp long, rep long")
    got = {r.node: r.component for r in simhash.components(simhash.links(classes, block=block, shard=shard)).collect()}
    linked = [(a, b) for a, b in combinations(range(len(fps)), 2) if (fps[a] ^ fps[b]).bit_count() <= 3]
    want = brute_components(range(len(fps)), linked)
    touched = {x for p in linked for x in p}
    assert got == {i: c for i, c in want.items() if i in touched}


def test_simhash_groups_and_stage(spark):
    long = " ".join(f"word{i}" for i in range(300))
    d = table(spark, [long, long, long + " tail", None, "", "quite another text here", None], [4, 2, 9, 7, 6, 1, None])
    got = {(r["__kd"], r["__kn"]): r.component for r in simhash.simhash_dedup(d).collect()}
    assert got[4, False] == got[2, False] == got[9, False] == 2 and got[7, False] == got[6, False] == 6 and got[1, False] == 1
    out = simhash.stage(d)
    assert out.columns == d.columns and sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect()) == [(False, 1), (False, 2), (False, 6), (True, 0)]
    assert simhash.stage(d.limit(0)).count() == 0


def test_one_id_with_two_texts_joins_nothing(spark):
    a, b, c = ("alpha beta gamma delta " * 9, "one two three four five six " * 7, "red green blue black white grey pink " * 5)
    d = table(spark, [a, b, b + "x", c], [5, 5, 3, 9])
    got = sorted((r["__kd"], r.component) for r in simhash.simhash_dedup(d).collect())
    want = brute_components(range(4), [(x, y) for x, y in combinations(range(4), 2) if (brute_fingerprint([a, b, b + "x", c][x]) ^ brute_fingerprint([a, b, b + "x", c][y])).bit_count() <= 3])
    least = {w: min([5, 5, 3, 9][i] for i in want if want[i] == w) for w in want.values()}
    assert got == sorted(([5, 5, 3, 9][i], least[want[i]]) for i in want) and simhash.simhash_dedup(d.limit(0)).count() == 0


def test_the_tree_passes_over_most_nodes():
    rng = np.random.default_rng(9)
    fps = rng.integers(0, 1 << 63, 1024, dtype=np.uint64)
    tree = simhash.BKTree(fps)
    assert sum(len(q) for _, q in tree.within(fps, 3)) == 1024
    assert tree.visited < 0.4 * 1024 * 1024, tree.visited / 1024
    print("nodes visited a query, of 1024:", tree.visited / 1024)


def test_bk_tree_finds_all_within_the_radius():
    rng = np.random.default_rng(3)
    fps = np.unique(rng.integers(0, 1 << 12, 200, dtype=np.uint64))
    found = {(int(n), int(q)) for n, near in simhash.BKTree(fps).within(fps, 3) for q in near}
    assert found == {(a, b) for a in range(len(fps)) for b in range(len(fps)) if int(fps[a] ^ fps[b]).bit_count() <= 3}


# -- BPE


def test_bpe_like_the_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path())
    t.no_truncation(), t.no_padding()
    rng = random.Random(4)
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    odd = [None, "", " ", "  a", "a  b \n\n c", "don't we'll I'M", "x" * 3000, "ab" * 1000, "é" * 50, "日本語のテキスト", "a<|endoftext|>b", "\t\r\n x", "🙂🙃" * 20, "  x y", "1234 12a", "end "]
    odd += ["".join(rng.choice("ab é\n\t 'st1.🙂日") for _ in range(rng.randint(1, 60))) for _ in range(400)]
    texts = docs + odd
    got = {r.doc_id: r for r in bpe.bpe(table(spark, texts), vocabulary_path()).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids), text
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), text
        assert got[i].decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.bpe(table(spark, []), vocabulary_path()).count() == 0
    twice = bpe.bpe(table(spark, ["some words", "some words", None, None], [7, 7, None, None]), vocabulary_path()).collect()
    assert [(r.doc_id, r.n_tokens) for r in twice] == [(7, 2), (7, 2), (None, 0), (None, 0)]


def test_bpe_with_a_cache_that_forgets_and_words_merged_together():
    v = bpe.Vocabulary(Path(vocabulary_path()).read_bytes())
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdeinrst é") for _ in range(rng.randint(1, 20))).encode() for _ in range(3000)]
    want = {w: v.id_of[v.exact(w)].astype("<u4").tobytes() for w in words}
    assert v.encode_words(words) == [want[w] for w in words]
    small, large = bpe.Encoder(v, cache_bytes=20_000), bpe.Encoder(v)
    texts = [" ".join(f"{rng.choice('abc')}{rng.randint(0, 2000)}, x" for _ in range(40)) + "end. \n y" * (i % 3) for i in range(300)]
    got = [ids for i in range(0, 300, 20) for ids in small.encode(texts[i : i + 20])]
    assert got == large.encode(texts) and len(small.spaced.young) < len(large.spaced.young)
    assert small.decode(got, most=500) == texts == large.decode(got)


# -- licenses


def test_licenses(spark):
    mit = license_scan.TEMPLATES["mit"]
    words = mit.split()
    edited = " ".join(w for i, w in enumerate(words) if i % 12)
    texts = ["before. " + mit + " after", edited.upper(), "permission is hereby granted to nobody at all", None, "", "a b", "x\n" + license_scan.TEMPLATES["cc-by-4.0-notice"] + " y", "Licensed under CC BY-SA 4.0. z", mit + "\n filler words here \n" + mit]
    rows = license_scan.license_scan(table(spark, texts)).collect()
    found = sorted((r.doc_id, r.license, r.occurrence) for r in rows)
    assert found == [(0, "mit", 1), (1, "mit", 1), (6, "cc-by-4.0-notice", 1), (7, "cc-by-sa-4.0-notice", 1), (8, "mit", 1), (8, "mit", 2)]
    first = next(r for r in rows if r.doc_id == 0)
    assert first.coverage == 1.0 and texts[0].encode()[first.span_start : first.span_end].decode() == mit.rstrip(".")
    assert license_scan.license_scan(table(spark, [])).count() == 0
    with pytest.raises(ValueError):
        license_scan.Index({"short": "too few"})


def test_alignment_like_the_longest_common_subsequence():
    rng = random.Random(5)
    for _ in range(40):
        a = np.array([rng.randint(0, 5) for _ in range(20)], np.uint64)
        b = np.array([rng.randint(0, 5) for _ in range(24)], np.uint64)
        best = np.zeros((21, 25), int)
        for i in range(20):
            for j in range(24):
                best[i + 1, j + 1] = best[i, j] + 1 if a[i] == b[j] else max(best[i, j + 1], best[i + 1, j])
        assert license_scan.align(a, b, 0, band=30)[0] == best[-1, -1]


def brute_coverage(template: str, text: str) -> float:
    """The longest common subsequence of all words, over the template's words: no match can cover more."""
    a, b = (license_scan.words(x.encode())[0].tolist() for x in (template, text))
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1] / len(a)


def test_license_scan_of_random_edits_like_brute_force():
    """Whole texts with words dropped, changed and put in: those covered in their place are found, no other is."""
    index, rng = license_scan.Index(license_scan.TEMPLATES), random.Random(11)
    names = ["mit", "isc", "bsd-2-clause", "bsd-3-clause", "zlib", "unlicense", "apache-2.0-header", "mit-notice", "gpl-3.0-notice", "mpl-2.0-notice"]
    filler = lambda n: " ".join(f"word{rng.randint(0, 500)}" for _ in range(n))
    found = clean = 0
    for _ in range(120):
        name = rng.choice(names)
        own = license_scan.TEMPLATES[name].split()
        rate = rng.choice([0.0, 0.04, 0.1, 0.3, 0.6])
        edited = [w for w in ((rng.choice(["", f"x{rng.randint(0, 99)}", f"{w} y"]) if rng.random() < rate else w) for w in own) if w]
        text = f"{filler(rng.randint(0, 60))}\n{' '.join(edited)}\n{filler(rng.randint(0, 60))}"
        bound = brute_coverage(license_scan.TEMPLATES[name], text)
        got = license_scan.scan(index, [None, text, ""])
        for row in got:
            assert row[0] == 1 and row[3] <= brute_coverage(license_scan.TEMPLATES[row[1]], text) + 1e-9
            span = text.encode()[row[5] : row[6]].decode()
            assert brute_coverage(license_scan.TEMPLATES[row[1]], span) >= row[3] - 1e-9
        if rate <= 0.1 and bound >= 0.8 and (len(own) >= license_scan.LONG or bound == 1):
            assert name in [r[1] for r in got], (name, rate, bound, got)
            found += 1
        if bound < 0.8:
            assert name not in [r[1] for r in got]
            clean += 1
    assert found > 40 and clean > 20


def test_notices_with_one_edit_and_insertions():
    index = license_scan.Index(license_scan.TEMPLATES)
    mit = license_scan.TEMPLATES["mit"].split()
    inserted = " ".join([*mit[:80], *[f"z{i}" for i in range(20)], *mit[80:]])
    texts = ["Released under MIT License", "Released under the terms of the MIT License", "Licensed under the Apache Software License, Version 2.0.", inserted, license_scan.TEMPLATES["gpl-3"], license_scan.TEMPLATES["bsd-3-clause"], license_scan.TEMPLATES["bsd-2-clause"], "We sat under the tree of the general, and you read to any public."]
    got = {}
    for row in license_scan.scan(index, texts):
        got.setdefault(row[0], []).append(row[1])
    assert {i: n for i, n in got.items()} == {0: ["mit-notice"], 1: ["mit-notice"], 2: ["apache-2.0-notice"], 3: ["mit"], 4: ["gpl-3"], 5: ["bsd-3-clause"], 6: ["bsd-2-clause"]}


def test_license_scan_of_repeated_and_long_texts(spark):
    mit = license_scan.TEMPLATES["mit"]
    long = "filler words " * 60_000 + mit
    rows = license_scan.license_scan(table(spark, [mit, mit, long], [3, 3, 4]).withColumnRenamed("rep", "license")).collect()
    assert sorted((r.doc_id, r.license) for r in rows) == [(3, "mit"), (3, "mit"), (4, "mit")] and rows[-1].span_start >= 120_000

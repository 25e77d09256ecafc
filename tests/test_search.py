"""Paths with jumps, synonyms and names against plain recursion over small random graphs; the surfaces on top of them."""

from __future__ import annotations

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from chronoweave.functions.ids import SYNONYM
from chronoweave.operators import search
from chronoweave.plans import convert as plan

INF = 2147483647


def small_graph(spark, seed: int):
    """(Tables, plain tables) of a few ids over eight releases, with gaps, branches and shared names."""
    rng = random.Random(seed)
    ids, events, xref, relation = [], [], [], []
    alive = {}
    for k in range(6):
        version = 1
        for r in range(1, 9):
            if rng.random() < 0.6:
                if (k, r - 1) in alive and rng.random() < 0.3:
                    version += 1
                alive[k, r] = version
                ids.append((r, f"G{k}", version))
                for x in range(5):
                    if rng.random() < 0.12:
                        xref.append((r, f"G{k}.{version}", f"X{x}", f"DB{x % 2}", rng.choice([37, 38, 38])))
                if rng.random() < 0.5:
                    relation.append((r, f"G{k}.{version}", f"T{k}.1", f"L{k}.1" if rng.random() < 0.5 else None))
            elif (k, r - 1) in alive:
                version += 1
    for (k, r), v in alive.items():
        for j in range(6):
            if j != k and (j, r + 1) in alive and rng.random() < 0.08:
                events.append((f"G{k}", v, f"G{j}", alive[j, r + 1], rng.choice([0.5, 0.9, None]), r, r + 1))
        if alive.get((k, r + 1)) == v and rng.random() < 0.2:
            events.append((f"G{k}", v, f"G{k}", v, 0.7, r, r + 1))
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    t = plan.build(df(ids, "release int, stable_id string, version int"), df(events, "old_id string, old_version int, new_id string, new_version int, score double, old_release int, new_release int"),
                   df(xref, "release int, graph_id string, id_db string, name_db string, assembly int"), df(relation, "release int, gene string, transcript string, translation string"))
    return t, Plain([tuple(r) for r in t.history.select("src", "dst", "old_release", "new_release", "weight").collect()], [tuple(r) for r in t.connections.collect()], [tuple(r) for r in t.ranges.select("node", "start", "end").collect()])


class Plain:
    """The same searches by recursion over dicts."""

    def __init__(self, history, conn, ranges):
        self.history, self.ranges, self.facts, self.kind = history, {}, {}, {}
        for n, s, e in ranges:
            self.ranges.setdefault(n, []).append((s, INF if e is None else e))
            self.kind[n] = "gene"
        for src, dst, *_ in history:
            self.kind[src] = self.kind[dst] = "gene"
        for src, dst, db, _, release in conn:
            a, b = {"form_gene": ("transcript", "gene"), "form_transcript": ("translation", "transcript")}.get(db, ("external", "gene"))
            self.kind[src], self.kind[dst] = a, b
            for x, y in ((src, dst), (dst, src)):
                self.facts.setdefault(x, {}).setdefault(y, set()).add(release)

    @staticmethod
    def base(node):
        return node.rsplit(".", 1)[0]

    def edges(self, node, release, back):
        out = []
        for src, dst, old, new, _ in self.history:
            a, b, at, until = (dst, src, new, old) if back else (src, dst, old, new)
            if a != node or back and new is None:
                continue
            if (at <= release) if back else (at >= release or new is None):
                out.append((at, b == node, b, until, f"{src}>{dst}@{old}-{'' if new is None else new}"))
        own = [e for e in out if not e[1] and self.base(e[2]) == self.base(node)]
        if own:
            first = (max if back else min)(e[0] for e in own)
            out = [e for e in out if e not in own or e[0] == first]
        times = [e[0] for e in out]
        return sorted(((at, loop and times.count(at) == 1, far, key, until) for at, loop, far, until, key in out), reverse=back)

    def synonyms(self, node, wanted, release, depth=2):
        found = []

        def go(path):
            kinds = [self.kind[n] for n in path]
            if kinds[-1] == wanted and (wanted != "gene" or release is None or any(s <= release <= e for s, e in self.ranges.get(path[-1], []))):
                found.append(path)
            if max(map(kinds.count, kinds)) >= depth:
                return
            for n, releases in self.facts.get(path[-1], {}).items():
                k = self.kind[n]
                if n in path or k == kinds[-1] or release is not None and release not in releases:
                    continue
                if len(path) > 1 and kinds[-2] == k != "external" and self.base(path[-2]) == self.base(n):
                    continue
                go([*path, n])

        go([node])
        least = {}
        for p in found:
            least[p[-1]] = min(len(p), least.get(p[-1], 99))
        return [p for p in found if len(p) == least[p[-1]]]

    @staticmethod
    def closest(ranges, p):
        for s, e in ranges:
            if s >= p:
                yield s, s > p
            elif e <= p:
                yield e, False
            else:
                yield s, True
                yield e, False

    def entries(self, node, found, to):
        out, groups = [], {}
        for p in found:
            groups.setdefault(self.base(p[-1]), []).append(p)
        for own in groups.values():
            points = set()
            for syn in {p[-1] for p in own}:
                ranges = self.ranges[syn]
                if self.kind[node] == "gene":
                    ranges = [(max(a, c), min(b, d)) for a, b in ranges for c, d in self.ranges[node] if a <= d and c <= b]
                points |= {(abs(at - to), syn, at, back) for at, back in self.closest(ranges, to)}
            if not points:
                ends = {to} if any(s <= to <= e for s, e in self.ranges[node]) else {x for r in self.ranges[node] for x in r}
                ends = {x for x in ends if abs(x - to) == min(abs(y - to) for y in ends)}
                points = {(abs(at - x), syn, at, to <= at) for syn in {p[-1] for p in own} for x in ends for at, _ in self.closest(self.ranges[syn], x)}
            least = min(p[0] for p in points)
            out += [(syn, at, back, p) for d, syn, at, back in points if d == least for p in own if p[-1] == syn]
        return out

    def paths(self, start, release, to, back, jumps, any_release=False):
        out = set()

        def walk(node, release, back, beamed, left, hist, seen):
            hist = list(hist)
            for at, loop, far, key, until in self.edges(node, release, back):
                if left and not beamed:
                    for syn, r, b, p in self.entries(node, [p for p in self.synonyms(node, "gene", None) if len(p) > 1], to):
                        names = set(p[1:-1])
                        if not names & seen:
                            walk(syn, r, b, True, left - 1, hist + [f"{x}~{y}" for x, y in zip(p, p[1:])], seen | names)
                if key in hist:
                    continue
                if (at <= to) if back else (at >= to):
                    if not node.endswith((".Void", ".Retired")):
                        out.add((node, ";".join(hist)))
                elif loop:
                    if until is None:
                        out.add((node, ";".join(hist)))
                    elif (until <= to) if back else (until >= to):
                        out.add((node, ";".join([*hist, key])))
                    else:
                        hist.append(key)
                else:
                    walk(far, at, back, False, left, [*hist, key], seen)

        if self.kind[start] == "gene":
            walk(start, release, back, False, jumps, [], set())
            return out
        found = [] if any_release else self.synonyms(start, "gene", release)
        ways = [(p[-1], release, release > to, p) for p in found] or self.entries(start, self.synonyms(start, "gene", None), to)
        for syn, r, b, p in ways:
            walk(syn, r, b, True, jumps, [f"{x}~{y}" for x, y in zip(p, p[1:])], set(p[:-1]))
        return out


@pytest.mark.parametrize("seed", [1])
def test_paths_like_plain_recursion(spark, seed):
    t, g = small_graph(spark, seed)
    rng = random.Random(seed)
    nodes = sorted(n for n in g.kind if not n.endswith((".Void", ".Retired")))
    rows = [(f"{n}|{r}|{to}", n, n, g.kind[n], r, to, r > to) for n in nodes for r, to in [(rng.randint(1, 8), rng.randint(1, 8)) for _ in range(2)]]
    df = spark.createDataFrame(rows, "qid string, query_id string, node string, node_type string, release int, to_release int, reverse boolean")
    got = {}
    for r in plan.possible_paths(t, df, deeper=0, jump_limit=1).select("qid", "target", search.path_text().alias("p"), "stage").collect():
        got.setdefault(r.qid, (r.stage, set()))[1].add((r.target, r.p))
    stages = set()
    for qid, _, n, kind, r, to, back in rows:
        want = None
        for stage, (any_release, jumps) in enumerate([(False, 0), (False, 1), (True, 0), (True, 1)]):
            if not (any_release and kind == "gene") and (found := g.paths(n, r, to, back, jumps, any_release)):
                want = (stage, found)
                stages.add(stage)
                break
        assert got.get(qid) == want, qid
    assert {0, 1} <= stages


def test_synonyms_like_plain_recursion(spark):
    t, g = small_graph(spark, 5)
    rows = [(f"{n}|{r}", n, k, r) for n, k in g.kind.items() if not n.endswith((".Void", ".Retired")) for r in (None, 3, 6)]
    q = spark.createDataFrame(rows, "query_id string, node string, node_type string, release int")
    got = {}
    for r in search.synonyms(q, t.connections, "gene", ranges=t.ranges).collect():
        got.setdefault(r.query_id, set()).add(";".join([*(s.a for s in r.steps), r.target]))
    for qid, n, _, release in rows:
        assert got.get(qid, set()) == {";".join(p) for p in g.synonyms(n, "gene", release)}, qid


def variants(name):
    at = [i for i, c in enumerate(name) if c in "-_"]
    for n in range(len(at) + 1 if at else 0):
        for chosen in combinations(at, n):
            yield "".join(("_" if i in chosen else "-") if i in at else c for i, c in enumerate(name))


def plain_name(name, nodes):
    import re

    lower = {n.lower(): n for n in nodes}

    def forms(x):
        yield x in nodes and x
        yield lower.get(x.lower())
        if m := re.match(r"^(.+)(_|-|\.)[0-9]+$", x):
            yield m[1] in nodes and m[1]
            yield lower.get(m[1].lower())

    for whole in (name, SYNONYM + name):
        for x in (whole, *variants(whole)):
            for hit in forms(x):
                if hit:
                    return hit
    return None


def test_names_like_trying_every_variant(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(["a", "B", "-", "_", "1", ".2"]) for _ in range(rng.randint(1, 9)))
    nodes = {}
    for _ in range(400):
        n = rng.choice(["", "", SYNONYM]) + word()
        nodes.setdefault(n.lower(), n)
    nodes = set(nodes.values())
    queries = sorted({word() for _ in range(1500)} | {"a_B-a_B-a_B-1", "-1", "a-b_a-b_a-b_a-b_a-2"})
    nodes |= {"a-b_a-b_a-b_a_b-a"}
    got = {r["query"]: r.node for r in search.resolve(spark.createDataFrame([(q,) for q in queries], "q string"), spark.createDataFrame([(n,) for n in nodes], "n string")).collect()}
    assert got == {q: plain_name(q, nodes) for q in queries} and sum(v is not None for v in got.values()) > 100
    assert got["a-b_a-b_a-b_a-b_a-2"] == "a-b_a-b_a-b_a_b-a"


def test_long_histories_are_walked_to_their_end(spark):
    n = 68
    edges = [(f"A.{i}", f"A.{i + 1}", i, i + 1, None, "version") for i in range(1, n)] + [(f"A.{n}", f"A.{n}", n, None, 1.0, "open")]
    e = spark.createDataFrame(edges, "src string, dst string, old_release int, new_release int, weight double, kind string")
    got = search.walk(spark.createDataFrame([("q", "A.1", 1, n, False)], "query_id string, node string, release int, to_release int, reverse boolean"), e).select("target", F.size("path").alias("n")).collect()
    assert [tuple(r) for r in got] == [(f"A.{n}", n - 1)]


def test_reductions(spark):
    step = "struct<a: string, b: string, key: string, release: int, w: double, pri: array<int>>"
    d = spark.sql(f"select from_json('[{{\"key\":\"x\",\"w\":0.5}},{{\"key\":\"y\"}},{{\"key\":\"z\",\"w\":0.7}},{{\"release\":3}}]', 'array<{step}>') path")
    get = lambda *a: round(d.select(search.path_score("path", *a).alias("s")).first().s, 6)
    assert [get("mean"), get("mean", "to_1"), get("mean", "to_0"), get("sum"), get("min"), get("max", "to_1")] == [0.6, 0.733333, 0.4, 1.2, 0.5, 1.0]
    with pytest.raises(ValueError):
        search.path_score("path", "mode")

"""Bounded search: names, synonyms, walks through history. Batches of queries move together, one join a step.

A path is an array of steps (a, b, key, release, w, pri): a step of history has its edge's key and weight, a step through
names has no key, its release (NULL for any) and the priorities of the assemblies that make it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ids import SENTINEL, SYNONYM, separators_unified, split_id, variant_order, without_suffix
from ..functions.temporal import closed, contains, entry_points, opened
from ..schema import PRIORITY
from ..session import cut

STEP = "struct<a: string, b: string, key: string, release: int, w: double, pri: array<int>>"
#: Names that may be walked through either way where the search is shallow.
BOTH_WAYS = ("external", "base")


def resolve(queries: DataFrame, names: DataFrame) -> DataFrame:
    """(query, node, was_modified): tried in order are the name itself, its lower case, the name without its trailing
    number, that in lower case; then the same four of every - and _ variant; then all of it behind the synonym prefix. The
    first hit wins, queries without one have node NULL. No variant is enumerated: names meet on their lower case with one
    separator for both, and a hit's own separators say which variant it is, so names of any length cost the same."""
    q = queries.toDF("query").distinct()
    own = F.array(*[F.struct(F.lit(i).alias("prefixed"), x.alias("name")) for i, x in enumerate((F.col("query"), F.concat(F.lit(SYNONYM), "query")))])
    d = q.select("query", F.explode(own).alias("o")).select("query", "o.*")
    forms = F.array(*[F.struct(F.lit(i).alias("cut"), x.alias("form")) for i, x in enumerate((F.col("name"), without_suffix(F.col("name"))))])
    d = d.select("query", "prefixed", "name", F.explode(forms).alias("f")).select("query", "prefixed", "name", "f.*").filter("form is not null")
    key = lambda c: F.lower(separators_unified(F.col(c)))
    n = names.toDF("node").distinct()
    hit = d.join(n, key("form") == key("node"))
    plain = F.lower("form") == F.lower("node")
    exact = F.when(plain, F.col("form") == F.col("node")).otherwise(separators_unified(F.col("form")) == separators_unified(F.col("node")))
    # The separator before a number that was cut off may be either: - is tried first.
    few, place = variant_order(F.concat("node", F.when((F.col("cut") == 1) & F.substring("name", F.length("form") + 1, F.lit(1)).isin("-", "_"), "-").otherwise("")))
    order = [F.col("prefixed"), (~plain).cast("int"), F.when(plain, 0).otherwise(few), F.when(plain, "").otherwise(place), F.col("cut") * 2 + (~exact).cast("int"), F.col("node")]
    hit = hit.select("query", F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)]).alias("k"))
    best = hit.groupBy("query").agg(F.min("k").alias("k")).select("query", F.col("k.k5").alias("node"))
    return q.join(best, "query", "left").select("query", "node", (F.col("node") != F.col("query")).alias("was_modified"))


def _step(a, b, key=None, release=None, w=None, pri=None) -> Column:
    null = lambda x, t: F.lit(None).cast(t) if x is None else x
    return F.struct(a.alias("a"), b.alias("b"), null(key, "string").alias("key"), null(release, "int").alias("release"), null(w, "double").alias("w"), null(pri, "array<int>").alias("pri"))


def two_way(edges: DataFrame) -> DataFrame:
    """History as it is walked: (node, reverse, far, at, until, weight, key); an open loop leads forwards only."""
    key = F.concat("src", F.lit(">"), "dst", F.lit("@"), F.col("old_release").cast("string"), F.lit("-"), F.coalesce(F.col("new_release").cast("string"), F.lit("")))
    e = edges.withColumn("key", key)
    ahead = e.select(F.col("src").alias("node"), F.lit(False).alias("reverse"), F.col("dst").alias("far"), F.col("old_release").alias("at"), F.col("new_release").alias("until"), "weight", "key", "kind")
    back = e.filter("new_release is not null").select(F.col("dst").alias("node"), F.lit(True).alias("reverse"), F.col("src").alias("far"), F.col("new_release").alias("at"), F.col("old_release").alias("until"), "weight", "key", "kind")
    return ahead.unionByName(back)


def next_edges(states: DataFrame, edges: DataFrame, by: list[str] | None = None) -> DataFrame:
    """states (…, node, release, reverse) beside the edges of two_way() that they may take next: later ones forwards (an
    open loop too), earlier ones backwards; of those that stay on the same id only the first in time. Adds is_loop: a
    loop at a time when no other edge leaves. `by` names columns that tell states apart (all, if it is not given)."""
    j = states.join(edges, ["node", "reverse"])
    ok = F.when(F.col("reverse"), F.col("at") <= F.col("release")).otherwise((F.col("at") >= F.col("release")) | F.col("until").isNull())
    j = j.filter(ok)
    by = by or states.columns
    stays = (split_id(F.col("far"))[0] == split_id(F.col("node"))[0]) & (F.col("far") != F.col("node"))
    soon = F.when(F.col("reverse"), -F.col("at")).otherwise(F.col("at"))
    by = [*dict.fromkeys(["node", "reverse", *by])]  # as the join has dealt them: no shuffle
    w = W.partitionBy(*by, stays).orderBy(soon)
    j = j.withColumn("__m", stays).withColumn("__r", F.rank().over(w)).filter("not __m or __r = 1").drop("__m", "__r")
    alone = F.count("*").over(W.partitionBy(*by, "at")) == 1
    return j.withColumn("is_loop", (F.col("far") == F.col("node")) & alone)


def walk(starts: DataFrame, edges: DataFrame, jump: Callable[[DataFrame], DataFrame] | None = None, jump_limit: int = 2) -> DataFrame:
    """(query_id, target, path) of every way through history from node, at release, to what lives at to_release.

    starts: (query_id, node, release, to_release, reverse) and optionally path (steps taken before). An edge is used once
    a path. A loop alone at its time is passed in place: the edges after it have it behind them. A node is reached where
    an edge leaves it at or beyond to_release, or a loop spans or ends it. jump, if given, takes (node, to_release) and
    gives entries (node, to_release, entry, release, reverse, steps, via): a path may leave its node for an entry up to
    jump_limit times, not twice in a row, and never through a name twice. Each step is a table, of which the next one's
    states are read; the walk ends when no state is left, as edges are used once and jumps are few."""
    add = {"path": f"array<{STEP}>", "via": "array<string>"}
    state = starts.select("query_id", "node", F.col("release").cast("int").alias("release"), F.col("to_release").cast("int").alias("to_release"), "reverse", *[F.col(c) if c in starts.columns else F.array().cast(t).alias(c) for c, t in add.items()])
    state = cut(state.withColumns({"jumps": F.lit(0), "beamed": F.col("path").isNotNull() & (F.size("path") > 0), "sid": F.monotonically_increasing_id()}), "starts")
    hashed = two_way(cut(edges, "edges")).repartition("node", "reverse").persist(StorageLevel.DISK_ONLY)  # shuffled once
    out = None
    try:
        while not state.isEmpty():
            nxt = next_edges(state, hashed, ["sid"])
            used = F.exists("path", lambda x: x["key"].eqNullSafe(F.col("key")))
            reached = F.when(F.col("reverse"), F.col("at") <= F.col("to_release")).otherwise(F.col("at") >= F.col("to_release"))
            spans = F.when(F.col("reverse"), F.col("until") <= F.col("to_release")).otherwise(F.col("until") >= F.col("to_release"))
            nxt = nxt.withColumns({"used": used, "reached": reached, "spans": spans, "own": _step(F.col("node"), F.col("far"), F.col("key"), w=F.col("weight"), pri=F.array(F.lit(1)))})
            passed = F.col("is_loop") & ~F.col("used") & ~F.col("reached") & F.col("until").isNotNull() & ~F.col("spans")
            turn = lambda c: F.when(F.col("reverse"), -c).otherwise(c)
            order = W.partitionBy("node", "reverse", "sid").orderBy(turn(F.col("at")), turn(F.col("is_loop").cast("int")), "far", "key").rowsBetween(W.unboundedPreceding, -1)
            nxt = nxt.withColumn("path", F.concat("path", F.collect_list(F.when(passed, F.col("own"))).over(order)))
            every = cut(nxt.drop("sid", "release", "weight", "kind"), "frontier")
            nxt = every.filter("not used")
            sentinel = F.col("node").rlike(SENTINEL)
            here = nxt.filter(F.col("reached") & ~sentinel | ~F.col("reached") & F.col("is_loop") & F.col("until").isNull()).select("query_id", F.col("node").alias("target"), "path")
            loop = nxt.filter("not reached and is_loop and spans").select("query_id", F.col("node").alias("target"), F.concat("path", F.array("own")).alias("path"))
            done = here.unionByName(loop).distinct()
            out = done if out is None else out.unionByName(done)
            go = nxt.filter("not reached and not is_loop").select("query_id", F.col("far").alias("node"), F.col("at").alias("release"), "to_release", "reverse", F.concat("path", F.array("own")).alias("path"), "via", "jumps", F.lit(False).alias("beamed"))
            if jump is not None:
                leave = every.filter(f"not beamed and jumps < {jump_limit}").select("query_id", "node", "to_release", "path", "via", "jumps").distinct()
                entered = jump(leave.select("node", "to_release").distinct()).withColumnRenamed("via", "names")
                gone = leave.join(entered, ["node", "to_release"]).filter(~F.arrays_overlap("names", "via"))
                go = go.unionByName(gone.select("query_id", F.col("entry").alias("node"), "release", "to_release", "reverse", F.concat("path", "steps").alias("path"), F.concat("via", "names").alias("via"), (F.col("jumps") + 1).alias("jumps"), F.lit(True).alias("beamed")))
            # Without jumps a state is known by its path and its start; what two starts share is made distinct at the end.
            state = go if jump is None else cut(go.distinct(), "state")
            state = state.withColumn("sid", F.monotonically_increasing_id())
    finally:
        hashed.unpersist()
    if out is None:
        out = state.select("query_id", F.col("node").alias("target"), "path")
    return out.distinct()


def path_text(path: str | Column = "path") -> Column:
    """A path of history as text: its edges' keys; steps through names as a~b."""
    p = F.col(path) if isinstance(path, str) else path
    return F.array_join(F.transform(p, lambda x: F.coalesce(x["key"], F.concat(x["a"], F.lit("~"), x["b"]))), ";")


def path_score(path: str = "path", reduction: str = "mean", remove_na: str = "omit", empty: float | None = None) -> Column:
    """The edges' weights reduced to one number (mean, sum, min, max): unknown ones are left out, or count as 1 or 0
    (to_1, to_0). A path without an edge has the score `empty`."""
    w = F.transform(F.filter(path, lambda x: x["key"].isNotNull()), lambda x: x["w"])
    w = F.when(F.size(w) == 0, F.array(F.lit(empty).cast("double"))).otherwise(w)
    if remove_na == "omit":
        w = F.filter(w, lambda x: x.isNotNull())
    elif remove_na in ("to_1", "to_0"):
        w = F.transform(w, lambda x: F.coalesce(x, F.lit(float(remove_na[-1]))))
    else:
        raise ValueError(f"remove_na: {remove_na}")
    total = F.aggregate(w, F.lit(0.0), lambda acc, x: acc + x)
    made = {"mean": lambda: total / F.size(w), "sum": lambda: total, "min": lambda: F.array_min(w), "max": lambda: F.array_max(w)}
    if reduction not in made:
        raise ValueError(f"reduction: {reduction}")
    return F.when(F.size(w) > 0, made[reduction]())


#: Types that forms' own connections join.
_FORM_ENDS = {"form_gene": ("transcript", "gene"), "form_transcript": ("translation", "transcript"), "base": ("base", "gene")}


def _kinds(conn: DataFrame) -> tuple[Column, Column]:
    """Types of src and dst."""
    end = lambda i, other: F.coalesce(*[F.when(F.col("db") == k, v[i]) for k, v in _FORM_ENDS.items()], F.lit(other))
    to = F.col("dst_form") if "dst_form" in conn.columns else F.lit("gene")
    return end(0, "external"), F.when(F.col("db").isin(*_FORM_ENDS), end(1, "gene")).otherwise(to)


def typed_once(conn: DataFrame) -> DataFrame:
    """typed() in the way in which connections were made."""
    a, b = _kinds(conn)
    one = conn.select("src", "dst", a.alias("src_type"), b.alias("dst_type"), F.struct("db", "assembly", "release").alias("f"))
    return one.groupBy("src", "dst", "src_type", "dst_type").agg(F.collect_set("f").alias("facts"), F.lit(True).alias("up"))


def _turned(one: DataFrame) -> DataFrame:
    return one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("dst_type").alias("src_type"), F.col("src_type").alias("dst_type"), "facts", F.lit(False).alias("up"))


def typed(conn: DataFrame) -> DataFrame:
    """Connections both ways, once for each pair: (src, dst, up, src_type, dst_type, facts); up is the way in which they
    were made, facts are their (db, assembly, release)."""
    one = typed_once(conn)
    return one.unionByName(_turned(one))


class Ways:
    """Sequences of types by which a search may get from a start to `wanted`, by the rules of _expand(); joined: the pairs
    of types (as made, lower form first) that connections have. Of more than `most` sequences nothing is said."""

    def __init__(self, starts: list[str], wanted: str, depths: tuple[int, ...], joined: set[tuple[str, str]], shallow: bool, most: int = 5000):
        self.steps = {(a, b) for a, b in joined if not shallow or a in BOTH_WAYS} | {(b, a) for a, b in joined}
        self.useful: set[tuple[str, ...]] = set()
        self.alone: set[tuple[str, ...]] = set()  # useful also if the last node has no other neighbour of the type before it
        self.many = False

        def go(seq: tuple[str, ...], depth: int) -> bool:
            ways = set()
            if max(seq.count(t) for t in seq) < depth:
                for t in sorted({b for a, b in self.steps if a == seq[-1] and b != a}):
                    again = seq.count(t) + 1
                    if (t == wanted or again < depth) and not self.many and go((*seq, t), depth):
                        ways.add(t)
            self.many = self.many or len(self.useful) > most
            good = seq[-1] == wanted or bool(ways)
            if good:
                self.useful.add(seq)
            if seq[-1] == wanted or len(seq) > 1 and ways - {seq[-2]}:
                self.alone.add(seq)
            return good

        for s in starts:
            for d in depths:
                go((s,), d)

    def pairs(self) -> set[tuple[str, str]]:
        return self.steps if self.many else {p for s in self.useful for p in zip(s, s[1:])}

    def pairs_alone(self) -> set[tuple[str, str]]:
        """Steps from a node with one neighbour only of the other's type that are useful."""
        if self.many:
            return self.steps
        return {(a, b) for s in self.useful for i, (a, b) in enumerate(zip(s, s[1:])) if not i or s[i - 1] != b}

    def last_only(self, kind: str) -> bool:
        return not self.many and not any(kind in s[1:-1] for s in self.useful)


def _has(pairs: set[tuple[str, str]]) -> Column:
    return F.concat_ws(">", "src_type", "dst_type").isin(sorted(f"{a}>{b}" for a, b in pairs))


def _once(conn: DataFrame, state: DataFrame) -> DataFrame:
    """typed_once() of the facts of the queries' own releases, if all have one."""
    at = [r[0] for r in state.select("release").distinct().limit(1001).collect()]
    if None not in at and len(at) <= 1000:
        conn = conn.filter(F.col("release").isin(at))
    return cut(typed_once(conn), "typed")


def _mixed(one: DataFrame, state: DataFrame) -> bool:
    """Does any node have several types, as connections and queries say?"""
    end = lambda c, t: F.struct(F.col(c).alias("node"), F.col(t).alias("t"))
    ends = one.select(F.explode(F.array(end("src", "src_type"), end("dst", "dst_type"))).alias("e")).select("e.*").unionByName(state.select("node", F.col("node_type").alias("t")))
    rank = F.hash("t")  # fewer bytes than names of types; two types of one hash would be an equal rank
    if len({r[0] for r in ends.select(rank).distinct().collect()}) < ends.select("t").distinct().count():
        return True
    return not ends.select("node", rank.alias("h")).groupBy("node").agg(F.min("h").alias("a"), F.max("h").alias("b")).filter("a <> b").isEmpty()


def _edges_for(conn: DataFrame, one: DataFrame, ways: Ways, hub: int | None, wanted: str, wanted_db: str | None, starts: list[str]) -> DataFrame:
    """What of typed(conn) the search may use: pairs of types that lead to what is wanted, and names of wanted_db, where a
    name ends the way. A form that belongs to one id only leads to no other id, as ways never turn back to another
    version of the same."""
    many = None
    if hub is not None:
        a, b = _kinds(conn)
        many = cut(conn.select("src", "dst", a.alias("a"), b.alias("b")).distinct().groupBy("src").count().filter(F.col("count") > hub).select(F.col("src").alias("dst")), "hubs")
    pairs, own = ways.pairs(), set()
    if wanted_db is not None and wanted in starts:  # a start that is wanted itself has the facts of its own connections
        own = {(a, b) for a, b in ways.steps if a == wanted}
    used = pairs | own
    if ways.many:
        e = one.unionByName(_turned(one))
        return e if many is None else cut(e.join(many, "dst", "left_anti").select(*e.columns), "typed")
    form = F.col("src_type") != "external"
    turned = _turned(one)
    if wanted_db is not None and wanted == "external" and ways.last_only("external"):
        turned = turned.filter((F.col("dst_type") != "external") | F.exists("facts", lambda f: f["db"] == wanted_db))
    e = one.filter(~form).unionByName(turned.filter(F.col("dst_type") == "external")).filter(_has(used))
    forms = one.filter(form)
    if {x for p in used for x in p} <= {"external", "gene"}:  # no form is passed
        forms = None
    else:
        ids = forms.groupBy("src", "dst_type").agg(F.min(split_id(F.col("dst"))[0]).alias("__a"), F.max(split_id(F.col("dst"))[0]).alias("__b"))
        ids = ids.filter(F.col("__a") != F.col("__b")).select("src", "dst_type").withColumn("__many", F.lit(True))
        # Names and bases may be gone back to another of: only the same node is barred.
        forms = forms.join(ids, ["src", "dst_type"], "left").withColumn("lone", F.col("__many").isNull() & ~F.col("dst_type").isin(*BOTH_WAYS)).drop("__many")
        up = forms.filter(_has(used) & (~F.col("lone") | _has(ways.pairs_alone() | own)))
        down = forms.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("dst_type").alias("src_type"), F.col("src_type").alias("dst_type"), "facts", F.lit(False).alias("up"), "lone")
        down = down.filter(_has(pairs) & (~F.col("lone") | _has({s[-2:] for s in ways.alone if len(s) > 1})))
        forms = up.drop("lone").unionByName(down.drop("lone"))
    if forms is not None:
        e = e.unionByName(cut(forms.select(*e.columns), "forms"))
    return e if many is None else cut(e.join(many, "dst", "left_anti").select(*e.columns), "typed")


def _priorities(facts) -> Column:
    of = F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])
    return F.array_sort(F.array_distinct(F.transform(facts, lambda f: of[f["assembly"]])))


def _expand(state: DataFrame, e: DataFrame, wanted: str, wanted_db: str | None, depth: int, shallow: bool, ways: Ways) -> DataFrame:
    """(query_id, release, target, distance, steps, last): all paths to wanted nodes; last is its last step's facts."""
    after = None if ways.many else sorted(",".join(s) for s in ways.useful)
    level = 1
    out = None
    while True:
        hit = F.col("node_type") == wanted
        if wanted_db is not None:
            hit = hit & F.exists("last", lambda f: f["db"] == wanted_db)
        found = state.filter(hit).select("query_id", "release", F.col("node").alias("target"), F.size("steps").alias("distance"), "steps", "last")
        out = found if out is None else out.unionByName(found)
        most = F.array_max(F.transform("types", lambda t: F.size(F.filter("types", lambda u: u == t))))
        level += 1
        longer = {x[level - 2 : level] for x in ways.useful if len(x) >= level}
        if not ways.many and not longer:
            return out
        near = e if ways.many else e.filter(_has(longer))
        j = state.filter(most < depth).join(near, state["node"] == near["src"])
        if shallow:
            j = j.filter(~F.col("up") | F.col("src_type").isin(*BOTH_WAYS))
        j = j.withColumn("now", F.filter("facts", lambda f: F.col("release").isNull() | (f["release"] == F.col("release")))).filter(F.size("now") > 0)
        two_back, back_type = F.try_element_at("path", F.lit(-2)), F.try_element_at("types", F.lit(-2))
        bounce = (back_type == F.col("dst_type")) & ~F.col("dst_type").isin(*BOTH_WAYS) & (split_id(two_back)[0] == split_id(F.col("dst"))[0])
        j = j.filter((F.col("dst_type") != F.col("src_type")) & ~F.array_contains("path", F.col("dst")) & ~F.coalesce(bounce, F.lit(False)))
        step = _step(F.col("src"), F.col("dst"), release=F.col("release"), pri=_priorities(F.col("now")))
        # What can neither be wanted nor go on is not kept.
        again = F.size(F.filter("types", lambda t: t == F.col("dst_type"))) + 1
        j = j.filter((F.col("dst_type") == wanted) | ((again < depth) & (most < depth)))
        if after is not None:
            j = j.filter(F.concat_ws(",", "types", "dst_type").isin(after))
        state = j.select("query_id", "release", F.col("dst").alias("node"), F.col("dst_type").alias("node_type"), F.concat("path", F.array("dst")).alias("path"), F.concat("types", F.array("dst_type")).alias("types"), F.concat("steps", F.array(step)).alias("steps"), F.col("now").alias("last"))
        state = cut(state, "synonyms")
        if state.isEmpty():
            return out


def synonyms(queries: DataFrame, conn: DataFrame, wanted: str, depth: int = 2, hub: int | None = None, wanted_db: str | None = None, shallow: bool = False, ranges: DataFrame | None = None) -> DataFrame:
    """(query_id, target, distance, steps, last): the shortest ways to each node of type `wanted` (externals: whose last
    step is in `wanted_db`), all ties. queries: (query_id, node, node_type, release or NULL for any). A path expands
    while no type is in it `depth` times, never through a node twice, to the same type, back to another version of the
    id that it came from, into a hub (a name with more than `hub` neighbours), or by a step that the release lacks;
    shallow: only away from genes, but for externals and bases. First with a depth of 2; queries that find nothing then
    search to `depth`. With ranges (node, start, end), genes count while they live at the release. conn are connections as
    they are, of which just those that can lead to `wanted` are typed."""
    state = queries.select("query_id", F.col("release").cast("int").alias("release"), "node", "node_type", F.array("node").alias("path"), F.array("node_type").alias("types"), F.array().cast(f"array<{STEP}>").alias("steps"))
    fact = "array<struct<db: string, assembly: int, release: int>>"
    state = cut(state.withColumn("last", F.lit(None).cast(fact)), "synonyms")
    starts = sorted(r[0] for r in state.select("node_type").distinct().collect())  # a row a type
    joined = {*_FORM_ENDS.values(), ("external", "gene")}
    if "dst_form" in conn.columns:
        joined |= {("external", r[0]) for r in conn.select("dst_form").distinct().collect() if r[0] is not None}  # a row a form
    ways = {d: Ways(starts, wanted, (d,), joined, shallow) for d in {min(depth, 2), depth}}
    every = Ways(starts, wanted, tuple(ways), joined, shallow)
    one = _once(conn, state)
    if _mixed(one, state):  # then nothing can be told from types
        for w in (every, *ways.values()):
            w.many = True
    e = _edges_for(conn, one, every, hub, wanted, wanted_db, starts)
    if wanted_db is not None and (wanted in starts or every.many):  # a node that begins as external has the facts of all its connections
        own = e.filter("up").groupBy("src").agg(F.flatten(F.collect_list("facts")).alias("last"))
        state = state.drop("last").join(own.withColumnRenamed("src", "node"), "node", "left").withColumn("last", F.filter("last", lambda f: F.col("release").isNull() | (f["release"] == F.col("release"))))
        state = cut(state, "synonyms")

    def pass_(state: DataFrame, depth: int) -> DataFrame:
        found = _expand(state, e, wanted, wanted_db, depth, shallow, ways[depth])
        if ranges is not None and wanted == "gene":
            alive = found.filter("release is not null").join(ranges.select(F.col("node").alias("target"), "start", "end"), "target").filter(contains(F.col("start"), F.col("end"), F.col("release")))
            found = alive.select(*found.columns).unionByName(found.filter("release is null"))
        return found

    found = cut(pass_(state, 2 if depth > 2 else depth), "found")
    if depth > 2:
        rest = state.join(found.select("query_id").distinct(), "query_id", "left_anti")
        if not rest.isEmpty():
            found = found.unionByName(pass_(rest, depth))
    w = W.partitionBy("query_id", "target").orderBy("distance")
    return found.withColumn("__r", F.rank().over(w)).filter("__r = 1").select("query_id", "target", "distance", "steps", "last").distinct()


def relaxed(queries: DataFrame, conn: DataFrame, wanted: str, depth: int = 2, hub: int | None = None, **more) -> DataFrame:
    """synonyms() at each query's release (stage 0), and at any release (1) for queries that find none."""
    strict = cut(synonyms(queries, conn, wanted, depth, hub, **more).withColumn("stage", F.lit(0)), "strict")
    rest = queries.join(strict.select("query_id").distinct(), "query_id", "left_anti").withColumn("release", F.lit(None).cast("int"))
    return strict.unionByName(synonyms(rest, conn, wanted, depth, hub, **more).withColumn("stage", F.lit(1)))


def nearest(found: DataFrame, key: str = "query_id") -> DataFrame:
    """All of the least distance."""
    return found.withColumn("__r", F.rank().over(W.partitionBy(key).orderBy("distance"))).filter("__r = 1").drop("__r")


def entries(found: DataFrame, ranges: DataFrame, backbone: bool) -> DataFrame:
    """Where walks towards to_release begin on synonyms: found (query_id, node, to_release, target, steps) of any release
    gives (query_id, entry, release, reverse, steps), for each gene id what lies nearest to to_release.

    backbone: node is a gene itself. Then releases at which both live are preferred; an id without any is entered where
    it lies nearest to the node's own end that is nearest to to_release."""
    r = ranges.select(F.col("node").alias("target"), "start", "end")
    key = ["query_id", "node", "to_release", "target"]
    base = found.select(*key).distinct().withColumn("gene", split_id(F.col("target"))[0])
    if backbone:
        own = ranges.select("node", F.col("start").alias("s0"), F.col("end").alias("e0"))
        both = base.join(r, "target").join(own, "node").filter((F.col("start") <= closed(F.col("e0"))) & (F.col("s0") <= closed(F.col("end"))))
        both = both.withColumns({"start": F.greatest("start", "s0"), "end": opened(F.least(closed(F.col("end")), closed(F.col("e0"))))}).drop("s0", "e0")
        first = entry_points(both, "to_release").withColumn("distance", F.abs(F.col("entry") - F.col("to_release")))
        apart = base.join(first.select("query_id", "gene").distinct(), ["query_id", "gene"], "left_anti")
        ends = apart.select("query_id", "node", "to_release").distinct().join(own, "node").groupBy("query_id", "node", "to_release").agg(
            F.max(contains(F.col("s0"), F.col("e0"), F.col("to_release"))).alias("alive"), F.collect_set("s0").alias("s"), F.collect_set(closed(F.col("e0"))).alias("e"))
        far = F.array_union("s", "e")
        least = F.array_min(F.transform(far, lambda x: F.abs(x - F.col("to_release"))))
        points = F.when(F.col("alive"), F.array("to_release")).otherwise(F.filter(far, lambda x: F.abs(x - F.col("to_release")) == least))
        ends = ends.select("query_id", "node", "to_release", F.explode(points).alias("point"))
        second = entry_points(apart.join(ends, ["query_id", "node", "to_release"]).join(r, "target"), "point")
        second = second.withColumns({"distance": F.abs(F.col("entry") - F.col("point")), "reverse": F.col("to_release") <= F.col("entry")}).drop("point")
        all_ = first.unionByName(second)
    else:
        all_ = entry_points(base.join(r, "target"), "to_release").withColumn("distance", F.abs(F.col("entry") - F.col("to_release")))
    best = all_.withColumn("__r", F.rank().over(W.partitionBy("query_id", "gene").orderBy("distance"))).filter("__r = 1").select(*key, F.col("entry").alias("release"), "reverse").distinct()
    return found.join(best, key).select("query_id", "node", "to_release", F.col("target").alias("entry"), "release", "reverse", "steps")


def names_of(steps: str = "steps", types: str | None = None) -> Column:
    """What a way through names passes that is not its own ends: no name may be passed twice."""
    inner = F.transform(F.slice(steps, 2, F.greatest(F.size(steps) - 1, F.lit(0))), lambda x: x["a"])
    return F.array_distinct(inner)


def jumper(conn: DataFrame, ranges: DataFrame, depth: int = 2, hub: int | None = None) -> Callable[[DataFrame], DataFrame]:
    """The jump that walk() takes: from a gene through other names to other genes."""
    def jump(nodes: DataFrame) -> DataFrame:
        q = nodes.withColumn("query_id", F.concat_ws("|", "node", F.col("to_release").cast("string")))
        found = synonyms(q.select("query_id", "node", F.lit("gene").alias("node_type"), F.lit(None).cast("int").alias("release")), conn, "gene", depth, hub)
        found = cut(found.filter("distance > 0").join(q, "query_id").select("query_id", "node", "to_release", "target", "steps"), "jumps")
        return entries(found, ranges, backbone=True).withColumn("via", names_of()).drop("query_id")

    return jump


def jump_fold(steps: str, start: str | None = None) -> Column:
    """(jumps, cur) of an array of arrays of priorities, one a step; the last step is left to the final hop. cur begins
    as the largest of the first step (or as column `start`), and sinks to the largest priority <= cur of each step; a
    step without one costs a jump to its least."""
    s = F.col(steps)
    first = F.array_max(F.get(s, F.lit(0))) if start is None else F.col(start)

    def step(acc, own):
        cur = F.least(acc["cur"], F.array_max(own))
        jump = cur < F.array_min(own)
        below = F.array_max(F.filter(own, lambda x: x <= cur))
        return F.struct((acc["jumps"] + jump.cast("int")).alias("jumps"), F.when(jump, F.array_min(own)).otherwise(below).alias("cur"))

    return F.aggregate(F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))), F.struct(F.lit(0).alias("jumps"), first.alias("cur")), step)


def scored(paths: DataFrame, genes: DataFrame, reduction: str = "mean", remove_na: str = "omit", empty: float | None = None) -> DataFrame:
    """paths (query_id, target, path) with assembly_jump, external_jump, external_step, score, steps, last_pri and cur.
    genes: (node, pri: the priorities of all assemblies of a gene), for paths without a step."""
    through = F.col("path.key")
    ext = F.size(F.filter(through, lambda k: k.isNull()))
    runs = F.size(F.filter(F.sequence(F.lit(0), F.greatest(F.size("path") - 1, F.lit(0))), lambda i: F.get(through, i).isNull() & ((i == 0) | F.get(through, i - 1).isNotNull())))
    p = paths.withColumns({"external_step": F.when(F.size("path") > 0, ext).otherwise(0), "external_jump": F.when(F.size("path") > 0, runs).otherwise(0), "score": path_score("path", reduction, remove_na, empty)})
    p = p.withColumn("steps", F.size("path") - F.col("external_step"))
    p = p.join(genes.select(F.col("node").alias("target"), F.col("pri").alias("__all")), "target", "left")
    pri = F.when(F.size("path") > 0, F.col("path.pri")).otherwise(F.array(F.coalesce("__all", F.array(F.lit(1)))))
    p = p.withColumn("__pri", pri).withColumn("__fold", jump_fold("__pri"))
    return p.withColumns({"assembly_jump": F.col("__fold.jumps"), "cur": F.col("__fold.cur"), "last_pri": F.element_at("__pri", -1)}).drop("__pri", "__fold", "__all")


def best_per_target(paths: DataFrame) -> DataFrame:
    """One path for each (query_id, target): least assembly jumps, external jumps and steps, best score (unknown last),
    fewest steps, then by path."""
    text = path_text() if paths.schema["path"].dataType.typeName() == "array" else F.col("path")
    w = W.partitionBy("query_id", "target").orderBy("assembly_jump", "external_jump", "external_step", F.col("score").desc_nulls_last(), "steps", text)
    return paths.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


#: Columns by which targets are ranked, the most important first; all are better when smaller.
TARGET_KEYS = ["confidence", "final_min_pri", "assembly_jump", "external_jump", "min_pri", "neg_pri", "neg_final_pri"]


def choose_targets(best: DataFrame) -> DataFrame:
    """Of a query's (target, final) those of the least keys, all ties; of these the query's own name, if it is a final."""
    w = W.partitionBy("query_id").orderBy(*TARGET_KEYS)
    d = best.withColumn("__r", F.rank().over(w)).filter("__r = 1").drop("__r")
    own = F.col("final") == F.col("node")
    return d.withColumn("__any", F.max(own).over(W.partitionBy("query_id"))).filter(own | ~F.col("__any")).drop("__any")


def alive(ranges: DataFrame, queries: DataFrame) -> DataFrame:
    """Queries whose node lives at their from_release."""
    r = ranges.select("node", "start", "end")
    return queries.join(r, "node").filter((F.col("start") <= F.col("from_release")) & (F.col("from_release") <= closed(F.col("end")))).select(*queries.columns).distinct()

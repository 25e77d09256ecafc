"""Embedding near-dedup: collision-counting projections.

A table has m random projections; a vector enters the sorted list of the one in which it is most extreme (and of its
sign), at its value there. Two vectors collide in a table if they are in one list and within a window, centred at each
query, of each other. A pair is verified if it collides in at least `LEAST` of the T tables; T is calibrated so that a
pair exactly at the threshold passes with probability `recall`, closer ones with more: for a pair of cosine c the
projections are normal with correlation c whatever the dimension, so the chance of a collision is measured once by
simulation. Lists are many because one list of all cannot do this in less than quadratic work: a window that holds a
pair at cosine 0.95 holds random pairs nearly as often. m grows with the input, so that a list stays near `ROWS`; from
`MOST` projections on a list is named by the extremes of two sets.

With a vector travel its lists and places in all tables, two to five bytes each, and its components in sixteen bits. So a task
counts a pair's collisions in all tables by itself, and the pair is handled in the first table where it collides: no
list of pairs is emitted. A task screens windows by single-precision products and counts collisions for what
remains. Sixteen bits bound the cosine to about 0.0001; pairs that they leave undecided, few at any size of a group, are
fetched and decided on the whole vectors in double precision. Tasks give each vector's number of links and a spanning
forest. Equal vectors are one class with a weight. Lists that are too large go to tasks as pairs of blocks.

Vectors of different lengths never link. Null, empty, zero and non-finite vectors and those with a null vec_id link with
nothing; every row counts as a vector, also rows of one vec_id, whose links are not shared. An empty table gives an empty
one. Extra columns, whatever their names, change nothing.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, groups, hash_blocks, local_forest, materialise, scratch, ship

ROWS, MOST, LEAST, BLOCK = 1000, 1024, 2, 4096
#: Half of a window in deviations of what a pair at the threshold differs by; steps of a place, up to the value 6.
WINDOW, STEP, TOP = 2.0, 6 / 255, 255


class Plan:
    """m projections in each of `sets` sets a table, T tables, and the window in steps."""

    def __init__(self, rows: int, threshold: float, recall: float, seed: int):
        lists = max(rows, 1) / ROWS
        self.sets = 1 if lists <= 2 * MOST else 2
        self.m = max(8, 1 << round(math.log2(lists ** (1 / self.sets) / 2))) if lists > 16 else 8
        self.half = math.ceil(WINDOW * math.sqrt(2 - 2 * threshold) / STEP)
        self.seed, self.threshold = seed, threshold
        self.p = self._chance(threshold)
        self.t = LEAST
        while (1 - self.p) ** self.t + self.t * self.p * (1 - self.p) ** (self.t - 1) > 1 - recall:
            self.t += 1
        cells = (2 * self.m) ** self.sets
        self.code = "<u1" if cells <= 1 << 8 else "<u2" if cells <= 1 << 16 else "<u4"

    def _chance(self, c: float, draws: int = 40_000) -> float:
        """The chance that a pair of cosine c collides, less three deviations of its estimate."""
        rng, n, p = np.random.default_rng([self.seed, self.m]), 0, np.ones(self.sets)
        size = max(200, 4_000_000 // self.m)
        hits = np.zeros(self.sets)
        while n < draws:
            a = rng.standard_normal((size, self.m), dtype=np.float32)
            b = c * a + math.sqrt(1 - c * c) * rng.standard_normal((size, self.m), dtype=np.float32)
            (ca, va), (cb, vb) = self._extreme(a), self._extreme(b)
            hits += [((ca == cb) & (np.abs(va.astype(int) - vb) <= self.half)).sum(), (ca == cb).sum()][: self.sets]
            n += size
        p = hits / n
        return float(np.prod(p - 3 * np.sqrt(p * (1 - p) / n)))

    @staticmethod
    def _extreme(projected: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(list, place) of each row."""
        at = np.abs(projected).argmax(axis=1)
        value = projected[np.arange(len(at)), at]
        return at * 2 + (value > 0), np.minimum(np.abs(value) / STEP, TOP).astype(np.uint8)

    def places(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lists, places), of (rows, T) each."""
        n, dim = unit.shape
        lists, places = np.empty((n, self.t), self.code), np.empty((n, self.t), np.uint8)
        x = unit.astype(np.float32)
        for t in range(self.t):
            rng = np.random.default_rng([self.seed, dim, t])
            cell, place = self._extreme(x @ rng.standard_normal((dim, self.m), dtype=np.float32))
            if self.sets == 2:
                cell = cell * 2 * self.m + self._extreme(x @ rng.standard_normal((dim, self.m), dtype=np.float32))[0]
            lists[:, t], places[:, t] = cell, place
        return lists, places


def _unit(emb: np.ndarray) -> np.ndarray:
    x = emb.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def short(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Components as sixteen-bit multiples of a step of each vector's own, the steps, and the error's length."""
    step = np.abs(unit).max(axis=1, keepdims=True) / 32767
    q = np.rint(unit / step).astype("<i2")
    return q, step[:, 0], np.sqrt(((unit - q * step) ** 2).sum(axis=1))


def _by_dim(batches):
    """(keys, weights, unit vectors) of (__e, key, w), by length of vector."""
    for batch in batches:
        dims = np.diff(np.asarray(batch.column(0).offsets))
        values = np.asarray(batch.column(0).flatten(), dtype=np.float64)
        starts = np.cumsum(dims) - dims
        for dim in np.unique(dims):
            own = np.flatnonzero(dims == dim)
            yield int(dim), batch.column(1).take(pa.array(own)), batch.column(2).take(pa.array(own)), _unit(values[starts[own][:, None] + np.arange(dim)])


def _rows(plan: Plan):
    names = ["key", "rep", "w", "vec", "sig", "t"]

    def run(batches):
        for dim, rep, w, unit in _by_dim(batches):
            lists, places = plan.places(unit)
            q, step, error = short(unit)
            tail = np.stack([step, error], axis=1)
            vec = pa.array([a.tobytes() + b.tobytes() for a, b in zip(q, tail, strict=True)], pa.binary())
            sig = pa.array([a.tobytes() + b.tobytes() for a, b in zip(lists, places, strict=True)], pa.binary())
            for t in range(plan.t):
                key = (np.int64(dim) << 42) + (np.int64(t) << 32) + lists[:, t].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), rep, w, vec, sig, pa.array(np.full(len(rep), t), pa.int32())], names=names)

    return run


def _list_links(rep, w, vec, sig, table, block, i, j, plan: Plan, chunk: int = 512):
    """Of one list, or between its blocks i and j: each row's number of links found first in this table, a spanning
    forest of these, and pairs that sixteen bits leave undecided."""
    n, code = len(rep), np.dtype(plan.code)
    raw = np.frombuffer(b"".join(vec), np.uint8).reshape(n, -1)
    dim = (raw.shape[1] - 16) // 2
    tail = np.ascontiguousarray(raw[:, 2 * dim :]).view("<f8")
    x = np.ascontiguousarray(raw[:, : 2 * dim]).view("<i2") * tail[:, :1]
    error = tail[:, 1] * (1 + 1e-9) + 1e-13
    raw = np.frombuffer(b"".join(sig), np.uint8).reshape(n, -1)
    lists = np.ascontiguousarray(raw[:, : plan.t * code.itemsize]).view(code)
    places = raw[:, plan.t * code.itemsize :].astype(np.int16)
    order = np.argsort(places[:, table], kind="stable")
    x, error, lists, places, rep, w, block = x[order], error[order], lists[order], places[order], rep[order], w[order], block[order]
    line, low_x = places[:, table], x.astype(np.float32)
    screen = np.float32(plan.threshold - 2 * error.max() - 1e-5 - 1e-7 * dim)
    n_links, (fa, fb), open_ = np.zeros(n, np.int64), (np.zeros(0, np.int64),) * 2, []
    for low in range(0, n, chunk):
        high = min(n, low + chunk)
        stop = int(np.searchsorted(line, line[high - 1] + plan.half, side="right"))
        a, b = np.nonzero(low_x[low:high] @ low_x[low:stop].T >= screen)
        a, b = a + low, b + low
        fine = (b > a) & (line[b] - line[a] <= plan.half)
        if i != j:
            fine &= block[a] != block[b]
        a, b = a[fine], b[fine]
        for at in range(0, len(a), 1 << 17):
            u, v = a[at : at + (1 << 17)], b[at : at + (1 << 17)]
            hit = (lists[u] == lists[v]) & (np.abs(places[u] - places[v]) <= plan.half)
            mine = (hit.sum(axis=1) >= LEAST) & (hit.argmax(axis=1) == table)
            u, v = u[mine], v[mine]
            cos, off = np.einsum("ij,ij->i", x[u], x[v]), (error[u] + error[v]) * 1.001
            sure, maybe = cos - off >= plan.threshold, np.abs(cos - plan.threshold) <= off
            maybe &= ~sure
            if maybe.any():
                open_.append((rep[u[maybe]], rep[v[maybe]]))
            u, v = u[sure], v[sure]
            np.add.at(n_links, u, w[v])
            np.add.at(n_links, v, w[u])
            root = local_forest(n, np.concatenate([fa, u]), np.concatenate([fb, v]))
            fa = np.flatnonzero(root != np.arange(n))
            fb = root[fa]
    undecided = tuple(np.concatenate(z) for z in zip(*open_, strict=True)) if open_ else (rep[:0], rep[:0])
    return rep, n_links, fa, fb, undecided


def embedding_dedup(vectors: DataFrame, threshold: float = 0.95, recall: float = 0.9999, id_col: str = "vec_id", vec_col: str = "embedding", seed: int = 11) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors."""
    spark = vectors.sparkSession
    ship(spark)
    v = vectors.select(F.col(id_col).cast("long").alias("__id"), F.col(vec_col).alias("__e"))
    fine = F.forall("__e", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)) & F.exists("__e", lambda x: x != 0)
    v = v.withColumn("__ok", F.coalesce(fine & F.col("__id").isNotNull(), F.lit(False)))
    good = v.filter("__ok")
    with scratch(spark):
        # A class is named by a number of its own, fixed when it is written: rows of one id may have several vectors.
        classes = good.groupBy("__e").agg(F.min("__id").alias("least"), F.count("*").alias("w"))
        classes = materialise(classes.withColumn("rep", F.monotonically_increasing_id()), "vectors")
        plan = Plan(classes.count(), threshold, recall, seed)
        rows = classes.select("__e", "rep", "w").mapInArrow(_rows(plan), "key long, rep long, w long, vec binary, sig binary, t int")
        rows = hash_blocks(rows, "key", "rep", BLOCK)
        rows = rows.repartition("key", "__i", "__j").sortWithinPartitions("key", "__i", "__j").select("key", "__i", "__j", "rep", "w", "vec", "sig", "t", "__b")

        def verify(batches):
            for (_, i, j), (rep, w, vec, sig, table, block) in groups(batches, 3):
                rep, n, a, b, (u, v) = _list_links(rep, w, vec, sig, int(table[0]), block, i, j, plan)
                some, root = n > 0, rep.copy()
                root[a] = rep[b]
                some[a] = True
                if some.any() or len(u):  # an undecided pair has n = -1
                    columns = (np.concatenate(x) for x in ((rep[some], u), (n[some], np.full(len(u), -1)), (root[some], v)))
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["rep", "n", "root"])

        found = materialise(rows.mapInArrow(verify, "rep long, n long, root long"), "found")
        decided = materialise(_decide(found.filter("n = -1").select("rep", "root"), classes, threshold), "decided")
        both = decided.select("rep", F.col("w2").alias("n")).unionByName(decided.select(F.col("root").alias("rep"), F.col("w1").alias("n")))
        n = found.filter("n > 0").select("rep", "n").unionByName(both).groupBy("rep").agg(F.sum("n").alias("n"))
        links = found.filter("n >= 0").select("rep", "root").unionByName(decided.select("rep", "root"))
        named = classes.join(n, "rep", "left").join(components(links).toDF("rep", "root"), "rep", "left")
        named = materialise(named.select("__e", "least", F.coalesce("root", "rep").alias("root"), (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links")), "roots")
        first = named.groupBy("root").agg(F.min("least").alias("component_id"))
        named = materialise(named.join(first, "root").select("__e", "n_links", "component_id"), "named", keep=True)
    out = good.join(named, "__e").select("__id", "n_links", "component_id")
    rest = v.filter(~F.col("__ok")).select("__id", F.lit(0).cast("long").alias("n_links"), F.col("__id").alias("component_id"))
    out = out.unionByName(rest)
    return out.select(F.col("__id").alias("vec_id"), "n_links", "component_id", F.col("__id").eqNullSafe(F.col("component_id")).alias("kept"))


def _decide(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """(rep, root, w1, w2): the pairs that reach the threshold on whole vectors."""
    e = classes.select("rep", "w", "__e")
    j = pairs.join(e.toDF("rep", "w1", "__a"), "rep").join(e.toDF("root", "w2", "__b"), "root").select("rep", "root", "w1", "w2", "__a", "__b")

    def run(batches):
        for batch in batches:
            a, b = ([_unit(np.asarray([x.as_py()]))[0] for x in batch.column(i)] for i in (4, 5))
            keep = pa.array([float(np.dot(x, y)) >= threshold for x, y in zip(a, b, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays(batch.columns[:4], names=["rep", "root", "w1", "w2"]).filter(keep)

    return j.mapInArrow(run, "rep long, root long, w1 long, w2 long")

"""SimHash near-dedup: 64-bit fingerprints of word shingles, linked through BK-trees.

Fingerprints: A-Z lower-cased, words are runs of anything but ASCII white space, shingles are `words` words joined by a
space, repeats included; a shorter text is one shingle; no words (null too) gives zero, linked like any other. Texts are
taken whole, however long.

Links: pairs that differ in at most 3 of 64 bits agree in one of four 16-bit parts. So each distinct fingerprint goes,
for each part, to the shard of that part's low bits, as many bits as make shards of about `SHARD` fingerprints. Each
shard's fingerprints stand in a BK-tree (children keyed by Hamming distance to the parent), in which all of them are
searched along the edges within the radius only. Trees travel with their shard, not by broadcast, since a tree of all
fingerprints has no bound. A shard of over `block` fingerprints is split by the same rule once more, over 12-bit parts
of the other 48 bits; what is still larger is dealt as pairs of blocks, so each pair is met in some tree. Shards give
spanning forests, no lists of pairs. Equal fingerprints are one node, so copies cost nothing.

A row with a null doc_id has a fingerprint and a null component; rows of one doc_id are each linked. An empty table
gives an empty one. Extra columns, whatever their names, change nothing.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEY, components, groups, hash_blocks, local_forest, map_batches, materialise, own_names, row_key, scratch, ship

RADIUS = 3
#: Fingerprints of a shard, as planned from the number of all; and bits of the four parts and of the parts of the rest.
SHARD, PART, REST = 1024, 16, 12


def fingerprint(text: str | None, words: int = 3) -> int:
    """The unsigned fingerprint of one text."""
    from xxhash import xxh64_intdigest as h

    parts = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    k = min(words, len(parts))
    stops = ends[k - 1 :].tolist()
    starts = [0, *(ends[: len(stops) - 1] + 1).tolist()]
    total, n = np.zeros(64, np.int64), len(stops)
    for at in range(0, n, 8192):
        chunk = np.array([h(joined[a:b], 42) for a, b in zip(starts[at : at + 8192], stops[at : at + 8192], strict=True)], "<u8")
        total += np.unpackbits(chunk.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def majority(hashes: np.ndarray) -> int:
    """The unsigned fingerprint of shingles given by their hashes; zero without any."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        chunk = hashes[at : at + 8192].astype("<u8", copy=False)
        total += np.unpackbits(chunk.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(__kn, __kd, __kh, fp): fp as a signed long, by the row's key."""
    d = docs.select(*row_key(id_col, text_col), F.col(text_col).alias("__t"))

    def run(batch):
        fp = [fingerprint(t, words) for t in batch.column(3).to_pylist()]
        return {"__kn": batch.column(0), "__kd": batch.column(1), "__kh": batch.column(2), "fp": np.array(fp, "u8").view("i8")}

    return map_batches(d, run, "__kn boolean, __kd long, __kh long, fp long")


class BKTree:
    """A BK-tree over an array of fingerprints: nodes are their positions, edges carry the distance to the parent.
    visited counts the nodes that all searches so far compared with a query."""

    def __init__(self, fps: np.ndarray):
        self.fps, self.children, self.visited = fps, {}, 0
        todo = [np.arange(len(fps))] if len(fps) else []
        while todo:
            own = todo.pop()
            root, rest = own[0], own[1:]
            if not len(rest):
                continue
            d = np.bitwise_count(fps[rest] ^ fps[root])
            order = np.argsort(d, kind="stable")
            rest, d = rest[order], d[order]
            cuts = np.flatnonzero(np.diff(d)) + 1
            parts = np.split(rest, cuts)
            self.children[root] = (d[[0, *cuts]].astype(np.int16), [int(p[0]) for p in parts])
            todo += parts

    def within(self, queries: np.ndarray, radius: int):
        """Yields (node, positions of the queries within radius of it), all queries moving down together."""
        todo = [(0, np.arange(len(queries)))] if len(self.fps) and len(queries) else []
        while todo:
            node, q = todo.pop()
            d = np.bitwise_count(queries[q] ^ self.fps[node]).astype(np.int16)
            self.visited += len(q)
            near = q[d <= radius]
            if len(near):
                yield node, near
            if node in self.children:
                edges, nodes = self.children[node]
                order = np.argsort(d, kind="stable")
                q, d = q[order], d[order]
                low, high = np.searchsorted(d, edges - radius), np.searchsorted(d, edges + radius, side="right")
                todo += [(child, q[a:b]) for child, a, b in zip(nodes, low.tolist(), high.tolist(), strict=True) if b > a]


def _direct(fp: np.ndarray, tree: np.ndarray, ask: np.ndarray, radius: int):
    """Links of tree with ask that join what all of them join, each only where it joins more; no list of pairs."""
    label, left, right = np.arange(len(fp)), [], []
    for node, near in BKTree(fp[tree]).within(fp[ask], radius):
        own, q = tree[node], ask[near]
        q = q[label[q] != label[own]]
        if len(q):
            others, first = np.unique(label[q], return_index=True)
            left.append(np.full(len(first), own))
            right.append(q[first])
            label[np.isin(label, others)] = label[own]
    return (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))


def _shard_links(fp: np.ndarray, rep: np.ndarray, block: np.ndarray, i: int, j: int, radius: int, direct: bool = False):
    """A spanning forest of the links of one shard, or between its blocks i and j; direct: of links themselves, where
    otherwise each node hangs on the least that it reaches."""
    tree, ask = (np.arange(len(fp)),) * 2 if i == j else (np.flatnonzero(block == i), np.flatnonzero(block == j))
    if direct:
        a, b = _direct(fp, tree, ask, radius)
        return rep[a], rep[b]
    pairs = [(np.full(len(q), tree[n]), ask[q]) for n, q in BKTree(fp[tree]).within(fp[ask], radius)]
    a, b = (np.concatenate(x) if pairs else np.zeros(0, int) for x in (zip(*pairs, strict=True) if pairs else ((), ())))
    root = local_forest(len(fp), a, b)
    keep = root != np.arange(len(fp))
    return rep[keep], rep[root[keep]]


def shards(classes: DataFrame, bits: int, block: int) -> DataFrame:
    """classes (fp, rep), once for each shard that a row belongs to, with its key __k."""
    fp = F.col("fp")
    turned = [F.shiftrightunsigned(fp, PART * p).bitwiseOR(F.shiftleft(fp, 64 - PART * p) if p else F.lit(0).cast("long")) for p in range(4)]
    rows = classes.select("fp", "rep", F.explode(F.array(*[F.struct((t.bitwiseAND(F.lit((1 << bits) - 1)) * 4 + p).alias("k"), F.shiftrightunsigned(t, PART).alias("rest")) for p, t in enumerate(turned)])).alias("s"))
    rows = rows.select("fp", "rep", F.col("s.k").alias("__k"), F.col("s.rest").alias("__rest"))
    large = materialise(rows.groupBy("__k").count().filter(F.col("count") > block).select("__k", F.lit(True).alias("__large")), "large")
    if large.isEmpty():
        return rows.drop("__rest")
    rest = [(F.shiftrightunsigned("__rest", REST * s).bitwiseAND(F.lit((1 << REST) - 1)) * 4 + s + 1) for s in range(4)]
    within = F.when(F.col("__large"), F.array(*rest)).otherwise(F.array(F.lit(0).cast("long")))
    rows = rows.join(large, "__k", "left").withColumn("__w", F.explode(within))
    return rows.select("fp", "rep", F.shiftleft("__k", REST + 3).bitwiseOR(F.col("__w")).alias("__k"))


def links(classes: DataFrame, radius: int = RADIUS, block: int = 2048, shard: int = SHARD, direct: bool = False) -> DataFrame:
    """(u, v): links that join exactly the classes (fp, rep) within radius bits, as forests of each shard; with direct
    each is of two classes that are within radius bits themselves."""
    if radius > 3:
        raise ValueError("four parts find up to 3 differing bits")
    ship(classes.sparkSession)
    bits = min(PART, max(0, math.ceil(math.log2(max(classes.count(), 1) / shard))))
    rows = hash_blocks(shards(classes, bits, block), "__k", "fp", block)
    rows = rows.repartition("__k", "__i", "__j").sortWithinPartitions("__k", "__i", "__j").select("__k", "__i", "__j", "__b", "fp", "rep")

    def run(batches):
        for (_, i, j), (block_of, fps, reps) in groups(batches, 3):
            a, b = _shard_links(fps.view("u8"), reps, block_of, i, j, radius, direct)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["u", "v"])

    return rows.mapInArrow(run, "u long, v long")


def simhash_dedup(docs: DataFrame, words: int = 3, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key columns, fp, component) of every row: component is the smallest id of its group, null where the id is."""
    with scratch(docs.sparkSession):
        fps = materialise(fingerprints(docs, words, id_col, text_col), "fingerprints", keep=True)
        classes = materialise(fps.filter("not __kn").groupBy("fp").agg(F.min("__kd").alias("least")), "classes")
        # Links are between fingerprints, not ids: one id may have several texts.
        joined = components(links(classes.select("fp", F.col("fp").alias("rep")), radius)).toDF("fp", "root")
        named = materialise(classes.join(joined, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "roots")
        first = named.groupBy("root").agg(F.min("least").alias("component"))
        named = materialise(named.join(first, "root").select("fp", "component"), "named", keep=True)
    out = fps.join(named, "fp", "left")
    return out.withColumn("component", F.when(~F.col("__kn"), F.col("component")))


@own_names
def stage(docs: DataFrame) -> DataFrame:
    """The pipeline's form, by five-word shingles at a similarity of 0.8 (near_copies): first by fingerprints through the
    BK-trees, then for edits that differ in more bits by bands. Of each group the document with the smallest id stays,
    once. Documents without any word are one group."""
    from .near_copies import near_copies  # which is built on this module

    out = near_copies(docs).filter("__kn or __kd = first")
    # An id with several texts in one group stays once; rows equal in id and text are one document.
    keep = out.groupBy("__kn", "__kd", F.coalesce("component", "__kh")).agg(F.min("__kh").alias("__kh")).select(*KEY)
    d = docs.withColumns(dict(zip(KEY, row_key("doc_id", "text"), strict=True)))
    return d.join(keep, KEY).dropDuplicates(KEY).select(*docs.columns)

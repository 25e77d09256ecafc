"""Near copies by word shingles: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Sets: A-Z lower-cased, words are runs of anything but ASCII white space, a shingle is the hash of `WORDS` words in
order; a shorter text is one shingle; no words (null too) give the empty set. Rows of equal sets are one class.

First SimHash: each class has the 64-bit fingerprint of its shingles, and fingerprints within 3 bits are found through
the shards and BK-trees of simhash.links; of each shard's links as many as span them are candidates, and classes of one
fingerprint with one of them. At 0.8 fingerprints differ in about 10 bits, so an exact way for the rest follows:
candidates there are classes that agree in one of 24 bands of 4 MinHash values; at a similarity of exactly 0.8 a pair is
missed with a probability of (1 - 0.8^4)^24, 3 in a million, and less above. Every link is verified on whole sets, so no
pair below 0.8 is ever one. What fingerprints joined is not compared again: each member of a bucket that is not yet
joined with the bucket's most connected one, its pivot, is compared with it.
Buckets whose other members these links do not join go to tasks, each member as what it has of the pivot's shingles
(bits) and what it has beside them; so a task knows all common shingles exactly from one product of matrices and gives a
spanning forest, no pairs. Large buckets are dealt as pairs of blocks.

A row with a null id is in no group. Rows equal in id and text share one key. Ties in a pivot go to the larger name;
an empty table gives an empty one; texts are taken whole, however long; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import components, groups, hash_blocks, local_forest, materialise, row_key, scratch, ship, worker_state

WORDS, ROWS, BANDS = 5, 4, 24
#: The least similarity, as a fraction of integers.
LEAST = (4, 5)
#: Members of a block of a large bucket, and columns that a task multiplies at a time.
BLOCK, COLUMNS = 1024, 2048
_ODD = np.random.default_rng(42).integers(0, 1 << 63, ROWS * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _fold(columns, start: np.ndarray) -> np.ndarray:
    out = start
    for c in columns:
        out = (out ^ c) * _MIX
        out ^= out >> np.uint64(29)
    return out


def shingle_set(text: str | None) -> np.ndarray:
    """The hashes of a text's shingles, sorted, each once."""
    from xxhash import xxh64_intdigest as h

    parts = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    k = min(WORDS, len(parts))
    if not k:
        return np.zeros(0, np.uint64)
    words = np.fromiter(map(h, parts), np.uint64, len(parts))
    n = len(words) - k + 1
    return np.unique(_fold((words[i : i + n] for i in range(k)), np.full(n, k, np.uint64)))


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """One key a band, as signed longs; none for the empty set."""
    if not len(shingles):
        return np.zeros(0, np.int64)
    low = np.full(ROWS * BANDS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        low = np.minimum(low, np.multiply.outer(shingles[at : at + 2048], _ODD).min(axis=0))
    return _fold(low.reshape(BANDS, ROWS).T, np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def _name(shingles: np.ndarray) -> int:
    from xxhash import xxh64_intdigest as h

    return int(np.uint64(h(shingles.tobytes(), 42)).view(np.int64))


def sketches(docs: DataFrame) -> DataFrame:
    """(__kn, __kd, __kh, sig, fp, bands) of (doc_id, text): sig names the set of shingles, fp is its fingerprint as a
    signed long."""
    ship(docs.sparkSession)
    d = docs.select(*row_key("doc_id", "text"), F.col("text").alias("__t"))

    def run(batches):
        worker_state("near_copies", lambda: None)  # an earlier stage's model goes
        for batch in batches:
            sigs, fps, keys = [], [], []
            for t in batch.column(3).to_pylist():
                s = shingle_set(t)
                sigs.append(_name(s))
                fps.append(simhash.majority(s))
                keys.append(band_keys(s))
            ends = np.cumsum([0, *map(len, keys)])
            bands = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sigs, pa.int64()), pa.array(np.array(fps, "u8").view("i8")), bands], names=["__kn", "__kd", "__kh", "sig", "fp", "bands"])

    return d.mapInArrow(run, "__kn boolean, __kd long, __kh long, sig long, fp long, bands array<long>")


def _sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(sig, set), once each, of the documents whose ids are wanted."""
    d = docs.select(F.col("doc_id").cast("long").alias("__kd"), F.col("text").alias("__t")).join(ids, "__kd").select("__t")

    def run(batches):
        worker_state("near_copies", lambda: None)  # an earlier stage's model goes
        for batch in batches:
            sets = [shingle_set(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([_name(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["sig", "set"])

    return d.mapInArrow(run, "sig long, set binary").dropDuplicates(["sig"])


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets reach the least similarity."""
    few, many = sorted((len(a), len(b)))
    if few * LEAST[1] < many * LEAST[0]:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * LEAST[1] >= (few + many - both) * LEAST[0]


def _joined(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    return pairs.join(sets.toDF("u", "__a"), "u").join(sets.toDF("v", "__b"), "v")


def _shingles(column) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint64) for x in column]


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) that are similar."""
    def run(batches):
        worker_state("near_copies", lambda: None)  # an earlier stage's model goes
        for batch in batches:
            keep = [similar(a, b) for a, b in zip(_shingles(batch.column(2)), _shingles(batch.column(3)), strict=True)]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return _joined(pairs, sets).select("u", "v", "__a", "__b").mapInArrow(run, "u long, v long")


def _beside(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """rows (k, u: pivot, v: member) with the member's bits of the pivot's shingles and its other shingles."""
    def run(batches):
        worker_state("near_copies", lambda: None)
        for batch in batches:
            bits, rest = [], []
            for p, m in zip(_shingles(batch.column(3)), _shingles(batch.column(4)), strict=True):
                bits.append(np.packbits(np.isin(p, m, assume_unique=True)).tobytes())
                rest.append(np.setdiff1d(m, p, assume_unique=True).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(bits, pa.binary()), pa.array(rest, pa.binary())], names=["k", "v", "bits", "rest"])

    return _joined(rows, sets).select("k", "u", "v", "__a", "__b").mapInArrow(run, "k long, v long, bits binary, rest binary")


def _common(bits: list[bytes], rest: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(common shingles of each two members, members' sizes): of the pivot's by their bits, of the others by columns of
    those that several members have."""
    n = len(bits)
    inside = np.unpackbits(np.frombuffer(b"".join(bits), np.uint8).reshape(n, -1), axis=1)
    others = np.frombuffer(b"".join(rest), np.uint64)
    counts = np.fromiter((len(x) // 8 for x in rest), np.int64, n)
    owner = np.repeat(np.arange(n), counts)
    _, column, times = np.unique(others, return_inverse=True, return_counts=True)
    several = times[column] > 1
    number = np.cumsum(times > 1) - 1
    at, own = number[column[several]], owner[several]
    order = np.argsort(at, kind="stable")
    at, own = at[order], own[order]
    common = np.zeros((n, n), np.float32)  # whole numbers, exact
    for low in range(0, inside.shape[1], COLUMNS):
        x = inside[:, low : low + COLUMNS].astype(np.float32)
        common += x @ x.T
    for low in range(0, int((times > 1).sum()), COLUMNS):
        a, b = np.searchsorted(at, [low, low + COLUMNS])
        x = np.zeros((n, COLUMNS), np.float32)
        x[own[a:b], at[a:b] - low] = 1
        common += x @ x.T
    return common, inside.sum(axis=1, dtype=np.int64) + counts


def _bucket_links(ids: np.ndarray, bits, rest, block: np.ndarray, i: int, j: int):
    """A spanning forest of the links of one bucket, or between its blocks i and j."""
    common, size = _common(list(bits), list(rest))
    alike = common * (LEAST[0] + LEAST[1]) >= LEAST[0] * (size[:, None] + size[None, :])
    if i != j:
        alike &= block[:, None] != block[None, :]
    a, b = np.nonzero(np.triu(alike, 1))
    root = local_forest(len(ids), a, b)
    keep = root != np.arange(len(ids))
    return ids[keep], ids[root[keep]]


def fingerprint_pairs(classes: DataFrame) -> DataFrame:
    """(u, v): pairs of classes (sig, fp), each within 3 bits, that join all classes which such pairs join."""
    fps = materialise(classes.groupBy("fp").agg(F.min("sig").alias("rep")), "fps")
    same = classes.join(fps, "fp").filter("sig <> rep").select(F.col("rep").alias("u"), F.col("sig").alias("v"))
    return same.unionByName(simhash.links(fps, direct=True)).distinct()


def _links(docs: DataFrame, classes: DataFrame, block: int = BLOCK) -> DataFrame | None:
    """(u, v): verified links that join exactly what all similar candidates join; None without candidates."""
    near = materialise(fingerprint_pairs(classes), "near")
    rows = classes.select("sig", "__kd", F.explode("bands").alias("k"))
    shared = materialise(rows.groupBy("k").agg(F.count("*").alias("n")).filter("n > 1"), "shared")
    members = materialise(rows.join(shared, "k"), "members")
    if members.isEmpty() and near.isEmpty():
        return None
    ends = near.select(F.explode(F.array("u", "v")).alias("sig")).distinct()
    wanted = members.select("__kd").unionByName(classes.join(ends, "sig").select("__kd")).distinct()
    sets = materialise(_sets(docs, wanted), "sets")
    by_bits = materialise(_verified(near, sets), "by_bits")
    at = materialise(components(by_bits).toDF("sig", "at"), "at")
    # How many others a class meets in its buckets: of a group of edits of one text, the text meets the most.
    met = members.groupBy("sig").agg(F.sum("n").alias("met"))
    pivots = members.select("k", "sig").join(met, "sig").groupBy("k").agg(F.max(F.struct("met", "sig"))["sig"].alias("pivot"))
    pivots = pivots.join(at.toDF("pivot", "pivot_at"), "pivot", "left").select("k", "pivot", F.coalesce("pivot_at", "pivot").alias("pivot_at"))
    pivots = materialise(pivots, "pivots")  # so that the join below has plain exchanges, which can be split where a bucket is hot
    members = members.select("k", "sig").join(at, "sig", "left").select("k", "sig", F.coalesce("at", "sig").alias("at"))
    members = materialise(members.join(pivots, "k").filter("sig <> pivot"), "beside")
    apart = members.filter("at <> pivot_at").select(F.col("pivot").alias("u"), F.col("sig").alias("v")).distinct()
    links = materialise(by_bits.unionByName(_verified(apart, sets)), "similar")
    members = members.select("k", "sig", "pivot")
    at = components(links).toDF("sig", "at")
    own = members.join(at, "sig", "left").select("k", "pivot", "sig", F.coalesce("at", "sig").alias("at"))
    open_ = materialise(own.groupBy("k").agg(F.min("at").alias("lo"), F.max("at").alias("hi")).filter("lo <> hi").select("k"), "open")
    rows = materialise(_beside(members.join(open_, "k").select("k", F.col("pivot").alias("u"), F.col("sig").alias("v")), sets), "rows")
    rows = hash_blocks(rows, "k", "v", block)
    rows = rows.repartition("k", "__i", "__j").sortWithinPartitions("k", "__i", "__j").select("k", "__i", "__j", "v", "bits", "rest", "__b")

    def run(batches):
        for (_, i, j), (ids, bits, rest, block_of) in groups(batches, 3):
            a, b = _bucket_links(ids, bits, rest, block_of, i, j)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["u", "v"])

    return links.unionByName(materialise(rows.mapInArrow(run, "u long, v long"), "within"))


def near_copies(docs: DataFrame) -> DataFrame:
    """(__kn, __kd, __kh, component, first): of every row its group, null where the id is, and the group's least id."""
    spark = docs.sparkSession
    with scratch(spark):
        rows = materialise(sketches(docs), "sketches")
        classes = materialise(rows.filter("not __kn").groupBy("sig").agg(F.min("__kd").alias("__kd"), F.first("fp").alias("fp"), F.first("bands").alias("bands")), "classes")
        with scratch(spark):
            links = _links(docs, classes)
            if links is not None:
                links = materialise(components(links).toDF("sig", "component"), "joined", keep=True)
        named = classes.select("sig", "__kd")
        named = named.withColumn("component", F.col("sig")) if links is None else named.join(links, "sig", "left").select("sig", "__kd", F.coalesce("component", "sig").alias("component"))
        named = materialise(named, "grouped")
        first = named.groupBy("component").agg(F.min("__kd").alias("first"))
        named = materialise(named.join(first, "component").select("sig", "component", "first"), "named")
        out = rows.drop("fp", "bands").join(named, "sig", "left").drop("sig")
        return materialise(out.withColumns({c: F.when(~F.col("__kn"), F.col(c)) for c in ("component", "first")}), "copies", keep=True)

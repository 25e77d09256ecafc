"""What the operators of this subpackage share: shared tables, shipping of the package, links and components."""

from __future__ import annotations

import atexit
import os
import tempfile
import threading
import uuid
import zipfile
from contextlib import contextmanager
from functools import wraps
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one block of a bucket that is too large for one task.
BLOCK = 2048
#: Rows and bytes of one Arrow batch; one row may be longer, and is then a batch of its own.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20
_own_dirs: dict[str, str] = {}
_shipped: set[str] = set()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A folder that the driver and all executors see: spark.checkpoint.dir, or where that is unset the warehouse
    (a cluster) or a temporary folder (local mode, where there is one machine)."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if sc.master.startswith("local["):
            base = _own_dirs.setdefault(sc.applicationId, tempfile.mkdtemp(prefix="chronoweave-"))
        else:
            base = spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/chronoweave-{sc.applicationId}"


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cleanup(spark: SparkSession) -> None:
    """Deletes the tables that materialise() wrote in this session; their readers must be done."""
    _delete(spark, shared_dir(spark))


_scopes = threading.local()


@contextmanager
def scratch(spark: SparkSession):
    """Tables that materialise() writes inside go at the end, but for kept ones: all that reads them has run by then."""
    open_ = _scopes.__dict__.setdefault("open", [])
    open_.append([])
    try:
        yield
    finally:
        for path in open_.pop():
            _delete(spark, path)


def own_names(fn):
    """For a function of docs that returns docs' columns, and perhaps more behind them: while it runs, columns that it is
    not asked to use have other names, so that none clashes with its inner ones."""

    @wraps(fn)
    def run(docs: DataFrame, *args, **kw) -> DataFrame:
        used = {"doc_id", "text", "lang", "source", "n_chars", *(x for x in (*args, *kw.values()) if isinstance(x, str))}
        inner = [c if c in used else f"extra_{i}" for i, c in enumerate(docs.columns)]
        out = fn(docs.toDF(*inner), *args, **kw)
        return out.toDF(*docs.columns, *out.columns[len(inner) :])

    return run


def _at_exit(app: str) -> None:
    spark = SparkSession.getActiveSession()
    try:
        if spark is not None and spark.sparkContext.applicationId == app:
            cleanup(spark)
    except Exception:  # noqa: BLE001  the JVM may have gone first
        pass


def materialise(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Writes df to the shared folder and reads it back: the lineage ends, a lost executor costs no recomputation,
    and a join of two such tables has plain exchanges on both sides, which AQE can split where a key is hot. The table
    lives until the innermost scratch() ends, with keep the one around that, or the session."""
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.add(app)
        atexit.register(_at_exit, app)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if scopes := getattr(_scopes, "open", [])[: -1 if keep else None]:
        scopes[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a session, so that their Python can import it. Arrow batches of texts
    are bounded: where the session has Spark's defaults of 10,000 rows and 64 MB a batch, these become
    BATCH_ROWS and BATCH_BYTES."""
    for name, default, ours in (("maxRecordsPerBatch", {"10000"}, BATCH_ROWS), ("maxBytesPerBatch", {"67108864b", "64MB", "67108864"}, BATCH_BYTES)):
        if spark.conf.get(f"spark.sql.execution.arrow.{name}") in default:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", ours)
    app = f"zip-{spark.sparkContext.applicationId}"
    if app in _shipped:
        return
    _shipped.add(app)
    root = Path(__file__).resolve().parents[1]
    to = Path(tempfile.mkdtemp(prefix="chronoweave-zip-")) / "chronoweave_pkg.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    spark.sparkContext.addPyFile(os.fspath(to))


_worker: dict[str, object] = {}


def worker_state(key: str, make):
    """What a Python worker keeps over tasks, such as a model with its cache: one operator's at a time, so that a
    pipeline's stages do not add up in a worker that Spark reuses."""
    if key not in _worker:
        _worker.clear()
        pa.default_memory_pool().release_unused()
        _worker[key] = make()
    return _worker[key]


def map_batches(df: DataFrame, fn, schema: str) -> DataFrame:
    """mapInArrow of a function that turns a RecordBatch into a dict of columns (or None)."""
    ship(df.sparkSession)
    out = pa.schema([_arrow_field(x) for x in schema.split(", ")])

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                columns = fn(batch)
                if columns is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)


def _arrow_field(x: str) -> pa.Field:
    name, kind = x.split(" ")
    types = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.field(name, types[kind])


def fold(doc_id: Column | str) -> Column:
    """crc32 of the id as text, mod 5; 0 is held out. A null id is never learned from: it counts as 0."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 5, F.lit(0))


def row_key(id_col: str, text_col: str) -> list[Column]:
    """Never-null columns that name a row: nulls last, then the id, then a hash of the text."""
    return [F.col(id_col).isNull().alias("__kn"), F.coalesce(F.col(id_col), F.lit(0)).cast("long").alias("__kd"), F.xxhash64(F.col(text_col)).alias("__kh")]


KEY = ["__kn", "__kd", "__kh"]


def hash_blocks(rows: DataFrame, key: str, ident: str, block: int = BLOCK) -> DataFrame:
    """Adds __i, __j, __b: within a bucket of at most `block` rows all are 0; a larger one is cut by a hash of
    `ident` into blocks, and each row goes to every pair of blocks that has its own, so that no task holds more
    than two blocks and each pair of rows still meets exactly once where __i != __j, or within its block."""
    hot = materialise(rows.groupBy(key).count().filter(F.col("count") > block).select(key, F.ceil(F.col("count") / block).cast("int").alias("__nb")), "hot")
    if hot.isEmpty():
        return rows.withColumns({c: F.lit(0) for c in ("__i", "__j", "__b")})
    rows = rows.join(hot, key, "left").withColumn("__nb", F.coalesce("__nb", F.lit(1)))
    rows = rows.withColumn("__b", F.pmod(F.xxhash64(ident, F.lit(7)), F.col("__nb")).cast("int"))
    rows = rows.withColumn("__o", F.explode(F.sequence(F.lit(0), F.col("__nb") - 1)))
    return rows.withColumns({"__i": F.least("__b", "__o"), "__j": F.greatest("__b", "__o")}).drop("__o", "__nb")


def groups(batches, n_keys: int):
    """Of batches sorted by their first n_keys columns, yields (key, arrays of the others) for groups of two and
    more rows; a group may span batches. Groups of one row are passed over."""
    held: list[np.ndarray] | None = None
    for batch in chain(batches, [None]):
        if batch is not None:
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
        if held is None or not len(held[0]):
            continue
        n = len(held[0])
        new = np.zeros(n, bool)
        new[0] = True
        for k in held[:n_keys]:
            new[1:] |= k[1:] != k[:-1]
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], n)
        if batch is not None:  # the last group may go on
            starts, ends, cut = starts[:-1], ends[:-1], starts[-1]
        for a, b in zip(starts[ends - starts > 1], ends[ends - starts > 1], strict=True):
            yield tuple(int(k[a]) for k in held[:n_keys]), [x[a:b] for x in held[n_keys:]]
        held = [x[cut:] for x in held] if batch is not None else None


def local_forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest index that each of 0..n-1 reaches by the links left-right."""
    label = np.arange(n)
    if not len(left):
        return label
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def _contract(batches):
    """A spanning forest of each task's own links, in bounded chunks."""
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = (np.asarray(batch.column(i)) for i in (0, 1))
        ids, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = local_forest(len(ids), inv[: len(a)], inv[len(a) :])
        keep = root != np.arange(len(ids))
        yield pa.RecordBatch.from_arrays([pa.array(ids[keep], pa.int64()), pa.array(ids[root[keep]], pa.int64())], names=["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with a link; component is the smallest node it reaches.

    Alternating large and small stars over tables of links (u, v): each round hangs the neighbours of a node on the
    smallest of them, so paths halve and a group of any size ends as one star. Each node's smallest neighbour is a
    pre-aggregated minimum in a table of its own; the join back has exchanges on both sides for AQE to split.
    """
    spark = edges.sparkSession
    ship(spark)
    e = edges.toDF("u", "v").filter("u <> v")
    e = materialise(e.select(F.col("u").cast("long"), F.col("v").cast("long")).mapInArrow(_contract, "u long, v long").distinct(), "links")
    last = None
    while True:
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == last:
            break
        last = state
        with scratch(spark):
            both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "low")
            large = materialise(both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), "large")
            low = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "low")
            hung = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
            e = materialise(hung.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "small", keep=True)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

Sixteen statistics of the whole text (never of labels, lang, source or doc_id) are standardised and mapped to cosines
of random projections, whose inner products approximate a Gaussian kernel. Each partition of the fit rows sums its part
of the normal equations; the sums, of a size set by the number of features, are added and solved on the driver. Scores
of the fit rows that the ridge did not see (a fifth of them) are counted in bins and made monotone by pooling adjacent
violators, which gives the calibrated score.

Fit rows: labelled documents of folds 1-4, at most `fit_rows` of them by hash of the id; every document is scored. A
text that is null or empty has the statistics of an empty text. Several labels of one id count by their largest. With
no labelled row every score is 0.5. Rows are scored one by one, so repeated rows, ties and extra columns, whatever their
names, change nothing; a text is read whole, however long; an empty table gives an empty one.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, materialise, ship

N_STATS, BINS, THRESHOLD = 16, 400, 0.3
_KIND = np.zeros(256, np.int64)  # 0 other control, 1 lower, 2 upper, 3 digit, 4 space, 5 newline, 6 sentence mark, 7 other mark, 8 beyond ASCII
_KIND[ord("a") : ord("z") + 1] = 1
_KIND[ord("A") : ord("Z") + 1] = 2
_KIND[ord("0") : ord("9") + 1] = 3
_KIND[[32, 9, 11, 12, 13]] = 4
_KIND[10] = 5
_KIND[[ord(c) for c in ".,;:!?'\"-()"]] = 6
_KIND[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = 7
_KIND[128:] = 8


def statistics(text: str | None) -> np.ndarray:
    raw = (text or "").encode()
    n = max(len(raw), 1)
    b = np.frombuffer(raw, np.uint8)
    by_byte = np.bincount(b, minlength=256)
    kinds = np.bincount(_KIND, weights=by_byte, minlength=9)
    words = raw.split()
    k = max(len(words), 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    lines = raw.split(b"\n")
    ratio = lambda x, y: x / max(y, 1)
    p = by_byte[by_byte > 0] / n
    letters = kinds[1] + kinds[2] + kinds[8]
    mean = float(lengths.mean()) if len(words) else 0.0
    return np.array([
        np.log1p(len(words)), np.log1p(mean), np.log1p(float(lengths.std()) if len(words) else 0.0), ratio(kinds[2], letters), kinds[3] / n, kinds[4] / n,
        ratio(kinds[6], k), ratio(kinds[7], k), letters / n, len(set(words)) / k, len(set(lines)) / len(lines), np.log1p(k / len(lines)),
        float(-(p * np.log(p)).sum()), ratio(by_byte[ord(".")] + by_byte[ord("!")] + by_byte[ord("?")], k), ratio(by_byte[ord("!")], k), np.log1p(float(lengths.max()) if len(words) else 0.0),
    ])


class Model:
    def __init__(self, mean, scale, proj, phase, beta, steps):
        self.mean, self.scale, self.proj, self.phase, self.beta, self.steps = mean, scale, proj, phase, beta, steps

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -8, 8)
        phi = np.cos(z @ self.proj + self.phase) * np.sqrt(2 / len(self.phase))
        return np.concatenate([np.ones((len(z), 1)), phi], axis=1)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.beta

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), *self.steps)


def pool(y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The monotone means of bins with sums y and sizes n (pool adjacent violators)."""
    out: list[list[float]] = []
    for a, b in zip(y, n, strict=True):
        out.append([a, b, 1])
        while len(out) > 1 and out[-2][0] * out[-1][1] >= out[-1][0] * out[-2][1]:
            a2, b2, c2 = out.pop()
            out[-1] = [out[-1][0] + a2, out[-1][1] + b2, out[-1][2] + c2]
    return np.concatenate([np.full(int(c), a / b) for a, b, c in out]) if out else np.zeros(0)


def _sums(rows: DataFrame, fn, schema: str = "part binary") -> list:
    """Adds up the arrays that fn gives for each partition of the bounded fit rows."""
    def run(batches):
        total = None
        for b in batches:
            if b.num_rows:
                got = fn(np.frombuffer(b"".join(b.column(0).to_pylist()), np.float64).reshape(b.num_rows, N_STATS), np.asarray(b.column(1), np.float64))
                total = got if total is None else [x + y for x, y in zip(total, got, strict=True)]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total)], pa.binary())], names=["part"])

    parts = [pickle.loads(r[0]) for r in rows.mapInArrow(run, schema).collect()]
    return [sum(x) for x in zip(*parts, strict=True)] if parts else []


def labelled(docs: DataFrame, labels: DataFrame, label: str, fit_rows: int) -> DataFrame:
    """(__id, __t, __y) of at most fit_rows labelled documents of folds 1-4."""
    y = labels.select(F.col("doc_id").alias("__id"), F.col(label).alias("__y")).filter("__id is not null and __y is not null").filter(fold("__id") != 0)
    y = y.groupBy("__id").agg((F.max("__y") > 0).cast("double").alias("__y"))
    y = y.orderBy(F.xxhash64("__id"), "__id").limit(fit_rows)
    # fit_rows short rows at most: a bound that makes this safe to broadcast
    return docs.select(F.col("doc_id").alias("__id"), F.col("text").alias("__t")).join(F.broadcast(y), "__id")


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = 20_000, features: int = 160, ridge: float = 1e-3, width: float = 4.0, seed: int = 3) -> Model | None:
    ship(docs.sparkSession)

    @F.pandas_udf("binary")
    def stats(texts: pd.Series) -> pd.Series:
        return pd.Series([statistics(t if isinstance(t, str) else None).tobytes() for t in texts])

    rows = labelled(docs, labels, "quality", fit_rows)
    rows = materialise(rows.select(stats("__t").alias("s"), "__y", F.pmod(F.xxhash64("__id", F.lit(1)), F.lit(5)).alias("f")), "fit").coalesce(8)
    got = _sums(rows.select("s", "__y"), lambda s, y: [np.array([len(s)]), s.sum(0), (s * s).sum(0)])
    if not got:
        return None
    n = got[0][0]
    mean = got[1] / n
    scale = np.sqrt(np.maximum(got[2] / n - mean**2, 1e-12)) + 1e-6
    rng = np.random.default_rng(seed)
    m = Model(mean, scale, rng.standard_normal((N_STATS, features)) / width, rng.uniform(0, 2 * np.pi, features), None, None)
    ship_m = lambda s: m.features(s)
    part = rows.filter("f > 0") if n >= 50 else rows
    got = _sums(part.select("s", "__y"), lambda s, y: [(x := ship_m(s)).T @ x, x.T @ y, np.array([len(s)])])
    if not got:
        return None
    m.beta = np.linalg.solve(got[0] + ridge * got[2][0] * np.diag([1e-9] + [1.0] * features), got[1])
    edges = np.linspace(-0.5, 1.5, BINS + 1)
    rest = rows.filter("f = 0") if n >= 50 else rows
    got = _sums(rest.select("s", "__y"), lambda s, y: [np.histogram(np.clip(m.raw(s), -0.499, 1.499), edges, weights=y)[0], np.histogram(np.clip(m.raw(s), -0.499, 1.499), edges)[0]])
    at = (edges[:-1] + edges[1:]) / 2
    if got and (full := got[1] > 0).any():
        base = float(got[0].sum() / got[1].sum())
        y, k = got[0][full] + base * 0.5, got[1][full] + 0.5  # half a row of the mean in each bin
        m.steps = (at[full], pool(y, k))
    else:
        m.steps = (at, np.clip(at, 0, 1))
    return m


def quality(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        m = pickle.loads(shared.value)
        if m is None or not len(texts):
            return pd.Series(np.full(len(texts), 0.5))
        return pd.Series(np.clip(m.score(np.array([statistics(t if isinstance(t, str) else None) for t in texts])), 0, 1))

    d = docs.select(F.col(id_col).alias("doc_id"), (fold(id_col) == 0).alias("held_out"), score(text_col).alias("score"))
    return d.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))

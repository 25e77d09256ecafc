"""Language identification: a bidirectional gated recurrent network over bytes, trained in numpy.

One gated recurrent layer reads a text's bytes forwards and one backwards, across words and lines; a softmax labels
every byte from both states, and a document's probability is the mean over all labelled bytes of its whole text. A unit
has one gate f that both passes the old state on and lets it into the candidate c (a minimal gated unit); gates and
candidates use x / (1 + |x|) in place of tanh. For speed a text is read in windows of `WINDOW` bytes side by side, whose
state has been carried through the `HALO` bytes before (backwards: behind) them; a shorter text is one window. Windows
depend on their text only, so a document's score does not depend on its neighbours.

Training: up to `per_lang` documents of each language from folds 1-4, those of at most `fit_bytes` bytes first, then by
hash of the id, and no more than `fit_rows` of all; their whole texts reach the driver. Learned are at most `most_labels`
languages, the most frequent; rarer ones are never predicted. Backpropagation through time over stretches of `STRETCH`
bytes with Adam, seeded.

A null text or one without a letter is `und` with score 0; so is every text if no labelled row was there to learn from.
Rows with a null id or lang are not learned from. Rows are scored one by one: ties, repeated rows and extra columns,
whatever their names, change nothing; very long texts are read whole; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import pickle
from zlib import crc32

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fold, materialise, own_names, ship, worker_state

WINDOW, HALO, STRETCH, LANES = 256, 32, 160, 1024
PAD = 256  # the symbol of no byte: its gate is shut, so the state stays as it is
_SHUT = np.float32(-1e9)
_LETTER = regex.compile(r"\p{L}")


class BiGRU:
    """Weights of each direction: E (2 hidden x 257) gives what a byte adds to the gate and the candidate, U what the
    state adds. Arrays run over (feature, lane), one step after the other."""

    def __init__(self, n_labels: int, hidden: int = 8, seed: int = 5):
        rng = np.random.default_rng(seed)
        init = lambda *s: (rng.standard_normal(s) * 0.3).astype(np.float32)
        self.hidden, self.n_labels = hidden, n_labels
        self.w = {f"{k}{d}": v for d in "fb" for k, v in (("E", init(2 * hidden, 257)), ("U", init(2 * hidden, hidden)), ("V", init(n_labels, hidden)))}
        self.w["c"] = np.zeros((n_labels, 1), np.float32)
        self._shut()

    def _shut(self) -> None:
        for d in "fb":
            self.w[f"E{d}"][: self.hidden, PAD], self.w[f"E{d}"][self.hidden :, PAD] = _SHUT, 0

    def run(self, x: np.ndarray, d: str) -> np.ndarray:
        """States (steps, hidden, lanes) of one direction over x (steps, lanes), in the order in which it reads."""
        table, u, h, (steps, lanes) = self.w[f"E{d}"], self.w[f"U{d}"], self.hidden, x.shape
        out = np.empty((steps, h, lanes), table.dtype)
        s, g, us = np.zeros((h, lanes), table.dtype), np.empty((2 * h, lanes), table.dtype), np.empty((2 * h, lanes), table.dtype)
        a, f, c = np.empty((h, lanes), table.dtype), g[:h], g[h:]
        for t in range(steps):
            np.take(table, x[t], axis=1, out=g, mode="clip")
            np.matmul(u, s, out=us)
            f += us[:h]
            np.abs(f, out=a)
            a += 1
            f /= a
            f += 1
            f *= 0.5
            us[h:] *= f
            c += us[h:]
            np.abs(c, out=a)
            a += 1
            c /= a
            c -= s
            c *= f
            s = np.add(s, c, out=out[t])
        return out

    def logits(self, xf: np.ndarray, xb: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """(steps, labels, lanes) for the places of lanes that end with the last step; a lane's first place is at
        steps - size. xf and xb are what each direction reads, both ending with the last step."""
        steps = len(xf)
        back = np.matmul(self.w["Vb"], self.run(xb, "b"))
        at = np.clip(2 * steps - 1 - sizes[None, :] - np.arange(steps)[:, None], 0, steps - 1)
        return np.matmul(self.w["Vf"], self.run(xf, "f")) + np.take_along_axis(back, at[:, None, :], axis=0) + self.w["c"]

    def pooled(self, xf: np.ndarray, xb: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """(labels, lanes): the sums of each place's label probabilities."""
        p = self.logits(xf, xb, sizes)
        p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=1, keepdims=True)
        p *= (np.arange(len(p))[:, None] >= len(p) - sizes)[:, None, :]
        return p.sum(axis=0)

    def loss_gradients(self, x: np.ndarray, sizes: np.ndarray, y: np.ndarray, weight: np.ndarray):
        """The mean loss over places and its gradients; x (steps, lanes) is padded in front."""
        steps, h = len(x), self.hidden
        place = np.arange(steps)[:, None] - (steps - sizes)
        at = np.clip(2 * steps - 1 - sizes[None, :] - np.arange(steps)[:, None], 0, steps - 1)
        xb = np.where(place >= 0, np.take_along_axis(x, at, axis=0), PAD)
        own = (place >= 0) * (weight / (weight * sizes).sum())
        sf, sb = self.run(x, "f"), self.run(xb, "b")
        p = np.matmul(self.w["Vf"], sf) + np.take_along_axis(np.matmul(self.w["Vb"], sb), at[:, None, :], axis=0) + self.w["c"]
        p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=1, keepdims=True)
        lanes = np.arange(len(y))
        loss = float(-(np.log(np.maximum(p[:, y, lanes], 1e-30)) * own).sum())
        p[:, y, lanes] -= 1
        p *= own[:, None, :].astype(p.dtype)
        grad = {"c": p.sum(axis=(0, 2))[:, None]}
        backward = np.take_along_axis(p, at[:, None, :], axis=0) * (place >= 0)[:, None, :]
        for d, xd, s, dl in (("f", x, sf, p), ("b", xb, sb, backward)):
            u, table = self.w[f"U{d}"], self.w[f"E{d}"]
            grad[f"V{d}"] = np.matmul(dl, s.transpose(0, 2, 1)).sum(axis=0)
            ds = np.matmul(self.w[f"V{d}"].T, dl)
            before = np.concatenate([np.zeros_like(s[:1]), s[:-1]])
            g = np.moveaxis(table[:, xd], 0, 1)
            us = np.matmul(u, before)
            a = g[:, :h] + us[:, :h]
            f, df = 0.5 * (1 + a / (1 + np.abs(a))), 0.5 / (1 + np.abs(a)) ** 2
            b = g[:, h:] + f * us[:, h:]
            c, dc = b / (1 + np.abs(b)), 1 / (1 + np.abs(b)) ** 2
            dg, du, carry = np.empty_like(g), np.empty_like(g), np.zeros_like(s[0])
            for t in range(steps - 1, -1, -1):
                new = ds[t] + carry
                into_c = new * f[t] * dc[t]
                into_f = (new * (c[t] - before[t]) + into_c * us[t, h:]) * df[t]
                dg[t, :h], dg[t, h:] = into_f, into_c
                du[t, :h], du[t, h:] = into_f, into_c * f[t]
                carry = new * (1 - f[t]) + u.T @ du[t]
            grad[f"U{d}"] = np.matmul(du, before.transpose(0, 2, 1)).sum(axis=0)
            flat = xd.ravel()
            grad[f"E{d}"] = np.stack([np.bincount(flat, weights=dg[:, k].ravel(), minlength=257) for k in range(2 * h)])
            grad[f"E{d}"][:, PAD] = 0
        return loss, grad

    def fit(self, stretches: list[bytes], labels: np.ndarray, weights: np.ndarray, updates: int = 600, batch: int = 96, rate: float = 0.02, seed: int = 5):
        """So many updates, each over a batch of stretches of like length, in a seeded order."""
        rng = np.random.default_rng(seed)
        order = np.argsort([len(s) for s in stretches], kind="stable")
        todo = [order[a : a + batch] for a in range(0, len(order), batch)]
        m, v = ({k: np.zeros_like(a) for k, a in self.w.items()} for _ in range(2))
        turn = []
        for step in range(1, updates + 1):
            turn = turn or list(rng.permutation(len(todo)))
            own = todo[turn.pop()]
            _, grads = self.loss_gradients(padded([stretches[i] for i in own]), np.array([len(stretches[i]) for i in own]), labels[own], weights[own])
            for name, g in grads.items():
                m[name] = 0.9 * m[name] + 0.1 * g
                v[name] = 0.99 * v[name] + 0.01 * g * g
                self.w[name] -= (rate * (1 - step / (updates + 1)) * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-8)).astype(self.w[name].dtype)
            self._shut()
        return self


def padded(parts: list[bytes]) -> np.ndarray:
    """(steps, lanes), each part ending with the last step."""
    steps = max(map(len, parts))
    out = np.full((len(parts), steps), PAD, np.int64)
    for i, p in enumerate(parts):
        out[i, steps - len(p) :] = np.frombuffer(p, np.uint8)
    return np.ascontiguousarray(out.T)


class Model:
    """A trained network with its labels."""

    def __init__(self, labels: list[str], net: BiGRU | None):
        self.labels, self.net = labels, net


def _lanes(raw: np.ndarray, begins: np.ndarray, sizes: np.ndarray, heads: np.ndarray, forwards: bool) -> np.ndarray:
    """What lanes read of raw: `sizes` bytes each from `begins`, after `heads` bytes of halo, (steps, lanes), padded."""
    steps = int((sizes + heads).max())
    back = np.arange(steps - 1, -1, -1)[:, None]  # how far from the end
    at = begins + sizes - 1 - back if forwards else begins + back
    inside = back < sizes + heads
    return np.where(inside, raw[np.clip(at, 0, len(raw) - 1)].astype(np.int64), PAD)


def probabilities(net: BiGRU, texts: list[bytes]) -> np.ndarray:
    """(texts, labels): the mean label probabilities of each text that has a byte."""
    raw = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    n = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(texts)), n)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    begin = (ends - sizes)[owner] + nth * WINDOW
    size = np.minimum(WINDOW, ends[owner] - begin)
    total = np.zeros((len(texts), net.n_labels))
    order = np.argsort(-size, kind="stable")
    for low in range(0, len(order), LANES):
        own = order[low : low + LANES]
        b, k = begin[own], size[own]
        before = np.minimum(HALO, nth[own] * WINDOW)
        behind = np.minimum(HALO, ends[owner[own]] - b - k)
        xf, xb = _lanes(raw, b, k, before, True), _lanes(raw, b, k, behind, False)
        steps = max(len(xf), len(xb))
        xf, xb = (np.concatenate([np.full((steps - len(x), len(own)), PAD), x]) if len(x) < steps else x for x in (xf, xb))
        np.add.at(total, owner[own], net.pooled(xf, xb, k).T)
    return total / np.maximum(sizes, 1)[:, None]


def score(model: Model, texts: list[str | None]) -> list[tuple[str, float]]:
    own = [i for i, t in enumerate(texts) if t is not None and model.net and _LETTER.search(t)]
    out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
    if own:
        p = probabilities(model.net, [texts[i].encode() for i in own])
        for i, row in zip(own, p, strict=True):
            best = int(row.argmax())
            out[i] = (model.labels[best], round(min(1.0, float(row[best])), 6))
    return out


def train(docs: DataFrame, per_lang: int = 400, fit_rows: int = 4000, fit_bytes: int = 8192, most_labels: int = 100, hidden: int = 8, updates: int = 600) -> Model:
    d = docs.select(F.col("doc_id").alias("__id"), F.col("lang").alias("__lang"), F.octet_length("text").alias("__b")).filter("__id is not null and __lang is not null and __b > 0").filter(fold("__id") != 0)
    short = F.col("__b") <= fit_bytes
    n = materialise(d.groupBy("__lang").agg(F.count("*").alias("__all"), F.count_if(short).alias("__short")), "languages")
    n = materialise(n.orderBy(F.desc("__all"), "__lang").limit(most_labels), "learned")
    per_lang = max(1, min(per_lang, fit_rows // max(1, n.count())))
    # A hash thins each language to about twice per_lang documents before they are ranked, so none meets whole in a task.
    enough = F.col("__short") >= per_lang
    n = n.select("__lang", enough.alias("__enough"), (2.0 * per_lang / F.when(enough, F.col("__short")).otherwise(F.col("__all"))).alias("__share"))
    d = d.join(F.broadcast(n), "__lang").filter(short | ~F.col("__enough")).filter(F.pmod(F.xxhash64("__id", F.lit(2)), F.lit(1_000_003)) < F.col("__share") * 1_000_003)
    w = W.partitionBy("__lang").orderBy(~short, F.xxhash64("__id"), "__id")
    chosen = d.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= per_lang).select("__id", "__lang").distinct()
    chosen = materialise(chosen, "chosen")  # per_lang x most_labels rows at most
    texts = docs.select(F.col("doc_id").alias("__id"), F.col("lang").alias("__lang"), F.col("text").alias("__t"))
    rows = texts.join(F.broadcast(chosen), ["__id", "__lang"], "left_semi").dropDuplicates(["__id", "__lang", "__t"]).orderBy("__id", "__lang", "__t").collect()
    labels = sorted({r[1] for r in rows})
    if not labels:
        return Model([], None)
    x, y = [], []
    for r in rows:
        raw = (r[2] or "").encode()
        for a in (*range(0, len(raw), STRETCH), -1):  # and its beginning, of a length drawn from its bytes, for short texts
            x.append(raw[a : a + STRETCH] if a >= 0 else raw[: 4 + crc32(raw) % 60])
            y.append(labels.index(r[1]))
    y = np.array(y)
    total = np.bincount(y, weights=[len(p) for p in x], minlength=len(labels))
    weight = (total.sum() / len(labels) / total[y]).astype(np.float32)
    return Model(labels, BiGRU(len(labels), hidden).fit(x, y, weight, updates))


@own_names
def with_language(docs: DataFrame, model: Model, text_col: str = "text", batch_chars: int = 1_000_000) -> DataFrame:
    """docs with __lang and __score of every row; texts are scored together up to batch_chars, a longer one alone."""
    ship(docs.sparkSession)
    raw = pickle.dumps((model.labels, model.net.w if model.net else None, model.net.hidden if model.net else 0))
    shared, name = docs.sparkSession.sparkContext.broadcast(raw), hashlib.sha256(raw).hexdigest()

    @F.pandas_udf("lang string, score double")
    def label(texts: pd.Series) -> pd.DataFrame:
        model, part, size, got = worker_state(f"langid-{name}", lambda: _load(shared.value)), [], 0, []
        for t in texts:
            part.append(t if isinstance(t, str) else None)
            size += len(part[-1] or "")
            if size > batch_chars:
                got += score(model, part)
                part, size = [], 0
        return pd.DataFrame(got + score(model, part), columns=["lang", "score"])

    got = docs.withColumn("__l", label(text_col))
    return got.withColumns({"__lang": F.col("__l.lang"), "__score": F.col("__l.score")}).drop("__l")


def _load(raw: bytes) -> Model:
    labels, w, hidden = pickle.loads(raw)
    net = BiGRU(len(labels), hidden) if w is not None else None
    if net:
        net.w = w
    return Model(labels, net)


def language_id(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    d = with_language(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), model)
    return d.select("doc_id", (fold("doc_id") == 0).alias("held_out"), F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"))


@own_names
def stage(docs: DataFrame, least: float = 0.3) -> DataFrame:
    """The pipeline's form: a document without letters goes, and one whose language is unclear: whose score is under
    `least`, or with many languages less than 0.05 above chance. Without any labelled row only the former go."""
    model = train(docs)
    if model.net is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    floor = min(least, 1 / len(model.labels) + 0.05)
    scored = with_language(docs, model)
    return scored.filter((F.col("__lang") != "und") & (F.col("__score") >= floor)).select(*docs.columns)

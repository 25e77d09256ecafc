"""License scans: winnowed template fingerprints in an inverted index, then banded alignment.

Words are runs of ASCII letters and digits and of bytes beyond ASCII, A-Z lower-cased. Of a template of `LONG` words and
more, the word 5-grams are winnowed (the least hash of every 4 consecutive ones) into an index from hash to (template,
place). Of a shorter one all 2-grams are taken that hold a word other than the most common ones, since a single edit can
break every 5-gram of a notice that is still covered to 0.8. Of a document all grams are looked up, all texts of a batch
in one pass of numpy. Hits of a template whose diagonals lie within half its length (8 at least) are one candidate, so
words that were put in between do not part it. An alignment of the template with the words around it, confined to the
band around these diagonals, gives the matched words: a longest common subsequence. Coverage is matched words over the
template's words; spans of 0.8 and more in which at least two words of five match are reported, also several of one
template; where spans of several templates overlap, the one of the best fit (matched words less those of the template
and of the span that are unmatched; ties all).

Templates, a parameter, are broadcast: their size does not depend on the documents. The packaged ones are whole public
texts (licenses/) and one-line notices. Templates of fewer than five words are refused.

A null or empty text matches nothing and gives no row, nor does an empty table give any. Texts are taken together up to
`batch_bytes`, a longer one alone and whole. Repeated rows are scanned each; extra columns, whatever their names, do not
matter.
"""

from __future__ import annotations

import pickle
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

K, WINDOW, BAND, COVERAGE, SPARSE = 5, 4, 8, 0.8, 0.4
#: Words of a template from which its 5-grams are winnowed; the grams of a shorter one; words that say little there.
LONG, SHORT_K = 24, 2
COMMON = "a and any by for in is it of or released licensed the this to under with work you".split()
NOTICES = {
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "lgpl-3.0-notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "agpl-3.0-notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "mit-notice": "Released under the MIT License.",
    "bsd-notice": "Released under the BSD License.",
    "mpl-2.0-notice": "Licensed under the Mozilla Public License, Version 2.0.",
    "cc-by-4.0-notice": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc0-notice": "Dedicated to the public domain under CC0 1.0 Universal.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
}
#: Whole license texts, by their files' names in lower case, and notices.
TEMPLATES = {f.stem.lower(): f.read_text().strip() for f in sorted((Path(__file__).parent / "licenses").glob("*.txt"))} | NOTICES
_LOW = np.zeros(256, np.uint8)  # 0 between words
for _c in range(256):
    _ch = bytes([_c])
    if _ch.isalnum() or _c > 127:
        _LOW[_c] = _ch.lower()[0]
_P = np.uint64(0x9E3779B97F4A7C15)
_MASK = (1 << 64) - 1
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def words(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of each word: polynomial hashes mod 2^64 by prefix sums."""
    low = _LOW[np.frombuffer(raw, np.uint8)]
    inside = np.concatenate([[False], low > 0, [False]])
    start, end = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(~inside[1:] & inside[:-1])
    prefix = np.zeros(len(low) + 1, np.uint64)
    np.cumsum(low.astype(np.uint64) * _powers(_P, len(low)), out=prefix[1:])
    h = (prefix[end] - prefix[start]) * _powers(_P_INV, len(low) + 1)[start]
    h ^= h >> np.uint64(31)
    return h, start, end


def grams(h: np.ndarray, k: int = K) -> np.ndarray:
    n = max(len(h) - k + 1, 0)
    g = np.zeros(n, np.uint64)
    for i in range(k):
        g = g * np.uint64(0xD6E8FEB86659FD93) + h[i : i + n]
    return g ^ (g >> np.uint64(29))


class Index:
    """Hashes of grams with their template and place, sorted, for each length of gram."""

    def __init__(self, templates: dict[str, str], k: int = K, window: int = WINDOW):
        self.names, self.words = list(templates), []
        keys: dict[int, list[tuple[int, int, int]]] = {k: [], SHORT_K: []}
        common = words(" ".join(COMMON).encode())[0]
        for t, text in enumerate(templates.values()):
            h = words(text.encode())[0]
            if len(h) < K:
                raise ValueError(f"{self.names[t]} has fewer than {K} words")
            self.words.append(h)
            if len(h) >= LONG:
                g = grams(h, k)
                chosen = {int(a + np.argmin(g[a : a + window])) for a in range(max(1, len(g) - window + 1))}
                keys[k] += [(int(g[p]), t, p) for p in sorted(chosen)]
            else:
                g, plain = grams(h, SHORT_K), np.isin(h, common)
                keys[SHORT_K] += [(int(g[p]), t, p) for p in range(len(g)) if not plain[p : p + SHORT_K].all()]
        self.grams = {}
        for size, own in keys.items():
            own.sort()
            self.grams[size] = (np.array([x[0] for x in own], np.uint64), *(np.array([x[i] for x in own], np.int64) for i in (1, 2)))

    def hits(self, h: np.ndarray, owner: np.ndarray):
        """(text, template, diagonal) of every gram of h, words of texts `owner`, that a template has."""
        found = []
        for size, (hashes, template, place) in self.grams.items():
            if len(h) < size or not len(hashes):
                continue
            g = grams(h, size)
            low, high = np.searchsorted(hashes, g), np.searchsorted(hashes, g, side="right")
            p = np.flatnonzero((high > low) & (owner[: len(g)] == owner[size - 1 :]))
            n = high[p] - low[p]
            at = np.repeat(low[p] - np.cumsum(n) + n, n) + np.arange(n.sum())
            word = np.repeat(p, n)
            found.append((owner[word], template[at], word - place[at]))
        return [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 3


def align(template: np.ndarray, doc: np.ndarray, diagonal: int, band: int = BAND) -> tuple[int, int, int]:
    """(matched words, first and last matched word of doc) of the best alignment with |doc place - template place -
    diagonal| <= band: the longest common subsequence inside the band, and of these one with few gaps."""
    width = 2 * band + 1
    score, first, last = np.zeros(width + 1, np.int64), np.full(width + 1, -1), np.full(width + 1, -1)
    at, own = np.arange(width) + diagonal - band, np.arange(width)
    padded = np.concatenate([np.zeros(1, template.dtype), doc, np.zeros(1, template.dtype)])
    for i, w in enumerate(template):
        cols = at + i
        hit = (padded[np.clip(cols + 1, 0, len(doc) + 1)] == w) & (cols >= 0) & (cols < len(doc))
        # Along a diagonal a match adds one; skipping a template word moves from the right-hand diagonal.
        new, f, e = score[:-1] + hit, np.where(hit & (first[:-1] < 0), cols, first[:-1]), np.where(hit, cols, last[:-1])
        up = score[1:] > new
        new, f, e = np.where(up, score[1:], new), np.where(up, first[1:], f), np.where(up, last[1:], e)
        top = np.maximum.accumulate(new)  # skipping document words moves from a left-hand diagonal, the nearest of the best
        best = np.maximum.accumulate(np.where(new == top, own, 0))
        score[:-1], first[:-1], last[:-1] = new[best], f[best], e[best]
    best = int(np.argmax(score[:-1]))
    return int(score[best]), int(first[best]), int(last[best])


def scan(index: Index, texts: list[str | None], coverage: float = COVERAGE, band: int = BAND) -> list[tuple]:
    """(text number, template, occurrence, coverage, matched, start, end) with byte offsets in the text's UTF-8."""
    raws = [(t or "").encode() for t in texts]
    h, start, end = words(b"\n".join(raws))
    if not len(h):
        return []
    sizes = np.fromiter(map(len, raws), np.int64, len(raws)) + 1
    begins = np.cumsum(sizes) - sizes
    owner = np.searchsorted(begins, start, side="right") - 1
    first_word = np.searchsorted(owner, np.arange(len(raws) + 1))
    doc, template, diagonal = index.hits(h, owner)
    order = np.lexsort((diagonal, template, doc))
    doc, template, diagonal = doc[order], template[order], diagonal[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (template[1:] != template[:-1])
    cuts = [*np.flatnonzero(new).tolist(), len(doc)]
    out = []
    for x, y in zip(cuts, cuts[1:], strict=False):
        d, t = int(doc[x]), int(template[x])
        own, a, b = index.words[t], int(first_word[d]), int(first_word[d + 1])
        if b - a < coverage * len(own):  # too few words to cover it
            continue
        gap, groups, n, covered = max(band, len(own) // 2), [], 0, -1
        for z in np.unique(diagonal[x:y]).tolist():
            if groups and z - groups[-1][0] <= gap:
                groups[-1][1] = z
            else:
                groups.append([z, z])
        for low, high in groups:
            half = (high - low + 1) // 2 + band
            matched, i, j = align(own, h[a:b], (low + high) // 2 - a, half)
            if matched / len(own) >= coverage and matched >= SPARSE * (j - i + 1) and i > covered:
                n, covered = n + 1, j
                s, e = int(start[a + i] - begins[d]), int(end[a + j] - begins[d])
                out.append((d, index.names[t], n, matched / len(own), matched, s, e, 3 * matched - len(own) - (j - i + 1)))
    return [row[:7] for row in _best(out)]


def _best(rows: list[tuple]) -> list[tuple]:
    """Of matches that overlap in one text, the one of the best fit (last column), then the most words; ties stay."""
    of: dict[int, list[tuple]] = {}
    for row in sorted(rows, key=lambda r: (r[0], -r[7], -r[4], r[5], r[1])):
        kept = of.setdefault(row[0], [])
        if all((o[7], o[4]) == (row[7], row[4]) for o in kept if o[5] < row[6] and row[5] < o[6]):
            kept.append(row)
    return sorted(r for kept in of.values() for r in kept)


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 2_000_000) -> DataFrame:
    """doc_id, license, occurrence, coverage, matched_words, span_start, span_end (bytes): one row a match."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(Index(templates or TEMPLATES)))
    schema = "doc_id long, license string, occurrence int, coverage double, matched_words int, span_start long, span_end long"
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.float64(), pa.int32(), pa.int64(), pa.int64()]

    def run(batches):
        index = pickle.loads(shared.value)
        for batch in batches:
            ids, texts, part, size, base = batch.column(0), batch.column(1), [], 0, 0
            for i in range(len(texts) + 1):
                if i == len(texts) or size > batch_bytes:
                    rows = scan(index, part, coverage)
                    if rows:
                        cols = list(zip(*rows, strict=True))
                        arrays = [ids.take(pa.array([base + d for d in cols[0]])), *[pa.array(c, k) for c, k in zip(cols[1:], kinds[1:], strict=True)]]
                        yield pa.RecordBatch.from_arrays(arrays, names=[x.split(" ")[0] for x in schema.split(", ")])
                    part, size, base = [], 0, i
                if i < len(texts):
                    part.append(texts[i].as_py())
                    size += len(part[-1] or "")

    return docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__t")).mapInArrow(run, schema)

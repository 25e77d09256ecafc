"""BPE encoding and decoding: speculate and verify.

Texts are cut as byte-level BPE does (by the public pattern, around special tokens). Words that a worker has not seen
are encoded together: greedy longest match proposes tokens; a vectorised test of all adjacent pairs asks whether
merging the two tokens' bytes from scratch would give these two tokens again (a sequence is the exact encoding if and
only if every adjacent pair passes); only words with a failing pair go through exact merging, all of a batch together. Known
words come from a cache of two generations bounded in bytes: what a batch uses moves to the young one, so common words
never leave. The vocabulary file is read once on the driver and broadcast: its size does not depend on the data.

A null or empty text has no tokens and decodes to the empty text; an empty table gives an empty one. A text is cut whole,
however long; texts are taken together up to `batch_chars` characters, a longer one alone. Rows are independent, so
repeated rows and ids, ties and extra columns, whatever their names, change nothing.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from itertools import chain

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, worker_state

PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: White space beside a space: there, cutting at single spaces could differ from the pattern.
_UNEVEN = regex.compile(r" \s|\s | $")
_RARE_SPACE = [chr(c) for c in range(0x3001) if chr(c).isspace() and chr(c) not in " \n"]
#: Bytes of one generation of known words, and what an entry takes beside its characters and ids.
CACHE_BYTES, ENTRY_BYTES = 50_000_000, 190
#: Words of at most so many bytes are merged together in arrays.
SHORT = 64


def _byte_chars() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: character to byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Ranks are 0..255 for single bytes and 256 + the place in the merge list for the others."""

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        back = _byte_chars()
        as_bytes = lambda s: bytes(back[c] for c in s)
        vocab = spec["model"]["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: as_bytes(s) for s, i in vocab.items() if s not in self.special} | {i: s.encode() for s, i in self.special.items()}
        one = {b: c for c, b in back.items()}
        tokens = [bytes([b]) for b in range(256)] + [as_bytes(a + b) for a, b in merges]
        self.rank = {t: r for r, t in reversed(list(enumerate(tokens)))}
        self.id_of = np.array([vocab[one[b]] for b in range(256)] + [vocab[a + b] for a, b in merges], np.uint32)
        self.size = len(tokens)
        left = np.arange(self.size, dtype=np.int64)
        right = np.arange(self.size, dtype=np.int64)
        for i, (a, b) in enumerate(merges):
            left[256 + i], right[256 + i] = self.rank[as_bytes(a)], self.rank[as_bytes(b)]
        self.left, self.right = left, right
        self.merged = {(int(a), int(b)): r for r, (a, b) in enumerate(zip(left, right, strict=True)) if r > 255}
        keys = left[256:] * self.size + right[256:]
        order = np.argsort(keys, kind="stable")
        self.pair_keys, self.pair_ranks = keys[order], order + 256
        # Tokens as a tree: byte -> (its tree, the token that ends there or None).
        self.tree: dict = {}
        for t in tokens:
            node = self.tree
            for i, byte in enumerate(t):
                found = node.get(byte)
                ends = self.rank[t] if i + 1 == len(t) else found and found[1]
                node[byte] = found = ({} if found is None else found[0], ends)
                node = found[0]
        # The rank of each pair of bytes that some merge joins first; size where none does.
        self.byte_pairs = np.full(256 * 256, self.size, np.int64)
        low = (left[256:] < 256) & (right[256:] < 256)
        self.byte_pairs[left[256:][low] * 256 + right[256:][low]] = np.flatnonzero(low) + 256

    def greedy(self, word: bytes) -> list[int]:
        tree, out, at, n = self.tree, [], 0, len(word)
        while at < n:
            node, i = tree, at
            while i < n and (found := node.get(word[i])):
                node, rank = found
                i += 1
                if rank is not None:
                    last, at = rank, i
            out.append(last)
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each pair of ranks survives when its bytes are merged from scratch: undo the later of the two
        tokens' merges again and again; a merge across the border that would have come before the undone one breaks
        the pair."""
        ok = np.ones(len(a), bool)
        on = np.arange(len(a))
        a, b, limit = a.copy(), b.copy(), np.full(len(a), np.iinfo(np.int64).max)
        while len(on):
            key = a * self.size + b
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            broken = (self.pair_keys[at] == key) & (self.pair_ranks[at] < limit)
            ok[on[broken]] = False
            first = a > b
            undo_a = self.right[a]
            end_a = first & (undo_a == a)
            limit = np.where(first & ~end_a, a, limit)
            a2 = np.where(first, undo_a, a)
            # the left token is a byte, or the right one is the later: undo the right one
            turn = ~first | end_a
            limit = np.where(turn, b + 1, limit)
            undo_b = self.left[b]
            end_b = turn & (undo_b == b)
            b2 = np.where(turn, undo_b, b)
            # the right token is a byte: back to the left one, unless that is a byte as well
            back = end_b & ~first
            undo = self.right[a2]
            done = end_b & (first | (undo == a2))
            limit = np.where(back & ~done, a2, limit)
            a2 = np.where(back, undo, a2)
            go = ~broken & ~done
            on, a, b, limit = on[go], a2[go], b2[go], limit[go]
        return ok

    def exact(self, word: bytes) -> list[int]:
        """Merges by rank, leftmost first: over a list of ranks for a short word, with a heap for a long one."""
        parts, n = list(word), len(word)  # a byte's rank is the byte
        if n <= 64:
            get, none = self.merged.get, self.size
            ranks = [get(p, none) for p in zip(parts, parts[1:], strict=False)]
            while ranks and (r := min(ranks)) < none:
                i = ranks.index(r)
                parts[i : i + 2] = (r,)
                del ranks[i]
                if i:
                    ranks[i - 1] = get((parts[i - 1], r), none)
                if i < len(ranks):
                    ranks[i] = get((r, parts[i + 1]), none)
            return parts
        nxt, prv, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := self.merged.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, x, y = heapq.heappop(heap)
            j = nxt[i]
            if not alive[i] or j >= n or parts[i] != x or parts[j] != y:
                continue
            parts[i], alive[j], nxt[i] = r, False, nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
                if (m := self.merged.get((r, parts[nxt[i]]))) is not None:
                    heapq.heappush(heap, (m, i, r, parts[nxt[i]]))
            if (p := prv[i]) >= 0 and (m := self.merged.get((parts[p], r))) is not None:
                heapq.heappush(heap, (m, p, parts[p], r))
        return [x for x, a in zip(parts, alive, strict=True) if a]

    def _pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank that merging a and b gives, size where nothing does."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], self.size)

    def exact_together(self, words: list[bytes]) -> list[np.ndarray]:
        """exact() of words of one length of at least two bytes: each round merges every word's least pair, leftmost
        first. The tokens of a word are a linked list over its bytes' places."""
        n, width = len(words), len(words[0])
        parts = np.frombuffer(b"".join(words), np.uint8).reshape(n, width).astype(np.int64)
        ranks = np.full((n, width), self.size, np.int64)  # of the pair that begins at each place
        ranks[:, :-1] = self.byte_pairs[parts[:, :-1] * 256 + parts[:, 1:]]
        after = np.tile(np.arange(1, width + 1), (n, 1))
        before = np.tile(np.arange(-1, width - 1), (n, 1))
        on = np.arange(n)
        while len(on):
            own = ranks[on]
            i = own.argmin(axis=1)
            r = own[np.arange(len(on)), i]
            go = r < self.size
            on, i, r = on[go], i[go], r[go]
            j = after[on, i]
            k = after[on, j]
            parts[on, i], parts[on, j], after[on, i], ranks[on, j] = r, -1, k, self.size
            has = k < width
            ranks[on[~has], i[~has]] = self.size
            before[on[has], k[has]] = i[has]
            p = before[on, i]
            had = p >= 0
            a = np.concatenate([r[has], parts[on[had], p[had]]])
            b = np.concatenate([parts[on[has], k[has]], r[had]])
            new = self._pair_ranks(a, b)
            ranks[on[has], i[has]] = new[: has.sum()]
            ranks[on[had], p[had]] = new[has.sum() :]
        keep = parts >= 0
        return np.split(parts[keep], np.cumsum(keep.sum(axis=1))[:-1])

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Each word's ids as little-endian unsigned 32-bit integers."""
        proposed = [self.greedy(w) for w in words]
        sizes = np.fromiter(map(len, proposed), np.int64, len(words))
        flat = np.fromiter(chain.from_iterable(proposed), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(words)), sizes)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        keys, inv = np.unique(flat[inner] * self.size + flat[inner + 1], return_inverse=True)
        ok = self.compatible(keys // self.size, keys % self.size)
        failing = np.zeros(len(words), bool)
        failing[owner[inner[~ok[inv]]]] = True
        ids = self.id_of[flat].astype("<u4").tobytes()
        ends = (np.cumsum(sizes) * 4).tolist()
        out = [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        by_size: dict[int, list[int]] = {}
        for i in np.flatnonzero(failing).tolist():
            by_size.setdefault(len(words[i]), []).append(i)
        for size, own in by_size.items():
            several = size <= SHORT and len(own) > 8
            merged = self.exact_together([words[i] for i in own]) if several else [np.array(self.exact(words[i])) for i in own]
            for i, ranks in zip(own, merged, strict=True):
                out[i] = self.id_of[ranks].astype("<u4").tobytes()
        return out


class Cache:
    """Ids of words in two generations. A batch's words are brought to the young one, which becomes the old one, and the
    old one is forgotten, before the batch in which it would outgrow its bytes."""

    def __init__(self, most: int):
        self.most, self.size, self.young, self.old = most, 0, {}, {}

    def missing(self, words: set[str]) -> list[str]:
        """Makes room, brings known words to the young generation and returns the others."""
        if self.size > self.most:
            self.old, self.young, self.size = self.young, {}, 0
        new = words - self.young.keys()
        known = new & self.old.keys()
        self.add((w, self.old[w]) for w in known)
        return list(new - known)

    def add(self, found) -> None:
        for word, ids in found:
            self.young[word] = ids
            self.size += len(word) + len(ids) + ENTRY_BYTES


class Encoder:
    def __init__(self, vocab: Vocabulary, cache_bytes: int = CACHE_BYTES):
        self.v = vocab
        self.spaced = Cache(cache_bytes)  # pieces that follow a single space, which is theirs
        self.plain = Cache(cache_bytes // 4)
        table = [vocab.bytes_of.get(i, b"") for i in range(max(vocab.bytes_of) + 1)]
        self.sizes = np.fromiter(map(len, table), np.int64, len(table))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.blob = np.frombuffer(b"".join(table), np.uint8)
        self.split = regex.compile("|".join(map(regex.escape, sorted(vocab.special, key=len, reverse=True)))) if vocab.special else None

    def _segments(self, text: str):
        """Texts between special tokens, and these tokens' ids."""
        if self.split is None or not any(s in text for s in self.v.special):
            return [text]
        out, at = [], 0
        for m in self.split.finditer(text):
            out += [text[at : m.start()], self.v.special[m[0]]]
            at = m.end()
        return [*out, text[at:]]

    def _pieces(self, text: str) -> tuple[list[str], list[tuple[bool, str]]]:
        """Either pieces between single spaces (the first is plain), or the pattern's words where white space is uneven."""
        if not self._uneven(text):
            return text.split(" "), []
        return [], [(w[0] == " " and len(w) > 1 and not w.isspace(), w) for w in PATTERN.findall(text)]

    @staticmethod
    def _uneven(text: str) -> bool:
        if any(c in text for c in _RARE_SPACE):
            return _UNEVEN.search(text) is not None
        return "  " in text or " \n" in text or "\n " in text or text[-1] == " "

    def _learn(self, spaced: set[str], plain: set[str]) -> None:
        """Brings pieces to the caches. A piece of several words is joined from these words' ids."""
        new = [(cache, cache.missing(pieces), lead) for cache, pieces, lead in ((self.spaced, spaced, " "), (self.plain, plain, ""))]
        cut = [[ws[0] if len(ws := PATTERN.findall(lead + p)) == 1 else ws for p in ps] for _, ps, lead in new]
        unseen = {w for own in cut for ws in own if type(ws) is list for w in ws}
        words: dict[str, bytes] = {}
        for w in unseen:
            known = self.spaced.young.get(w[1:]) if w[0] == " " and len(w) > 1 and not w.isspace() else self.plain.young.get(w)
            if known is not None:
                words[w] = known
        unseen.update(w for own in cut for w in own if type(w) is str)
        todo = list(unseen - words.keys())
        words.update(zip(todo, self.v.encode_words([w.encode() for w in todo]) if todo else [], strict=True))
        for (cache, ps, _), own in zip(new, cut, strict=True):
            cache.add((p, words[ws] if type(ws) is str else b"".join([words[w] for w in ws])) for p, ws in zip(ps, own, strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        plan, spaced, plain = [], set(), set()
        for text in texts:
            own = []
            for s in self._segments(text):
                if isinstance(s, int):
                    own.append(s)
                elif s:
                    cut, words = self._pieces(s)
                    if cut:
                        plain.add(cut[0])
                        spaced.update(cut[1:])
                    for after, w in words:
                        (spaced if after else plain).add(w[1:] if after else w)
                    own.append((cut, words))
            plan.append(own)
        self._learn(spaced, plain)
        out, after_space, alone = [], self.spaced.young.__getitem__, self.plain.young.__getitem__
        for own in plan:
            parts: list[bytes] = []
            for s in own:
                if isinstance(s, int):
                    parts.append(s.to_bytes(4, "little"))
                    continue
                cut, words = s
                if cut:
                    parts.append(alone(cut[0]))
                    parts += map(after_space, cut[1:])
                parts += [after_space(w[1:]) if after else alone(w) for after, w in words]
            out.append(b"".join(parts))
        return out

    def decode(self, encoded: list[bytes], most: int = 200_000) -> list[str]:
        """The texts of ids, gathered from the tokens' bytes; texts are taken together up to `most` ids."""
        out, low = [], 0
        while low < len(encoded):
            high, n = low, 0
            while high < len(encoded) and (high == low or n + len(encoded[high]) // 4 <= most):
                n, high = n + len(encoded[high]) // 4, high + 1
            ids = np.frombuffer(b"".join(encoded[low:high]), "<u4")
            sizes = self.sizes[ids]
            ends = np.cumsum(sizes)
            at = np.repeat(self.starts[ids] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)
            raw, ends = self.blob[at].tobytes(), np.concatenate([[0], ends])
            cuts = ends[np.cumsum([0, *(len(e) // 4 for e in encoded[low:high])])].tolist()
            out += [raw[a:b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:], strict=False)]
            low = high
        return out


def _vocabulary(spark: SparkSession, path: str):
    with open(path, "rb") as f:
        raw = f.read()
    return spark.sparkContext.broadcast(raw), hashlib.sha256(raw).hexdigest()


def bpe(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, batch_chars: int = 3_000_000) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row; with_ids adds ids (binary, little-endian u4) and
    decoded (string). batch_chars bounds how much text is cut at a time."""
    shared, name = _vocabulary(docs.sparkSession, vocabulary)
    d = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__t"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded string" * with_ids

    def run(batch):
        enc = worker_state(f"bpe-{name}", lambda: Encoder(Vocabulary(shared.value)))
        out: dict = {"doc_id": batch.column(0), "n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "ids": [], "decoded": []}
        texts, part, size = batch.column(1), [], 0
        for i in range(len(texts) + 1):
            if i == len(texts) or size > batch_chars:
                encoded = enc.encode(part)
                for ids, decoded in zip(encoded, enc.decode(encoded), strict=True):
                    out["n_tokens"].append(len(ids) // 4)
                    out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
                    out["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
                    if with_ids:
                        out["ids"].append(ids)
                        out["decoded"].append(decoded)
                part, size = [], 0
            if i < len(texts):
                part.append(texts[i].as_py() or "")
                size += len(part[-1])
        return out

    return map_batches(d, run, schema)

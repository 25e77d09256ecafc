"""Toxicity: a weighted finite-state pattern grammar over clauses.

A lexical transducer maps words to classes (insult, threat, target, object, passive, negation, report, pause); its
insults are a seed list and words or word beginnings whose presence in labelled documents speaks for toxicity, with
their log odds as weights. It is composed with three bimachines: each reads a clause's classes from the left and from
the right, and gives a word a factor by both states. Targets: an insult beside a target counts in full ("you are an
idiot", "you idiot"), one that addresses someone after a pause nearly so ("shut up, moron"), one beside another insult
half, a lone one a third ("take out the trash"); a threat counts if its object follows ("kill you"), precedes as a
pronoun ("je vais te tuer", "ich werde dich töten") or is its passive subject ("you will be shot"), else not at all
("kill the process"). Negation weakens the next few words, a reporting verb the other words of its clause. A clause
scores the sum over its matches; a document its clauses' sum, largest and density, which a logistic curve fitted to the
labels turns into a score. So matched clauses decide, not words alone.

Fit rows: labelled documents of folds 1-4, at most `fit_rows` by hash of the id, in `PARTS` parts: the curve sees each
row as a lexicon learned from the other parts scores it, and the lexicon that is kept learns from all. Every whole text
is scored, however long. Null and empty texts have no clause and score the curve's low end; an empty table gives an
empty one. With no labelled rows the seed grammar and a fixed curve apply. Rows are scored one by one, so repeated rows,
ties and extra columns, whatever their names, change nothing.
"""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, materialise, ship, worker_state
from .quality import labelled

SEED = "idiot idiots moron morons stupid scum loser losers trash worthless pathetic disgusting clown bastard imbecile cretin vermin filth dumb jerk idiota estúpido imbécil basura asqueroso inútil idiote stupide imbécile ordure débile blöd dumm dummkopf abschaum trottel wertlos ekelhaft".split()
THREATS = "kill killed hurt destroy destroyed attack attacked murder murdered beat beaten shoot shot burn burned strangle strangled matar matarte matarlos golpear golpearte töten getötet umbringen umgebracht schlagen tuer frapper tué".split()
TARGETS = "you your youre you're u he she they him her them these those du dich ihr euch sie ihn tu toi vous te usted ustedes ellos él ella lui eux eres sois bist".split()
#: Pronouns that may stand before the verb whose object they are; with the object's ending some verbs hold it.
OBJECTS = "dich euch ihn sie te vous le la les lo los os t".split()
HELD = {"matarte", "matarlos", "golpearte"}
PASSIVE = "be been get gets got deserve deserves should werdet wirst werden gehörst seras sera serás será".split()
NEGATIONS = "not never no isn't aren't wasn't don't won't cannot can't nicht kein keine nie pas jamais nunca ningún".split()
REPORTS = "said says called claimed reported quoted wrote alleged accused sagte schrieb dijo escribió".split()
SHORTEST, LONGEST, PARTS = 4, 8, 3
INSULT, THREAT = 3.0, 4.0
#: A stem's likelihood ratio against chance: below CHANCE it is not learned, from SURE on at its full weight. 28 is what
#: none of some hundred thousand stems reaches by luck.
CHANCE, SURE = 16.0, 28.0
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}']+|,")
_CLAUSE_END = regex.compile(r"[.!?;:\n]")
_ENDS = ".!?;:\n"


class Automaton:
    """Deterministic over classes: arcs (state, class) -> state; other classes use the state's default."""

    def __init__(self, arcs: dict, default: dict, start=0):
        self.arcs, self.default, self.start = arcs, default, start

    def step(self, state, label):
        return self.arcs.get((state, label), self.default[state])


class Bimachine:
    """A word's factor is factor(state before it from the left, its class, state before it from the right)."""

    def __init__(self, left: Automaton, right: Automaton, factor):
        self.left, self.right, self.factor = left, right, factor


def _product(parts: list[Automaton]) -> Automaton:
    start = tuple(p.start for p in parts)
    labels = sorted({label for p in parts for _, label in p.arcs})
    arcs, default, todo = {}, {}, [start]
    while todo:
        s = todo.pop()
        if s not in default:
            for label in [*labels, None]:
                to = tuple(p.step(x, label) for p, x in zip(parts, s, strict=True))
                if label is None:
                    default[s] = to
                else:
                    arcs[s, label] = to
                todo.append(to)
    return Automaton(arcs, default, start)


def compose(*parts: Bimachine) -> Bimachine:
    """Reads with all parts, multiplies their factors; each factor is computed once."""
    known: dict = {}

    def factor(left, label, right):
        key = (left, label, right)
        if key not in known:
            known[key] = float(np.prod([p.factor(x, label, y) for p, x, y in zip(parts, left, right, strict=True)]))
        return known[key]

    return Bimachine(_product([p.left for p in parts]), _product([p.right for p in parts]), factor)


def _since(classes: dict[str, int], reach: int, others: dict | None = None) -> Automaton:
    """States 0 .. reach: words since one of the classes, reach being none; others map (state, class) to states."""
    arcs = {(s, c): to for c, to in classes.items() for s in range(reach + 1)} | (others or {})
    return Automaton(arcs, {s: min(s + 1, reach) for s in range(reach + 1)}, reach)


_ADDRESS = _product([
    _since({"target": 0, "object": 0}, 5),  # words since a target
    _since({"object": 0}, 4),  # since a pronoun that may be the object
    _since({"passive": 0}, 3),
    _since({"pause": 0}, 1),  # whether a pause came just before
    _since({"insult": 0}, 1),
])
_AHEAD = _product([_since({"target": 0, "object": 0}, 3), _since({"insult": 0}, 1), Automaton({}, {0: 1, 1: 1}, 0)])


def _addressed(left, label, right) -> float:
    target, pronoun, passive, pause, insult = left
    ahead, insult_next, inside = right
    if label == "insult":
        if target < 5 or ahead < 2:
            return 1.3
        return 1.0 if pause == 0 and not inside else 0.65 if insult == 0 or insult_next == 0 else 0.35
    if label == "threat":
        return 1.0 if ahead < 3 or pronoun < 4 else 0.8 if passive < 3 and target < 5 else 0.0
    return 1.0 if label == "held" else 0.0


_HARM = ("insult", "threat", "held")
_NOWHERE = Automaton({}, {0: 0})
#: State: how many words a negation still reaches. It weakens, it does not clear: weights are per clause, labels per text.
_DENIED = Bimachine(Automaton({(s, "negation"): 4 for s in range(5)} | {(s, "pause"): 0 for s in range(5)}, {s: max(s - 1, 0) for s in range(5)}), _NOWHERE, lambda a, label, _: 0.2 if a and label in _HARM else 1.0)
_REPORTED = Automaton({(s, "report"): 1 for s in range(2)}, {s: s for s in range(2)})
_SAID = Bimachine(_REPORTED, _REPORTED, lambda a, label, b: 0.5 if (a or b) and label in _HARM else 1.0)
GRAMMAR = compose(Bimachine(_ADDRESS, _AHEAD, _addressed), _DENIED, _SAID)


class Lexicon:
    """The lexical transducer: a whole word, else its longest listed beginning, else a fixed class."""

    def __init__(self, learned: dict[str, float]):
        self.words = {w: INSULT for w in SEED}
        self.stems: dict[str, float] = {}
        for k, v in learned.items():
            (self.stems if k[-1] == "*" else self.words)[k.rstrip("*")] = v
        classes = (("threat", THREATS), ("held", HELD), ("passive", PASSIVE), ("negation", NEGATIONS), ("report", REPORTS), ("target", TARGETS), ("object", OBJECTS), ("pause", [","]))
        self.fixed = {w: k for k, ws in classes for w in ws if w not in self.words}
        self.lengths = sorted({len(s) for s in self.stems}, reverse=True)

    def insult(self, word: str) -> float:
        if w := self.words.get(word):
            return w
        for n in self.lengths:
            if len(word) > n and (w := self.stems.get(word[:n])):
                return w
        return 0.0

    def matcher(self):
        """An automaton that finds all insults and threats of a text in one pass."""
        import ahocorasick

        a = ahocorasick.Automaton()
        for w in [*self.words, *self.stems, *THREATS, *HELD]:
            a.add_word(w, len(w))
        a.make_automaton()
        return a


class Scorer:
    def __init__(self, lexicon: Lexicon):
        self.lex, self.find = lexicon, lexicon.matcher()

    def clauses(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, score) of each clause that has a match."""
        low, out, done = text.lower(), [], -1
        for end, n in self.find.iter(low):
            at = end - n + 1
            if at < done or at and (low[at - 1].isalnum() or low[at - 1] == "'"):
                continue
            stop = _CLAUSE_END.search(low, end + 1)
            b = stop.start() if stop else len(low)
            a = max(low.rfind(c, 0, at) for c in _ENDS) + 1
            out.append((a, b, self.clause(low[a:b])))
            done = b
        return [x for x in out if x[2] > 0]

    def clause(self, low: str) -> float:
        classes: list[tuple[str | None, float]] = []
        for m in _WORD.finditer(low):
            weight = self.lex.insult(m[0])
            label = "insult" if weight else self.lex.fixed.get(m[0])
            classes.append((label, weight or (THREAT if label in ("threat", "held") else 0.0)))
        right, behind = GRAMMAR.right.start, []
        for label, _ in reversed(classes):
            behind.append(right)
            right = GRAMMAR.right.step(right, label)
        left, total = GRAMMAR.left.start, 0.0
        for (label, weight), right in zip(classes, reversed(behind), strict=True):
            if weight:
                total += weight * GRAMMAR.factor(left, label, right)
            left = GRAMMAR.left.step(left, label)
        return total

    def features(self, text: str | None) -> list[float]:
        found = self.clauses(text) if text else []
        total = sum(c for *_, c in found)
        words = max(text.count(" ") + text.count("\n") + 1, 1) if text else 1
        return [np.log1p(total), max((c for *_, c in found), default=0.0), np.log1p(100 * total / words)]


class Model:
    def __init__(self, learned: dict[str, float], curve: np.ndarray):
        self.learned, self.curve = learned, curve


def _stems(batch: pa.RecordBatch, of: dict) -> None:
    """Counts, of each word and word beginning, the documents by part and label."""
    for text, y, part in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
        own = set(_WORD.findall((text or "").lower()))
        keys = {w for w in own if len(w) >= 3}
        keys |= {w[:n] + "*" for w in own for n in range(SHORTEST, min(LONGEST, len(w) - 1) + 1)}
        for k in keys:
            c = of.setdefault(k, [0] * (2 * PARTS))
            c[2 * part + y] += 1


def choose(rows: list, n0: int, n1: int, most: int) -> dict[str, float]:
    """The lexicon from (stem, clean, toxic) counts: log odds of stems that are unlikely to be chance, the likeliest
    first, none that a shorter chosen beginning covers."""
    p0 = n1 / (n0 + n1)
    found = []
    for stem, c, t in rows:
        odds = np.log((t + 0.1) / (n1 + 0.2)) - np.log((c + 0.3) / (n0 + 0.6))
        ratio = 2 * (t * np.log(t / ((t + c) * p0)) + (c * np.log(c / ((t + c) * (1 - p0))) if c else 0)) if t else 0
        if odds > 1.5 and ratio > CHANCE:
            found.append((-ratio, len(stem), stem, float(min(odds, 6.0) * min(1.0, ratio / SURE))))
    learned: dict[str, float] = {}
    for _, _, stem, weight in sorted(found):
        word = stem.rstrip("*")
        if len(learned) < most and not any(word[:n] + "*" in learned for n in range(SHORTEST, len(word))):
            learned[stem] = weight
    return learned


def _fit_curve(x: np.ndarray, y: np.ndarray, steps: int = 40) -> np.ndarray:
    """Ridge-penalised logistic regression by Newton's method."""
    x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    beta, penalty = np.zeros(x.shape[1]), np.diag([1e-3] + [0.05] * (x.shape[1] - 1))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + penalty
        beta = beta + np.clip(np.linalg.solve(h, x.T @ (y - p) - penalty @ beta), -5, 5)
    return beta


def train_without_labels() -> Model:
    return Model({}, np.array([-3.5, 1.5, 0.6, 0.0]))


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = 8_000, lexicon: int = 400, least: int = 3) -> Model:
    ship(docs.sparkSession)
    part = F.pmod(F.xxhash64("__id", F.lit(5)), F.lit(PARTS)).cast("int")
    rows = materialise(labelled(docs, labels, "toxic", fit_rows).select("__t", F.col("__y").cast("int").alias("y"), part.alias("part")), "fit")
    n = np.zeros((PARTS, 2), np.int64)
    for r in rows.groupBy("part", "y").count().collect():
        n[r[0], r[1]] = r[2]
    if not n.sum(axis=0).all():
        return train_without_labels()
    names = [f"c{i}" for i in range(2 * PARTS)]

    def count(batches):
        of: dict = {}
        for b in batches:
            _stems(b, of)
            if len(of) > 300_000:
                yield _counts(of)
                of = {}
        if of:
            yield _counts(of)

    def _counts(of):
        columns = np.array(list(of.values()), np.int64).T
        return pa.RecordBatch.from_arrays([pa.array(list(of)), *[pa.array(c) for c in columns]], names=["stem", *names])

    stems = rows.select("__t", "y", "part").mapInArrow(count, f"stem string, {', '.join(f'{c} long' for c in names)}").groupBy("stem").agg(*[F.sum(c).alias(c) for c in names])
    toxic = sum(F.col(f"c{2 * i + 1}") for i in range(PARTS))
    clean = sum(F.col(f"c{2 * i}") for i in range(PARTS))
    n0, n1 = (int(x) for x in n.sum(axis=0))
    # What may pass in some lexicon: far fewer stems than there are, and no more than `lexicon` times 50.
    odds = F.log((toxic + 0.1) / (n1 + 0.2)) - F.log((clean + 0.3) / (n0 + 0.6))
    best = stems.filter(toxic >= least).withColumn("o", odds).filter("o > 1").orderBy(F.desc(toxic * F.col("o")), F.length("stem"), "stem").limit(lexicon * 50)
    counts = [(r[0], np.array(r[1 : 1 + 2 * PARTS]).reshape(PARTS, 2)) for r in best.collect()]

    def learn(without: int | None) -> dict[str, float]:
        use = [i for i in range(PARTS) if i != without]
        m = n[use].sum(axis=0)
        return choose([(stem, int(c[use, 0].sum()), int(c[use, 1].sum())) for stem, c in counts], int(m[0]), int(m[1]), lexicon) if m.all() else {}

    by_part, learned = [learn(i) for i in range(PARTS)], learn(None)
    shared = docs.sparkSession.sparkContext.broadcast(by_part)

    @F.pandas_udf("a double, b double, c double")
    def features(texts: pd.Series, parts: pd.Series) -> pd.DataFrame:
        s = [Scorer(Lexicon(x)) for x in shared.value]
        return pd.DataFrame([s[i].features(t if isinstance(t, str) else None) for t, i in zip(texts, parts, strict=True)], columns=["a", "b", "c"])

    got = rows.select("y", features("__t", "part").alias("f")).select("y", "f.*").toPandas()  # fit_rows rows of four numbers
    return Model(learned, _fit_curve(got[["a", "b", "c"]].to_numpy(), got["y"].to_numpy().astype(float)))


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted, clauses (how many match) of every row."""
    ship(docs.sparkSession)
    raw = pickle.dumps((model.learned, model.curve))
    shared, name = docs.sparkSession.sparkContext.broadcast(raw), hashlib.sha256(raw).hexdigest()

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        learned, curve = pickle.loads(shared.value)
        s = worker_state(f"toxicity-{name}", lambda: Scorer(Lexicon(learned)))
        x = np.array([[1.0, *s.features(t if isinstance(t, str) else None)] for t in texts]).reshape(-1, 4)
        return pd.Series(1 / (1 + np.exp(-np.clip(x @ curve, -30, 30))))

    d = docs.select(F.col(id_col).alias("doc_id"), (fold(id_col) == 0).alias("held_out"), score(text_col).alias("score"))
    return d.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))

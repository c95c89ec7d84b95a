"""Toxicity by a weighted finite-state pattern grammar.

A text is cut into clauses, and the words of a clause into classes: insult, threat,
target, negation, reported speech, other. Five transducers are composed into one
deterministic machine that runs over the classes once. The first two turn an insult
or a threat into a match; the others mark a match as aimed at somebody (before or
after it), negated, or reported. So a match comes out as one of a few kinds, such as
an aimed insult or a reported threat, and each kind has its weight. The weight of a
clause is that of its matches, each times its word's weight in the lexicon. Matched
clauses, not single words, make the features of a document.

All weights are learned: those of words by their odds with the labels, those of
kinds and of the features by logistic regression, with a prior that a kind that was
never seen weighs what its marks say. Labelled rows are a sample of at most
MOST_LABELLED documents, chosen by a hash of doc_id, in which near copies of one
label (equal least hashes of three-word windows under two hashes) count once, lest
the words of one much copied text pass for insults.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import crc_mod, lean, mix, stored
from loomgraph.llm.shingles import words

#: The bound of what is learned from: labelled documents.
MOST_LABELLED = 20_000
#: A learned term must be found with toxic labels so many deviations more often
#: than by chance, and in so many documents.
LEAST_Z, LEAST_DOCS = 6.5, 4
PREFIX = 6
#: Words that a negation reaches.
REACH = 3

INSULTS = frozenset("idiot idiots moron morons stupid trash scum loser losers worthless pathetic disgusting clown clowns dumb fool fools garbage imbecile vermin jerk dummkopf abschaum idioten imbécile ordure raclure estúpido basura escoria".split())
THREATS = frozenset("kill hurt destroy murder beat crush smash shoot stab burn strangle töten umbringen tuer frapper matar golpear".split())
TARGETS = frozenset("you your yours yourself u ur they them these those people du dich dein ihr euch tu toi vous tú usted ustedes".split())
NEGATIONS = frozenset("not no never neither nor without isn aren wasn don doesn didn nicht kein keine nie ne pas jamais nunca".split())
REPORTS = frozenset("said says say wrote writes quoted claimed claims alleged reported called according stated sagte schrieb dit écrit dijo escribió".split())

_WORD, _CLAUSE = re.compile(r"[^\W\d_]+"), re.compile(r"[.!?;:\n]+")


@dataclass
class Transducer:
    """A deterministic transducer: step gives the next state and what a symbol
    becomes in a state. Symbols are a class and the marks that it has got."""

    step: Callable[[int, str], tuple[int, str]]
    start: int = 0


def compose(first: Transducer, second: Transducer, alphabet: str) -> Transducer:
    """Feed the first one's output to the second: one machine over the alphabet,
    with an arc for every symbol in every state that can be reached."""
    arcs, seen = {}, {(first.start, second.start): 0}
    todo = list(seen)
    while todo:
        a, b = todo.pop()
        for symbol in alphabet:
            to_a, middle = first.step(a, symbol)
            to_b, last = second.step(b, middle)
            if (to_a, to_b) not in seen:
                seen[to_a, to_b] = len(seen)
                todo.append((to_a, to_b))
            arcs[seen[a, b], symbol] = (seen[to_a, to_b], last)
    return Transducer(lambda state, symbol: arcs[state, symbol])


#: Insult, threat, target, negation, report, other.
ALPHABET = "ITGNRO"


def _insult(state: int, symbol: str) -> tuple[int, str]:
    """An insult is a match; one right after another is marked as piled up."""
    return (1, "i+" if state else "i") if symbol == "I" else (0, symbol)


def _threat(state: int, symbol: str) -> tuple[int, str]:
    """A threat is a match; in a clause that has had one it is marked too."""
    return (1, "t+" if state else "t") if symbol == "T" else (state, symbol)


def _target(state: int, symbol: str) -> tuple[int, str]:
    """Marks matches after a target; a target after an open match closes it: states
    are nothing yet, target seen, and an insult or a threat still open."""
    if symbol == "G":
        return 1, {2: "i@", 3: "t@"}.get(state, symbol)
    if symbol[0] in "it":
        return (1, symbol + "@") if state == 1 else (3 if symbol[0] == "t" else max(state, 2), symbol)
    return state, symbol


def _negation(state: int, symbol: str) -> tuple[int, str]:
    """Marks matches up to REACH words after a negation."""
    if symbol == "N":
        return REACH, symbol
    return max(0, state - 1), symbol + "-" if state and symbol[0] in "it" else symbol


def _report(state: int, symbol: str) -> tuple[int, str]:
    """Marks matches after a verb of reported speech."""
    if symbol == "R":
        return 1, symbol
    return state, symbol + '"' if state and symbol[0] in "it" else symbol


def grammar() -> dict:
    """The arcs of the five, composed: (state, class) to (state, kind of match, or
    None where there is none)."""
    machine = Transducer(_insult)
    for part in (_threat, _target, _negation, _report):
        machine = compose(machine, Transducer(part), ALPHABET)
    arcs, todo = {}, [0]
    while todo:
        state = todo.pop()
        for symbol in ALPHABET:
            to, kind = machine.step(state, symbol)
            if (state, symbol) not in arcs:
                arcs[state, symbol] = (to, kind if kind[0] in "it" else None)
                todo.append(to)
    return arcs


ARCS = grammar()
KINDS = sorted({kind for _, kind in ARCS.values() if kind})


def prior(kind: str) -> float:
    """What a kind weighs before anything is learned, by its marks."""
    out = 1.0 if kind[0] == "i" else 0.3
    for mark, factor in (("@", 1.5), ("+", 1.1), ("-", 0.4), ('"', 0.5)):
        out *= factor if mark in kind else 1.0
    return out


@dataclass
class Model:
    """A lexicon of words and stems with weights, weights of the kinds of matches,
    and a logistic model over what the clauses of a document give."""

    terms: dict
    stems: dict
    threats: dict = field(default_factory=lambda: dict.fromkeys(THREATS, 1.0))
    kinds: dict = field(default_factory=lambda: {k: prior(k) for k in KINDS})
    weights: list = field(default_factory=list)

    def matches(self, tokens: list[str]) -> list[tuple[str, float]]:
        """(kind, weight of the word) for each match of a clause. A mark that a
        target gives to the match before it weighs what that match does."""
        state, found, last = 0, [], 1.0
        for word in tokens:
            own = self.terms.get(word) or self.stems.get(word[:PREFIX])
            symbol = "I" if own else "T" if word in self.threats else "N" if word in NEGATIONS else "G" if word in TARGETS else "R" if word in REPORTS else "O"
            state, kind = ARCS[state, symbol]
            if kind:
                last = last if symbol == "G" else own or self.threats[word]
                found.append((kind, last))
        return found

    def clause(self, tokens: list[str]) -> float:
        return sum(self.kinds[kind] * weight for kind, weight in self.matches(tokens))

    def clauses(self, text: str | None) -> list[list[str]]:
        """The words of the clauses that hold an insult or a threat."""
        low = (text or "").lower()
        terms, stems, threats = self.terms, self.stems, self.threats
        if not any(w in terms or w[:PREFIX] in stems or w in threats for w in _WORD.findall(low)):
            return []
        return [_WORD.findall(c) for c in _CLAUSE.split(low)]

    def by_kind(self, text: str | None) -> list[float]:
        """Sums of a document's matches, by kind."""
        sums = dict.fromkeys(KINDS, 0.0)
        for c in self.clauses(text):
            for kind, weight in self.matches(c):
                sums[kind] += weight
        return [math.log1p(sums[k]) for k in KINDS]

    def features(self, text: str | None) -> list[float]:
        scores = [s for c in self.clauses(text) if (s := self.clause(c)) > 0]
        if not scores:
            return [0.0] * 4
        return [math.log1p(sum(scores)), math.log1p(max(scores)), math.log1p(len(scores)), sum(scores) / math.sqrt(len(_WORD.findall(text)))]

    def score(self, features: list) -> np.ndarray:
        x = np.asarray(features, float)
        z = np.clip(x @ np.array(self.weights[1:]) + self.weights[0], -30, 30)
        return 1 / (1 + np.exp(-z))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 40, start: np.ndarray | None = None) -> list[float]:
    """Newton's method on standardised features; weights for the raw ones. The ridge
    draws them to 0, or to start, which are weights for the raw ones too."""
    if not len(y) or y.min() == y.max():
        return [math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)) if len(y) else -3.0, *[0.0] * x.shape[1]]
    mean, scale = x.mean(0), x.std(0)
    if start is not None:  # what never varies keeps its start
        scale = np.where(scale > 1e-6, scale, 1.0)
    scale = scale + 1e-9
    a = np.hstack([np.ones((len(x), 1)), (x - mean) / scale])
    drawn = np.zeros(x.shape[1]) if start is None else start * scale
    w = np.r_[0.0, drawn]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - y) / len(y) + ridge * np.r_[0, w[1:] - drawn]
        hess = (a * (p * (1 - p))[:, None]).T @ a / len(y) + ridge * np.diag(np.r_[0, np.ones(len(w) - 1)]) + 1e-9 * np.eye(len(w))
        w -= np.linalg.solve(hess, grad)
    raw = w[1:] / scale
    return [float(w[0] - raw @ mean), *map(float, raw)]


def _least_windows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Add a key that near copies mostly share and other texts don't: the least
    window under two hashes."""
    for frame in frames:
        keys = []
        for text in frame["text"]:
            h, _ = words([text])
            n = max(1, len(h) - 2)
            own = mix(h[:n] + (h[1:][:n] * np.uint64(3) + h[2:][:n] * np.uint64(5) if len(h) > 2 else np.uint64(0)))
            least = (int(own.min()) + 7 * int(mix(own ^ np.uint64(0xA0761D6478BD642F)).min())) % (1 << 63) if len(h) else 0
            keys.append(least)
        yield frame.assign(key=keys)


def _count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents with each word and each stem, by label: one partition's sums."""
    found: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for frame in frames:
        for text, toxic in zip(frame["text"], frame["toxic"], strict=True):
            own = set(_WORD.findall((text or "").lower()))
            found[int(toxic)].update(own | {f"{w[:PREFIX]}*" for w in own if len(w) > PREFIX})
    terms = list(found[0].keys() | found[1].keys())
    for a in range(0, len(terms), 50_000):
        part = terms[a : a + 50_000]
        yield pd.DataFrame({"term": part, "n0": [found[0][t] for t in part], "n1": [found[1][t] for t in part]})


def _rows(sample: DataFrame, of: Callable) -> tuple[np.ndarray, np.ndarray]:
    """of() of every text of the sample, and its label: some numbers for each of at
    most MOST_LABELLED rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"x": [of(t) for t in frame["text"]], "y": frame["toxic"].astype(float)})

    rows = sample.mapInPandas(run, "x array<double>, y double").toPandas()
    return np.array(rows["x"].tolist(), float), rows["y"].to_numpy(float)


def fit(labelled: DataFrame, most: int = MOST_LABELLED) -> Model:
    """Learn from rows (doc_id, text, toxic). Nothing known: a model that finds
    nothing toxic."""
    labelled = labelled.where("toxic is not null and doc_id is not null").select("doc_id", F.col("text").cast("string"), (F.col("toxic") > 0).cast("int").alias("toxic"))
    n = labelled.select("doc_id").count()
    share = min(1.0, most / max(1, n))
    sample = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < math.ceil(share * 1_000_003))
    sample = sample.mapInPandas(lean(_least_windows), "doc_id long, text string, toxic int, key long").groupBy("key", "toxic").agg(F.min_by("text", F.struct("doc_id", "text")).alias("text"))
    sample = stored(sample, "labelled")
    totals = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n0, n1 = totals.get(0, 0), totals.get(1, 0)
    rate = n1 / max(1, n0 + n1)
    learned, seeds = {}, {}
    if n0 and n1:
        df = F.col("n0") + F.col("n1")
        z = (F.col("n1") - df * rate) / F.sqrt(df * rate * (1 - rate))
        odds = F.log((F.col("n1") + 0.5) / (n1 + 1)) - F.log((F.col("n0") + 0.5) / (n0 + 1))
        counts = sample.mapInPandas(_count, "term string, n0 long, n1 long").groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
        # No more of these than the sample has words.
        wanted = counts.where(((F.col("n1") >= LEAST_DOCS) & (z >= LEAST_Z) & (odds >= 2)) | F.col("term").isin(sorted(INSULTS | THREATS)))
        for r in wanted.select("term", odds.alias("w"), df.alias("n"), ((F.col("n1") >= LEAST_DOCS) & (z >= LEAST_Z) & (odds >= 2)).alias("strong")).collect():
            if r["term"] in INSULTS or r["term"] in THREATS:
                if r["n"] >= LEAST_DOCS:
                    seeds[r["term"]] = max(0.1, r["w"])
            if r["strong"] and r["term"] not in THREATS:
                learned[r["term"]] = r["w"]
    # Seed words that the labels say nothing of weigh what the others do.
    usual = float(np.median([*learned.values(), *(w for t, w in seeds.items() if t in INSULTS)] or [1.0]))
    terms = {w: seeds.get(w, usual) for w in INSULTS} | {t: w for t, w in learned.items() if not t.endswith("*")}
    stems = {t[:-1]: w for t, w in learned.items() if t.endswith("*")}
    model = Model(terms, stems, {w: seeds.get(w, usual) for w in THREATS})
    x, y = _rows(sample, model.by_kind)
    if n0 and n1:
        start = np.array([prior(k) for k in KINDS])
        got = np.array(logistic(x, y, 0.05, start=start)[1:])
        model.kinds = dict(zip(KINDS, map(float, np.maximum(got, 0.0)), strict=True))
    x, y = _rows(sample, model.features)
    model.weights = logistic(x if len(x) else np.zeros((0, 4)), y)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and predicted for every row of docs (doc_id, text).

    Null, empty and wordless texts get the score of a text without matches. Other
    columns are ignored; repeated rows give repeated rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = model.score([model.features(t) for t in frame["text"]]) if len(frame) else np.zeros(0)
            yield pd.DataFrame({"doc_id": frame["doc_id"], "score": found, "predicted": (found >= 0.5).astype(int)})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(run, "doc_id long, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that are not predicted toxic, with all their columns."""

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score([model.features(t) for t in texts]) if len(texts) else [], dtype=float)

    return docs.where(scored(F.col("text").cast("string")) < 0.5)


def held_out(column: str = "doc_id"):
    return F.coalesce(crc_mod(column, 5) == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled documents that may be learned from."""
    named = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").alias("toxic"))
    return docs.select("doc_id", "text").where(~held_out()).join(named, F.col("doc_id") == F.col("_id")).select("doc_id", "text", "toxic")

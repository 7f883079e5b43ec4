"""Toxicity as a weighted finite-state pattern grammar over clauses.

Words become tags: insult (with a weight), threat, target, negation, reported speech, other.  One transducer per pattern reads
the tags of a clause.  Their composition is one machine (see `compose`): at an insult, or at a threat that has a target, it
emits that event and which of negation, target and reported speech hold there.  An event weighs its entry's or the threats'
weight times the factors of what holds; a clause scores the sum of its events, and a document is judged by its clauses'
scores alone.  Clauses without insult or threat score 0 and are not tagged: an automaton over all lexicon entries finds the
others in one pass over the whole text.

Learned from at most MAX_TRAINING labelled documents: insult entries (words and stems whose document frequencies differ between
labels; weight: log odds ratio), the weight of threats and the three factors (from a prior, as far as labels speak for others),
and a logistic curve from a document's clause scores to its probability.

Defined cases: null and empty texts get the probability of a text without matches; no labels, or of one class, leave the
built-in lexicon, the prior factors and a fixed curve; null labels are left out; a labelled doc_id of several texts teaches by
the first in their order; repeated rows are each scored; a long text is read once, whole; an empty table gives an empty
result; other columns, of whatever names, are not read, and no column but text is an input of a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_TRAINING = 8_000
STEM = (4, 9)
LEAST_DOCS, LEAST_Z, LEAST_WEIGHT = 5, 3.2, 1.2

#: Fixed word lists of the grammar, in English, German, French and Spanish.
INSULTS = ("idiot", "moron", "stupid", "scum", "loser", "dumbass", "imbecile", "bastard", "arschloch", "connard", "cabron")
THREATS = ("kill", "hurt", "destroy", "murder", "strangle", "töten", "umbringen", "tuer", "matar")
TARGETS = ("you", "your", "he", "she", "they", "them", "his", "her", "their", "du", "dich", "ihr", "sie", "tu", "toi", "vous", "ils", "usted", "ellos")
NEGATIONS = ("not", "never", "isn't", "aren't", "nicht", "kein", "keine", "pas", "jamais", "nunca")
REPORTS = ("said", "says", "wrote", "claimed", "called", "quoted", "sagte", "schrieb", "déclaré", "écrit", "dijo", "escribió")

_WORD = re.compile(r"\w+(?:'\w+)?")
_CLAUSE = re.compile(r"[.!?;\n]")


# ---------------------------------------------------------------------------------------------
# The grammar.

INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER = range(6)
TAGS = range(6)
#: Words for which a negation or a target holds.
REACH = 3


@dataclass(frozen=True)
class Transducer:
    """step[state][tag] = (next state, output): 1 where the pattern holds or the event happens at this word."""

    step: tuple[tuple[tuple[int, int], ...], ...]


def _countdown(on: int) -> Transducer:
    """State k > 0: the tag `on` was read at most REACH - k words ago."""
    return Transducer(tuple(tuple((REACH, 0) if tag == on else (max(0, k - 1), int(k > 0)) for tag in TAGS) for k in range(REACH + 1)))


NEGATED, TARGETED = _countdown(NEGATION), _countdown(TARGET)
#: After reported speech begins, the rest of the clause is someone else's.
REPORTED = Transducer((tuple((int(tag == REPORT), 0) for tag in TAGS), tuple((1, 1) for _ in TAGS)))
INSULTING = Transducer((tuple((0, int(tag == INSULT)) for tag in TAGS),))


def _threatening() -> Transducer:
    """A threat needs its target within reach: states 1..REACH have read a threat, the states above those a target."""
    rows = [tuple((REACH if tag == THREAT else 2 * REACH if tag == TARGET else 0, 0) for tag in TAGS)]
    for k in range(1, REACH + 1):
        rows.append(tuple((2 * REACH, 1) if tag == TARGET else (REACH if tag == THREAT else k - 1, 0) for tag in TAGS))
    for k in range(1, REACH + 1):
        rows.append(tuple((0, 1) if tag == THREAT else (2 * REACH if tag == TARGET else REACH + k - 1 if k > 1 else 0, 0) for tag in TAGS))
    return Transducer(tuple(rows))


THREATENING = _threatening()
EVENTS, CONTEXTS = ("insult", "threat"), ("negated", "targeted", "reported")
GRAMMAR = {"insult": INSULTING, "threat": THREATENING, "negated": NEGATED, "targeted": TARGETED, "reported": REPORTED}


def compose(parts: list[Transducer]) -> list[list[tuple[int, tuple[int, ...]]]]:
    """The machine that runs all parts in lockstep, over the states that can be reached: [state][tag] = (next state, outputs)."""
    at, table = {(0,) * len(parts): 0}, []
    for state in (order := list(at)):
        row = []
        for tag in TAGS:
            went = [p.step[k][tag] for p, k in zip(parts, state)]
            to = tuple(x for x, _ in went)
            if to not in at:
                at[to] = len(at)
                order.append(to)
            row.append((at[to], tuple(y for _, y in went)))
        table.append(row)
    return table


#: A document's sums by event and what holds there: event * 8 + negated + 2 * targeted + 4 * reported.
SIGNATURES = len(EVENTS) << len(CONTEXTS)


class Machine:
    """The composition of the grammar's transducers; those left out never hold."""

    def __init__(self, without: tuple[str, ...] = ()):
        never = Transducer((tuple((0, 0) for _ in TAGS),))
        use = {k: never if k in without else t for k, t in GRAMMAR.items()}
        self.forward, self.backward = compose([use[k] for k in (*EVENTS, *CONTEXTS)]), compose([use["targeted"]])

    def events(self, tags: list[tuple[int, float]]) -> list[tuple[int, float]]:
        """(signature, weight) of the clause's events; a target holds on either side of it."""
        state, heard = 0, []
        for k, (tag, weight) in enumerate(tags):
            state, out = self.forward[state][tag]
            for e in range(len(EVENTS)):
                if out[e]:
                    heard.append((k, e, weight if e == 0 else 1.0, out[2], out[3], out[4]))
        if not heard:
            return []
        state, after = 0, [0] * len(tags)
        for k in range(len(tags) - 1, -1, -1):
            state, out = self.backward[state][tags[k][0]]
            after[k] = out[0]
        return [(e * 8 + negated + 2 * (targeted | after[k] if e == 0 else 1) + 4 * reported, w) for k, e, w, negated, targeted, reported in heard]


class Grammar:
    """insults: entry -> weight; an entry that ends with '$' is a whole word, any other is the beginning of words."""

    def __init__(self, insults: dict[str, float], without: tuple[str, ...] = ()):
        self.insults, self.machine = insults, Machine(without)
        self.longest = max((len(x.rstrip("$")) for x in insults), default=0)
        self.shortest = min((len(x.rstrip("$")) for x in insults), default=0)
        self.other = {w: t for t, ws in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in ws}
        self.find = ahocorasick.Automaton()
        for x in {*(x.rstrip("$") for x in insults), *THREATS}:
            self.find.add_word(x, len(x))
        self.find.make_automaton()
        self.known: dict[str, tuple[int, float]] = {}

    def tag(self, word: str) -> tuple[int, float]:
        got = self.known.get(word)
        if got is None:
            got = (self.other.get(word, OTHER), 0.0)
            if (w := self.insults.get(word + "$")) is not None:
                got = (INSULT, w)
            elif got[0] == OTHER:
                for k in range(min(self.longest, len(word)), self.shortest - 1, -1):  # the longest stem counts
                    if (w := self.insults.get(word[:k])) is not None:
                        got = (INSULT, w)
                        break
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[word] = got
        return got

    def sums(self, text: str) -> list[float]:
        """Of the text's clauses: summed weights of events by signature, then how many clauses have events, and how many words it has."""
        low = text.lower()
        out, matched, upto = [0.0] * SIGNATURES, 0, -1
        for end, size in self.find.iter(low):
            at = end - size + 1
            if at < upto or at and (low[at - 1].isalnum() or low[at - 1] == "_"):
                continue
            # The last clause's end is the earliest place where this one may begin.
            begin = max(low.rfind(c, max(upto, 0), at) for c in ".!?;\n") + 1 or max(upto, 0)
            m = _CLAUSE.search(low, end)
            upto = m.start() if m else len(low)
            heard = self.machine.events([self.tag(w) for w in _WORD.findall(low, begin, upto)])
            matched += bool(heard)
            for k, w in heard:
                out[k] += w
        return [*out, float(matched), float(low.count(" ") + low.count("\n") + 1)]


#: Prior weights: of a threat, and the factors of what holds at an event.
PRIOR = {"threat": 2.0, "negated": 0.6, "targeted": 1.25, "reported": 0.7}


def signature_weights(weights: dict[str, float]) -> np.ndarray:
    out = np.ones(SIGNATURES)
    for k in range(SIGNATURES):
        out[k] *= weights["threat"] if k >> len(CONTEXTS) else 1.0
        for i, name in enumerate(CONTEXTS):
            # A threat always has its target, whose factor is then part of the threat's weight.
            if k >> i & 1 and not (name == "targeted" and k >> len(CONTEXTS)):
                out[k] *= weights[name]
    return out


def features(sums: np.ndarray, weights: dict[str, float]) -> np.ndarray:
    """What the curve sees of documents: their clauses' score, the same by words, and the clauses that have one."""
    total, matched, words = sums[:, :SIGNATURES] @ signature_weights(weights), sums[:, -2], sums[:, -1]
    return np.log1p(np.stack([total, 100.0 * total / words, matched, total / np.maximum(matched, 1)], axis=1))


# ---------------------------------------------------------------------------------------------
# Learning.


def is_held_out():
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def _stems(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        by = {0: Counter(), 1: Counter()}
        for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
            some = set()
            for w in set(_WORD.findall((text or "").lower())):
                some.add(w + "$")
                some.update(w[:k] for k in range(STEM[0], min(STEM[1], len(w)) + 1))
            by[toxic].update(some)
        keys = list({*by[0], *by[1]})
        yield pa.record_batch([pa.array(keys, pa.string()), pa.array([by[1][k] for k in keys], pa.int64()), pa.array([by[0][k] for k in keys], pa.int64())], names=["stem", "bad", "fine"])


def without_nested(found: dict[str, tuple[int, int, float]]) -> dict[str, float]:
    """Weights of entries (bad, fine, weight), one for each evidence along a word: of stems within each other that occur in as many
    documents of either label the longest stays, and a whole word only where no stem says the same."""
    by: dict[tuple, list[str]] = {}
    for x, (bad, fine, _) in found.items():
        by.setdefault((bad, fine), []).append(x)
    out = {}
    for same in by.values():
        stems = [x for x in same if not x.endswith("$")]
        for x in same:
            nested = any(x.startswith(s) for s in stems) if x.endswith("$") else any(s != x and s.startswith(x) for s in stems)
            if not nested:
                out[x] = found[x][2]
    return out


def _curve(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton steps; the constant comes last."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * np.append(w[:-1], 0)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _loss(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    z = np.clip(x @ w[:-1] + w[-1], -30, 30)
    return float((np.logaddexp(0, z) - y * z).sum() + 0.5 * (w[:-1] ** 2).sum())


def learn_weights(sums: np.ndarray, y: np.ndarray, spread: float = 0.5) -> tuple[dict[str, float], np.ndarray]:
    """(weights, curve): each weight in turn takes the best of its grid, by the curve's loss and its distance from the prior."""
    weights = dict(PRIOR)
    grid = np.exp(np.linspace(-1.5, 1.5, 13))

    def cost(w: dict[str, float]) -> float:
        x = features(sums, w)
        return _loss(x, y, _curve(x, y)) + sum((math.log(w[k] / PRIOR[k]) / spread) ** 2 / 2 for k in PRIOR)

    for _ in range(2):
        for name in PRIOR:
            tried = [weights | {name: PRIOR[name] * float(g)} for g in grid]
            weights = min(tried, key=lambda w: (round(cost(w), 6), abs(math.log(w[name] / PRIOR[name]))))
    return weights, _curve(features(sums, weights), y)


@dataclass
class Model:
    insults: dict[str, float]
    weights: dict[str, float]
    curve: np.ndarray
    without: tuple[str, ...] = ()

    def grammar(self) -> Grammar:
        return Grammar(self.insults, self.without)

    def probability(self, sums: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features(sums, self.weights) @ self.curve[:-1] + self.curve[-1], -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, max_training: int = MAX_TRAINING, without: tuple[str, ...] = ()) -> Model:
    """without: names of transducers that are left out, to see what they do."""
    spark = docs.sparkSession
    # A bounded sample: at most max_training rows of two numbers, so it may be sent to every executor.
    said = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out()).groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
    said = said.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_training)
    # One text of each labelled doc_id, so what is collected below is bounded as well.
    seen = docs.select("doc_id", "text").join(F.broadcast(said), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("text", "toxic").persist()
    try:
        n = {r["toxic"]: r["count"] for r in seen.groupBy("toxic").count().collect()}
        bad, fine = n.get(1, 0), n.get(0, 0)
        insults = {x + "$": 3.0 for x in INSULTS}
        if bad < LEAST_DOCS or fine < LEAST_DOCS:
            return Model(insults, dict(PRIOR), np.array([1.0, 0, 0, 0, -1.5]), without)
        stems = seen.mapInArrow(_stems, "stem string, bad long, fine long").groupBy("stem").agg(F.sum("bad").alias("bad"), F.sum("fine").alias("fine"))
        odds = F.log((F.col("bad") + 0.5) / (F.lit(bad + 0.5) - F.col("bad"))) - F.log((F.col("fine") + 0.5) / (F.lit(fine + 0.5) - F.col("fine")))
        spread = F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("fine") + 0.5))
        best = stems.where(F.col("bad") >= LEAST_DOCS).withColumn("weight", odds).withColumn("z", odds / spread)
        # Words of the grammar's own lists are no insults.
        listed = [w + "$" for ws in (THREATS, TARGETS, NEGATIONS, REPORTS) for w in ws]
        best = best.where((F.col("z") >= LEAST_Z) & (F.col("weight") >= LEAST_WEIGHT) & ~F.col("stem").isin(listed)).collect()  # of a bounded sample's words
        insults |= without_nested({r["stem"]: (r["bad"], r["fine"], round(r["weight"], 4)) for r in best})
        shared = spark.sparkContext.broadcast(insults)

        def seen_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            g = Grammar(shared.value, without)
            for b in batches:
                yield pa.record_batch([pa.array([g.sums(t.as_py() or "") for t in b.column("text")], pa.list_(pa.float64())), b.column("toxic")], names=["x", "toxic"])

        rows = seen.mapInArrow(seen_sums, "x array<double>, toxic int").collect()
    finally:
        seen.unpersist()
    rows.sort()
    weights, curve = learn_weights(np.array([r["x"] for r in rows]), np.array([r["toxic"] for r in rows], dtype=np.float64))
    return Model(insults, weights, curve, without)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        g = m.grammar()
        for b in batches:
            x = np.array([g.sums(t.as_py() or "") for t in b.column("text")]).reshape(b.num_rows, -1)
            p = m.probability(x) if b.num_rows else np.empty(0)
            yield pa.record_batch([b.column("doc_id"), b.column("held_out"), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), is_held_out().alias("held_out"), "text")
    return some.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")

"""Quality rules: a learned decision list, grown and pruned by sequential covering, run as ordered Spark conditions.

Everything that touches rows is a built-in DataFrame expression.  The driver sees only a table of counts: labelled
rows are put into cells of a grid of thresholds, and the covering works on the cells' counts.

Defined cases: a null or empty text has no words and fails the base rule; no labels, or labels of one class, give an
empty list, so the base rule alone decides; repeated rows are each judged alike; null labels are left out; conditions of
equal gain go to the first feature and the lowest threshold, and labels of a doc_id that tie are of high quality; a long text
is counted whole within its row; an empty table gives an empty list and result; extra columns stay out of the result of
``score`` and untouched in that of ``filter_documents``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, WS

SYMBOLS = r"[#*$%&|<>]"
#: What conditions of the list may test.
FEATURES = ("n_words", "word_length", "symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate")
#: Labelled rows that are looked at, at most; they are those of the smallest hashes.
MAX_LABELLED = 20_000
MAX_RULES = 8
MAX_CONDITIONS = 3
#: Share of a rule's labelled rows that must be of low quality, or the rule is not taken.
LEAST_PRECISION = 0.9
LEAST_COVER = 5


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def column(self, values: dict[str, Column]) -> Column:
        x = values[self.feature]
        return x > F.lit(self.cut) if self.above else x <= F.lit(self.cut)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:g}"


@dataclass
class DecisionList:
    """Rules in order; the first that holds rejects the document, and a document that none holds for is kept."""

    rules: list[tuple[Condition, ...]] = field(default_factory=list)

    def column(self, values: dict[str, Column]) -> Column:
        out = None
        for rule in self.rules:
            test = F.lit(True)
            for c in rule:
                test = test & c.column(values)
            out = F.when(test, F.lit(False)) if out is None else out.when(test, F.lit(False))
        return F.lit(True) if out is None else out.otherwise(F.lit(True))

    def __str__(self) -> str:
        return "\n".join(f"if {' and '.join(map(str, r))}: reject" for r in self.rules) + "\nelse: keep"


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(words: Column) -> Column:
    """Words in three-word windows found twice or more: sort (hash, place), keep places whose hash a neighbour has, and add up what they cover."""
    windows = F.sort_array(
        F.transform(
            F.sequence(F.lit(0), F.size(words) - 3),
            lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("at")),
        )
    )
    again = lambda w: F.sort_array(F.transform(F.filter(w, lambda x, k: (F.get(w, k + 1)["h"] == x["h"]) | ((k > 0) & (F.get(w, k - 1)["h"] == x["h"]))), lambda x: x["at"]))
    # Windows cover three words each; of overlapping ones only what lies before the next one counts.
    cover = lambda at: F.aggregate(F.transform(at, lambda x, k: F.least(F.lit(3), F.get(at, k + 1) - x)), F.lit(0), lambda a, x: a + x)
    return F.when(F.size(words) < 3, F.lit(0)).otherwise(_let(windows, lambda w: _let(again(w), cover)))


def with_counts(docs: DataFrame, prefix: str = "") -> DataFrame:
    """Adds word, symbol, line and repetition counts of the text; their names begin with the prefix.

    Three-word windows are compared by 64-bit hash within one text.  The counts pass through a one-row generator, which
    keeps the optimiser from copying their expressions into filters above.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    of_words = _let(
        F.filter(F.split(text, WS + "+"), lambda w: w != ""),
        lambda w: F.struct(F.size(w).cast("long").alias("n"), F.length(F.array_join(w, "")).cast("long").alias("chars"), _repeat_words(w).cast("long").alias("again")),
    )
    of_lines = _let(
        F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)),
        lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")),
    )
    gone = lambda pattern: (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")
    c = f"{prefix}counts"
    found = F.struct(of_words.alias("w"), of_lines.alias("l"), gone(SYMBOLS).alias("symbols"), gone(r"\p{Lu}").alias("upper"), F.length(text).cast("long").alias("chars"))
    fields = {"n_words": "w.n", "word_chars": "w.chars", "n_repeat_words": "w.again", "n_lines": "l.n", "n_dup_lines": "l.dup", "n_symbols": "symbols", "n_upper": "upper", "n_chars": "chars"}
    out = docs.select("*", F.explode(F.array(found)).alias(c))
    return out.withColumns({f"{prefix}{k}": F.col(f"{c}.{v}") for k, v in fields.items()}).drop(c)


def _features(p: str = "") -> dict[str, Column]:
    rate = lambda a, b: F.when(F.col(p + b) > 0, F.col(p + a) / F.col(p + b)).otherwise(F.lit(0.0))
    return {
        "n_words": F.col(f"{p}n_words").cast("double"),
        "word_length": rate("word_chars", "n_words"),
        "symbol_rate": rate("n_symbols", "n_words"),
        "dup_line_rate": rate("n_dup_lines", "n_lines"),
        "repeat_rate": rate("n_repeat_words", "n_words"),
        "upper_rate": rate("n_upper", "n_chars"),
    }


def base_failed(p: str = "") -> Column:
    return (F.col(f"{p}n_words") < 50) | (100 * F.col(f"{p}n_repeat_words") > 50 * F.col(f"{p}n_words"))


# ---------------------------------------------------------------------------------------------
# Learning.


def _cells(docs: DataFrame, labels: DataFrame, max_labelled: int) -> tuple[list[dict], dict[str, list[float]]]:
    """Counts of labelled rows by cell of the threshold grid, and the thresholds of each feature."""
    said = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg((F.avg("quality") >= 0.5).cast("int").alias("q"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_labelled)
    )
    # The sample has at most max_labelled rows of two numbers, so it may be sent to every executor.
    seen = with_counts(docs.select("doc_id", "text").join(F.broadcast(said), "doc_id")).where(~base_failed())
    seen = seen.select("q", (F.pmod(F.xxhash64(F.col("doc_id"), F.lit(7)), F.lit(3)) == 0).alias("prune"), *[v.alias(k) for k, v in _features().items()])
    seen = seen.persist()
    try:
        at = [i / 20 for i in range(1, 20)] + [0.01, 0.02, 0.98, 0.99]
        found = seen.agg(*[F.percentile_approx(F.when(F.col("q") == c, F.col(f)), F.array(*map(F.lit, at)), 1000).alias(f"{f}_{c}") for f in FEATURES for c in (0, 1)]).first()
        cuts = {}
        for f in FEATURES:
            ends = sorted({x for c in (0, 1) for x in (found[f"{f}_{c}"] or [])})
            cuts[f] = sorted({float(f"{(a + b) / 2:.6g}") for a, b in zip(ends, ends[1:])})
        grid = [sum([(F.col(f) > F.lit(c)).cast("int") for c in cuts[f]], F.lit(0)).alias(f) for f in FEATURES]
        rows = seen.select("q", "prune", *grid).groupBy("prune", *FEATURES).agg(F.sum(F.col("q")).alias("good"), F.sum(1 - F.col("q")).alias("bad")).collect()
    finally:
        seen.unpersist()
    return [r.asDict() for r in rows], cuts


def _cover(cells: list[dict], cuts: dict[str, list[float]]) -> list[tuple[Condition, ...]]:
    """Sequential covering of the low-quality cells: grow on two thirds of the rows, prune on the rest, remove what is covered."""
    import math

    def holds(cell: dict, rule: list) -> bool:
        return all((cell[f] > k) == above for f, above, k in rule)

    def counts(some: list[dict]) -> tuple[int, int]:
        return sum(c["bad"] for c in some), sum(c["good"] for c in some)

    rules, left = [], cells
    while len(rules) < MAX_RULES:
        grow, prune = [c for c in left if not c["prune"]], [c for c in left if c["prune"]]
        rule: list[tuple[str, bool, int]] = []
        inside = grow
        while len(rule) < MAX_CONDITIONS:
            p0, n0 = counts(inside)
            if not p0 or not n0:
                break
            base, best = math.log2(p0 / (p0 + n0)), (1e-9, None)
            for f in FEATURES:
                by: dict[int, list[int]] = {}
                for c in inside:
                    x = by.setdefault(c[f], [0, 0])
                    x[0] += c["bad"]
                    x[1] += c["good"]
                bad = good = 0
                for k in range(len(cuts[f])):
                    x = by.get(k, (0, 0))
                    bad, good = bad + x[0], good + x[1]
                    for above, p, n in ((False, bad, good), (True, p0 - bad, n0 - good)):
                        if p >= LEAST_COVER and (gain := p * (math.log2(p / (p + n)) - base)) > best[0]:
                            best = (gain, (f, above, k))
            if best[1] is None:
                break
            rule.append(best[1])
            inside = [c for c in inside if holds(c, rule)]
        if not rule:
            break

        def worth(r: list) -> float:
            p, n = counts([c for c in prune if holds(c, r)])
            return (p - n) / (p + n) if p + n else -1.0

        rule = max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda r: (worth(r), -len(r)))
        p, n = counts([c for c in left if holds(c, rule)])
        if p < LEAST_COVER or p < LEAST_PRECISION * (p + n):
            break
        rules.append(tuple(Condition(f, above, cuts[f][k]) for f, above, k in rule))
        left = [c for c in left if not holds(c, rule)]
    return rules


def learn(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DecisionList:
    """A decision list from at most max_labelled labelled documents that pass the base rule."""
    return DecisionList(_cover(*_cells(docs, labels, max_labelled)))


def score(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """One row per document: doc_id, the counts, base_failed and the verdict."""
    out = with_counts(docs.select("doc_id", "text"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper",
        base_failed().alias("base_failed"), (~base_failed() & rules.column(_features())).alias("kept"),
    )


def filter_documents(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """The documents that are kept, with their own columns."""
    p = "_quality_rules_"
    out = with_counts(docs, p)
    return out.where(~base_failed(p) & rules.column(_features(p))).select(*docs.columns)

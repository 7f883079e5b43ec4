"""Mixing sources to target weights with hash-threshold histograms, in DataFrame expressions only.

Documents get a fixed 24-bit key from the MD5 of their doc_id.  Sizes are summed by source and the key's upper half; the
bucket in which a source's budget runs out is found from running sums, and only that bucket is summed again by the
lower half.  The result is one threshold per source: documents below it are taken once more than those above.  Budgets
are nested: the documents in a smaller mix of a source are in every larger one.  Nothing is sorted but histograms.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; documents that repeat a
doc_id share a key and so a fate; of two keys equally near to a budget the smaller one ends it; a long text is counted whole
and is taken or left whole; a source of size 0 has target 0; an empty table gives an empty result; other columns, of
whatever names, are not read by `plan` and pass through `take_documents`.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, word_count

WEIGHTS = (3, 1, 2)
SHARE = Fraction(3, 2)
MOST_TIMES = 2
BITS = 12


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE, most: int = MOST_TIMES) -> dict[str | None, float]:
    """Targets of sources in code point order, null last: shares by weight, stopped at `most` times the source, the rest shared again."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    budget, out, free = share * sum(sizes.values()), {}, list(order)
    while free:
        rest, total = budget - sum(out.values()), sum(weight[s] for s in free)
        over = [s for s in free if rest * weight[s] / total > most * sizes[s]]
        if not over:
            out |= {s: rest * Fraction(weight[s], total) for s in free}
            break
        out |= {s: Fraction(most * sizes[s]) for s in over}
        free = [s for s in free if s not in out]
    return {s: float(out[s]) for s in order}


def _sized(docs: DataFrame, p: str) -> DataFrame:
    key = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 1, 6), 16, 10).cast("long")
    return docs.withColumns({f"{p}size": word_count(F.col("text")), f"{p}key": key})


def _thresholds(sized: DataFrame) -> DataFrame:
    """One row per source: source, source_size, target, times (copies of every document), cut (keys up to it get one more copy)."""
    spark, half = sized.sparkSession, F.lit(1 << BITS)
    hist = materialize(sized.groupBy("source", F.floor(F.col("key") / half).cast("long").alias("bucket")).agg(F.sum("size").alias("size")), "mix-histogram")
    # Sources are the catalogue that weights are given for; each is one row here.
    sizes = {r["source"]: r["size"] for r in hist.groupBy("source").agg(F.sum("size").alias("size")).collect()}
    rows = []
    for s, t in targets(sizes).items():
        times = min(MOST_TIMES, int(t // sizes[s])) if sizes[s] else 0
        rows.append((s, sizes[s], t, times, t - times * sizes[s]))
    goal = spark.createDataFrame(rows, "source string, source_size long, target double, times int, rest double").withColumn("none", F.col("source").isNull())
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    run = Window.partitionBy("source").orderBy("bucket")
    h = hist.withColumn("upto", F.sum("size").over(run))
    h = h.join(goal, same(h, goal)).select(h["*"], "rest").where((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("size") < F.col("rest")) & (F.col("size") > 0))
    edge = h.select("source", "bucket", (F.col("upto") - F.col("size")).alias("before"), "rest")
    inside = sized.withColumn("bucket", F.floor(F.col("key") / half).cast("long"))
    inside = inside.join(edge, same(inside, edge) & (inside["bucket"] == edge["bucket"])).select(inside["source"], inside["key"], inside["size"], edge["before"], edge["rest"])
    fine = inside.groupBy("source", "key", "before", "rest").agg(F.sum("size").alias("size"))
    fine = fine.withColumn("upto", F.col("before") + F.sum("size").over(Window.partitionBy("source").orderBy("key")))
    # The budget ends at one key: with it or without it, whichever is nearer.
    fine = fine.where((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("size") < F.col("rest")) & (F.col("size") > 0))
    cut = fine.select("source", F.when(F.col("upto") - F.col("rest") < F.col("rest") - (F.col("upto") - F.col("size")), F.col("key")).otherwise(F.col("key") - 1).alias("cut"))
    return goal.join(cut, same(goal, cut), "left").select(goal["source"], "source_size", "target", "times", F.coalesce(F.col("cut"), F.lit(-1)).alias("cut"))


def _times(cut: DataFrame, key) -> F.Column:
    return (cut["times"] + (key <= cut["cut"]).cast("int")).cast("long")


def plan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    sized = materialize(_sized(docs.select("doc_id", "source", "text"), "").drop("text"), "mix-sizes")
    cut = materialize(_thresholds(sized), "mix-cuts")
    out = sized.join(cut, sized["source"].eqNullSafe(cut["source"]))
    return out.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), (F.col("size") * _times(cut, sized["key"])).alias("taken"))


def take_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: each document as often as it is taken (not at all, once or twice), with its own columns."""
    p = "_mixing_"
    cut = materialize(_thresholds(materialize(_sized(docs.select("doc_id", "source", "text"), "").drop("text"), "mix-sizes")), "mix-cuts")
    cut = cut.withColumnRenamed("source", f"{p}source")
    keyed = _sized(docs, p).drop(f"{p}size")
    out = keyed.join(cut, keyed["source"].eqNullSafe(cut[f"{p}source"])).withColumn(f"{p}times", _times(cut, F.col(f"{p}key")))
    return out.where(F.col(f"{p}times") > 0).withColumn(f"{p}copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col(f"{p}times")))).select(*docs.columns)

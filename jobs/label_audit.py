"""Job 2: how well labels that are described in free text agree with curated labels, by subject and run.

    python -m jobs.label_audit --documents PATH --labels PATH --out FOLDER [--config FILE]

Sites describe channels in words, and labels are made of what those words say; before that is trusted it is held against
labels that were given by hand.  A row's score is how many of the `terms` its whole text contains (ASCII letters in any
case).  Each subject is judged by a cut that the others give, leaving it out: midway between the mean score of their labelled and
of their unlabelled rows.  Below `out` are written

* `described/subject=...`: run, channel, y, score, predicted of every row that has a label;
* `metrics/subject=...`: per run the sizes, the confusion at the subject's cut, accuracy, sensitivity, specificity, the area
  under the curve and the average precision.

Both are written whole, so a rerun gives the same tables.  Rows without a label are not judged; a null text has score 0; a null
subject or run is one like others; where the other subjects have rows of one class only, nothing is predicted positive.

Scores are few and metrics are sums over (subject, run, score), so no subject's rows meet in one task; files of a large
subject are split by `rebalance`.
"""

from __future__ import annotations

import functools
import logging
import operator
import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import support
from sulcus.operators import evaluation as L

log = logging.getLogger("label_audit")

RUN = ["subject", "run"]
#: Stands for a null subject or run, which partitions and joins by key would leave out.
NONE = "(none)"
DESCRIBED = "run string, channel long, y int, score long, predicted int, subject string"
METRICS = "run string, n_channels long, n_soz long, tp long, fp long, fn long, tn long, acc double, sen double, spec double, auc double, ap double, cut double, subject string"


def described(documents: DataFrame, labels: DataFrame, config: dict) -> DataFrame:
    """(subject, run, channel, y, score): labelled rows and how many of the terms they contain."""
    text = F.translate(F.coalesce(F.expr(config["text"]), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    named = {name: F.coalesce(F.expr(config[name]).cast("string"), F.lit(NONE)) for name in RUN}
    d = documents.select(*[c.alias(n) for n, c in named.items()], F.expr(config["channel"]).cast("long").alias("channel"), text.alias("text"))
    hits = [F.contains("text", F.lit(t)).cast("long") for t in config["terms"]]
    d = d.select(*RUN, "channel", functools.reduce(operator.add, hits, F.lit(0).cast("long")).alias("score"))
    y = labels.select(F.expr(config["channel"]).cast("long").alias("channel"), F.expr(config["label"]).cast("int").alias("y")).na.drop()
    return d.join(y, "channel").select(*RUN, "channel", "y", "score")


def cuts(x: DataFrame) -> DataFrame:
    """(subject, cut): midway between the other subjects' mean scores of the two classes, from one row per subject."""
    y, s = F.col("y"), F.col("score")
    own = x.groupBy("subject").agg(F.sum(y).alias("p"), F.sum(1 - y).alias("n"), F.sum(y * s).alias("sp"), F.sum((1 - y) * s).alias("sn"))
    all_ = own.agg(*[F.sum(c).alias(f"all_{c}") for c in ("p", "n", "sp", "sn")])  # one row
    rest = own.crossJoin(F.broadcast(all_))
    mean = lambda total, count: F.try_divide((F.col(f"all_{total}") - F.col(total)).cast("double"), (F.col(f"all_{count}") - F.col(count)).cast("double"))
    return rest.select("subject", ((mean("sp", "p") + mean("sn", "n")) / 2).alias("cut"))


def metrics(x: DataFrame, cut: DataFrame) -> DataFrame:
    """x: subject, run, channel, y, score, predicted.  One row per subject and run."""
    judged = L.with_auc(x.withColumn("score", F.col("score").cast("double")), 0.0, RUN).select(*RUN, "n_channels", "n_soz", "auc")
    at_cut = L.confusion(x.withColumn("score", F.col("predicted")), 1.0, RUN)
    return judged.join(at_cut, RUN).join(L.average_precision(x, RUN), RUN, "left").join(cut, "subject")


def output(spark: SparkSession, out: str) -> DataFrame:
    """Every judged row, with the accuracy, sensitivity, specificity, areas and cut of its run."""
    rows, of = (spark.read.schema(schema).parquet(f"{out}/{name}") for name, schema in (("described", DESCRIBED), ("metrics", METRICS)))
    return rows.join(of.select(*RUN, "n_soz", "acc", "sen", "spec", "auc", "ap", "cut"), RUN)


def run(spark: SparkSession, documents: str, labels: str, out: str, config: dict | None = None) -> DataFrame:
    """Judges all labelled rows of `documents` and writes the tables below `out`; returns `output`."""
    config = support.defaults("label_audit") | (config or {})
    given = spark.read.parquet(documents), spark.read.parquet(labels)
    x = described(*given, config)
    cut = cuts(x)
    x = x.join(cut, "subject").withColumn("predicted", F.coalesce(F.col("score") > F.col("cut"), F.lit(False)).cast("int"))
    write = lambda df, name, schema: df.select(*[c.split()[0] for c in schema.split(", ")]).hint("rebalance", "subject").write.mode("overwrite").partitionBy("subject").parquet(f"{out}/{name}")
    write(x, "described", DESCRIBED)
    rows = spark.read.schema(DESCRIBED).parquet(f"{out}/described")
    log.info("read %d rows of %s and %d of %s", given[0].count(), documents, given[1].count(), labels)
    # What is written is read again, so texts are gone through once.
    write(metrics(rows, cuts(rows)), "metrics", METRICS)
    runs = spark.read.schema(METRICS).parquet(f"{out}/metrics")
    log.info("wrote %d judged rows and the metrics of %d runs below %s", rows.count(), runs.count(), out)
    return output(spark, out)


if __name__ == "__main__":
    support.main("label_audit", __doc__, ("documents", "labels"), run)

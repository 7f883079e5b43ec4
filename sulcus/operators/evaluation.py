"""Features, splits, learning and metrics of channel-level localisation."""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.classification import RandomForestClassifier as ForestOfPasses
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import forests
from .forests import RandomForestClassifier


def minmax_metrics(x: DataFrame, keys: list[str]) -> DataFrame:
    """Finite range per group to 0..1; infinities to the ends, NaN stays; a constant group is 0.5 throughout, one without finite values 0."""
    v = F.col("value")
    finite = F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)
    w = Window.partitionBy(*keys)
    lo, hi = F.min(finite).over(w), F.max(finite).over(w)
    # Spark orders NaN above all numbers, so it must not meet least().
    scaled = F.when(F.isnan(v), v).otherwise(F.least(F.greatest(F.try_divide(v - lo, hi - lo), F.lit(0.0)), F.lit(1.0)))
    return x.withColumn("value", F.when(lo.isNull(), 0.0).when(hi == lo, 0.5).otherwise(scaled))


def time_bins(x: DataFrame, bins: int, keys: list[str], time: str = "op_window") -> DataFrame:
    """Mean per bin; the first n % bins bins are longer by one window.  NaN is left out, and a bin of nothing but NaN is 0."""
    place = x.select(*keys, time).distinct().withColumn("bin", (F.ntile(bins).over(Window.partitionBy(*keys).orderBy(time)) - 1).cast("long"))
    value = F.when(~F.isnan("value"), F.col("value"))
    rest = [c for c in x.columns if c not in (*keys, time, "value")]
    return x.join(place, [*keys, time]).groupBy(*keys, *rest, "bin").agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("value"))


def top_modes(x: DataFrame, modes: int) -> DataFrame:
    """The first modes of each window; asking for more than there are is an error."""
    have = x.agg(F.max("mode")).first()[0]
    if modes < 1 or have is not None and modes > have + 1:
        raise ValueError(f"{modes} modes are asked for, and there are {0 if have is None else have + 1}")
    return x.where(F.col("mode") < modes)


def feature_vectors(binned: DataFrame, modes: int, metrics: int, keys: list[str]) -> DataFrame:
    """One array per channel, in order of ((bin * modes) + mode) * metrics + metric."""
    index = (F.col("bin") * modes + F.col("mode")) * metrics + F.col("metric")
    return binned.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(index.alias("k"), "value"))).alias("f")).select(*keys, F.col("f.value").alias("features"))


def minmax(value: Column, over: Window) -> Column:
    """A value by its group's range without NaN, which stays NaN; all 0 where the range is 0 or infinite, or nothing but NaN is there."""
    v = F.when(~F.isnan(value), value)
    lo, hi = F.min(v).over(over), F.max(v).over(over)
    endless = lo.isNull() | (F.abs(lo) == float("inf")) | (F.abs(hi) == float("inf"))
    return F.when(endless, 0.0).when(hi - lo < 1e-12, 0.0).otherwise((value - lo) / (hi - lo + 1e-12))


def minmax_scores(x: DataFrame, keys: list[str]) -> DataFrame:
    return x.withColumn("score", minmax(F.col("score"), Window.partitionBy(*keys)))


def confusion(x: DataFrame, cut: float, keys: list[str]) -> DataFrame:
    p, y = F.col("score") >= cut, F.col("y") == 1
    g = x.groupBy(*keys).agg(F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & y).alias("fn"), F.count_if(~p & ~y).alias("tn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return g.select(*keys, "tp", "fp", "fn", "tn", ratio(tp + tn, tp + fp + fn + tn).alias("acc"), ratio(tp, tp + fn).alias("sen"), ratio(tn, tn + fp).alias("spec"))


def roc_auc(x: DataFrame, keys: list[str], single_class: float | None = 0.5) -> DataFrame:
    """Mann-Whitney statistic with tied ranks averaged."""
    per = x.groupBy(*keys, "score").agg(F.sum("y").alias("p"), F.count(F.lit(1)).alias("n"))  # ties meet before the window
    w = Window.partitionBy(*keys).orderBy("score")
    per = per.withColumn("rank", F.sum("n").over(w) - F.col("n") + (F.col("n") + 1) / 2)
    g = per.groupBy(*keys).agg(F.sum(F.col("rank") * F.col("p")).alias("r"), F.sum("p").alias("np"), F.sum(F.col("n") - F.col("p")).alias("nn"))
    auc = F.try_divide(F.col("r") - F.col("np") * (F.col("np") + 1) / 2, (F.col("np") * F.col("nn")).cast("double"))
    return g.select(*keys, (F.coalesce(auc, F.lit(single_class)) if single_class is not None else auc).alias("auc"))


def average_precision(x: DataFrame, keys: list[str]) -> DataFrame:
    per = x.groupBy(*keys, "score").agg(F.sum("y").alias("p"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys).orderBy(F.desc("score"))
    per = per.withColumns({"cp": F.sum("p").over(w), "cn": F.sum("n").over(w), "tp": F.sum("p").over(Window.partitionBy(*keys))})
    return per.where("tp > 0").groupBy(*keys).agg(F.sum(F.col("p") / F.col("tp") * F.col("cp") / F.col("cn")).alias("ap"))


def _ranked(x: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys)
    return x.withColumns({"rank": F.row_number().over(w.orderBy(F.desc("score"), F.desc("channel"))), "pos": F.sum("y").over(w), "n": F.count(F.lit(1)).over(w)})


def topk_metrics(x: DataFrame, keys: list[str]) -> DataFrame:
    """Accuracy, balanced accuracy, precision, recall and F1 when as many channels are named as there are positives (one at least)."""
    p, y = F.col("rank") <= F.greatest("pos", F.lit(1)), F.col("y") == 1
    g = _ranked(x, keys).groupBy(*keys).agg(F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & y).alias("fn"), F.count_if(~p & ~y).alias("tn"))
    ratio = lambda a, b: F.try_divide(F.expr(a).cast("double"), F.expr(b).cast("double"))
    sen, spec = ratio("tp", "tp + fn"), ratio("tn", "tn + fp")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    balanced = F.when(sen.isNull(), spec).when(spec.isNull(), sen).otherwise((sen + spec) / 2)
    return g.select(*keys, ratio("tp + tn", "tp + fp + fn + tn").alias("accuracy"), balanced.alias("balanced_accuracy"), zero(ratio("tp", "tp + fp")).alias("precision"), zero(sen).alias("recall"), zero(ratio("2 * tp", "2 * tp + fp + fn")).alias("f1"))


def hit_recall_at_k(x: DataFrame, keys: list[str], ks=(1, 3, 5)) -> DataFrame:
    """hit and recall among the first k channels, k also the number of positives; k is capped at the number of channels, and distinct."""
    r = _ranked(x, keys)
    k = F.array_distinct(F.transform(F.array(*[F.lit(v).cast("long") for v in ks], F.greatest("pos", F.lit(1)).cast("long")), lambda v: F.least(v, F.col("n"))))
    r = r.withColumn("k", F.explode(k))
    g = r.groupBy(*keys, "k").agg(F.sum(F.when(F.col("rank") <= F.col("k"), F.col("y")).otherwise(0)).alias("h"), F.max("pos").alias("pos"))
    return g.select(*keys, "k", (F.col("h") > 0).cast("long").alias("hit"), F.coalesce(F.try_divide(F.col("h").cast("double"), F.col("pos").cast("double")), F.lit(0.0)).alias("recall"))


def summary(x: DataFrame, columns: list[str]) -> DataFrame:
    long = x.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("v")) for c in columns])).alias("s")).select("s.*")
    v = F.when(~F.isnan("v"), F.col("v"))
    return long.groupBy("metric").agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), F.count(v).alias("n"))


def mean_score(x: DataFrame) -> DataFrame:
    return x.groupBy("subject", "channel").agg(F.avg("score").alias("score"), F.max("y").alias("y"))


def order_hash(seed: int, *cols: str) -> Column:
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in cols], F.lit(str(seed))))


def undersample(x: DataFrame, seed: int, keys: list[str], id_cols: list[str], keep_positives: bool = False) -> DataFrame:
    """As many rows of each class as the smaller has, by hash order; groups of one class stay.  keep_positives: all of class 1."""
    per = x.groupBy(*keys).agg(F.sum("y").alias("_p"), F.sum(1 - F.col("y")).alias("_n"))
    r = x.join(per, keys).withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "y").orderBy(order_hash(seed, *id_cols), *id_cols)))
    least = F.least("_p", "_n")
    keep = (least == 0) | (F.col("_r") <= least)
    return r.where(keep | (F.col("y") == 1) if keep_positives else keep).select(*x.columns)


def oversample(x: DataFrame, seed: int, keys: list[str], id_cols: list[str]) -> DataFrame:
    """As many rows of each class as the larger has: whole copies, and for the rest the first by hash order."""
    per = x.groupBy(*keys).agg(F.sum("y").alias("_p"), F.sum(1 - F.col("y")).alias("_n"))
    r = x.join(per, keys).withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "y").orderBy(order_hash(seed, *id_cols), *id_cols)))
    own, most = F.when(F.col("y") == 1, F.col("_p")).otherwise(F.col("_n")), F.greatest("_p", "_n")
    times = F.floor(most / own).cast("long") + (F.col("_r") <= most % own).cast("long")
    return r.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), times))).select(*x.columns, "copy")


def loso_split(subjects: DataFrame) -> DataFrame:
    """(fold, subject) for every training subject of each fold: one row per pair of subjects, not of their rows."""
    return subjects.select(F.col("subject").alias("fold")).join(subjects, F.col("fold") != F.col("subject"))


def standardise(train: DataFrame, test: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """Population z-scores by the training rows; constant features are only centred."""
    s = train.agg(*[f(F.get("features", F.lit(k))).alias(f"{m}{k}") for k in range(n) for m, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    mean, dev = F.array(*[F.lit(float(s[f"m{k}"])) for k in range(n)]), F.array(*[F.lit(float(s[f"s{k}"]) or 1.0) for k in range(n)])
    apply = lambda d: d.withColumn("features", F.transform(F.arrays_zip(F.col("features").alias("x"), mean.alias("m"), dev.alias("s")), lambda z: (z["x"] - z["m"]) / z["s"]))
    return apply(train), apply(test)


def first_by_hash(x: DataFrame, n: int, seed: int, ids: list[str]) -> DataFrame:
    """The n rows of the smallest hashes, ties by ids: whole buckets of hashes, and of the bucket at the edge its first rows.

    Only the edge bucket, one of 4,096, is sorted; the buckets' counts come to the driver.
    """
    h = x.withColumn("_h", order_hash(seed, *ids)).withColumn("_b", F.conv(F.substring("_h", 1, 3), 16, 10).cast("int"))
    edge, left = -1, n
    for r in sorted(h.groupBy("_b").count().collect()):
        edge = r["_b"]
        if r["count"] >= left:
            break
        left -= r["count"]
    place = F.row_number().over(Window.partitionBy("_b").orderBy("_h", *ids))
    some = h.where(F.col("_b") == edge).withColumn("_r", place).where(F.col("_r") <= left)
    return h.where(F.col("_b") < edge).select(*x.columns).unionByName(some.select(*x.columns))


def balance_rows(x: DataFrame, how: str, seed: int) -> DataFrame:
    """x: subject, (run,) channel, y.  none: all rows; undersample, oversample: classes of equal size; positives: all of class 1 and as many others.

    Rows of one class only stay as they are.
    """
    if how not in ("none", "undersample", "oversample", "positives"):
        raise ValueError(f"no way to balance called {how!r}")
    n = {int(r["y"]): r["count"] for r in x.groupBy("y").count().collect()}
    if how == "none" or len(n) < 2 or n[0] == n[1]:
        return x
    ids = [c for c in ("subject", "run", "channel") if c in x.columns]
    few, many = sorted(n, key=n.get)
    if how == "oversample":
        copies = x.where(F.col("y") == few).withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(n[many] // n[few])))).drop("_k")
        out = x.where(F.col("y") == many).unionByName(copies)
        return out.unionByName(first_by_hash(x.where(F.col("y") == few), n[many] % n[few], seed, ids)) if n[many] % n[few] else out
    if how == "positives" and many == 1:
        return x
    return x.where(F.col("y") == few).unionByName(first_by_hash(x.where(F.col("y") == many), n[few], seed, ids))


def dealt(x: DataFrame, rows: int, keys: list[str], least: int = 500) -> DataFrame:
    """x, of about `rows` rows, in partitions of `least` to 200,000 rows, about as many as there are cores, in order of keys.

    Learners pass over their rows hundreds of times, and each pass starts a task for every partition and sends its sums to the driver.
    """
    cores = x.sparkSession.sparkContext.defaultParallelism
    return x.repartition(max(1, min(cores, -(-rows // least)), -(-rows // 200_000)), *keys).sortWithinPartitions(*keys)


#: Rows of a partition while a forest grows by passes, at least: each partition sends sums for every node of every tree, so fewer send less.
FOREST_ROWS = 100_000
#: Rows times trees of a task that grows trees.
AT_ONCE = 3_000_000
#: A fold's tasks that run at a time.
PARTS_AT_ONCE = 16
#: Rows times trees of a forest that grows at once by passes.  Nodes grow with both, and the driver has them all while the forest grows.
PASSES_AT_ONCE = 500_000


def parts_of_forest(trees: int, rows: int, most: int | None = None) -> list[int]:
    """Numbers of trees of the forests that are judged as one: each is a task, or grows by passes, one after another."""
    n = -(-trees // max(1, (most or AT_ONCE) // rows))
    return [trees // n + (k < trees % n) for k in range(n)]


def _mean(sums: DataFrame, keys: list[str], trees: int) -> DataFrame:
    """Parts' sums (value) over all trees, added in one order."""
    added = F.aggregate(F.array_sort(F.collect_list("value")), F.lit(0.0), lambda a, b: a + b)
    return sums.groupBy(*keys).agg((added / trees).alias("score"))


def _kept(p: DataFrame) -> DataFrame:
    """Made now, in the checkpoint folder if there is one."""
    if p.sparkSession.sparkContext.getCheckpointDir():
        return p.checkpoint()
    p.persist().count()
    return p


def forest_in_tasks(train: DataFrame, test: DataFrame, keys: list[str], rows: int, trees: int, depth: int, seed: int, leaf: int, split: int) -> tuple[DataFrame, list[float]]:
    """Scores of test (keys, y, features) and importances by a forest over train (weight too), some trees a task."""
    names = [*keys, "y", "weight", "features"]
    both = train.select(names).unionByName(test.withColumn("weight", F.lit(None).cast("double")).select(names)).coalesce(1).persist()
    both.count()  # else each task would make the rows
    some = parts_of_forest(trees, rows)
    parts = [
        RandomForestClassifier(numTrees=k, maxDepth=depth, minInstancesPerNode=leaf, minInstancesPerSplit=split, seed=seed, first=sum(some[:i])).fit(both).persist()
        for i, k in enumerate(some)
    ]
    with ThreadPool(min(len(parts), PARTS_AT_ONCE)) as pool:  # a union of single partitions would be one task
        pool.map(DataFrame.count, parts, 1)
    sums = parts[0]
    for part in parts[1:]:
        sums = sums.unionByName(part)
    gains = {r["feature"]: r["score"] for r in _mean(sums.where("feature IS NOT NULL"), ["feature"], trees).collect()}
    total = sum(gains.values())
    p = _kept(_mean(sums.where("feature IS NULL"), [*keys, "y", "place"], trees).select(*keys, F.col("y").cast("int").alias("y"), "score"))
    for made in (*parts, both):
        made.unpersist()
    return p, [gains[k] / total if total else 0.0 for k in sorted(gains)]


def forest_by_passes(train: DataFrame, test: DataFrame, keys: list[str], rows: int, trees: int, depth: int, seed: int, leaf: int) -> tuple[DataFrame, list[float]]:
    """The same by Spark's forests, which pass over the distributed rows for each level of some trees, with binned splits."""
    kept = lambda p: p.checkpoint() if p.sparkSession.sparkContext.getCheckpointDir() else p
    train, test = (d.withColumn("v", array_to_vector("features")) for d in (train, test))
    train, parts, total = train.select("v", "y", "weight").persist(), [], 0.0
    for k, some in enumerate(parts_of_forest(trees, rows, PASSES_AT_ONCE)):
        # Seeds lie far apart: a partition's draws start from the seed and its number.
        m = (
            ForestOfPasses(featuresCol="v", labelCol="y", weightCol="weight", numTrees=some, maxDepth=depth, minInstancesPerNode=leaf, featureSubsetStrategy="sqrt", cacheNodeIds=True, seed=seed + k * 1_000_003)
            .fit(train)
        )
        total = total + m.featureImportances.toArray() * some
        scored = m.transform(test).select(*keys, F.col("y").cast("int").alias("y"), (vector_to_array("probability")[1] * some).alias("value"))
        parts.append(kept(scored))
    train.unpersist()
    p = parts[0]
    for q in parts[1:]:
        p = p.unionByName(q)
    return kept(_mean(p, [*keys, "y"], trees)), [float(v) for v in total / trees]


def loso(x: DataFrame, model: str = "forest", trees: int = 300, depth: int = 20, seed: int = 42, balance: str = "undersample", leaf: int = 2, parallel: int = 10, split: int = 5) -> dict[str, DataFrame]:
    """Leave one subject out.  x: subject, (run,) channel, features (array), y.  Gives predictions, importances, folds and skipped folds.

    balance: see balance_rows; classes left unequal weigh the same.  The driver loops over subjects, of which there are tens, and fits
    `parallel` of them at a time; the rows stay distributed.  With a checkpoint folder, predictions are kept there.
    A fold's trees are dealt over tasks while the fold's rows fit one (see forests.fits), and else grow by Spark's forests, which know
    no `split` (rows of a node that may be split, at least).  Either way they grow in parts, and scores and importances are means over all trees.
    """
    spark = x.sparkSession
    keys = [c for c in ("subject", "run", "channel") if c in x.columns]
    # Each fold reads the features again, so they are kept.
    made = x.withColumn("y", F.col("y").cast("double")).persist()
    every = made.count()
    x = dealt(made, every, keys).persist()
    first = x.first()
    n = len(first["features"]) if first else 0
    if model not in ("forest", "logistic"):
        raise ValueError(f"no model called {model!r}")

    def fold(s) -> tuple:
        """Predictions, importances, row of folds and row of skipped folds."""
        raw, test = x.where(F.col("subject") != s), x.where(F.col("subject") == s)
        before = {r["y"]: r["count"] for r in raw.groupBy("y").count().collect()}
        if len(before) < 2:
            return [], [], [], [(s, "training data has only one class")]
        balanced = dealt(balance_rows(raw, balance, seed), sum(before.values()), keys, FOREST_ROWS if model == "forest" else 500).persist()
        count = {r["y"]: r["count"] for r in balanced.groupBy("y").count().collect()}
        train, test = standardise(balanced, test, n)
        rows = sum(count.values())
        train = train.withColumn("weight", F.when(F.col("y") == 1, rows / 2 / count[1.0]).otherwise(rows / 2 / count[0.0]))
        imps = []
        if model == "forest" and forests.fits(rows + every - sum(before.values()), n):
            p, imps = forest_in_tasks(train, test, keys, rows, trees, depth, seed, leaf, split)
        elif model == "forest":
            p, imps = forest_by_passes(train, test, keys, rows, trees, depth, seed, leaf)
        else:
            train, test = (d.withColumn("v", array_to_vector("features")) for d in (train, test))
            m = LogisticRegression(featuresCol="v", labelCol="y", weightCol="weight", regParam=1.0 / rows, standardization=False, maxIter=2000).fit(train)
            p = m.transform(test).select(*keys, F.col("y").cast("int").alias("y"), vector_to_array("probability")[1].alias("score"))
            p = p.checkpoint() if spark.sparkContext.getCheckpointDir() else p
        balanced.unpersist()
        return [p], [(s, k, v) for k, v in enumerate(imps)], [(s, sum(before.values()), before[1.0], rows, count[1.0])], []

    subjects = sorted(r["subject"] for r in x.select("subject").distinct().collect())
    made.unpersist()
    with ThreadPool(parallel) as pool:
        done = pool.map(fold, subjects, 1)
    preds, imps, folds, skipped = ([r for f in done for r in f[k]] for k in range(4))
    kinds = dict(x.dtypes)
    empty = ", ".join(f"{c} {kinds[c]}" for c in keys) + ", y int, score double"
    out = preds[0] if preds else spark.createDataFrame([], empty)
    for p in preds[1:]:
        out = out.unionByName(p)
    kind = kinds["subject"]
    return {
        "predictions": out,
        "importances": spark.createDataFrame(imps, f"fold {kind}, feature long, importance double"),
        "folds": spark.createDataFrame(folds, f"subject {kind}, train_rows long, train_positives long, balanced_rows long, balanced_positives long"),
        "skipped": spark.createDataFrame(skipped, f"subject {kind}, reason string"),
    }


def baseline(x: DataFrame, model: str = "forest", seed: int = 0) -> dict[str, DataFrame]:
    """The baselines' evaluation: NaN and infinities as 0, all positives and as many others, trees as deep as Spark's can be, ranking metrics per subject."""
    clean = x.withColumn("features", F.transform("features", lambda v: F.when(F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(F.coalesce(v, F.lit(0.0)))))
    out = loso(clean, model, 300, 30, seed, "positives", 1, split=2)
    return out | {"metrics": ranking_metrics(out["predictions"])}


def ranking_metrics(p: DataFrame) -> DataFrame:
    """p: subject, channel, y, score, judged as they are.  Per subject: areas (null for one class), metrics of the top k, sizes."""
    size = p.groupBy("subject").agg(F.count(F.lit(1)).alias("n_channels"), F.sum("y").cast("long").alias("n_soz"))
    return size.join(roc_auc(p, ["subject"], None), "subject").join(average_precision(p, ["subject"]), "subject", "left").join(topk_metrics(p, ["subject"]), "subject")


def with_auc(p: DataFrame, cut: float, keys: list[str]) -> DataFrame:
    size = p.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_channels"), F.sum("y").cast("long").alias("n_soz"))
    return size.join(confusion(p, cut, keys), keys).join(roc_auc(p, keys), keys)


def loso_tables(result: dict[str, DataFrame], cut: float = 0.5) -> dict[str, DataFrame]:
    """The tables of a LOSO run: metrics by run and by subject (a channel's score is its mean over runs), predictions, summary, importances, and what was skipped."""
    p = result["predictions"]
    per_run = with_auc(p, cut, ["subject", "run"])
    mean = mean_score(p)
    n = p.groupBy("subject").agg(F.count_distinct("run").alias("n_runs"))
    subjects = with_auc(mean, cut, ["subject"]).join(n, "subject").join(result["folds"], "subject")
    odd = label_consistency(p).where("inconsistent").select("subject", F.lit("labels or channels differ between runs; the subject's mean may be invalid").alias("reason"))
    return {
        "subject_metrics": subjects,
        "run_metrics": per_run,
        "channel_predictions": mean.withColumn("y_pred", (F.col("score") >= cut).cast("int")),
        "summary_metrics": summary(subjects, ["acc", "sen", "spec", "auc"]),
        "skipped_subjects": result["skipped"].unionByName(odd),
        "feature_importance_by_fold": result["importances"],
        "feature_importance_mean": importance_summary(result["importances"]),
    }


def feature_names(bins: int, modes: int, metrics: list[str]) -> list[dict]:
    """What each place of a feature vector is: the bin varies slowest, the metric fastest."""
    return [{"feature": (b * modes + m) * len(metrics) + k, "bin": b, "mode": m, "metric": name} for b in range(bins) for m in range(modes) for k, name in enumerate(metrics)]


def scores_of_runs(runs: DataFrame, scores: DataFrame) -> DataFrame:
    """Scores by subject, run and channel joined to the runs' channels; a channel without a score has 0."""
    keys = ["subject", "run", "channel"]
    return runs.join(scores.select(*keys, "score"), keys, "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def subject_runs(metrics: DataFrame, soz: DataFrame, bins: int = 6, modes: int = 10, n_metrics: int = 4) -> DataFrame:
    """Node metrics (subject, run, channel, op_window, mode, metric 0.., value) as labelled feature vectors of runs with windows in `bins` bins."""
    x = top_modes(minmax_metrics(metrics, ["subject", "run", "metric"]), modes)
    vectors = feature_vectors(time_bins(x, bins, ["subject", "run"]), modes, n_metrics, ["subject", "run", "channel"])
    listed = soz.select("subject", "channel", F.lit(1).alias("_y")).distinct()
    return vectors.join(listed, ["subject", "channel"], "left").withColumn("y", F.coalesce("_y", F.lit(0))).drop("_y")


def importance_summary(imp: DataFrame) -> DataFrame:
    return imp.groupBy("feature").agg(F.avg("importance").alias("mean"), F.stddev_pop("importance").alias("std")).orderBy(F.desc("mean"))


def label_consistency(x: DataFrame) -> DataFrame:
    """Subjects whose runs disagree on labels."""
    runs = x.groupBy("subject", "run").agg(F.array_sort(F.collect_list(F.struct("channel", "y"))).alias("l"))
    return runs.groupBy("subject").agg(F.count(F.lit(1)).alias("n_runs"), (F.count_distinct("l") > 1).alias("inconsistent"))

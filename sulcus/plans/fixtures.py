"""Recordings, graphs, tensors and scores derived from the synthetic tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


#: Channels of a recording of F1, at most; a label's vectors are dealt into as many runs as that takes.
CHANNELS = 8
#: What tells recordings apart.
RUN = ["subject", "run"]


def dense_wide(spark: SparkSession, d: str) -> DataFrame:
    """subject, run, channel, samples (64 doubles), y: every vector of a label is a channel of one of its runs."""
    by = Window.partitionBy("label")
    rn, runs = F.row_number().over(by.orderBy("vec_id")) - 1, F.ceil(F.count(F.lit(1)).over(by) / CHANNELS)
    e = _read(spark, d, "embeddings").select("label", "vec_id", "embedding", rn.alias("rn"), runs.alias("runs"))
    return e.select(F.col("label").cast("long").alias("subject"), (F.col("rn") % F.col("runs")).cast("long").alias("run"), F.floor(F.col("rn") / F.col("runs")).cast("long").alias("channel"), F.col("embedding").cast("array<double>").alias("samples"), (F.col("vec_id") % 4 == 0).cast("int").alias("y"))


def long_form(wide: DataFrame) -> DataFrame:
    keep = [c for c in wide.columns if c != "samples"]
    return wide.select(*keep, F.posexplode("samples").alias("sample", "value")).withColumn("sample", F.col("sample").cast("long"))


def dense(spark: SparkSession, d: str) -> DataFrame:
    return long_form(dense_wide(spark, d))


def bursts(spark: SparkSession, d: str) -> DataFrame:
    """subject, channel, sample, value: sums over bins of 4 hours, counted from the first bin of any event to the last; empty bins are 0."""
    e = _read(spark, d, "events")
    at = F.floor(F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)") / F.lit(1e6) / 14400)
    sums = e.groupBy(F.col("event_type").alias("subject"), (F.col("user_id") % 8).cast("long").alias("channel"), at.cast("long").alias("at")).agg(F.sum("value").alias("v"))
    ends = sums.agg(F.min("at").alias("first"), F.max("at").alias("last"))  # one row
    grid = sums.select("subject", "channel").distinct().crossJoin(F.broadcast(ends)).select("subject", "channel", "first", F.explode(F.sequence("first", "last")).alias("at"))
    return grid.join(sums, ["subject", "channel", "at"], "left").select("subject", "channel", (F.col("at") - F.col("first")).alias("sample"), F.coalesce("v", F.lit(0.0)).alias("value"))


def bursts_wide(spark: SparkSession, d: str) -> DataFrame:
    rows = bursts(spark, d).groupBy("subject", "channel").agg(F.array_sort(F.collect_list(F.struct("sample", "value"))).alias("s"))
    return rows.select("subject", "channel", F.col("s.value").alias("samples"))


def trade_graphs(spark: SparkSession, d: str) -> DataFrame:
    """period, u, v, w: a directed weighted graph between nations for each year and order priority."""
    return _trade(spark, d, F.concat_ws("-", F.year("o_orderdate").cast("string"), F.substring("o_orderpriority", 1, 1)).alias("period"))


def trade_graph(spark: SparkSession, d: str) -> DataFrame:
    """u, v, w: directed weighted edges between nations."""
    return _trade(spark, d)


def _trade(spark: SparkSession, d: str, *keys: Column) -> DataFrame:
    line, orders, supp, cust = (_read(spark, d, t) for t in ("lineitem", "orders", "supplier", "customer"))
    j = line.select("l_orderkey", "l_suppkey", "l_extendedprice").join(orders.select("o_orderkey", "o_custkey", *keys), F.col("l_orderkey") == F.col("o_orderkey"))
    j = j.join(supp.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).join(cust.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    names = ["period"] if keys else []
    return (
        j.where("s_nationkey <> c_nationkey")
        .groupBy(*names, F.col("s_nationkey").cast("long").alias("u"), F.col("c_nationkey").cast("long").alias("v"))
        .agg((F.sum("l_extendedprice") / 1e6).alias("w"))
    )


def nations(spark: SparkSession, d: str) -> DataFrame:
    """The trade graph's nodes, with and without edges."""
    return _read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("channel"))


def metric_tensor(spark: SparkSession, d: str) -> DataFrame:
    """subject, channel, op_window, mode, metric, value, y; some values are NaN or infinite, and one metric of a subject is constant."""
    rn = F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))
    e = (
        _read(spark, d, "embeddings")
        .select(F.col("label").cast("long").alias("subject"), (rn - 1).cast("long").alias("channel"), F.col("embedding").cast("array<double>").alias("samples"), (F.col("vec_id") % 4 == 0).cast("int").alias("y"), "vec_id")
    )
    p, odd = F.col("sample"), (F.col("vec_id") * 64 + F.col("sample")) % 997
    value = F.when(odd == 0, float("nan")).when(odd == 1, float("inf")).when(odd == 2, float("-inf")).when((F.col("subject") == 9) & (p % 2 == 1), 0.25).otherwise(F.col("value"))
    return (
        long_form(e)
        .select("subject", "channel", F.floor(p / 4).cast("long").alias("op_window"), F.floor(p % 4 / 2).cast("long").alias("mode"), (p % 2).cast("long").alias("metric"), value.alias("value"), "y")
    )


def scores(spark: SparkSession, d: str) -> DataFrame:
    """subject, run, channel, y, score."""
    docs, labels = _read(spark, d, "documents").select("doc_id", "source", "lang", "n_chars"), _read(spark, d, "labels")
    return (
        docs.join(labels, "doc_id")
        .select(F.col("source").alias("subject"), F.col("lang").alias("run"), F.col("doc_id").alias("channel"), F.col("toxic").cast("int").alias("y"), (F.col("n_chars") / 1000.0).cast("double").alias("score"))
    )


def odd_scores(spark: SparkSession, d: str) -> DataFrame:
    """scores with NaN for every seventh channel, an infinite one in src1, a negative infinite one in src2, and nothing but NaN in src3."""
    k = F.col("channel") % 7
    odd = F.when((k == 0) | (F.col("subject") == "src3"), float("nan")).when((k == 1) & (F.col("subject") == "src1"), float("inf")).when((k == 1) & (F.col("subject") == "src2"), float("-inf"))
    return scores(spark, d).withColumn("score", odd.otherwise(F.col("score")))


def odd_signals(spark: SparkSession, d: str) -> DataFrame:
    """dense with NaN for every fifth sample of channel 1 and all samples of channel 2."""
    odd = ((F.col("channel") == 1) & (F.col("sample") % 5 == 0)) | (F.col("channel") == 2)
    return dense(spark, d).withColumn("value", F.when(odd, float("nan")).otherwise(F.col("value")))


def channels(spark: SparkSession, d: str) -> DataFrame:
    """subject, name, status, status_description."""
    p = _read(spark, d, "part")
    described = F.when(F.col("p_type") == "SMALL", "soz").when(F.col("p_type") == "PROMO", "soz,resect").when(F.col("p_type") == "LARGE", "resect")
    return p.select(F.col("p_brand").alias("subject"), F.col("p_partkey").alias("row"), F.col("p_partkey").cast("string").alias("name"), F.when(F.col("p_size") <= 40, "good").otherwise("bad").alias("status"), described.alias("status_description"))

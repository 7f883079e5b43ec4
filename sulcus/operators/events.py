"""Bursts above a robust threshold: gaps and islands in SQL once the envelope is there."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from .evaluation import minmax

#: Default keys of a channel; recordings of several runs have them in their keys.
CH = ["subject", "channel"]


def threshold(env: DataFrame, k: float = 5.0, ch: list[str] = CH) -> DataFrame:
    """Per channel: median + k * 1.4826 * (MAD + 1e-12) of the envelope, NaN left out."""
    env = env.where(~F.isnan("env"))
    mid = env.groupBy(*ch).agg(F.median("env").alias("mid"))
    mad = env.join(mid, ch).groupBy(*ch).agg(F.median(F.abs(F.col("env") - F.col("mid"))).alias("mad"))
    return mid.join(mad, ch).select(*ch, (F.col("mid") + k * 1.4826 * (F.col("mad") + 1e-12)).alias("thr"))


def islands(above: DataFrame, ch: list[str] = CH) -> DataFrame:
    """above: channel keys, sample.  Runs of consecutive samples as [start, stop)."""
    g = above.select(*ch, "sample", (F.col("sample") - F.row_number().over(Window.partitionBy(*ch).orderBy("sample"))).alias("_g"))
    return g.groupBy(*ch, "_g").agg(F.min("sample").alias("start"), (F.max("sample") + 1).alias("stop")).drop("_g")


def merge_gaps(parts: DataFrame, gap: int, ch: list[str] = CH) -> DataFrame:
    """Joins islands that are at most `gap` samples apart."""
    w = Window.partitionBy(*ch).orderBy("start")
    new = F.when(F.col("start") - F.lag("stop").over(w) <= gap, 0).otherwise(1)
    return parts.withColumn("_n", new).withColumn("_g", F.sum("_n").over(w)).groupBy(*ch, "_g").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("_g")


def detect(x: DataFrame, env: DataFrame, sfreq: float, least: int, most: int, gap: int, k: float = 5.0, ch: list[str] = CH) -> DataFrame:
    """Events with their attributes.  x: channel keys, sample, value (centred); env: channel keys, sample, env."""
    both = env.join(x, [*ch, "sample"])
    above = both.join(threshold(env, k, ch), ch).where("env > thr")
    found = merge_gaps(islands(above, ch), gap, ch).where(F.col("stop") - F.col("start") >= least).where(F.col("stop") - F.col("start") <= most)
    # Samples meet events by an equi-join on the samples an event covers, not by a range.
    cover = found.select(*ch, "start", "stop", F.explode(F.sequence(F.col("start"), F.col("stop") - 1)).alias("sample"))
    g = (
        cover.join(both, [*ch, "sample"])
        .groupBy(*ch, "start", "stop")
        .agg(F.max("env").alias("peak_amp"), F.avg("env").alias("mean_amp"), F.array_sort(F.collect_list(F.struct("sample", "value"))).alias("_s"))
    )
    # An event has `most` samples at most; squares are added in their order, so reruns agree to the last digit.
    g = g.withColumn("power", F.aggregate("_s", F.lit(0.0), lambda a, v: a + v["value"] * v["value"]) / F.size("_s")).drop("_s")
    return g.withColumn("duration_s", (F.col("stop") - F.col("start")) / sfreq)


def detect_wide(wide: DataFrame, sfreq: float, least: int, most: int, gap: int, k: float = 5.0, ch: list[str] = CH) -> DataFrame:
    """The same events, and each channel's length and power, from whole channels: one kernel call a channel, without a shuffle.

    wide: channel keys, samples (not yet centred).  A channel without events has one row of null start.  Power is that of the samples
    as they are, NaN left out; a channel with a NaN sample has no envelope and so no events.
    """
    kinds = dict(wide.dtypes)
    schema = "".join(f"{c} {kinds[c]}, " for c in ch) + "start long, stop long, peak_amp double, mean_amp double, power double, duration_s double, n long, band_power double"

    def run(batches):
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                keys = [getattr(r, c) for c in ch]
                x = np.asarray(r.samples, dtype=float)
                known = x[~np.isnan(x)]
                n, power = len(x), float((known * known).mean()) if len(known) else float("nan")
                x = x - np.median(x)
                found = K.burst_events(x, np.abs(K.analytic(x)), least, most, gap, k)
                rows += [(*keys, *e, (e[1] - e[0]) / sfreq, n, power) for e in found] or [(*keys, None, None, None, None, None, None, n, power)]
            out = pd.DataFrame(rows, columns=[*ch, "start", "stop", "peak_amp", "mean_amp", "power", "duration_s", "n", "band_power"])
            yield out.astype({"start": "Int64", "stop": "Int64"})

    return wide.select(*ch, "samples").mapInPandas(run, schema)


def rate(events: DataFrame, lengths: DataFrame, sfreq: float, ch: list[str] = CH) -> DataFrame:
    """Events per minute; lengths: channel keys, n."""
    c = events.groupBy(*ch).agg(F.count(F.lit(1)).alias("c"))
    minutes = F.greatest(F.col("n") / sfreq / 60, F.lit(1e-12))
    return lengths.join(c, ch, "left").select(*ch, F.coalesce("c", F.lit(0)).cast("long").alias("n_events"), (F.coalesce("c", F.lit(0)) / minutes).alias("rate"))


def features(found: DataFrame, sfreq: float, run: list[str] = ["subject"]) -> DataFrame:
    """Per channel, from `detect_wide`: count, rate, attributes of its events, power; and all but the count scaled to the run's range as ..._norm."""
    minutes = F.greatest(F.max("n") / sfreq / 60, F.lit(1e-12))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    g = found.groupBy(*run, "channel").agg(
        F.count("start").alias("n_events"), (F.count("start") / minutes).alias("rate"), F.max("band_power").alias("band_power"), zero(F.avg("peak_amp")).alias("peak_mean"),
        zero(F.median("peak_amp")).alias("peak_median"), zero(F.avg("power")).alias("power_mean"), zero(F.avg("duration_s")).alias("duration_mean"),
    )
    w = Window.partitionBy(*run)
    return g.select("*", *[minmax(F.col(c), w).alias(f"{c}_norm") for c in ("rate", "band_power", "peak_mean", "peak_median", "power_mean", "duration_mean")])

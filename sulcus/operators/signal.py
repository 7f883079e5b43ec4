"""Conditioning of signals: references, scales, windows, filters."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K

RUN = ["subject"]


def average_reference(x: DataFrame, run: list[str] = RUN) -> DataFrame:
    return x.withColumn("value", F.col("value") - F.avg("value").over(Window.partitionBy(*run, "sample")))


def array_average_reference(wide: DataFrame, run: list[str] = RUN) -> DataFrame:
    """The same on one row per channel: the runs' mean signals are made sample by sample, and taken from whole channels."""
    long = wide.select(*run, F.posexplode("samples").alias("sample", "value"))
    mean = long.groupBy(*run, "sample").agg(F.avg("value").alias("value")).groupBy(*run).agg(F.transform(F.array_sort(F.collect_list(F.struct("sample", "value"))), lambda v: v["value"]).alias("_mean"))
    return wide.join(mean, run).withColumn("samples", F.zip_with("samples", "_mean", lambda v, m: v - m)).drop("_mean")


def percentile_scale(x: DataFrame, q: float = 0.95, run: list[str] = RUN) -> DataFrame:
    """Divided by the run's exact percentile."""
    top = x.groupBy(*run).agg(F.percentile("value", F.lit(q)).alias("_top"))
    return x.join(top, run).withColumn("value", F.try_divide("value", "_top")).drop("_top")


def channel_zscore(x: DataFrame, eps: float = 1e-12, run: list[str] = RUN) -> DataFrame:
    w = Window.partitionBy(*run, "channel")
    return x.withColumn("value", (F.col("value") - F.avg("value").over(w)) / (F.stddev_pop("value").over(w) + eps))


def safe_standardise(x: DataFrame, run: list[str] = RUN) -> DataFrame:
    """Centred, divided by the largest magnitude and then by the root mean square; constant channels are 0."""
    w = Window.partitionBy(*run, "channel")
    out = x.withColumn("_c", F.col("value") - F.avg("value").over(w)).withColumn("_m", F.max(F.abs("_c")).over(w))
    out = out.withColumn("_s", F.coalesce(F.try_divide("_c", "_m"), F.lit(0.0))).withColumn("_r", F.sqrt(F.avg(F.col("_s") * F.col("_s")).over(w)))
    return out.withColumn("value", F.coalesce(F.try_divide("_s", "_r"), F.lit(0.0))).drop("_c", "_m", "_s", "_r")


def robust_zscore(x: DataFrame, eps: float = 1e-12, run: list[str] = RUN) -> DataFrame:
    mid = x.groupBy(*run, "channel").agg(F.median("value").alias("_mid"))
    out = x.join(mid, [*run, "channel"])
    mad = out.groupBy(*run, "channel").agg(F.median(F.abs(F.col("value") - F.col("_mid"))).alias("_mad"))
    return out.join(mad, [*run, "channel"]).withColumn("value", (F.col("value") - F.col("_mid")) / (1.4826 * F.col("_mad") + eps)).drop("_mid", "_mad")


def window_starts(n: Column, width: int, step: int, inclusive: bool = True) -> Column:
    """Starts of full windows; without `inclusive` the last possible start is left out."""
    last = n - width - (0 if inclusive else 1)
    return F.when(last >= 0, F.sequence(F.lit(0).cast("long"), last.cast("long"), F.lit(step).cast("long"))).otherwise(F.array().cast("array<long>"))


def windows_seconds(lengths: DataFrame, width_s: float, step_s: float) -> DataFrame:
    """lengths: run columns, n, sfreq.  Sizes in samples round half to even, at least 1."""
    size = lambda s: F.greatest(F.lit(1), F.bround(F.lit(s) * F.col("sfreq"), 0)).cast("long")
    out = lengths.withColumns({"_w": size(width_s), "_s": size(step_s)})
    starts = F.when(F.col("n") >= F.col("_w"), F.sequence(F.lit(0).cast("long"), F.col("n") - F.col("_w"), F.col("_s")))
    return out.select("*", F.posexplode(starts).alias("window", "start")).withColumns({"window": F.col("window").cast("long"), "stop": F.col("start") + F.col("_w")}).drop("_w", "_s")


def segments(x: DataFrame, width: int, run: list[str] = RUN) -> DataFrame:
    """Contiguous segments of `width` samples; what is left over goes."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*run, "channel"))
    out = x.withColumns({"segment": F.floor(F.col("sample") / width).cast("long"), "_n": n})
    return out.where(F.col("segment") < F.floor(F.col("_n") / width)).drop("_n")


def sequence_targets(n_segments: DataFrame, length: int, onset_segment: int) -> DataFrame:
    """n_segments: run columns, n.  Targets from `length` on, the segments before each, and whether it lies after the onset."""
    out = n_segments.where(F.col("n") > length).select("*", F.explode(F.sequence(F.lit(length).cast("long"), F.col("n") - 1)).alias("target"))
    return out.withColumns({"first": F.col("target") - length, "last": F.col("target") - 1, "y": (F.col("target") >= onset_segment).cast("int")}).drop("n")


def sequences(segments: DataFrame, length: int, onset_segment: int, run: list[str] = RUN) -> DataFrame:
    """segments: run columns, channel, segment (from 0, without gaps), value.  For each target from `length` on: the values of the `length` segments before it, in order, and y."""
    w = Window.partitionBy(*run, "channel").orderBy("segment")
    before = F.collect_list("value").over(w.rowsBetween(-length, -1))
    out = segments.select(*run, "channel", F.col("segment").alias("target"), before.alias("sequence"))
    return out.where(F.col("target") >= length).withColumn("y", (F.col("target") >= onset_segment).cast("int"))


def delay_embedding(x: DataFrame, dim: int, tau: int, run: list[str] = RUN) -> DataFrame:
    """Coordinates e0.. of each sample that has all of them."""
    w = Window.partitionBy(*run, "channel").orderBy("sample")
    out = x.select(*run, "channel", "sample", *[F.lead("value", k * tau).over(w).alias(f"e{k}") for k in range(dim)])
    return out.where(F.col(f"e{dim - 1}").isNotNull())


def point_cap(x: DataFrame, most: int, run: list[str] = RUN) -> DataFrame:
    """`most` evenly spaced samples of each channel (all if there are no more)."""
    n = x.groupBy(*run, "channel").agg(F.count(F.lit(1)).alias("_n"))
    pick = n.select(*run, "channel", "_n", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("_n"), F.lit(most)) - 1)).alias("point"))
    pick = pick.withColumn("sample", F.when(F.col("_n") <= most, F.col("point")).otherwise(F.floor(F.col("point") * (F.col("_n") - 1) / (most - 1)).cast("long"))).drop("_n")
    return pick.join(x, [*run, "channel", "sample"])


def band_power(x: DataFrame, run: list[str] = RUN) -> DataFrame:
    """Mean square of each channel, NaN left out; NaN where nothing else is there."""
    square = F.when(~F.isnan("value"), F.col("value") * F.col("value"))
    return x.groupBy(*run, "channel").agg(F.coalesce(F.avg(square), F.lit(float("nan"))).alias("power"))


def crop(x: DataFrame, sfreq: float, onset: float, before: float = 50.0, after: float = 50.0) -> DataFrame:
    t = F.col("sample") / sfreq
    return x.where((t >= max(0.0, onset - before)) & (t <= onset + after))


def _per_channel(f) -> callable:
    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(f(np.asarray(v, dtype=float)), dtype=float) for v in s], dtype=object)

    return run


def _channels_at_once(f) -> callable:
    """f of [channel, sample]: an Arrow batch's channels of one length together, some MB at a time."""

    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        out, length = np.empty(len(s), dtype=object), s.str.len().to_numpy()
        for n in np.unique(length):
            at = np.flatnonzero(length == n)
            for part in np.array_split(at, -(-len(at) * int(n) * 8 // K.AT_ONCE)) if n else ():
                for k, v in zip(part, f(np.stack(s.to_numpy()[part]).astype(float))):
                    out[k] = v
        return pd.Series(out)

    return run


def filtered(wide: DataFrame, *steps) -> DataFrame:
    """Several kernels (functions of one channel's samples) one after another in one pass over Arrow batches."""
    return wide.withColumn("samples", _per_channel(lambda v: functools.reduce(lambda x, f: f(x), steps, v))("samples"))


def notch(wide: DataFrame, fs: float, freqs=(60.0, 180.0)) -> DataFrame:
    return wide.withColumn("samples", _per_channel(lambda v: K.notch(v, fs, freqs))("samples"))


def bandpass(wide: DataFrame, fs: float, low: float = 80.0, high: float = 200.0) -> DataFrame:
    return wide.withColumn("samples", _per_channel(lambda v: K.bandpass(v, fs, low, high))("samples"))


def butterworth(wide: DataFrame, fs: float, low: float, high: float) -> DataFrame:
    sections = K.butter_sections(fs, low, high)
    return wide.withColumn("samples", _channels_at_once(lambda x: K.sections_both_ways(x, sections))("samples"))


def resample(wide: DataFrame, fs: float, target: float = 500.0) -> DataFrame:
    return wide.withColumn("samples", _per_channel(lambda v: K.fft_resample(v, round(len(v) * target / fs)))("samples"))


def decimate(wide: DataFrame, fs: float, target: float = 50.0) -> DataFrame:
    return wide.withColumn("samples", _per_channel(lambda v: K.decimate(v, fs, target))("samples"))


def envelope(wide: DataFrame) -> DataFrame:
    return wide.withColumn("samples", _per_channel(lambda v: np.abs(K.analytic(v)))("samples"))


def analytic(wide: DataFrame) -> DataFrame:
    """Adds re and im of the analytic signal, as arrays."""
    return wide.withColumns({"re": _per_channel(lambda v: K.analytic(v).real)("samples"), "im": _per_channel(lambda v: K.analytic(v).imag)("samples")})

"""Channel tables: selection, labels, acquisition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def acquisition(path: Column) -> Column:
    return F.when(F.contains(F.lower(path), F.lit("seeg")), "seeg").when(F.contains(F.lower(path), F.lit("ecog")), "ecog").otherwise(F.raise_error(F.concat(F.lit("no acquisition in "), path)))


def good_channels(ch: DataFrame) -> DataFrame:
    """Channels of status good, numbered anew in their order."""
    return ch.where("status = 'good'").withColumn("channel", F.row_number().over(Window.partitionBy("subject").orderBy("row")).cast("long") - 1)


def labels(ch: DataFrame) -> DataFrame:
    """Good channels with their index and whether they are described as onset zone or resected."""
    has = lambda word: F.coalesce(F.contains("status_description", F.lit(word)), F.lit(False)).cast("int")
    said = ch.select("subject", "name", has("soz").alias("soz"), has("resect").alias("resected"))
    return good_channels(ch).select("subject", "channel", "name").join(said, ["subject", "name"])


def soz_first(x: DataFrame) -> DataFrame:
    return x.withColumn("place", F.row_number().over(Window.partitionBy("subject").orderBy(F.desc("soz"), "channel")).cast("long"))


def attach_labels(features: DataFrame, soz: DataFrame) -> DataFrame:
    """y = 1 for channels that are listed; listed ones that do not exist are ignored."""
    mark = soz.select("subject", "channel", F.lit(1).alias("_y")).distinct()
    return features.join(mark, ["subject", "channel"], "left").withColumn("y", F.coalesce("_y", F.lit(0))).drop("_y")


def fast_enough(recordings: DataFrame, least: float = 500.0) -> DataFrame:
    """Recordings of subjects whose first run has the sampling rate."""
    first = recordings.withColumn("_r", F.row_number().over(Window.partitionBy("subject").orderBy("run"))).where((F.col("_r") == 1) & (F.col("sfreq") >= least))
    return recordings.join(first.select("subject"), "subject", "left_semi")


def valid_subjects(x: DataFrame) -> DataFrame:
    """Subjects with a positive channel in their first run."""
    first = x.withColumn("_r", F.dense_rank().over(Window.partitionBy("subject").orderBy("run"))).where("_r = 1 and y = 1")
    return x.join(first.select("subject").distinct(), "subject", "left_semi")

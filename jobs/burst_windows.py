"""Job 1: power of channels by window, and bursts of windows, brought up to date by the files that came since the last run.

    python -m jobs.burst_windows --events PATH --out FOLDER [--config FILE]

A monitoring site adds files of values (time, subject, channel, value), in any order and also of days long past.  The job
takes each file once, by a file stream with a checkpoint (Trigger.AvailableNow), and keeps below `out`:

* `sums/batch=K/day=...`: count, sum and sum of squares of the windows that batch K had values of.  A batch that is run
  again after a failure overwrites its own folder, so nothing counts twice;
* `power/day=...`: the windows (subject, channel, window, n, mean, power), made of all sums of a day.  Only days that the
  batch had values of are written anew (dynamic partition overwrite);
* `bursts/subject=...`: runs of windows whose power is above median + deviations * 1.4826 * MAD of the channel's windows,
  joined over gaps of up to `gap` windows, with count, peak and mean power;
* `checkpoint`: which files were taken.  It belongs to this output, so it lies below the same folder.

A window is `hours` long; windows are numbered from 1970 on and belong to the day on which they begin.  Rows without a time,
subject, channel or value, and NaN values, are left out.  What a batch shuffles are sums by window, not values; bursts are
found anew from the windows, of which there are as few per channel as hours allow.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import support
from sulcus.operators import events as E

log = logging.getLogger("burst_windows")

CH = ["subject", "channel"]
SUMS = "subject string, channel long, window long, n long, total double, squares double"
POWER = "subject string, channel long, window long, n long, mean double, power double, day date"
BURSTS = "channel long, start long, stop long, n long, peak double, mean double, subject string"


def window_sums(values: DataFrame, config: dict) -> DataFrame:
    """Values to (subject, channel, window, day, n, total, squares)."""
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.expr(config["time"]).cast("timestamp_ntz"))
    x = values.select(
        F.expr(config["subject"]).cast("string").alias("subject"),
        F.expr(config["channel"]).cast("long").alias("channel"),
        F.floor(micros / (config["hours"] * 3_600_000_000)).cast("long").alias("window"),
        F.expr(config["value"]).cast("double").alias("value"),
    ).na.drop()  # nulls and NaN
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("window") * config["hours"] / 24).cast("int"))
    sums = x.groupBy(*CH, "window").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.sum(F.col("value") * F.col("value")).alias("squares"))
    return sums.withColumn("day", day)


def update_power(spark: SparkSession, values: DataFrame, batch: int, out: str, config: dict) -> None:
    """A batch's sums, and the windows of the days it touches; running it again with the same values changes nothing."""
    at = f"{out}/sums/batch={batch}"
    window_sums(values, config).hint("rebalance", "day").write.mode("overwrite").partitionBy("day").parquet(at)
    new = spark.read.schema(f"{SUMS}, day date").parquet(at)
    days = sorted(r["day"] for r in new.select("day").distinct().collect())
    if not days:
        log.info("batch %d: no values", batch)
        return
    every = spark.read.schema(f"{SUMS}, batch long, day date").parquet(f"{out}/sums").where(F.col("day").isin(days))
    whole = every.groupBy("day", *CH, "window").agg(*[F.sum(c).alias(c) for c in ("n", "total", "squares")])
    power = whole.select(*CH, "window", "n", (F.col("total") / F.col("n")).alias("mean"), (F.col("squares") / F.col("n")).alias("power"), "day")
    power.hint("rebalance", "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{out}/power")
    log.info("batch %d: %d windows with new values; wrote %d days, %s to %s", batch, new.count(), len(days), days[0], days[-1])


def find_bursts(power: DataFrame, config: dict) -> DataFrame:
    """(subject, channel, start, stop, n, peak, mean) of the runs of strong windows; n counts windows with values."""
    x = power.select(*CH, "window", "power")
    level = E.threshold(x.withColumnRenamed("power", "env"), config["deviations"], CH)
    above = x.join(level, CH).where("power > thr").select(*CH, F.col("window").alias("sample"))
    found = E.merge_gaps(E.islands(above, CH), config["gap"], CH)
    covered = found.withColumn("window", F.explode(F.sequence("start", F.col("stop") - 1)))
    return covered.join(x, [*CH, "window"]).groupBy(*CH, "start", "stop").agg(F.count(F.lit(1)).alias("n"), F.max("power").alias("peak"), F.avg("power").alias("mean"))


def output(spark: SparkSession, out: str) -> DataFrame:
    """The windows as they stand, each with the first window of the burst it lies in (null for none)."""
    bursts = spark.read.schema(BURSTS).parquet(f"{out}/bursts")
    inside = bursts.select(*CH, F.col("start").alias("burst"), F.explode(F.sequence("start", F.col("stop") - 1)).alias("window"))
    return spark.read.schema(POWER).parquet(f"{out}/power").join(inside, [*CH, "window"], "left")


def _streamed(spark: SparkSession, path: str) -> str:
    """The path as a file stream takes it: a folder as it is, one file as a pattern that only it matches."""
    bare = lambda p: p.split(":", 1)[-1].strip("/")
    first = spark.read.format("binaryFile").load(path).select("path").take(1)
    folder, _, name = path.rpartition("/")
    return f"{folder}/{{{name}}}" if first and bare(first[0]["path"]) == bare(path) else path


def run(spark: SparkSession, events: str, out: str, config: dict | None = None) -> DataFrame:
    """Takes the event files that no earlier run took into the tables below `out`; returns `output`."""
    config = support.defaults("burst_windows") | (config or {})
    # So that there is a table to read, also if no file has a value yet.
    spark.createDataFrame([], POWER).write.mode("append").partitionBy("day").parquet(f"{out}/power")
    values = spark.readStream.schema(spark.read.parquet(events).schema).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(_streamed(spark, events))
    stream = (
        values.writeStream.foreachBatch(lambda batch, k: update_power(spark, batch, k, out, config))
        .option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    )
    stream.awaitTermination()
    done = [p for p in stream.recentProgress if p["numInputRows"]]
    log.info("read %d new rows of %s in %d batches", sum(p["numInputRows"] for p in done), events, len(done))
    found = find_bursts(spark.read.schema(POWER).parquet(f"{out}/power"), config)
    found.select(*[c.split()[0] for c in BURSTS.split(", ")]).hint("rebalance", "subject").write.mode("overwrite").partitionBy("subject").parquet(f"{out}/bursts")
    whole = output(spark, out)
    log.info("%s: %d windows, %d of them in bursts", out, whole.count(), whole.where("burst IS NOT NULL").count())
    return whole


if __name__ == "__main__":
    support.main("burst_windows", __doc__, ("events",), run)

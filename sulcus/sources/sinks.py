"""Where tables go."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def signals(df: DataFrame, path: str) -> None:
    """Partitioned by subject and run, so that later reads of some subjects skip the others' files."""
    df.write.mode("overwrite").partitionBy("subject", "run").parquet(path)


def labels(df: DataFrame, path: str) -> None:
    """Onset-zone and resected channels of subjects, as lists of indices and of names.  df: subject, channel, name, soz, resected."""
    ordered = lambda flag, c: F.transform(F.array_sort(F.collect_list(F.when(F.col(flag) == 1, F.struct("channel", "name")))), lambda x: x[c])
    lists = [ordered(flag, c).alias(f"{flag}_{c}s") for flag in ("soz", "resected") for c in ("channel", "name")]
    df.groupBy("subject").agg(*lists).write.mode("overwrite").parquet(path)


def metrics(df: DataFrame, path: str) -> None:
    """Partitioned by subject.  Runs are many and small, so a subject's runs lie in its files one after another; reads of some runs skip the rest of a file."""
    keys = [c for c in ("subject", "run") if c in df.columns]
    df.repartition(*keys).sortWithinPartitions(*keys).write.mode("overwrite").partitionBy("subject").parquet(path)


def log(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def report(df: DataFrame, path: str, mark: bool = False) -> None:
    """A small table as one CSV file with a header, also when it has no rows; with a byte order mark for spreadsheets if asked for."""
    if mark and df.columns:
        df = df.withColumnRenamed(df.columns[0], "\ufeff" + df.columns[0])
    df.coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def workbook(tables: dict[str, DataFrame], path: str) -> None:
    """Several small tables below one folder, one CSV each, by names that spreadsheets can take (31 characters)."""
    for name, df in tables.items():
        report(df, f"{path}/{name[:31]}", True)


def features_by_run(df: DataFrame, path: str) -> None:
    """One file for each run."""
    df.repartition("subject", "run").write.mode("overwrite").partitionBy("subject", "run").option("header", "true").csv(path)


def model(fitted, path: str) -> None:
    fitted.write().overwrite().save(path)


def wide_features(df: DataFrame, features: list[str]) -> DataFrame:
    """(keys, feature, value) to one column per feature; what is missing is 0."""
    keys = [c for c in df.columns if c not in ("feature", "value")]
    return df.groupBy(*keys).pivot("feature", features).agg(F.first("value")).na.fill(0.0)

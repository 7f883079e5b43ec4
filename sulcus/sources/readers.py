"""Recordings, tables and registries from files, as typed tables; unreadable files become status rows."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .edf import file_system, register
from .office import spreadsheet

#: Names under which a run file may hold each field, in order of preference.
ALIASES = {
    "data": ("data", "X", "x", "signals", "ieeg", "eeg"),
    "sfreq": ("sfreq", "fs", "sampling_rate", "sample_rate"),
    "y": ("y", "labels", "soz_labels", "soz_mask"),
    "soz": ("soz_index", "soz_indices", "soz_ch_idx", "SOZ_index", "soz"),
    "names": ("ch_names", "channels", "channel_names"),
    "subject": ("subject", "sub", "patient"),
    "run": ("run", "seizure", "session"),
}

SIGNAL = "path string, subject string, run string, channel long, name string, sfreq double, samples array<double>, y int, status string"


def _stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)


def subject_of(path: Column) -> Column:
    """By the file's name, or else by its folders; a name that says nothing gives its part before the first '_'."""
    said = r"(?i)(HUP\d+|sub-[A-Za-z0-9]+|pt\d+|patient\d+)"
    found = [F.nullif(F.regexp_extract(x, said, 1), F.lit("")) for x in (_stem(path), path)]
    return F.coalesce(*found, F.substring_index(_stem(path), "_", 1))


def run_of(path: Column) -> Column:
    said = F.nullif(F.regexp_extract(_stem(path), r"(?i)(run[-_]?\d+|sz[-_]?\d+|seizure[-_]?\d+)", 1), F.lit(""))
    return F.coalesce(F.replace(said, F.lit("_"), F.lit("-")), F.lit("run-unknown"))


def run_index(path: Column) -> Column:
    return F.try_to_number(F.regexp_extract(path, r"run(\d+)", 1), F.lit("999999")).cast("int")


def scan(spark: SparkSession, root: str, pattern: str = "*.edf", containing: str = "", first_run: bool = False) -> DataFrame:
    """Files below root: path, subject, run, length; with first_run the first run of each subject only.  Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path", "length")
    files = files.where(F.contains("path", F.lit(containing))).select("path", subject_of(F.col("path")).alias("subject"), run_of(F.col("path")).alias("run"), "length")
    if not first_run:
        return files
    place = F.row_number().over(Window.partitionBy("subject").orderBy("run", "path"))
    return files.withColumn("_r", place).where("_r = 1").drop("_r")


def subjects(files: DataFrame, labels: DataFrame, requested: list[str] | None = None) -> DataFrame:
    """The subjects to evaluate, in order: those asked for, or else those of the files that have labels."""
    if requested:
        return files.sparkSession.createDataFrame([(x,) for x in sorted({r.removeprefix("subject_") for r in requested})], "subject string")
    return files.select("subject").distinct().join(labels.select("subject").distinct(), "subject", "left_semi").orderBy("subject")


def tsv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("sep", "\t").option("header", "true").option("nullValue", "n/a").csv(path)


def onset(events: DataFrame) -> DataFrame:
    """The first onset of each file; rows keep their file and order."""
    e = events.select(F.input_file_name().alias("path"), F.col("onset").cast("double").alias("onset"), F.monotonically_increasing_id().alias("_r"))
    return e.groupBy("path").agg(F.min_by("onset", "_r").alias("onset"))


def _workbooks(path: str) -> bool:
    system, at = file_system(path)
    return system.get_file_info(at).type == fs.FileType.Directory and any(f.path.lower().endswith(".xlsx") for f in system.get_file_info(fs.FileSelector(at)))


def participants(spark: SparkSession, path: str) -> DataFrame:
    """The adopted ones of a registry, which is CSV, a workbook, or a folder of workbooks."""
    table = spreadsheet(spark, path) if path.lower().endswith(".xlsx") or _workbooks(path) else spark.read.option("header", "true").csv(path)
    return table.where(F.expr("try_cast(adopt as double) = 1"))


def decode_run(raw: bytes, default_sfreq: float | None = None) -> dict:
    """One run file (npz, or npy that is the signal): fields by their aliases; channels are rows; labels from a mask or from in-range indices.  Pickles are refused."""
    z = np.load(io.BytesIO(raw), allow_pickle=False)
    z = {"data": z} if isinstance(z, np.ndarray) else dict(z)
    some = {k: next((z[a] for a in names if a in z), None) for k, names in ALIASES.items()}
    x = some["data"]
    if x is None:
        raise ValueError("no signal in the file")
    x = np.squeeze(np.asarray(x, dtype=float))
    if x.ndim != 2:
        raise ValueError(f"a signal of {x.ndim} dimensions")
    if x.shape[0] > x.shape[1]:
        x = x.T
    fs = some["sfreq"] if some["sfreq"] is not None else default_sfreq
    if fs is None:
        raise ValueError("no sampling rate in the file")
    y = np.zeros(len(x), dtype=int)
    if some["y"] is not None:
        y = np.asarray(some["y"]).astype(int).ravel()
        if len(y) != len(x):
            raise ValueError("as many labels as channels are needed")
    elif some["soz"] is not None:
        at = np.asarray(some["soz"]).astype(int).ravel()
        y[at[(at >= 0) & (at < len(x))]] = 1
    names = [str(n) for n in some["names"]] if some["names"] is not None else [f"ch{k:03d}" for k in range(len(x))]
    text = {k: str(some[k]) if some[k] is not None else None for k in ("subject", "run")}
    return {"x": x, "y": y, "names": names, "sfreq": float(fs), **text}


def runs(spark: SparkSession, root: str, pattern: str = "*.np[yz]", sfreq: float | None = None) -> DataFrame:
    """One row per channel of every run file; a file that can't be read is one row whose status says why."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    files = files.select("path", subject_of(F.col("path")).alias("subject"), run_of(F.col("path")).alias("run"), "content")

    def decode(batches):
        for b in batches:
            for r in b.itertuples(index=False):
                try:
                    d = decode_run(bytes(r.content), sfreq)
                    n = len(d["x"])
                    yield pd.DataFrame({"path": r.path, "subject": d["subject"] or r.subject, "run": d["run"] or r.run, "channel": range(n), "name": d["names"], "sfreq": d["sfreq"], "samples": list(d["x"]), "y": d["y"], "status": "ok"})
                except (ValueError, OSError, KeyError, EOFError) as e:
                    yield pd.DataFrame([[r.path, r.subject, r.run, None, None, None, None, None, str(e)]], columns=["path", "subject", "run", "channel", "name", "sfreq", "samples", "y", "status"])

    return files.mapInPandas(decode, SIGNAL)


def dataset(spark: SparkSession, root: str, pattern: str = "*.np[yz]", sfreq: float | None = None) -> DataFrame:
    """The readable channels of all run files; an error if no file could be read."""
    every = runs(spark, root, pattern, sfreq)
    good = every.where("status = 'ok'").drop("status")
    if good.isEmpty():
        why = [f"{r['path']}: {r['status']}" for r in every.select("path", "status").limit(5).collect()]
        raise ValueError(f"no readable run below {root}; {'; '.join(why) or 'no file'}")
    return good


def edf_parts(spark: SparkSession, root: str, containing: str = "task-ictal", **options) -> DataFrame:
    """EDF files below root in parts: path, subject, run, channel, name, sfreq, first, samples, status; see `edf` for the options."""
    found = register(spark).read.format("edf").options(containing=containing, **options).load(root)
    # Files of this kind name subjects sub-X, and X is meant.
    subject = F.regexp_replace(subject_of(F.col("path")), "^sub-", "")
    return found.select("path", subject.alias("subject"), run_of(F.col("path")).alias("run"), "channel", "name", "sfreq", "first", "samples", "status")


def whole_channels(parts: DataFrame) -> DataFrame:
    """One row per channel, its parts joined in order; a file's fault stays a row without channel."""
    keys = [c for c in parts.columns if c not in ("first", "samples")]
    joined = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("first", "samples"))), lambda p: p["samples"]))
    return parts.groupBy(*keys).agg(joined.alias("samples")).select(*[c for c in parts.columns if c != "first"])


def edf(spark: SparkSession, root: str, containing: str = "task-ictal", **options) -> DataFrame:
    """One row per channel of every EDF file; a file that can't be read is one row whose status says why."""
    return whole_channels(edf_parts(spark, root, containing, **options))


def located(path: Column) -> Column:
    """A path with one slash after its scheme, as different sources write it differently."""
    return F.regexp_replace(path, r"^file:/+", "file:/")


def recording_of(path: Column) -> Column:
    """What a recording shares with the tables beside it: its folder and name without the last _word and the ending."""
    return F.regexp_replace(located(path), r"_[A-Za-z]+\.[A-Za-z]+$", "")


def tables_beside(spark: SparkSession, root: str, kind: str, columns: list[str]) -> DataFrame:
    """Rows of all *_kind.tsv files below root: recording, row, and the columns by name, of each file's own header; n/a and missing ones are null."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", f"*_{kind}.tsv").text(root, wholetext=True)
    lines = F.filter(F.split("value", "\r\n|\n|\r"), lambda v: F.trim(v) != "")
    f = files.select(recording_of(F.col("_metadata.file_path")).alias("recording"), lines.alias("lines")).where(F.size("lines") > 0)
    f = f.select("recording", F.split(F.get("lines", F.lit(0)), "\t").alias("header"), F.posexplode("lines").alias("row", "line")).where("row > 0")
    cells = F.split("line", "\t")
    value = lambda c: F.nullif(F.trim(F.get(cells, (F.array_position("header", c) - 1).cast("int"))), F.lit("n/a"))
    return f.select("recording", "row", *[value(c).alias(c) for c in columns])

"""Queries over files: recordings and tables are written below the shared folder and read again by the library's readers."""

from __future__ import annotations

import io
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import connectivity as N
from ..operators import evaluation as L
from ..session import shared_path
from ..sources import edf, office, readers, sinks
from . import fixtures as X
from .oracle import F1, F5, F6, ORACLE, RUNS

R = X.RUN
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: What one step of an EDF file's samples is worth.
GRAIN = 1e-4


def query(f):
    QUERIES[f.__name__] = f
    return f


def _written(df: DataFrame, keys: list[str], put: Callable[[pd.DataFrame], str]) -> None:
    """put(group) writes a file and returns its path; done when all groups are."""

    def one(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"path": [put(g)]})

    df.groupBy(*keys).applyInPandas(one, "path string").write.format("noop").mode("overwrite").save()


def _run_files(s: SparkSession, d: str) -> str:
    """sub-S_run-K.npz of every recording; fields go by different names, every other run is transposed, and labels are masks or indices."""
    root = shared_path(s, "runs")

    def put(g: pd.DataFrame) -> str:
        g = g.sort_values("channel")
        subject, run = int(g.subject.iloc[0]), int(g["run"].iloc[0])
        x, y = np.stack(g.samples.to_numpy()), g.y.to_numpy()
        fields = {"X" if run % 2 else "data": x.T if run % 2 else x, "fs" if run % 3 else "sfreq": 500.0}
        fields |= {"soz_index": np.flatnonzero(y)} if subject % 2 else {"labels": y}
        raw = io.BytesIO()
        np.savez(raw, **fields)
        office.put_file(at := f"{root}/site{subject % 2}/sub-{subject}_run-{run}.npz", raw.getvalue())
        return at

    _written(X.dense_wide(s, d), R, put)
    return root


@query
def run_files(s, d):
    """Signals and labels of run files, whatever their fields are called and however they lie."""
    x = readers.dataset(s, _run_files(s, d))
    v = x.withColumn("total", F.aggregate("samples", F.lit(0.0), lambda a, b: a + b))
    number = lambda c: F.regexp_extract(c, r"-(\d+)$", 1).cast("long").alias(c)
    return v.select(number("subject"), number("run"), "channel", "name", "sfreq", F.size("samples").cast("long").alias("n"), F.round("total", 6).alias("total"), "y")


@query
def first_runs(s, d):
    """The first run file of each subject that has labelled channels, by names alone."""
    files = readers.scan(s, _run_files(s, d), "*.npz", "sub-", True)
    labels = X.dense_wide(s, d).where("y = 1").select(F.concat(F.lit("sub-"), "subject").alias("subject"))
    wanted = readers.subjects(files, labels)
    return files.join(wanted, "subject", "left_semi").select("subject", "run", (F.col("length") > 0).alias("filled"))


@query
def edf_files(s, d):
    """EDF recordings of subjects, a channel's samples one after another in two records; read in parts of one record."""
    root = shared_path(s, "edf")

    def field(v, width):
        return str(v)[:width].ljust(width).encode()

    def put(g: pd.DataFrame) -> str:
        g = g.sort_values("channel")
        x = np.floor(np.stack(g.samples.to_numpy()) / GRAIN).astype("<i2").reshape(len(g), 2, -1)
        head = field(0, 8) + field("", 176) + field(256 * (1 + len(g)), 8) + field("", 44) + field(2, 8) + field(1, 8) + field(len(g), 4)
        values = {"label": [f"C{c}" for c in g.channel], "pmin": -32768 * GRAIN, "pmax": 32767 * GRAIN, "dmin": -32768, "dmax": 32767, "n": x.shape[2]}
        for name, width in edf.FIELDS:
            v = values.get(name, "")
            head += b"".join(field(v[k] if isinstance(v, list) else v, width) for k in range(len(g)))
        office.put_file(at := f"{root}/sub-{g.subject.iloc[0]}/ieeg/sub-{g.subject.iloc[0]}_task-ictal_run-{g['run'].iloc[0]}_ieeg.edf", head + x.transpose(1, 0, 2).tobytes())
        return at

    _written(X.dense_wide(s, d), R, put)
    x = readers.edf(s, root, split_bytes=2500, row_bytes=1).where("status = 'ok'")
    steps = F.aggregate("samples", F.lit(0).cast("long"), lambda a, v: a + F.round(v / GRAIN).cast("long"))
    weighted = F.aggregate(F.transform("samples", lambda v, k: F.round(v / GRAIN).cast("long") * k), F.lit(0).cast("long"), lambda a, v: a + v)
    run = F.regexp_extract("run", r"-(\d+)$", 1).cast("long")
    return x.select(F.col("subject").cast("long").alias("subject"), run.alias("run"), "channel", "name", "sfreq", steps.alias("steps"), weighted.alias("weighted"))


@query
def channel_tables(s, d):
    """Channel tables of recordings, one TSV a subject with columns in an order of its own."""
    root = shared_path(s, "tables")

    def put(g: pd.DataFrame) -> str:
        g = g.sort_values("row")
        subject = g.subject.iloc[0]
        order = ["name", "status", "status_description"] if len(subject) % 2 else ["status_description", "extra", "name", "status"]
        lines = ["\t".join(order)] + ["\t".join({"extra": "-"}.get(c) or getattr(r, c) or "n/a" for c in order) for r in g.itertuples()]
        office.put_file(at := f"{root}/{subject}/{subject}_task-ictal_channels.tsv", ("\r\n".join(lines) + "\r\n").encode())
        return at

    _written(X.channels(s, d).withColumn("subject", F.translate("subject", "_#", "--")), ["subject"], put)
    t = readers.tables_beside(s, root, "channels", ["name", "status", "status_description", "absent"])
    subject = F.regexp_extract("recording", r"/([^/]*)_task-ictal$", 1)
    return t.select(subject.alias("subject"), F.col("row").cast("long").alias("row"), "name", "status", "status_description", F.col("absent").isNull().alias("absent"))


@query
def registry(s, d):
    """Adopted participants of a registry that is a folder of workbooks: every customer of a balance above 0."""
    people = X._read(s, d, "customer").select(F.concat(F.lit("P"), "c_custkey").alias("participant_id"), F.col("c_nationkey").alias("all_nodes"), (F.col("c_acctbal") > 0).cast("int").alias("adopt"))
    office.workbooks(people, path := shared_path(s, "registry"), "participants")
    return readers.participants(s, path).select("participant_id", F.col("all_nodes").cast("long").alias("all_nodes"))


@query
def workbook_round_trip(s, d):
    """Metrics by way of a workbook's second sheet."""
    tables = {"scores": X.scores(s, d).limit(0), "metrics": L.confusion(X.scores(s, d), 2.5, ["subject"])}
    office.workbook(tables, path := f"{shared_path(s, 'book')}/results.xlsx")
    t = office.spreadsheet(s, path, "metrics")
    return t.select("subject", *[F.col(c).cast("long").alias(c) for c in ("tp", "fp", "fn", "tn")], *[F.round(F.col(c).cast("double"), 6).alias(c) for c in ("acc", "sen", "spec")])


@query
def metric_round_trip(s, d):
    """Node strengths through the metrics' sink."""
    path = shared_path(s, "metrics")
    sinks.metrics(N.node_strength(N.block_correlation(X.dense_wide(s, d), 16, 8, run=R), [*R, "window"], X.dense_wide(s, d).select(*R, "channel")), path)
    x = s.read.schema("window long, channel long, strength double, subject long, run long").parquet(path)
    return x.select(*R, "window", "channel", F.round("strength", 6).alias("strength"))


@query
def feature_csv_round_trip(s, d):
    """Scores as features by subject and run, in CSV."""
    path = shared_path(s, "features")
    sinks.features_by_run(X.scores(s, d).select("subject", "run", "channel", F.lit("score").alias("feature"), F.col("score").alias("value")), path)
    x = s.read.schema("channel long, feature string, value double, subject string, run string").option("header", "true").csv(path)
    return x.select("subject", "run", "channel", "feature", F.round("value", 6).alias("value"))


def _apart(sql: str) -> str:
    """A recording's number as subject and run again."""
    return f"SELECT subject // {RUNS} AS subject, subject % {RUNS} AS run, * EXCLUDE (subject) FROM ({sql})"


ORACLE_FILES = {
    "run_files": _apart(f"""WITH {F1}
SELECT subject, channel, 'ch' || lpad(CAST(channel AS VARCHAR), 3, '0') AS name, 500.0::DOUBLE AS sfreq, count(*) AS n, round(sum(value), 6) AS total, max(y) AS y FROM f1 GROUP BY subject, channel"""),
    "first_runs": f"""WITH {F1}
SELECT 'sub-' || (subject // {RUNS}) AS subject, 'run-0' AS run, true AS filled FROM f1 GROUP BY subject // {RUNS} HAVING max(y) = 1""",
    "edf_files": _apart(f"""WITH {F1}, q AS (SELECT subject, channel, sample, CAST(floor(value / {GRAIN}) AS BIGINT) AS v FROM f1)
SELECT subject, channel, 'C' || channel AS name, 32.0::DOUBLE AS sfreq, CAST(sum(v) AS BIGINT) AS steps, CAST(sum(v * sample) AS BIGINT) AS weighted FROM q GROUP BY subject, channel"""),
    "channel_tables": f"""WITH {F6}
SELECT translate(subject, '_#', '--') AS subject, row_number() OVER (PARTITION BY subject ORDER BY row) AS row, name, status, status_description, true AS absent FROM f6""",
    "registry": "SELECT 'P' || c_custkey AS participant_id, CAST(c_nationkey AS BIGINT) AS all_nodes FROM customer WHERE c_acctbal > 0",
    "workbook_round_trip": ORACLE["confusion_metrics"],
    "metric_round_trip": ORACLE["fc_node_strength"],
    "feature_csv_round_trip": f"WITH {F5} SELECT subject, run, channel, 'score' AS feature, round(score, 6) AS value FROM f5",
}

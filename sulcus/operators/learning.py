"""Training of the adaptive graph network, leaving one subject out: gradients of runs in parallel, steps on the driver."""

from __future__ import annotations

import logging
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import network as W
from .connectivity import stream_groups

log = logging.getLogger(__name__)

RUN = ["subject", "run"]


def run_segments(x: np.ndarray, length: int) -> np.ndarray:
    """Runs' channels [runs, channels, samples] (each z-scored) as [runs, segments, channels, samples]; what is left over goes."""
    x = (x - x.mean(-1, keepdims=True)) / (x.std(-1, keepdims=True) + 1e-6)
    n = x.shape[-1] // length
    return x[..., : n * length].reshape(*x.shape[:2], n, length).swapaxes(1, 2)


def _run_gradients(folds: dict[str, W.Params], length: int, length_seq: int, onset: int, seed: int) -> Callable[[pd.DataFrame, np.ndarray], pd.DataFrame]:
    """Sums by fold over whole runs, in order of run and channel; runs of one shape are taken together, some MB at a time."""

    def some(g: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        rows, size = [], np.diff([*starts, len(g)])
        subject = g.subject.astype(str).to_numpy()[starts]
        name = (g.subject.astype(str) + "/" + g.run.astype(str)).to_numpy()[starts]
        samples = g.samples.to_numpy()
        wide = np.array([len(samples[k]) for k in starts])
        for c, n in set(zip(size, wide)):
            alike = np.flatnonzero((size == c) & (wide == n))
            block = max(1, W.AT_ONCE // int(8 * c * n + 1))
            for mine in (alike[k : k + block] for k in range(0, len(alike), block)):
                drawn = [W.balanced_targets(n // length, length_seq, onset, zlib.crc32(f"{seed}/{name[k]}".encode())) for k in mine]
                if not len(drawn[0][1]):  # as for all runs of this length
                    break
                segments = run_segments(np.stack([np.stack(samples[starts[k] : starts[k] + c]) for k in mine]).astype(float), length)
                targets, y = (np.stack(v) for v in zip(*drawn))
                for fold, p in folds.items():
                    at = np.flatnonzero(subject[mine] != fold)
                    if len(at):
                        rows.append((fold, len(at), *W.runs_gradient(segments[at], p, targets[at], y[at], length_seq)))
        return pd.DataFrame(rows, columns=["fold", "n", "loss", "grad", "met"])

    return some


_SUMS = "fold string, n long, loss double, grad array<double>, met array<double>"


def _added(parts: pd.DataFrame) -> pd.DataFrame:
    """Sums by fold."""
    rows = [(f, int(g.n.sum()), float(g.loss.sum()), np.sum(np.stack(g.grad.to_numpy()), 0), np.sum(np.stack(g.met.to_numpy()), 0)) for f, g in parts.groupby("fold")]
    return pd.DataFrame(rows, columns=["fold", "n", "loss", "grad", "met"])


def _task_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = None
    for b in batches:
        if len(b):
            total = _added(b if total is None else pd.concat([total, b]))
    if total is not None:
        yield total


def train_attention(
    wide: DataFrame, length: int, length_seq: int = 20, onset: int = 50, epochs: int = 10, rate: float = 1e-4, hidden: int = 32, per_update: int = 8, seed: int = 0,
) -> tuple[dict[str, W.Params], DataFrame]:
    """wide: subject, run, channel, samples.  ({subject: weights trained on the others}, losses: epoch, step, subject, n_runs, loss).

    The network learns whether the segment after each `length_seq` segments of `length` samples lies at or after segment `onset`.
    An epoch deals the runs by hash into updates of about `per_update`; each run's gradient is one task's work, with other runs of its shape, for all subjects'
    networks at once, gradients are added up per task and then by subject, and the driver gets one vector a subject and takes an
    Adam step (rate times 0.25 every third epoch, gradients clipped at 5).  Runs stay where they are from step to step: they are
    kept by run, in about as many partitions as there are cores.  A run without targets on both sides of the onset teaches nothing.
    """
    spark = wide.sparkSession
    # A step is short, and each of its tasks sends a vector a subject.
    x = wide.select(*RUN, "channel", "samples").repartition(spark.sparkContext.defaultParallelism, *RUN).sortWithinPartitions(*RUN, "channel").persist()
    subjects = sorted(str(r["subject"]) for r in x.select("subject").distinct().collect())  # tens
    runs = x.select(*RUN).distinct().count()
    updates = max(1, round(runs / per_update))
    folds = {s: W.initial(seed + k, hidden) for k, s in enumerate(subjects)}
    adam = {s: W.Adam(W.flat(p).size) for s, p in folds.items()}
    met: dict[str, np.ndarray] = {}
    losses = []
    for epoch in range(epochs):
        for u in range(updates):
            some = x.where(F.pmod(F.xxhash64(F.lit(seed), F.lit(epoch), *RUN), F.lit(updates)) == u)
            gradients = stream_groups(RUN, _run_gradients(folds, length, length_seq, onset, seed + epoch))
            parts = some.mapInPandas(lambda batches: _task_sums(gradients(batches)), _SUMS)
            for r in parts.groupBy("fold").applyInPandas(_added, _SUMS).collect():  # one row a subject
                s, n = r["fold"], r["n"]
                folds[s] = W.unflat(adam[s].step(W.flat(folds[s]), np.array(r["grad"]) / n, rate * 0.25 ** (epoch // 3)), folds[s])
                now = np.array(r["met"]) / n
                met[s] = now if s not in met else 0.9 * met[s] + 0.1 * now
                losses.append((epoch, u, s, n, r["loss"] / n))
        own = [v for e, _, _, _, v in losses if e == epoch]
        log.info("epoch %d: mean loss %.4f over %d updates", epoch, np.mean(own) if own else float("nan"), updates)
    x.unpersist()
    trained = {s: W.trained_weights(p, met[s]) for s, p in folds.items() if s in met}
    return trained, spark.createDataFrame(losses, "epoch long, step long, subject string, n_runs long, loss double")


def save_weights(spark: SparkSession, weights: dict[str, W.Params], path: str) -> None:
    """One row per subject and array, as Parquet partitioned by subject."""
    rows = [(s, k, list(map(int, v.shape)), v.ravel().tolist()) for s, w in weights.items() for k, v in w.items()]
    spark.createDataFrame(rows, "subject string, name string, shape array<long>, value array<double>").write.mode("overwrite").partitionBy("subject").parquet(path)


def load_weights(spark: SparkSession, path: str) -> dict[str, W.Params]:
    out: dict[str, W.Params] = {}
    for r in spark.read.schema("name string, shape array<long>, value array<double>, subject string").parquet(path).collect():
        out.setdefault(r["subject"], {})[r["name"]] = np.array(r["value"]).reshape(r["shape"])
    return out

"""The jobs as queries: each runs twice into one new folder and returns the whole output as the second run leaves it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import burst_windows, label_audit, support
from sulcus.session import shared_path


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if kind == "double" else c for c, kind in df.dtypes])


def job1_burst_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_path(spark, "job1")
    for _ in range(2):  # the second run finds nothing new
        whole = burst_windows.run(spark, f"{sf_dir}/events.parquet", out)
    return _rounded(whole)


def job2_label_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_path(spark, "job2")
    for _ in range(2):
        whole = label_audit.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet", out)
    return _rounded(whole)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (job1_burst_windows, job2_label_audit)}

_BURST_WINDOWS = """
WITH w AS (
  SELECT event_type AS subject, CAST(user_id % 8 AS BIGINT) AS channel, CAST(floor(epoch(ts) / 14400) AS BIGINT) AS win, count(*) AS n, avg(value) AS mean, avg(value * value) AS power
  FROM events WHERE ts IS NOT NULL AND event_type IS NOT NULL AND user_id IS NOT NULL AND value IS NOT NULL AND NOT isnan(value) GROUP BY 1, 2, 3
), m AS (
  SELECT *, median(power) OVER (PARTITION BY subject, channel) AS mid FROM w
), t AS (
  SELECT *, mid + 1.5 * 1.4826 * (median(abs(power - mid)) OVER (PARTITION BY subject, channel) + 1e-12) AS thr FROM m
), strong AS (
  SELECT subject, channel, win, lag(win) OVER (PARTITION BY subject, channel ORDER BY win) AS last FROM t WHERE power > thr
), runs AS (
  -- Up to one window may lie between strong windows of a burst.
  SELECT subject, channel, win, sum(CASE WHEN win - last <= 2 THEN 0 ELSE 1 END) OVER (PARTITION BY subject, channel ORDER BY win) AS k FROM strong
), bursts AS (
  SELECT subject, channel, min(win) AS burst, max(win) AS stop FROM runs GROUP BY subject, channel, k
)
SELECT w.subject, w.channel, w.win AS "window", w.n, round(w.mean, 6) AS mean, round(w.power, 6) AS power, CAST(DATE '1970-01-01' + CAST(floor(w.win * 4 / 24) AS INT) AS DATE) AS day, b.burst
FROM w LEFT JOIN bursts b ON w.subject = b.subject AND w.channel = b.channel AND w.win BETWEEN b.burst AND b.stop
"""

_TERMS = " + ".join(f"CAST(contains(t, '{term}') AS BIGINT)" for term in support.defaults("label_audit")["terms"])

_LABEL_AUDIT = f"""
WITH d AS (
  SELECT coalesce(source, '(none)') AS subject, coalesce(lang, '(none)') AS run, doc_id AS channel, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), x AS (
  SELECT subject, run, channel, CAST(toxic AS INT) AS y, {_TERMS} AS score FROM d JOIN labels ON channel = doc_id WHERE toxic IS NOT NULL
), s AS (
  SELECT subject, sum(y) AS p, sum(1 - y) AS n, sum(y * score) AS sp, sum((1 - y) * score) AS sn FROM x GROUP BY subject
), cuts AS (
  SELECT subject, (CAST(sum(sp) OVER () - sp AS DOUBLE) / nullif(sum(p) OVER () - p, 0) + CAST(sum(sn) OVER () - sn AS DOUBLE) / nullif(sum(n) OVER () - n, 0)) / 2 AS cut FROM s
), p AS (
  SELECT x.*, cut, CAST(coalesce(score > cut, false) AS INT) AS predicted FROM x JOIN cuts USING (subject)
), conf AS (
  SELECT subject, run, count(*) FILTER (predicted = 1 AND y = 1) AS tp, count(*) FILTER (predicted = 1 AND y = 0) AS fp, count(*) FILTER (predicted = 0 AND y = 1) AS fn,
         count(*) FILTER (predicted = 0 AND y = 0) AS tn FROM p GROUP BY subject, run
), ranked AS (
  SELECT *, rank() OVER (PARTITION BY subject, run ORDER BY score) + (count(*) OVER (PARTITION BY subject, run, score) - 1) / 2 AS r FROM p
), auc AS (
  SELECT subject, run, coalesce((sum(r * y) - sum(y) * (sum(y) + 1) / 2) / nullif(sum(y) * sum(1 - y), 0), 0.5) AS auc, CAST(sum(y) AS BIGINT) AS n_soz FROM ranked GROUP BY subject, run
), g AS (
  SELECT subject, run, score, sum(y) AS k, count(*) AS n FROM p GROUP BY subject, run, score
), c AS (
  SELECT *, sum(k) OVER w AS ck, sum(n) OVER w AS cn, sum(k) OVER (PARTITION BY subject, run) AS every FROM g WINDOW w AS (PARTITION BY subject, run ORDER BY score DESC)
), ap AS (
  SELECT subject, run, sum(k / every * ck / cn) AS ap FROM c WHERE every > 0 GROUP BY subject, run
)
SELECT subject, run, channel, y, score, predicted, n_soz, round(coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0), 0), 6) AS acc, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS sen,
       round(coalesce(tn / nullif(tn + fp, 0), 0), 6) AS spec, round(auc, 6) AS auc, round(ap, 6) AS ap, round(cut, 6) AS cut
FROM p JOIN conf USING (subject, run) JOIN auc USING (subject, run) LEFT JOIN ap USING (subject, run)
"""

ORACLE: dict[str, str] = {"job1_burst_windows": _BURST_WINDOWS, "job2_label_audit": _LABEL_AUDIT}

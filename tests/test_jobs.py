"""The two jobs: growing input, reruns, failures, odd rows, and their queries against SQL."""

import datetime as dt
import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F
from test_operators import texts

from jobs import burst_windows, label_audit, queries, support

EVENTS = "ts timestamp_ntz, event_type string, user_id long, value double"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def some_events(seed, days, n=300):
    rng = random.Random(seed)
    at = dt.datetime(2024, 1, 1)
    return [(at + dt.timedelta(days=rng.choice(days), minutes=rng.randrange(1440)), rng.choice("ab"), rng.randrange(4), rng.gauss(0, 1) * (9 if rng.random() < 0.02 else 1)) for _ in range(n)]


def put(spark, rows, path):
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(path)


def rounded(df):
    return rows_of(df.select(*[F.round(c, 9).alias(c) if t == "double" else c for c, t in df.dtypes]))


def test_growing_input(spark, tmp_path):
    """Two runs over growing input give what one run over all of it gives; the second takes the new file only, and rewrites its days only."""
    events, out = f"{tmp_path}/events", f"{tmp_path}/out"
    put(spark, some_events(1, [0, 1, 2]), events)
    first = burst_windows.run(spark, events, out).collect()
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "out/power").rglob("*.parquet")}
    put(spark, some_events(2, [2, 3]), events)  # day 2 again, and a new one
    second = burst_windows.run(spark, events, out)
    assert spark.read.parquet(f"{out}/sums").select("batch").distinct().count() == 2
    kept = {p.parent.name for p, t in before.items() if p.exists() and p.stat().st_mtime_ns == t}
    assert kept == {"day=2024-01-01", "day=2024-01-02"}
    whole = burst_windows.run(spark, events, f"{tmp_path}/other")
    assert len(first) < second.count() and rounded(second) == rounded(whole)
    assert second.where("burst is not null").count() > 0
    before = rows_of(second)
    again = burst_windows.run(spark, events, out)  # nothing new
    assert rows_of(again) == before and spark.read.parquet(f"{out}/sums").select("batch").distinct().count() == 2


def test_a_batch_twice_counts_once(spark, tmp_path):
    """What a stream does after a failure: the same batch comes again."""
    config = support.defaults("burst_windows")
    values = spark.createDataFrame(some_events(3, [0, 1]), EVENTS)
    seen = []
    for _ in range(2):
        burst_windows.update_power(spark, values, 0, str(tmp_path), config)
        seen.append(rows_of(spark.read.schema(burst_windows.POWER).parquet(f"{tmp_path}/power")))
    assert seen[0] == seen[1] and sum(r[3] for r in seen[0]) == 300


def test_odd_values(spark, tmp_path):
    at = dt.datetime(1969, 12, 31, 23)
    rows = [(at, "a", 1, 2.0), (at, "a", 1, None), (None, "a", 1, 1.0), (at, None, 1, 1.0), (at, "a", None, 1.0), (at, "a", 1, float("nan"))]
    put(spark, rows, f"{tmp_path}/events")
    got = burst_windows.run(spark, f"{tmp_path}/events", f"{tmp_path}/out").collect()
    assert [(r.subject, r.channel, r.window, r.n, r.mean, r.power, r.day, r.burst) for r in got] == [("a", 1, -1, 1, 2.0, 4.0, dt.date(1969, 12, 31), None)]
    put(spark, rows[1:], f"{tmp_path}/none")
    assert burst_windows.run(spark, f"{tmp_path}/none", f"{tmp_path}/nothing").count() == 0


def test_bursts_of_windows(spark):
    power = [1.0, 1.1, 9.0, 9.5, 1.0, 8.0, 1.2, 0.9, 1.0, 1.1, 1.0, 0.9, 7.0]
    x = spark.createDataFrame([("a", 0, k, v) for k, v in enumerate(power)], "subject string, channel long, window long, power double")
    found = burst_windows.find_bursts(x, support.defaults("burst_windows")).collect()
    assert sorted((r.start, r.stop, r.n, r.peak, round(r["mean"], 6)) for r in found) == [(2, 6, 4, 9.5, 6.875), (12, 13, 1, 7.0, 7.0)]


def audit_rows():
    """Documents and labels of three subjects, with nulls, a repeated row, an unlabelled row and one in capitals."""
    docs = [(1, "an IDIOT and a moron", "en", "s1"), (2, "fine", "en", "s1"), (3, None, "de", "s1"), (4, "trash", "en", "s2"), (5, "fine", None, "s2"), (6, "fine", "en", None), (7, "clown, trash", "en", None), (8, "idiot", "en", "s3"), (2, "fine", "en", "s1")]
    labels = [(1, 1), (2, 0), (3, 0), (4, 1), (5, 0), (6, 1), (7, 1), (9, 1), (8, None)]
    return docs, labels


def test_audit_by_hand(spark, tmp_path):
    docs, labels = audit_rows()
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels")
    runs = [label_audit.run(spark, f"{tmp_path}/documents", f"{tmp_path}/labels", f"{tmp_path}/out").collect() for _ in range(2)]
    rows = runs[0]
    assert sorted(rows, key=str) == sorted(runs[1], key=str)
    got = sorted((r.channel, r.subject, r.run, r.y, r.score, r.predicted) for r in rows)
    # Cuts: s1 by scores 1, 0, 2 of class 1 and 0 of class 0; s2 by 2, 0, 2; (none) by 2, 1 and 0.
    assert got == [(1, "s1", "en", 1, 2, 1), (2, "s1", "en", 0, 0, 0), (2, "s1", "en", 0, 0, 0), (3, "s1", "de", 0, 0, 0), (4, "s2", "en", 1, 1, 1), (5, "s2", "(none)", 0, 0, 0), (6, "(none)", "en", 1, 0, 0), (7, "(none)", "en", 1, 2, 1)]
    cut = {r.subject: round(r.cut, 6) for r in rows}
    assert cut == {"s1": 0.5, "s2": round(4 / 3 / 2, 6), "(none)": 0.75}
    of = {(r.subject, r.run): (r.acc, r.sen, r.spec, r.auc, r.ap) for r in rows}
    assert of["s1", "en"] == (1.0, 1.0, 1.0, 1.0, 1.0) and of["(none)", "en"] == (0.5, 0.5, 0.0, 0.5, 1.0) and of["s1", "de"][4] is None


def test_audit_without_rows(spark, tmp_path):
    docs, labels = audit_rows()
    spark.createDataFrame(docs[:0], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels")
    assert label_audit.run(spark, f"{tmp_path}/documents", f"{tmp_path}/labels", f"{tmp_path}/out").count() == 0


def test_config_file(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"hours": 6}))
    assert support.settings(spark, "burst_windows", f"file://{tmp_path}/c.json") == support.defaults("burst_windows") | {"hours": 6}
    (tmp_path / "bad.json").write_text(json.dumps({"hour": 6}))
    with pytest.raises(ValueError, match="hour"):
        support.settings(spark, "burst_windows", f"file://{tmp_path}/bad.json")


class Kept:
    """A session that outlives the command line that stops it."""

    def __init__(self, spark):
        self.spark, self.stopped = spark, 0

    def __getattr__(self, name):
        return getattr(self.spark, name)

    def stop(self):
        self.stopped += 1


def test_command_lines(spark, sf, tmp_path, monkeypatch):
    """Paths, settings and the session's end; an error ends it too."""
    kept = Kept(spark)
    monkeypatch.setattr(support, "session", lambda master: kept)
    (tmp_path / "c.json").write_text(json.dumps({"hours": 24}))
    support.main("burst_windows", "", ("events",), burst_windows.run, ["--events", f"{sf}/events.parquet", "--out", f"{tmp_path}/one", "--config", f"{tmp_path}/c.json"])
    whole = burst_windows.output(spark, f"{tmp_path}/one")
    assert kept.stopped == 1 and whole.selectExpr("sum(n)").first()[0] == spark.read.parquet(f"{sf}/events.parquet").count()
    assert whole.select("day").distinct().count() == whole.select("window").distinct().count()
    support.main("label_audit", "", ("documents", "labels"), label_audit.run, ["--documents", f"{sf}/documents.parquet", "--labels", f"{sf}/labels.parquet", "--out", f"{tmp_path}/two"])
    assert kept.stopped == 2 and label_audit.output(spark, f"{tmp_path}/two").count() == spark.read.parquet(f"{sf}/labels.parquet").count()
    with pytest.raises(Exception, match="(?i)path"):
        support.main("burst_windows", "", ("events",), burst_windows.run, ["--events", f"{tmp_path}/absent", "--out", f"{tmp_path}/three"])
    assert kept.stopped == 3


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("events", "documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    before = spark.conf.getAll
    got, want = queries.QUERIES[name](spark, sf), con.sql(queries.ORACLE[name])
    assert spark.conf.getAll == before and len(want.fetchall()) > 0
    want = con.sql(queries.ORACLE[name])
    assert texts(got.columns, got.collect()) == texts(want.columns, want.fetchall())

"""Queries against DuckDB on the smallest tables, edge cases, files and streams."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sulcus.functions import kernels as K
from sulcus.operators import channels as C
from sulcus.operators import connectivity as N
from sulcus.operators import evaluation as L
from sulcus.operators import events as E
from sulcus.operators import graphs as G
from sulcus.operators import signal as S
from sulcus.plans import fixtures as X
from sulcus.plans.catalogue import QUERIES
from sulcus.plans.oracle import ORACLE
from sulcus.sources import readers, sinks
from sulcus.streaming import bursts

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(df):
    return texts(df.columns, df.astype(object).itertuples(index=False))


def texts(cols, rows):
    """Rows as texts, columns by name; plain Python values, so that nullable integers stay integers on both sides."""
    order = sorted(range(len(cols)), key=lambda k: cols[k])
    return sorted(tuple("" if r[k] is None or r[k] != r[k] else f"{r[k] + 0.0:.6f}" if isinstance(r[k], float) else str(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, sf, duck, name):
    got, want = QUERIES[name](spark, sf), duck.sql(ORACLE[name])
    assert texts(got.columns, got.collect()) == texts(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE) - {"loso_random_forest", "loso_logreg", "feature_importance"}))
def test_the_rest_runs(spark, sf, name):
    rows = QUERIES[name](spark, sf).toPandas()
    assert len(rows) and not rows.isna().any().any()


@pytest.fixture(scope="module")
def twelve(spark, tmp_path_factory):
    """Two labels of twelve channels each, which are two runs of six."""
    d, rng = str(tmp_path_factory.mktemp("twelve")), np.random.default_rng(3)
    spark.createDataFrame([(k, k % 2, rng.normal(size=64).tolist()) for k in range(24)], "vec_id long, label int, embedding array<float>").write.parquet(f"{d}/embeddings.parquet")
    return d


def test_edges_by_brute_force(spark, twelve):
    """Every vector is a channel of one run, and a run's graph has its own channels only."""
    want = {}
    for r in sorted(spark.read.parquet(f"{twelve}/embeddings.parquet").collect()):
        want.setdefault(r.label, []).append(r.embedding)
    want = {(s, k): np.array(v[k::2]) for s, v in want.items() for k in range(2)}
    for name in ("fc_sliding_edges", "fc_sliding_edges_kernel"):
        got = QUERIES[name](spark, twelve).collect()
        assert len(got) == 2 * 2 * 7 * 15
        assert all(abs(r.w - np.corrcoef(want[r.subject, r.run][[r.i, r.j], 8 * r.window : 8 * r.window + 16])[0, 1]) < 2e-6 for r in got)


RECORDINGS = "fc_sliding_edges fc_sliding_edges_exclusive fc_edge_vectors fc_node_strength fc_degree_std average_reference percentile_scale robust_zscore linspace_decimate band_power onset_crop hilbert_envelope envelope_corr_layers lagged_coherence preictal_mapped supra_adjacency evolution_operator_svd evolution_node_metrics evolution_success_rate fragility_heatmap mlevc mlevc_quantised mlevc_consensus gnn_attention_score filtered_signals".split()


@pytest.mark.parametrize("name", RECORDINGS)
def test_runs_stay_apart(spark, twelve, name):
    """A run's rows are the same whether or not the subject has another run, and every channel of it is read."""
    e = spark.read.parquet(f"{twelve}/embeddings.parquet")
    rows = QUERIES[name](spark, twelve).toPandas()
    assert len(rows) and not rows.isna().any().any() and set(zip(rows.subject, rows.run)) == {(s, r) for s in range(2) for r in range(2)}
    if "channel" in rows:
        assert {*zip(rows.subject, rows.run, rows.channel)} == {(s, r, c) for s in range(2) for r in range(2) for c in range(6)}
    alone = f"{twelve}/{name}"
    e.where("label = 0 and cast((vec_id / 2) as int) % 2 = 0").write.parquet(f"{alone}/embeddings.parquet")
    own = QUERIES[name](spark, alone).toPandas()
    assert plain(own) == plain(rows[(rows.subject == 0) & (rows["run"] == 0)])


@pytest.mark.parametrize("parts", ["1", "17"])
def test_partitions_do_not_matter(spark, sf, parts):
    want = plain(QUERIES["fc_node_strength"](spark, sf).toPandas())
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        assert plain(QUERIES["fc_node_strength"](spark, sf).toPandas()) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_consensus_joins_runs_and_bands(spark, twelve):
    wide = X.dense_wide(spark, twelve)
    layers = N.coherence_layers(wide, 512.0, 16, 8, 32 / 512.0, run=X.RUN)
    assert {r.band for r in layers.select("band").distinct().collect()} == {"80-140", "140-200"}
    assert layers.count() == 2 * 4 * 7 * 15 and layers.where("w < 0 or w > 1").count() == 0
    rows = G.consensus(layers, (1, 5), sets=["run", "band"]).toPandas()
    one = G.consensus(layers.where("band = '80-140'"), (1, 5), sets=["run"]).toPandas()
    assert len(rows) == 12 and rows.score.between(0, 1).all() and plain(rows) != plain(one)
    with pytest.raises(Exception, match="same channels"):
        G.consensus(layers.where("run = 0 or j < 5"), (1,), sets=["run", "band"]).count()


def test_nodes_without_edges(spark):
    """A node without edges has a row of zeros, and counts where the number of nodes does."""
    e = spark.createDataFrame([("a", 0, 1, 2.0), ("a", 1, 2, 1.0)], "subject string, i long, j long, w double")
    nodes = spark.createDataFrame([("a", c) for c in range(5)], "subject string, channel long")
    assert {r.channel: r.strength for r in N.node_strength(e, ["subject"], nodes).collect()} == {0: 2.0, 1: 3.0, 2: 1.0, 3: 0.0, 4: 0.0}
    w = np.array([[0, 2, 0, 0, 0], [2, 0, 1, 0, 0], [0, 1, 0, 0, 0], [0] * 5, [0] * 5], dtype=float)
    assert {r.channel: round(r.degree_std, 9) for r in N.degree_std(e, ["subject"], nodes).collect()} == {c: round(w[c].std(), 9) for c in range(5)}
    assert {r.channel: round(r.degree_std, 9) for r in N.degree_std(e, ["subject"]).collect()} == {c: round(w[:3, :3][c].std(), 9) for c in range(3)}
    for metric, f in (("in_closeness", K.closeness), ("pagerank", K.pagerank), ("betweenness", K.betweenness)):
        got = G.centralities(e, ["subject"], nodes=nodes, wanted=(metric,)).collect()
        assert [r.value for r in sorted(got, key=lambda r: r.channel)] == pytest.approx(f(np.triu(w)).tolist())
    rate = G.success_rate(G.node_metrics(e, ["subject"], nodes), ["subject"], spark.createDataFrame([("a",), ("b",)], "subject string"))
    assert {r.subject: r.success_rate for r in rate.collect()} == {"a": 1.0, "b": 0.0}
    assert {r.subject: (r.n_runs, r.mean_success_rate) for r in G.mean_success(rate).collect()} == {"a": (1, 1.0), "b": (1, 0.0)}


def test_nan_stays_and_is_left_out(spark):
    rows = [("a", 0, float("nan")), ("a", 1, 1.0), ("a", 2, 3.0), ("a", 3, float("inf")), ("a", 4, float("-inf")), ("b", 0, float("nan")), ("c", 0, 2.0), ("c", 1, float("nan"))]
    x = L.minmax_metrics(spark.createDataFrame(rows, "subject string, op_window long, value double"), ["subject"])
    got = {(r.subject, r.op_window): r.value for r in x.collect()}
    assert np.isnan(got.pop(("a", 0))) and got == {("a", 1): 0.0, ("a", 2): 1.0, ("a", 3): 1.0, ("a", 4): 0.0, ("b", 0): 0.0, ("c", 0): 0.5, ("c", 1): 0.5}
    assert {(r.subject, r.bin): r.value for r in L.time_bins(x, 5, ["subject"]).where("subject = 'a'").collect()}[("a", 0)] == 0.0


def test_bursts_keep_every_event(spark, tmp_path):
    days = ["2023-12-30 01:00:00", "2024-01-05 00:00:00", "2024-03-01 00:00:00"]
    e = spark.createDataFrame([("a", k, t, 1.0 + k) for k, t in enumerate(days)], "event_type string, user_id long, ts string, value double")
    e.withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events.parquet")
    rows = X.bursts(spark, str(tmp_path)).collect()
    assert len(rows) == 3 * 373 and {(r.channel, r.sample, r.value) for r in rows if r.value} == {(0, 0, 1.0), (1, 36, 2.0), (2, 372, 3.0)}


def test_flat_and_short_signals(spark):
    x = spark.createDataFrame([("a", c, t, float(t * (c == 1))) for c in range(2) for t in range(20)], "subject string, channel long, sample long, value double")
    got = N.sliding_correlation(x, 8, 4).collect()
    assert len(got) == 4 and all(r.w == pytest.approx(0, abs=1e-6) for r in got)
    assert N.sliding_correlation(x, 32, 4).count() == 0
    assert N.sliding_correlation(x, 6, 4).count() == 4  # blocks of two samples
    assert {r.value for r in S.safe_standardise(x).where("channel = 0").collect()} == {0.0}


def test_half_even_windows(spark):
    d = spark.createDataFrame([("a", 300, 500.0), ("b", 10, 500.0)], "subject string, n long, sfreq double")
    rows = S.windows_seconds(d, 0.25, 0.125).collect()
    assert [(r.start, r.stop) for r in rows] == [(0, 125), (62, 187), (124, 249)]


def test_events_merge_and_last(spark):
    up = {3, 4, 5, 7, 8, 20, 40, 41}
    env = spark.createDataFrame([("a", 0, t, 9.0 if t in up else 1.0 + (t % 2) * 1e-3) for t in range(60)], "subject string, channel long, sample long, env double")
    x = env.select("subject", "channel", "sample", F.col("env").alias("value"))
    assert sorted((r.start, r.stop) for r in E.detect(x, env, 10.0, 2, 6, 1).collect()) == [(3, 9), (40, 42)]
    none = E.rate(E.detect(x, env.withColumn("env", F.lit(1.0)), 10.0, 2, 6, 1), x.groupBy("subject", "channel").agg(F.count("*").alias("n")), 10.0).collect()
    assert [(r.n_events, r.rate) for r in none] == [(0, 0.0)]


def test_scores_edges(spark):
    one = spark.createDataFrame([("a", 0, 1.0), ("a", 0, 1.0), ("b", 1, 2.0), ("b", 0, 2.0)], "subject string, y int, score double").withColumn("channel", F.monotonically_increasing_id())
    assert {r.subject: r.auc for r in L.roc_auc(one, ["subject"]).collect()} == {"a": 0.5, "b": 0.5}
    assert {r.subject: r.auc for r in L.roc_auc(one, ["subject"], None).collect()}["a"] is None
    assert {r.score for r in L.minmax_scores(one, ["subject"]).collect()} == {0.0}
    top = {r.subject: r for r in L.topk_metrics(one, ["subject"]).collect()}
    assert top["a"].recall == 0 and top["a"].accuracy == 0.5
    t = spark.createDataFrame([(0, float("inf")), (1, 2.0), (2, 4.0), (3, float("-inf"))], "k int, value double").withColumn("g", F.lit(1))
    assert [r.value for r in L.minmax_metrics(t, ["g"]).orderBy("k").collect()] == [1.0, 0.0, 1.0, 0.0]
    bins = L.time_bins(spark.createDataFrame([("a", w, 1.0) for w in range(194)], "subject string, op_window long, value double"), 6, ["subject"])
    assert bins.count() == 6


def test_loso_learns(spark):
    rng = np.random.default_rng(0)
    rows = [(s, c, [float(rng.normal() + 3 * (c % 3 == 0)), 1.0], int(c % 3 == 0)) for s in range(3) for c in range(30)]
    x = spark.createDataFrame(rows, "subject long, channel long, features array<double>, y int")
    for kind in ("forest", "logistic"):
        out = L.loso(x, kind, 5, 3)
        auc = L.roc_auc(out["predictions"], ["subject"]).collect()
        assert len(auc) == 3 and all(r.auc > 0.8 for r in auc)
    flat = L.loso(x.withColumn("y", F.lit(0)))
    assert flat["skipped"].count() == 3 and flat["predictions"].count() == 0


def test_loso_sizes_and_balance(spark, monkeypatch):
    rows = [(s, c, [float((7 * c + s) % 11), float(c % 5)], int(c % 4 == 0)) for s in range(3) for c in range(20)]
    x = spark.createDataFrame(rows, "subject long, channel long, features array<double>, y int")
    sizes = {how: tuple(L.balance_rows(x, how, 42).where(F.col("y") == k).count() for k in (0, 1)) for how in ("none", "undersample", "positives", "oversample")}
    assert sizes == {"none": (45, 15), "undersample": (15, 15), "positives": (15, 15), "oversample": (45, 45)}
    more = L.balance_rows(x.withColumn("y", 1 - F.col("y")), "positives", 42)
    assert more.where("y = 1").count() == 45 and more.where("y = 0").count() == 15
    with pytest.raises(ValueError, match="smote"):
        L.loso(x, balance="smote")
    made = []

    class Seen(L.RandomForestClassifier):
        def __init__(self, **given):
            made.append((given["numTrees"], given["maxDepth"]))
            super().__init__(**given | {"numTrees": 3, "maxDepth": 3})

    monkeypatch.setattr(L, "RandomForestClassifier", Seen)
    two = x.where("subject < 2")
    scores = [plain(L.loso(two, balance=how)["predictions"].toPandas()) for how in ("none", "undersample")]
    assert set(made) == {(300, 20)} and scores[0] != scores[1]


def test_learners_pass_over_few_partitions(spark, monkeypatch):
    rows = [(s, c, [float((7 * c + s) % 11), float(c % 5)], int(c % 4 == 0)) for s in range(3) for c in range(400)]
    x = spark.createDataFrame(rows, "subject long, channel long, features array<double>, y int").repartition(40)
    parts = []
    for name in ("RandomForestClassifier", "LogisticRegression"):

        class Seen(getattr(L, name)):
            def fit(self, train):
                parts.append(train.rdd.getNumPartitions())
                return super().fit(train)

        monkeypatch.setattr(L, name, Seen)
    for kind in ("forest", "logistic"):
        assert L.loso(x, kind, 3, 3)["predictions"].count() == 1200
    assert len(parts) == 6 and max(parts) <= 4  # 120, of ten rows or fewer each, before


def test_forests_grow_in_parts(spark, monkeypatch):
    assert L.parts_of_forest(300, 200) == [300] and sum(L.parts_of_forest(300, 46_000)) == 300
    assert max(L.parts_of_forest(300, 46_000)) * 46_000 <= L.AT_ONCE and L.parts_of_forest(3, 10**9) == [1, 1, 1]
    rng = np.random.default_rng(0)
    rows = [(s, c, [float(rng.normal() + 3 * (c % 3 == 0)), float(rng.normal())], int(c % 3 == 0)) for s in range(3) for c in range(400)]
    x = spark.createDataFrame(rows, "subject long, channel long, features array<double>, y int").persist()
    grown = []

    class Seen(L.RandomForestClassifier):
        def fit(self, train):
            grown.append((self.getNumTrees(), train.rdd.getNumPartitions()))
            return super().fit(train)

    monkeypatch.setattr(L, "RandomForestClassifier", Seen)
    whole = L.loso(x, "forest", 40, 4)
    monkeypatch.setattr(L, "AT_ONCE", 6_000)
    parts = L.loso(x, "forest", 40, 4)
    # One partition each; before, a fold's 40 trees grew at once over several partitions.
    assert {p for _, p in grown} == {1} and [n for n, _ in grown[:3]] == [40] * 3
    assert sum(n for n, _ in grown[3:]) == 120 and max(n for n, _ in grown[3:]) <= 11
    a, b = (r["predictions"].orderBy("subject", "channel").toPandas() for r in (whole, parts))
    assert len(a) == len(b) == 1200 and list(a.columns) == list(b.columns) and (a.channel == b.channel).all()
    assert np.abs(a.score - b.score).mean() < 0.03 and b.score.between(0, 1).all()
    sums = parts["importances"].groupBy("fold").agg(F.sum("importance").alias("s")).toPandas().s
    assert np.allclose(sums, 1)


def test_channels(spark):
    f = spark.createDataFrame([("a", 0), ("a", 1)], "subject string, channel long")
    soz = spark.createDataFrame([("a", 1), ("a", 9)], "subject string, channel long")
    assert sorted((r.channel, r.y) for r in C.attach_labels(f, soz).collect()) == [(0, 0), (1, 1)]
    assert spark.range(1).select(C.acquisition(F.lit("x/acq-SEEG_run"))).first()[0] == "seeg"
    rec = spark.createDataFrame([("a", 1, 256.0), ("b", 1, 512.0), ("b", 2, 256.0)], "subject string, run int, sfreq double")
    assert C.fast_enough(rec).count() == 2


def test_run_files(spark, tmp_path):
    np.savez(tmp_path / "HUB1_run_01.npz", X=np.zeros((50, 3)), fs=500.0, soz=[1, 7], subject="s1")
    np.savez(tmp_path / "bad_run02.npz", fs=500.0)
    rows = readers.runs(spark, str(tmp_path)).toPandas()
    ok = rows[rows.status == "ok"].sort_values("channel")
    assert ok.y.tolist() == [0, 1, 0] and ok.subject.tolist() == ["s1"] * 3 and ok["run"].tolist() == ["run-01"] * 3 and ok.name.tolist() == ["ch000", "ch001", "ch002"]
    assert rows[rows.status != "ok"].status.tolist() == ["no signal in the file"]
    sinks.signals(readers.runs(spark, str(tmp_path)).where("status = 'ok'"), f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").where("subject = 's1'").count() == 3
    sinks.report(spark.createDataFrame([], "a int"), f"{tmp_path}/csv")
    long = spark.createDataFrame([("a", "f1", 1.0), ("b", "f2", 2.0)], "subject string, feature string, value double")
    assert sorted(map(tuple, sinks.wide_features(long, ["f1", "f2"]).collect())) == [("a", 1.0, 0.0), ("b", 0.0, 2.0)]


def test_edf(spark, tmp_path):
    def field(v, n):
        return str(v).ljust(n).encode()

    head = field("0", 8) + field("", 80) * 2 + field("", 8) * 2 + field(512, 8) + field("", 44) + field(2, 8) + field(1, 8) + field(1, 4)
    head += b"".join([field("A1", 16), field("", 80), field("uV", 8), field(-100, 8), field(100, 8), field(-1000, 8), field(1000, 8), field("", 80), field(4, 8), field("", 32)])
    (tmp_path / "sub-x_task-ictal_run-01.edf").write_bytes(head + np.arange(8, dtype="<i2").tobytes())
    r = readers.edf(spark, str(tmp_path)).first()
    assert (r.name, r.sfreq, r.subject) == ("A1", 4.0, "x") and np.allclose(r.samples, np.arange(8) / 10)


def test_streams(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 4).alias("channel"), "value")
    e.write.parquet(f"{tmp_path}/in")
    live = spark.readStream.schema(e.schema).parquet(f"{tmp_path}/in")
    for name, f in (("power", bursts.window_power), ("bursts", lambda d: bursts.bursts(d, 1.0))):
        q = f(live).writeStream.format("memory").queryName(name).outputMode("append" if name == "bursts" else "complete").trigger(availableNow=True).start()
        q.awaitTermination(60)
    assert spark.table("power").count() == bursts.window_power(e).count()


@pytest.mark.parametrize("with_channels", [32, 1])
def test_consensus_of_runs_of_different_shapes(spark, monkeypatch, with_channels):
    """runs of one shape are taken together, others by themselves, and couplings are dealt into tasks by channels."""
    monkeypatch.setattr(G, "WITH_CHANNELS", with_channels)
    rng, rows, want = np.random.default_rng(4), [], {}
    for run, (n, t) in enumerate([(8, 5), (8, 5), (6, 5), (8, 4)]):
        mats = {}
        for c in (1.0, 5.0):
            mats[c] = []
        for band in ("a", "b"):
            layers = np.abs(rng.normal(size=(t + (run == 3 and band == "b"), n, n)))
            layers = np.triu(layers, 1) + np.triu(layers, 1).transpose(0, 2, 1)
            for c in mats:
                mats[c].append(K.multilayer_centrality(layers, c))
            rows += [(1, run, band, k, int(i), int(j), float(layers[k, i, j])) for k in range(len(layers)) for i, j in zip(*np.triu_indices(n, 1))]
        want[run] = K.consensus(mats, (20, 40))
    layers = spark.createDataFrame(rows, "subject long, run long, band string, window long, i long, j long, w double").repartition(3)
    nodes = layers.selectExpr("subject", "run", "explode(array(i, j)) as channel").distinct()
    got = G.consensus(layers, (1, 5), (20, 40), sets=["band"], keys=["subject", "run"], nodes=nodes).toPandas().sort_values("channel")
    for run, (score, top) in want.items():
        mine = got[got.run == run]
        assert np.allclose(mine.score, score) and list(mine.top) == list(top)


def test_layers_are_made_once(spark, sf):
    """each Python step of mlevc_quantised is in its plan once; joins with sums of themselves made edges and layers anew."""
    plan = QUERIES["mlevc_quantised"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert {step: plan.count(step) for step in ("ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas")} == {"ArrowEvalPython": 1, "FlatMapGroupsInPandas": 1, "MapInPandas": 1}


def test_cuts_of_groups(spark):
    """cuts, loops and windows stay as joins made them: unknown keys have no row, nor have nodes of runs without layers or signals that are too short."""
    rng = np.random.default_rng(7)
    rows = [(g, None if k == 3 else k, int(i), float(v)) for g in (1, 2, None) for k in range(4) for i, v in enumerate(rng.normal(size=9).round(1))]
    x = spark.createDataFrame(rows, "subject long, run long, window long, w double")
    values = {}
    for g, k, i, v in rows:
        if g is not None and k is not None:
            values.setdefault((g, k), []).append((i, v))
    want = {(*key, i): int(level) for key, v in values.items() for (i, _), level in zip(v, K.quantise(np.array([w for _, w in v]), 20))}
    assert {(r.subject, r.run, r.window): r.value for r in G.quantise(x.withColumnRenamed("w", "value"), 20.0, ["subject", "run"]).collect()} == want
    want = {(*key, i) for key, v in values.items() for i, w in v if w > 0 and w >= np.quantile([w for _, w in v if w > 0], 0.8)}
    assert {(r.subject, r.run, r.window) for r in N.quantile_sparsify(x, 0.8, ["subject", "run"]).collect()} == want

    layers = spark.createDataFrame([(1, 4, 0, 1, 0.5), (1, 3, 0, 2, 0.25)], "subject long, window long, i long, j long, w double")
    nodes = spark.createDataFrame([(s, c) for s in (1, 2, None) for c in range(2)], "subject long, channel long")
    assert sorted(tuple(r) for r in G.layer_nodes(layers, nodes, ["subject"]).collect()) == [(1, 3, 0, 0, 0.0), (1, 3, 0, 2, 0.25), (1, 3, 1, 1, 0.0), (1, 4, 0, 1, 0.5)]

    wide = spark.createDataFrame([(1, n, None if n < 0 else [float(k) for k in range(n)]) for n in (-1, 0, 3, 4, 7, 8)], "subject long, channel long, samples array<double>")
    got = [(r.channel, r.first, r.x) for r in N.window_chunks(wide, 4, 2, True, ["subject"], 2).orderBy("channel", "first").collect()]
    assert got == [(4, 0, [0.0, 1.0, 2.0, 3.0]), (7, 0, [0.0, 1.0, 2.0, 3.0, 4.0, 5.0]), (8, 0, [0.0, 1.0, 2.0, 3.0, 4.0, 5.0]), (8, 2, [4.0, 5.0, 6.0, 7.0])]

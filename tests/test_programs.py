"""The programs over files, from recordings to evaluations, and the sources that they read."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from recordings import edf_bytes, put_recording

from sulcus import cli
from sulcus.functions import kernels as K
from sulcus.functions import network as W
from sulcus.operators import connectivity as N
from sulcus.operators import graphs as G
from sulcus.operators import learning as T
from sulcus.operators import signal as S
from sulcus.plans import programs as P
from sulcus.sources import edf, readers, sinks

RATE = 512


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    """A BIDS tree: two good subjects (one of two runs), and a recording for each way to fail."""
    root, rng = tmp_path_factory.mktemp("bids"), np.random.default_rng(4)
    draw = lambda ch, rate=RATE, seconds=6: rng.integers(-900, 900, (ch, rate * seconds))
    names = ["A1", "A2", "A3", "A4"]
    x = draw(4)
    put_recording(root, "a1", 1, names, x, RATE, ["good", "bad", "good", "good"], ["soz", "n/a", "soz,resect", "n/a"])
    put_recording(root, "a1", 2, names, draw(4), RATE, ["good", "good", "good", "bad"], ["soz", "n/a", "resect", "n/a"], onset=3.0)
    put_recording(root, "b1", 1, ["X", "EDF Annotations", "Y"], draw(3), RATE)
    put_recording(root, "c1", 1, names, draw(4), RATE, events=False)
    put_recording(root, "c2", 1, names, draw(4), RATE, channels=False)
    put_recording(root, "c3", 1, names, draw(4, 256), 256)
    put_recording(root, "c4", 1, names, draw(4), RATE, cut=5000)
    put_recording(root, "c5", 1, names, draw(4), RATE, ["bad"] * 4)
    put_recording(root, "c6", 1, names, draw(4), RATE, onset="n/a")
    put_recording(root, "c7", 1, names, draw(4), RATE, cut=100)
    return root, x


def test_edf_in_parts(spark, tree, tmp_path):
    """A file larger than a split is read in parts that join to the same samples; channels can be left out; faults are rows."""
    root, x = tree
    at = f"{root}/sub-a1"
    whole = {(r["run"], r["name"]): r for r in readers.edf(spark, at).collect()}
    assert np.allclose(whole["run-01", "A3"].samples, x[2] / 10) and whole["run-01", "A3"].sfreq == RATE and whole["run-01", "A3"].subject == "a1"
    parts = readers.edf_parts(spark, at, split_bytes=9000, row_bytes=4200, channels="A1, A3")
    assert parts.rdd.getNumPartitions() > 4 and parts.where("run = 'run-01' and name = 'A3'").count() == 6
    cut = {(r["run"], r["name"]): r for r in readers.whole_channels(parts).collect()}
    assert set(cut) == {(r, c) for r in ("run-01", "run-02") for c in ("A1", "A3")}
    assert all(cut[k].samples == whole[k].samples and cut[k].channel == whole[k].channel for k in cut)
    heads = readers.edf_parts(spark, at, headers="true", split_bytes=9000)
    assert heads.count() == 8 and {(r["run"], r["name"], r.sfreq, r.channel) for r in heads.collect()} == {(*k, float(RATE), r.channel) for k, r in whole.items()}
    every = readers.edf(spark, str(root)).where("status <> 'ok'").select("subject", "status", "channel", "samples").collect()
    assert sorted((r.subject, r.channel) for r in every) == [("c4", None), ("c7", None)] and all(not r.samples for r in every)
    names = sorted((r["channel"], r["name"]) for r in readers.edf(spark, f"{root}/sub-b1").collect())
    assert names == [(0, "X"), (1, "Y")]  # annotations are no channel
    one = next((root / "sub-b1").rglob("*.edf"))
    assert readers.edf(spark, str(one)).count() == 2
    (tmp_path / "empty").mkdir()
    assert readers.edf(spark, str(tmp_path / "empty")).count() == 0
    (tmp_path / "open_task-ictal.edf").write_bytes(edf_bytes(["A"], np.arange(16)[None], 4, records=-1))
    assert np.allclose(readers.edf(spark, str(tmp_path)).first().samples, np.arange(16) / 10)


def test_preprocess(spark, tree, tmp_path):
    root, x = tree
    status = {(r["subject"], r["run"]): r["status"] for r in P.preprocess(spark, str(root), str(tmp_path), before=1.0, after=1.5).collect()}
    said = {k[0]: v for k, v in status.items() if k[0] > "b2"}
    assert len(status) == 10 and {k: v for k, v in status.items() if k[0] < "b2"} == {("a1", "run-01"): "ok", ("a1", "run-02"): "ok", ("b1", "run-01"): "ok"}
    assert said["c1"] == "no events table" and said["c2"] == "no channels table" and said["c3"] == "sampling rate below 500 Hz" and said["c5"] == "no good channel" and said["c6"] == "no onset"
    assert "records are announced" in said["c4"] and "header" in said["c7"]
    made = spark.read.parquet(f"{tmp_path}/signals/sfreq-512").collect()
    assert sorted((r.subject, r.run, r.name) for r in made) == sorted([("a1", "run-01", n) for n in ("A1", "A3", "A4")] + [("a1", "run-02", n) for n in ("A1", "A2", "A3")] + [("b1", "run-01", n) for n in "XY"])
    one = {r.name: r for r in made if (r.subject, r.run) == ("a1", "run-01")}
    assert one["A1"].sfreq == 500 and all(len(r.samples) == 1251 for r in one.values())  # 1 s to 3.5 s
    step = lambda v: K.fft_resample(K.bandpass(K.notch(v / 10, RATE), RATE), len(v) * 500 // RATE)
    want = np.array([step(x[k].astype(float)) for k in (0, 2, 3)])
    want = (want - want.mean(0))[:, 500:1751]
    assert np.allclose([one[n].samples for n in ("A1", "A3", "A4")], want, atol=1e-8)
    labels = {r.subject: r for r in spark.read.parquet(f"{tmp_path}/labels").collect()}
    assert set(labels["a1"].soz_names) == {"A1", "A3"} and labels["a1"].resected_names == ["A3"] and labels["b1"].soz_names == []


def test_preprocess_nothing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    assert P.preprocess(spark, str(tmp_path / "in"), f"{tmp_path}/out").count() == 0


def some_runs(spark, subjects=3, channels=6, n=2400, seed=1):
    """Signals in which channel 0 bursts late in the run; it is labelled."""
    rng, rows = np.random.default_rng(seed), []
    for s in range(subjects):
        for c in range(channels):
            v = rng.normal(size=n)
            if c == 0:
                v[n // 2 :] += 6 * np.sin(np.arange(n - n // 2) * 2.2)
            rows.append((f"s{s}", "run-01", c, f"ch{c:03d}", v.tolist(), int(c == 0)))
    return spark.createDataFrame(rows, "subject string, run string, channel long, name string, samples array<double>, y int")


def test_graph_features_and_loso(spark, tmp_path):
    wide = some_runs(spark)
    found = P.graph_features(wide, f"{tmp_path}/g", 200, 50, 10, 5, 3)
    assert found.where("metric = 'strength'").count() == 3 * 6 * 3 * found.where("subject = 's0'").select("op_window").distinct().count()
    soz = wide.where("y = 1").select("subject", "channel")
    tables = P.loso_classification(found, soz, f"{tmp_path}/l", bins=2, modes=3, trees=5, depth=4)
    assert tables["subject_metrics"].count() == 3 and spark.read.option("header", "true").csv(f"{tmp_path}/l/channel_predictions").count() == 18


def test_baselines_and_attention(spark, tmp_path):
    wide = some_runs(spark)
    means = P.baselines(wide, 100.0, f"{tmp_path}/b", ("hfo", "fragility"), model="logistic")
    assert {r["method"] for r in means.collect()} == {"hfo", "fragility"}
    met = P.attention(wide, 100.0, f"{tmp_path}/a", onset=12, sequence=4, epochs=2, hidden=6)
    assert met.count() == 3 and spark.read.option("header", "true").csv(f"{tmp_path}/a/attention_predictions").count() == 18
    kept = T.load_weights(spark, f"{tmp_path}/a/weights")
    assert set(kept) == {"s0", "s1", "s2"} and kept["s0"]["filter0"].shape == (12, 12, 3)
    again = P.attention(wide, 100.0, f"{tmp_path}/c", sequence=4, weights=kept)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, met.collect()))


def test_consensus_over_runs(spark):
    """A subject's runs vote together, by the channels that all of them have; every run gets the subject's scores."""
    a = some_runs(spark, 1, 5, 1600)
    b = some_runs(spark, 1, 4, 1600, seed=2).withColumn("run", F.lit("run-02"))
    got = P.baseline_features(a.unionByName(b), 512.0, "consensus", onset=1.5).collect()
    by = {r.channel: r.value for r in got if r["run"] == "run-01"}
    assert set(by) == {0, 1, 2, 3} and by == {r.channel: r.value for r in got if r["run"] == "run-02"}
    assert {r.feature for r in got} == {"mlevc_consensus"} and all(0 <= v <= 1 for v in by.values())


def test_command_line(spark, tree, tmp_path):
    cli.main(["preprocess", "--data-dir", f"{tree[0]}/sub-a1", "--out-dir", f"{tmp_path}/p", "--before", "1", "--after", "2"], spark)
    cli.main(["graph-features", "--data-dir", f"{tmp_path}/p/signals/sfreq-512", "--out-dir", f"{tmp_path}/g", "--width", "200", "--step", "50", "--windows", "5", "--hop", "2", "--modes", "2"], spark)
    assert spark.read.parquet(f"{tmp_path}/g/node_metrics").select("subject", "run").distinct().count() == 2


# -- kernels behind them


@pytest.mark.parametrize(("width", "step", "inclusive", "windows"), [(16, 8, True, 32), (16, 8, False, 2), (20, 15, True, 3), (12, 12, True, 1), (15, 4, False, 5)])
def test_block_correlation(spark, width, step, inclusive, windows):
    rng = np.random.default_rng(width)
    x = rng.normal(size=(5, 100)) + 1000
    x[3] = 7.0  # constant
    wide = spark.createDataFrame([("a", c, v.tolist()) for c, v in enumerate(x)] + [("b", 0, [1.0] * 5), ("b", 1, [1.0] * 5)], "subject string, channel long, samples array<double>")
    got = {(r.window, r.i, r.j): r.w for r in N.block_correlation(wide, width, step, inclusive, windows=windows).collect()}
    long = wide.select("subject", "channel", F.posexplode("samples").alias("sample", "value")).withColumn("sample", F.col("sample").cast("long"))
    want = {(r.window, r.i, r.j): r.w for r in N.sliding_correlation(long, width, step, inclusive).collect()}
    starts = range(0, 100 - width + (1 if inclusive else 0), step)
    assert set(got) == set(want) and len(got) == len(starts) * 10
    assert all(abs(got[k] - want[k]) < 1e-6 for k in got)
    assert abs(got[0, 0, 1] - np.corrcoef(x[0, :width], x[1, :width])[0, 1]) < 1e-9 and abs(got[0, 0, 3]) < 1e-6


def test_channel_pairs(spark):
    nodes = spark.createDataFrame([("a", c) for c in (2, 5, 7, 9)] + [("b", 1)], "subject string, channel long")
    got = sorted((r.edge, r.i, r.j) for r in N.channel_pairs(nodes).collect())
    assert got == [(k, i, j) for k, (i, j) in enumerate([(2, 5), (2, 7), (2, 9), (5, 7), (5, 9), (7, 9)])]


def test_cross_mapping_by_source(spark):
    rng = np.random.default_rng(3)
    x = np.cumsum(rng.normal(size=(4, 300)), 1)
    wide = spark.createDataFrame([("a", c, v.tolist()) for c, v in enumerate(x)], "subject string, channel long, samples array<double>")
    want = K.cross_map(x, 3, 1)
    got = {(r.i, r.j): r.w for r in N.cross_mapping(wide, 3, 1).collect()}
    assert set(got) == {(i, j) for i in range(4) for j in range(4) if i != j} and all(abs(w - want[k]) < 1e-12 for k, w in got.items())
    m = np.array([[0.0], [1.0], [1.0], [2.0], [1.0]])
    assert K.neighbours(m, 2)[0].tolist() == [[1, 2], [2, 4], [1, 4], [1, 2], [1, 2]]


def test_array_reference(spark):
    wide = some_runs(spark, 1, 3, 50)
    a = {r.channel: r.samples for r in S.array_average_reference(wide, ["subject", "run"]).collect()}
    x = np.stack([r.samples for r in wide.orderBy("channel").collect()])
    assert np.allclose([a[c] for c in range(3)], x - x.mean(0))


def test_gradients_by_finite_differences():
    """Every parameter's gradient, encoder and graph together, and that a trained network's weights give the same attributes."""
    rng = np.random.default_rng(0)
    segments = rng.normal(size=(7, 3, 20))
    p = {k: v + 0.05 * rng.normal(size=v.shape) for k, v in W.initial(1, 5).items()}
    p["node"] = rng.normal(size=5)
    p["time"] = rng.normal(size=W.WIDE)
    targets, y = np.array([3, 4, 5, 6]), np.array([0, 0, 1, 1])
    loss, grad, met = W.run_gradient(segments, p, targets, y, 3)
    x = W.flat(p)
    names = np.concatenate([np.full(p[k].size, k) for k in sorted(p)])
    checked = set()
    for name in p:
        for at in rng.choice(np.flatnonzero(names == name), min(3, p[name].size), replace=False):
            values = []
            for side in (1e-5, -1e-5):
                moved = x.copy()
                moved[at] += side
                values.append(W.run_gradient(segments, W.unflat(moved, p), targets, y, 3)[0])
            slope = (values[0] - values[1]) / 2e-5
            assert abs(slope - grad[at]) < 1e-6 + 1e-4 * abs(slope), name
            checked.add(name)
    assert checked == set(p) and loss > 0
    a, kept = W.encode(segments[0], p)
    assert np.allclose(K.gated_convolutions(segments[0], W.trained_weights(p, W.statistics(kept))), a)


def test_gradients_of_many_runs_at_once(monkeypatch):
    """Sums over runs are those of single runs, whole blocks of runs or one segment after another; before, each run was a call of its own."""
    rng = np.random.default_rng(2)
    segments, p = rng.normal(size=(9, 8, 5, 6)), W.initial(3, 4)
    targets, y = (np.stack(v) for v in zip(*[W.balanced_targets(8, 3, 5, k) for k in range(9)]))
    alone = [W.run_gradient(segments[k], p, targets[k], y[k], 3) for k in range(9)]
    for limit, some in ((1 << 30, 9), (3 * W.AT_ONCE // W.runs_at_once(8, 5, 6), 3), (1, 0)):
        monkeypatch.setattr(W, "AT_ONCE", limit)
        assert min(9, W.runs_at_once(8, 5, 6)) == some
        for at, got in enumerate(W.runs_gradient(segments, p, targets, y, 3)):
            assert np.allclose(got, sum(a[at] for a in alone), rtol=1e-9, atol=1e-12)


def test_runs_of_other_shapes_share_a_step(spark):
    """A step's loss is the mean over all runs, of any shape, that the fold's subject has not given; runs without targets teach nothing."""
    wide = some_runs(spark, 3, 3, 320).unionByName(some_runs(spark, 3, 2, 260).withColumn("run", F.concat(F.lit("x"), "run"))).unionByName(some_runs(spark, 3, 2, 60).withColumn("run", F.concat(F.lit("z"), "run")))
    _, losses = T.train_attention(wide, 20, 4, 8, epochs=1, hidden=4, per_update=1000)
    got = {r["subject"]: (r["n_runs"], r["loss"]) for r in losses.collect()}
    runs: dict = {}
    for r in wide.orderBy("channel").collect():
        runs.setdefault((r["subject"], r["run"]), []).append(r["samples"])
    for k, s in enumerate(sorted({s for s, _ in runs})):
        p, own = W.initial(k, 4), []
        for (subject, run), x in runs.items():
            seg = T.run_segments(np.array([x], dtype=float), 20)[0]
            targets, y = W.balanced_targets(len(seg), 4, 8, zlib.crc32(f"0/{subject}/{run}".encode()))
            if subject != s and len(y):
                own.append(W.run_gradient(seg, p, targets, y, 4)[0])
        assert got[s][0] == len(own) and abs(got[s][1] - np.mean(own)) < 1e-9


def test_training_lowers_the_loss(spark):
    """Late segments differ from early ones, and networks learn to tell them apart; each subject's network has not seen it."""
    wide = some_runs(spark, 3, 3, 640)
    weights, losses = T.train_attention(wide, 20, 4, 16, epochs=3, rate=2e-2, hidden=6, per_update=1)
    mean = {r["epoch"]: r["m"] for r in losses.groupBy("epoch").agg(F.avg("loss").alias("m")).collect()}
    assert mean[2] < mean[0] - 0.01 and set(weights) == {"s0", "s1", "s2"}
    alone, _ = T.train_attention(wide.where("subject = 's0'"), 20, 4, 16, epochs=1)
    assert alone == {}  # nobody else to learn from
    other, _ = T.train_attention(wide.where("subject <> 's2'"), 20, 4, 16, epochs=1, rate=2e-2, hidden=6)
    score = G.attention_score(wide.where("subject <> 's2'"), 20, 4, run=["subject", "run"], by_subject=other).collect()
    assert len(score) == 6 and all(0 <= r.score <= 1 for r in score)


def test_path_metrics_by_blocks(spark):
    """A graph of 90 nodes in blocks of sources gives what whole kernels give; also one without edges."""
    rng = np.random.default_rng(5)
    w = np.where(rng.random((90, 90)) < 0.08, rng.integers(1, 4, (90, 90)), 0).astype(float)  # equal paths
    np.fill_diagonal(w, 0)
    w[80:] = w[:, 80:] = 0
    i, j = np.nonzero(w)
    edges = spark.createDataFrame([("g", int(p), int(q), float(w[p, q])) for p, q in zip(i, j)], "subject string, i long, j long, w double")
    nodes = spark.createDataFrame([("g", c) for c in range(90)], "subject string, channel long")
    got = {(r.metric, r.channel): r.value for r in G.path_centralities(edges, ["subject"], nodes=nodes, block=16).collect()}
    want = {"in_closeness": K.closeness(w), "out_closeness": K.closeness(w.T), "local_efficiency": K.local_efficiency(w), "betweenness": K.betweenness(w)}
    assert len(got) == 4 * 90
    for m, v in want.items():
        assert np.allclose([got[m, c] for c in range(90)], v, atol=1e-12), m


def test_sketched_modes():
    """A randomised range finder finds the leading modes of an operator of higher rank, up to a small part of the first value left out."""
    rng = np.random.default_rng(2)
    x = np.cumsum(rng.normal(size=(41, 300)), 0)
    exact, sketch = K.evolution_modes(x[:-1], x[1:], 5), K.evolution_modes(x[:-1], x[1:], 5, sketch=1)
    assert np.allclose(exact[0], sketch[0], rtol=0.02) and exact[3] == sketch[3]
    q, b = np.linalg.qr(rng.normal(size=(300, 40)))[0], rng.normal(size=(40, 300)) * 0.7 ** np.arange(40)[:, None]
    u, s, v = K.leading_modes(q, b, 5, 1)
    values = np.linalg.svd(b)[1]
    assert np.linalg.norm(q @ b - (u * s) @ v.T, 2) <= 1.01 * values[5]
    few = K.leading_modes(q[:, :8], b[:8], 5, 1)
    assert np.allclose(few[1], np.linalg.svd(b[:8])[1][:5])


def test_grouped_streams_groups(spark):
    """Groups that span Arrow batches stay whole."""
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        x = spark.range(500).selectExpr("cast(pow(id, 1.3) as long) % 37 as k", "cast(id % 2 as string) as s", "id")
        got = N.grouped(x, ["k", "s"], lambda g: g.groupby(["k", "s"], as_index=False).agg(n=("id", "size")), "k long, s string, n long")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, x.groupBy("k", "s").count().collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_small_edf_files_share_a_task(tmp_path):
    for k in range(400):
        (tmp_path / f"{k}.edf").write_bytes(b"-" * 3000)
    reader = edf.EdfReader({"path": str(tmp_path), "split_bytes": "2500"})
    parts = reader.partitions()
    assert len(parts) < 160 and sum(len(b.parts) for b in parts) == 800  # a task for each part before
    large = [edf.Part("x", 640 << 20, k, 10) for k in range(10)]
    assert [len(b.parts) for b in edf.bundles(large, edf.TASK)] == [1] * 10
    assert [r.to_pylist()[0]["path"].rsplit("/")[-1] for b in parts for r in reader.read(b)] == sorted(f"{k}.edf" for k in range(400))


def test_metrics_of_many_runs_lie_in_few_files(spark, tmp_path):
    x = spark.range(400).selectExpr("id % 2 as subject", "id div 2 as run", "id as channel", "0.5 as value").repartition(7)
    sinks.metrics(x, f"{tmp_path}/m")
    assert len(list(tmp_path.glob("m/**/*.parquet"))) <= 2 * 4  # shuffle partitions; a file for each run and task before
    assert spark.read.parquet(f"{tmp_path}/m").select("run").distinct().count() == 200

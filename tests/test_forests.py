"""Trees against every possible cut, and forests dealt over tasks against forests that grow by passes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sulcus.functions import forest as T
from sulcus.operators import evaluation as L
from sulcus.operators import forests
from sulcus.plans.catalogue import QUERIES


def mixed(y, times, weights):
    w = [(times * (y == k)).sum() * weights[k] for k in (0, 1)]
    return w[0] * w[1] / sum(w)


@pytest.mark.parametrize("seed", range(12))
def test_first_cut_is_the_best(seed):
    g = np.random.default_rng(seed)
    n, leaf, weights = int(g.integers(8, 60)), seed % 3 + 1, np.array([1.3, 0.6])
    x = np.stack([np.round(g.normal(size=n)), g.normal(size=n), np.zeros(n)], 1)
    y = np.arange(n) % 3 % 2
    tree = T.grow(T.ranks(x), y, weights, 1, 2, leaf, 3, np.random.default_rng(seed))
    times = np.bincount(np.random.default_rng(seed).integers(0, n, n), minlength=n)
    bag = times > 0
    x, y, times = x[bag], y[bag], times[bag]
    sides = lambda f, cut: (x[:, f] <= cut, x[:, f] > cut)
    cuts = [(f, v) for f in range(3) for v in np.unique(x[:, f])[:-1] if min(s.sum() for s in sides(f, v)) >= leaf]
    best = min(sum(mixed(y[s], times[s], weights) for s in sides(f, v)) for f, v in cuts)
    own = sides(tree.feature[0], tree.cut[0])
    assert len(tree.feature) == 3 and np.isclose(sum(mixed(y[s], times[s], weights) for s in own), best)
    ones = [(times[s] * y[s]).sum() * 0.6 / ((times[s] * y[s]).sum() * 0.6 + (times[s] * (1 - y[s])).sum() * 1.3) for s in own]
    assert np.allclose(tree.share[1:], ones) and np.isclose(tree.gain.sum(), 1) and tree.gain[tree.feature[0]] == 1


def test_rules_of_trees():
    g = np.random.default_rng(1)
    x, y = g.normal(size=(400, 6)), g.integers(0, 2, 400)
    x[:, 5] = np.where(g.random(400) < 0.1, np.inf, x[:, 5])
    bag = np.bincount(np.random.default_rng(2).integers(0, 400, 400), minlength=400) > 0
    for depth, split, leaf in ((20, 5, 2), (3, 2, 1), (20, 30, 10)):
        tree = T.grow(T.ranks(x), y, np.ones(2), depth, split, leaf, 2, np.random.default_rng(2))
        rows, level = {0: bag}, {0: 0}
        for k, f in enumerate(tree.feature):
            if f >= 0:
                low = x[:, f] <= tree.cut[k]
                rows |= {tree.left[k]: rows[k] & low, tree.left[k] + 1: rows[k] & ~low}
                level |= {tree.left[k]: level[k] + 1, tree.left[k] + 1: level[k] + 1}
                assert rows[k].sum() >= split
            assert rows[k].sum() >= leaf and level[k] <= depth
        assert sorted(rows) == list(range(len(tree.feature)))
        got = T.shares(tree, np.ascontiguousarray(x.T))
        assert all((got[rows[k]] == tree.share[k]).all() for k, f in enumerate(tree.feature) if f < 0)
    assert len(set(map(tuple, np.sort(T.some_features(500, 4, 2, g), 1).tolist()))) == 6


def test_constant_features_are_passed_over():
    x = np.zeros((50, 9))
    x[:, 4] = np.arange(50)
    tree = T.grow(T.ranks(x), (np.arange(50) > 20).astype(int), np.ones(2), 5, 2, 1, 1, np.random.default_rng(0))
    assert tree.feature[0] == 4 and tree.gain[4] == 1 and set(T.shares(tree, x.T.copy())) == {0.0, 1.0}
    nothing = T.grow(T.ranks(np.zeros((50, 2))), np.arange(50) % 2, np.ones(2), 5, 2, 1, 1, np.random.default_rng(0))
    assert len(nothing.feature) == 1 and not nothing.gain.any()


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(0)
    rows = [(s, c, [float(rng.normal() + 1.5 * (c % 3 == 0)), float(rng.normal()), float(rng.normal()), 0.0], int(c % 3 == 0)) for s in range(3) for c in range(300)]
    return spark.createDataFrame(rows, "subject long, channel long, features array<double>, y int").persist()


def scores(x, *args):
    return L.loso(x, "forest", *args)["predictions"].orderBy("subject", "channel").toPandas()


def test_no_job_for_a_level_of_a_forest(spark, labelled):
    def jobs(*args):
        before = set(spark.sparkContext.statusTracker().getJobIdsForGroup())
        scores(labelled, *args)
        return len(set(spark.sparkContext.statusTracker().getJobIdsForGroup()) - before)

    assert jobs(30, 20) <= jobs(3, 2) + 3  # by passes, each fold has about two jobs more for each level


def test_parts_change_nothing_and_passes_agree(spark, labelled, monkeypatch):
    # Two of four features a node, and no least size of a node that is split, either way.
    whole = L.loso(labelled, "forest", 40, 8, split=2)
    a = whole["predictions"].orderBy("subject", "channel").toPandas()
    monkeypatch.setattr(L, "AT_ONCE", 3_000)
    b = L.loso(labelled, "forest", 40, 8, split=2)["predictions"].orderBy("subject", "channel").toPandas()
    assert len(a) == 900 and (a.channel == b.channel).all() and np.allclose(a.score, b.score, atol=1e-12)
    monkeypatch.setattr(forests, "CELLS", 1)
    passes = L.loso(labelled, "forest", 40, 8, split=2)
    c = passes["predictions"].orderBy("subject", "channel").toPandas()
    assert list(c.columns) == list(a.columns) and (c.y == a.y).all()
    # A row's shares deviate by some 0.4 from tree to tree, so two means of 40 trees differ by 0.07 on average.
    assert np.abs(a.score - c.score).mean() < 0.08 and abs((a.score - c.score).mean()) < 0.01
    areas = [{r.subject: r.auc for r in L.roc_auc(r["predictions"], ["subject"]).collect()} for r in (whole, passes)]
    assert all(v > 0.75 and abs(v - areas[1][k]) < 0.05 for k, v in areas[0].items())
    for r in (whole, passes):
        gains = r["importances"].groupBy("fold").pivot("feature", [0, 1, 2, 3]).agg(F.first("importance")).toPandas()
        assert np.allclose(gains[["0", "1", "2", "3"]].sum(1), 1) and (gains["3"] == 0).all() and (gains["0"] > gains["1"]).all()


def test_repeated_keys_and_odd_rows(spark, labelled):
    twice = labelled.withColumn("channel", F.floor(F.col("channel") / 2).cast("long"))
    got = scores(twice, 5, 4)
    assert len(got) == 900 and got.score.between(0, 1).all()
    for odd in ([0.5, None, 0.0, 0.0], [0.5, 0.0]):
        bad = labelled.unionByName(spark.createDataFrame([(0, 999, odd, 1)], "subject long, channel long, features array<double>, y int"))
        with pytest.raises(Exception, match="features, or one that is null|NULL_ELEMENT|null"):
            scores(bad, 2, 2)


def test_importance_query_makes_few_jobs(spark, sf):
    def jobs():
        return set(spark.sparkContext.statusTracker().getJobIdsForGroup())

    folds = spark.read.parquet(f"{sf}/embeddings.parquet").select("label").distinct().count()
    before = jobs()
    rows = QUERIES["feature_importance"](spark, sf).collect()
    made = len(jobs() - before)
    means = [r["mean"] for r in rows]
    assert sorted(r["feature"] for r in rows) == list(range(12)) and means == sorted(means, reverse=True) and abs(sum(means) - 1) < 1e-5
    # Each level of a forest that grows by passes is a job or two.
    assert made < 25 * folds, (made, folds)

"""Kernels against closed forms and direct computations."""

import numpy as np
import pytest

from sulcus.functions import kernels as K

RNG = np.random.default_rng(1)


def test_analytic_by_circulant():
    for n in (63, 64):
        x = RNG.normal(size=n)
        m = np.arange(n)[:, None] - np.arange(n)[None]
        with np.errstate(divide="ignore", invalid="ignore"):
            g = 2 / n / np.tan(np.pi * m / n) * (m % 2 == 1) if n % 2 == 0 else (1 / np.tan(np.pi * m / n) - np.cos(np.pi * m) / np.sin(np.pi * m / n)) / n
        g[np.arange(n), np.arange(n)] = 0
        g = np.where(m == 0, 0, g)
        assert np.allclose(K.analytic(x).imag, g @ x) and np.allclose(K.analytic(x).real, x)


def test_filters_pass_and_stop():
    fs, t = 500.0, np.arange(2000) / 500.0
    inside, outside, mains = (np.sin(2 * np.pi * f * t) for f in (120, 20, 60))
    for f in (lambda x: K.bandpass(x, fs), lambda x: K.sections_both_ways(x, K.butter_sections(fs, 80, 200))):
        assert np.abs(f(inside)[300:-300] - inside[300:-300]).max() < 0.05 and np.abs(f(outside)[300:-300]).max() < 0.02
    assert np.abs(K.notch(mains, fs)[600:-600]).max() < 0.05
    with pytest.raises(ValueError):
        K.bandpass(inside, 200.0)


def test_resample_and_decimate():
    t = np.arange(400) / 400.0
    x = np.cos(2 * np.pi * 5 * t)
    assert np.allclose(K.fft_resample(x, 500), np.cos(2 * np.pi * 5 * np.arange(500) / 500.0), atol=1e-9)
    y = K.decimate(x, 400.0, 50.0)
    assert len(y) == 50 and np.abs(y[12:-12] - x[::8][12:-12]).max() < 0.02


@pytest.mark.parametrize("rank", (3, 6))
def test_evolution_modes_equal_the_direct_way(rank):
    x = RNG.normal(size=(6, rank)) @ RNG.normal(size=(rank, 15))
    y = RNG.normal(size=(6, 15))
    k = np.linalg.lstsq(x, y, rcond=1e-10)[0]
    u, s, vt = np.linalg.svd(k)
    sigma, left, right, energy = K.evolution_modes(x, y, rank)
    assert np.allclose(sigma, s[:rank]) and np.isclose(energy, (k * k).sum())
    assert np.allclose(np.abs((left * u[:, :rank]).sum(0)), 1) and np.allclose(np.abs((right * vt[:rank].T).sum(0)), 1)


def test_graph_metrics_closed_forms():
    full = np.ones((5, 5)) - np.eye(5)
    assert np.allclose(K.eigenvector_centrality(full), 1 / np.sqrt(5)) and np.allclose(K.nodal_efficiency(full), 1, atol=1e-6)
    assert np.allclose(K.pagerank(full), 0.2) and np.allclose(K.directed_clustering(full), 1) and np.allclose(K.closeness(full), 1)
    star = np.zeros((4, 4))
    star[0, 1:] = star[1:, 0] = 1
    assert np.allclose(K.betweenness(star), [1, 0, 0, 0]) and np.allclose(K.local_efficiency(star), 0)
    assert not any(v.any() for v in K.ten_centralities(np.zeros((3, 3))).values() if v is not None and v.sum() != pytest.approx(1))


def test_metrics_follow_a_renaming_of_channels():
    w = np.where(RNG.random((7, 7)) < 0.5, RNG.random((7, 7)), 0)
    np.fill_diagonal(w, 0)
    p = RNG.permutation(7)
    a, b = K.ten_centralities(w), K.ten_centralities(w[np.ix_(p, p)])
    assert all(np.allclose(a[k][p], b[k], atol=1e-6) for k in a)


def test_perturbation_of_a_scalar():
    assert np.allclose(K.perturbation_norms(np.array([[0.3]])), 0.7)


def test_fragility_range_and_errors():
    v = K.fragility(RNG.normal(size=(5, 60)))
    assert v.min() == 0 and v.max() == pytest.approx(1)
    with pytest.raises(ValueError):
        K.fragility(np.full((2, 10), np.nan))


def test_cross_map_sees_coupling():
    x = np.zeros((2, 400))
    x[:, 0] = 0.4, 0.2
    for t in range(399):
        x[0, t + 1] = x[0, t] * (3.8 - 3.8 * x[0, t])
        x[1, t + 1] = x[1, t] * (3.5 - 3.5 * x[1, t] - 0.3 * x[0, t])
    w = K.cross_map(x, 2, 1)
    assert w[1, 0] > 0.9 > w[0, 1] and w[0, 0] == 0
    with pytest.raises(ValueError):
        K.delay_embedding(np.zeros(4), 3, 1)


def test_multilayer_and_clusters():
    layers = np.abs(RNG.normal(size=(3, 4, 4)))
    layers = layers + layers.transpose(0, 2, 1)
    assert K.multilayer_centrality(layers).shape == (4, 3)
    assert set(np.unique(K.quantise(np.arange(100.0), 20))) == {-1, 0, 1} and (K.quantise(np.ones(5), 20) == 1).all()
    x = np.concatenate([RNG.normal(0, 0.1, (8, 2)), RNG.normal(5, 0.1, (3, 2))])
    assert K.two_clusters(x).tolist() == [0] * 8 + [1] * 3 and K.target_cluster(x)[0].tolist() == [False] * 8 + [True] * 3
    assert K.three_means(np.array([0.0, 0.1, 5, 5.1, 9, 9.2])).tolist() == [0, 0, 1, 1, 2, 2]
    score, _ = K.consensus({1.0: RNG.normal(size=(10, 6))})
    assert 0 <= score.min() and score.max() <= 1


def test_three_means_of_many_values():
    rng = np.random.default_rng(4)
    for n in (3, 4, 7, 12):
        v = np.round(rng.normal(size=n), 1)
        u = np.unique(v)
        if len(u) > 2:
            spread = lambda part: ((part - part.mean()) ** 2).sum()
            cost = lambda i, j: sum(spread(p) for p in (v[v < u[i]], v[(v >= u[i]) & (v < u[j])], v[v >= u[j]]))
            i, j = min(((i, j) for i in range(1, len(u) - 1) for j in range(i + 1, len(u))), key=lambda c: cost(*c))
            assert K.three_means(v).tolist() == ((v >= u[i]).astype(int) + (v >= u[j])).tolist()
            assert K.three_means(*np.unique(v, return_counts=True)).tolist() == ((u >= u[i]).astype(int) + (u >= u[j])).tolist()
    many = K.three_means(np.concatenate([rng.normal(m, 0.1, 20000) for m in (0, 5, 9)]))  # every pair of cuts would take hours
    assert np.bincount(many).tolist() == [20000] * 3


def test_target_cluster_weights():
    x = np.array([[0.0, 0], [0.1, 90], [0, -80], [0.1, 10], [0.05, 50], [5, 4000], [5.2, 4100]])
    inside, worth = K.target_cluster(x)
    z = (x - x.mean(0)) / x.std(0)
    a, b = z[inside], z[~inside]
    assert inside.tolist() == [False] * 5 + [True] * 2
    assert worth == pytest.approx(((a.mean(0) - b.mean(0)) ** 2).sum() / (np.linalg.norm(a[0] - a[1]) * np.linalg.norm(a[0] - a[1]) / 2))
    one, worth = K.target_cluster(np.array([[0.0, 0], [0.1, 0], [0, 0.1], [0.1, 0.1], [9, 9]]))
    assert one.tolist() == [False] * 4 + [True] and worth == 0
    assert K.target_cluster(np.zeros((2, 2)))[1] == 0


def test_centroid_cut_by_brute_force():
    for _ in range(20):
        x = np.concatenate([RNG.normal(c, 0.3, (k, 3)) for c, k in ((0, 5), (6, 4), (20, 3))])
        groups = [[k] for k in range(12)]
        while len(groups) > 3:
            _, i, j = min((((x[a].mean(0) - x[b].mean(0)) ** 2).sum(), i, j) for j, b in enumerate(groups) for i, a in enumerate(groups[:j]))
            groups[i] += groups.pop(j)
        lab = K.centroid_cut(x, 3)
        assert {tuple(np.flatnonzero(lab == k)) for k in range(3)} == {tuple(sorted(g)) for g in groups}


def test_consensus_votes_by_case():
    mats = {c: [RNG.normal(size=(14, 5)), RNG.normal(size=(14, 7))] for c in (1.0, 5.0)}
    labels, weights = [], []
    for sets in mats.values():
        for p in (10, 20, 30, 40, 50, 60, 70, 80):
            u = np.linalg.svd(np.hstack([K.quantise(m, p) for m in sets]).astype(float))[0]
            found = [K.target_cluster(u[:, list(c)]) for c in ((0, 1), (0, 2), (1, 2), (0, 1, 2), (0, 1, 2, 3))]
            found = [(t, w) for t, w in found if w > 0]
            if found:
                total = sum(w for _, w in found)
                part = sum(w * t for t, w in found) / total
                labels.append(part > ((len(found) - 1) / len(found) if len(found) > 1 else 0.5))
                weights.append(total)
    want = np.average(labels, axis=0, weights=weights)
    want = (want - want.min()) / (want.max() - want.min() + 1e-12)
    score, top = K.consensus(mats)
    assert np.allclose(score, want) and top[score.argmax()] and not top.all()
    none, top = K.consensus({1.0: [np.eye(2)]})
    assert not none.any() and not top.any()


def test_network_forward():
    """The encoder and one step of the graph network by loops over their definitions."""
    w = K.network_weights(3)
    x = RNG.normal(size=(2, 16))
    got = K.gated_convolutions(x, w)
    assert got.shape == (2, 10)
    sig = lambda v: 1 / (1 + np.exp(-v))
    at = lambda h, c, t: h[c, t] if 0 <= t < h.shape[1] else 0.0
    for r in range(2):
        h = np.array([[max(0.0, sum(w["in"][f, k] * at(x, r, t + k - 2) for k in range(5))) for t in range(16)] for f in range(12)])
        for level in range(3):
            new = np.empty_like(h)
            for f in range(12):
                for t in range(16):
                    a, b = (sum(w[n + str(level)][f, c, j] * at(h, c, t - (2 - j) * 2**level) for c in range(12) for j in range(3)) for n in ("filter", "gate"))
                    new[f, t] = max(0.0, h[f, t] + np.tanh(a) * sig(b))
            h = new
        h = np.maximum(w["out"] @ h, 0)
        z = np.exp(w["time"] @ np.tanh(h))
        assert np.allclose(got[r], w["attributes"] @ (h @ (z / z.sum())))
    att, logits = K.graph_attention(RNG.normal(size=(5, 4, 10)), w)
    assert att.shape == (5, 4) and np.allclose(att.sum(1), 1) and logits.shape == (2,)
    other = K.network_weights(4)
    assert not np.allclose(K.gated_convolutions(x, other), got)


def test_betweenness_by_enumeration():
    for _ in range(10):
        w = np.where(RNG.random((6, 6)) < 0.4, RNG.integers(1, 3, (6, 6)), 0).astype(float)
        np.fill_diagonal(w, 0)
        want = np.zeros(6)
        for s in range(6):
            for t in range(6):
                if s == t:
                    continue
                paths = [[s]]
                done = []
                while paths:
                    p = paths.pop()
                    if p[-1] == t:
                        done.append((sum(1 / (w[a, b] + 1e-12) for a, b in zip(p, p[1:])), p))
                        continue
                    paths += [[*p, v] for v in range(6) if w[p[-1], v] > 0 and v not in p]
                if done:
                    best = min(d for d, _ in done)
                    short = [p for d, p in done if d <= best + 1e-9]
                    for v in range(6):
                        want[v] += sum(v in p[1:-1] for p in short) / len(short)
        assert np.allclose(K.betweenness(w), want / 20)


def test_largest_pairs_are_those_of_the_whole_matrix(monkeypatch):
    layers = np.abs(RNG.normal(size=(30, 8, 8))) * (RNG.random((30, 8, 8)) < 0.3)
    layers = layers + layers.transpose(0, 2, 1)
    layers[5] = layers[6] = 0
    for most in (None, 3):
        want = K.multilayer_centrality(layers, 2.0, most)
        monkeypatch.setattr(K, "MOST_DENSE", 10)
        assert np.allclose(K.multilayer_centrality(layers, 2.0, most), want, atol=1e-5)
        monkeypatch.undo()
    values, vectors = K.largest_pairs(lambda v: 2.0 * v, 50, 4)  # every vector is one
    assert np.allclose(values, 2) and np.allclose(vectors.T @ vectors, np.eye(4))


def test_ridge_is_fixed():
    x = RNG.normal(size=(3, 40))
    a, b = x[:, :-1], x[:, 1:]
    want = b @ a.T @ np.linalg.inv(a @ a.T + 1e-4 * np.eye(3))
    assert np.allclose(K.ridge_transition(x), want)
    grown = np.cumprod(np.full((1, 30), 1.5), axis=1)
    assert np.abs(np.linalg.eigvals(K.ridge_transition(grown))).max() == pytest.approx(0.99)
    with pytest.raises(ValueError):
        K.ridge_transition(x, -1.0)
    assert np.isfinite(K.ridge_transition(np.zeros((2, 10)), 0.0)).all()


def test_kernels_of_stacked_runs_equal_those_of_single_ones():
    """consensus queries take all runs of a batch at once."""
    x = RNG.normal(size=(6, 40))
    sections = K.butter_sections(512.0, 80, 200)
    assert np.array_equal(K.sections_both_ways(x, sections), np.stack([K.sections_both_ways(v, sections) for v in x]))
    layers = np.abs(RNG.normal(size=(9, 4, 5, 5)))
    layers += layers.transpose(0, 1, 3, 2)
    coupling = np.arange(1.0, 10)
    got = K.multilayer_centralities(layers, coupling)
    assert np.allclose(got, np.stack([K.multilayer_centrality(m, c) for m, c in zip(layers, coupling)]), rtol=0, atol=1e-12)
    percents = (10, 40, 80)
    levels = K.quantised_sets(got.reshape(3, 3, 5, 4), percents)
    for g in range(3):
        for k, p in enumerate(percents):
            assert np.array_equal(levels[g, k], np.concatenate([K.quantise(m, p) for m in got[3 * g : 3 * g + 3]], 1))
    cases = levels.reshape(9, 5, 12)
    inside, worth = K.consensus_cases(cases)
    for k, case in enumerate(cases):
        one = K.consensus_case(case)
        assert np.array_equal(inside[k], one[0]) and np.isclose(worth[k], one[1])
    for n in (2, 3, 8, 30):
        rows = np.round(RNG.normal(size=(20, n, 2)), 1)  # heights tie
        left, right, height = K.centroid_trees(rows)
        for b, r in enumerate(rows):
            tree = K.centroid_tree(r)
            assert [(a, c) for _, a, c, _ in tree[n:]] == list(zip(left[b, n:], right[b, n:])) and np.allclose([h for *_, h in tree], height[b])
            for k in (2, 3):
                labels = np.unique(K.cut_trees(left, right, height, k)[b], return_inverse=True)[1] if n > 2 else None
                assert n == 2 or np.array_equal(labels, K.cut_tree(tree, k))

"""Dense numerical kernels: plain numpy on one channel, window or graph at a time."""

from __future__ import annotations

import math

import numpy as np

# -- filters -----------------------------------------------------------------------------------


def fir_taps(fs: float, low: float, high: float, stop: bool = False, length: int | None = None) -> np.ndarray:
    """Hamming-windowed sinc band-pass taps, or band-stop with stop=True."""
    n = (length or int(3.3 * fs / max(min(low, fs / 2 - high, high - low) / 4, 1.0))) | 1
    k = np.arange(n) - (n - 1) / 2
    band = 2 * high / fs * np.sinc(2 * high / fs * k) - 2 * low / fs * np.sinc(2 * low / fs * k)
    taps = band * np.hamming(n)
    if stop:
        taps = -taps
        taps[(n - 1) // 2] += 1
    return taps


def zero_phase_fir(x: np.ndarray, taps: np.ndarray) -> np.ndarray:
    """Convolution with symmetric taps, centred, on a signal that is odd-reflected at both ends."""
    pad = min(len(taps) // 2, len(x) - 1)
    y = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]]) if pad else x
    n = 1 << (len(y) + len(taps) - 2).bit_length()
    full = np.fft.irfft(np.fft.rfft(y, n) * np.fft.rfft(taps, n), n)
    at = pad + len(taps) // 2
    return full[at : at + len(x)]


def notch(x: np.ndarray, fs: float, freqs=(60.0, 180.0), width: float = 2.0) -> np.ndarray:
    for f in freqs:
        if f + width < fs / 2:
            x = zero_phase_fir(x, fir_taps(fs, f - width, f + width, True, int(fs) | 1))
    return x


def bandpass(x: np.ndarray, fs: float, low: float = 80.0, high: float = 200.0) -> np.ndarray:
    if not 0 < low < high < fs / 2:
        raise ValueError(f"band {low}-{high} Hz does not fit a rate of {fs} Hz")
    return zero_phase_fir(x, fir_taps(fs, low, high))


def fft_resample(x: np.ndarray, n: int) -> np.ndarray:
    """Band-limited resampling to n samples."""
    have = len(x)
    s = np.fft.rfft(x)
    out = np.zeros(n // 2 + 1, dtype=complex)
    m = min(have, n)
    out[: m // 2 + 1] = s[: m // 2 + 1]
    if m % 2 == 0 and n != have:  # the shared Nyquist bin is halved or doubled
        out[m // 2] *= 0.5 if n > have else 2.0
        if n < have:
            out[m // 2] = out[m // 2].real
    return np.fft.irfft(out, n) * n / have


def butter_sections(fs: float, low: float, high: float, order: int = 4) -> np.ndarray:
    """Second-order sections [order, 6] of a Butterworth band-pass, by the bilinear transform."""
    if not 0 < low < high < fs / 2:
        raise ValueError(f"band {low}-{high} Hz does not fit a rate of {fs} Hz")
    w1, w2 = (2 * fs * math.tan(math.pi * f / fs) for f in (low, high))
    proto = np.exp(1j * math.pi * (2 * np.arange(order) + order + 1) / (2 * order)) * (w2 - w1) / 2
    root = np.sqrt(proto**2 - w1 * w2 + 0j)
    poles = np.concatenate([proto + root, proto - root])
    z = (2 * fs + poles) / (2 * fs - poles)
    z = z[np.imag(z) > 0]
    z = z[np.argsort(-np.abs(z))][:order]
    out = np.array([[1.0, 0.0, -1.0, 1.0, -2 * p.real, abs(p) ** 2] for p in z])
    mid = np.exp(2j * math.pi * math.sqrt(low * high) / fs)
    centre = 2 * math.atan(math.sqrt(w1 * w2) / (2 * fs))
    mid = np.exp(1j * centre)
    gain = np.prod([(s[0] + s[1] / mid + s[2] / mid**2) / (s[3] + s[4] / mid + s[5] / mid**2) for s in out])
    out[:, :3] *= (1 / abs(gain)) ** (1 / order)
    return out


def sections_both_ways(x: np.ndarray, sections: np.ndarray) -> np.ndarray:
    """Forward and backward through the sections, on an odd extension; zero phase.  x: samples, or [channel, sample] of as many samples each."""
    pad = min(3 * (2 * len(sections) + 1), x.shape[-1] - 1)
    x = x.T  # a step takes one sample of all channels
    y = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    for _ in range(2):
        for b0, b1, b2, _one, a1, a2 in sections:
            gain = (b0 + b1 + b2) / (1 + a1 + a2)
            s2 = (b2 - a2 * gain) * y[0]
            s1 = (b1 - a1 * gain) * y[0] + s2
            out = np.empty_like(y)
            for i, v in enumerate(y):
                o = b0 * v + s1
                s1, s2 = b1 * v - a1 * o + s2, b2 * v - a2 * o
                out[i] = o
            y = out
        y = y[::-1]
    return y[pad : pad + len(x)].T


def decimate(x: np.ndarray, fs: float, target: float) -> np.ndarray:
    """Low-pass FIR and every q-th sample, q = round(fs / target); unchanged if the rate is low already."""
    q = round(fs / target)
    if target >= fs or q < 2:
        return x
    half = 10 * q
    k = np.arange(-half, half + 1)
    taps = np.sinc(k / q) / q * np.kaiser(2 * half + 1, 5.0)
    taps /= taps.sum()
    return np.convolve(x, taps)[half : half + len(x)][::q]


def analytic(x: np.ndarray) -> np.ndarray:
    n = x.shape[-1]
    gain = np.zeros(n)
    gain[0] = 1
    gain[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        gain[n // 2] = 1
    return np.fft.ifft(np.fft.fft(x, axis=-1) * gain, axis=-1)


# -- windowed evolution operators ----------------------------------------------------------------


#: Columns beyond those asked for, and power steps, of a randomised range finder.
OVERSAMPLES, POWERS = 10, 3


def leading_modes(q: np.ndarray, b: np.ndarray, modes: int, sketch: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, values, right) singular modes of K = q b, q having orthonormal columns: those of the small b, or of K's sketch by random vectors."""
    if sketch is None or b.shape[0] <= modes + OVERSAMPLES:  # a sketch as wide as K's rank holds all of it
        u, s, vt = np.linalg.svd(b, full_matrices=False)
        return q @ u[:, :modes], s[:modes], vt[:modes].T
    z = np.random.default_rng(sketch).normal(size=(b.shape[1], modes + OVERSAMPLES))
    y = np.linalg.qr(b @ z)[0]
    for _ in range(POWERS):
        y = np.linalg.qr(b @ np.linalg.qr(b.T @ y)[0])[0]
    u, s, vt = np.linalg.svd(y.T @ b, full_matrices=False)
    return q @ (y @ u[:, :modes]), s[:modes], vt[:modes].T


def evolution_modes(x: np.ndarray, y: np.ndarray, modes: int = 10, rcond: float = 1e-10, sketch: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(singular values, left [E, k], right [E, k], energy) of the least-norm K with x K = y, never forming K.

    With x = P S Q', K = Q B for B = S^-1 P' y, so K's singular vectors are Q times those of the small B.  sketch: see `leading_modes`.
    """
    p, s, qt = np.linalg.svd(x, full_matrices=False)
    keep = s > rcond * s[0] if len(s) and s[0] > 0 else np.zeros(len(s), dtype=bool)
    if not keep.any():
        return np.zeros(0), np.zeros((x.shape[1], 0)), np.zeros((x.shape[1], 0)), 0.0
    b = (p[:, keep].T @ y) / s[keep, None]
    u, sigma, v = leading_modes(qt[keep].T, b, modes, sketch)
    sign = np.sign(u[np.abs(u).argmax(axis=0), np.arange(u.shape[1])])
    sign[sign == 0] = 1
    return sigma, u * sign, v * sign, float((b * b).sum())


# -- graph metrics (w: square, non-negative, zero diagonal; w[i, j] is the edge i -> j) -------------


def shortest(dist: np.ndarray) -> np.ndarray:
    """All-pairs shortest paths by Floyd and Warshall; inf where there is none."""
    d = dist.copy()
    np.fill_diagonal(d, 0)
    for k in range(len(d)):
        np.minimum(d, d[:, k, None] + d[None, k, :], out=d)
    return d


def lengths(w: np.ndarray, eps: float) -> np.ndarray:
    return np.where(w > 0, 1 / (w + eps), np.inf)


def nodal_efficiency(w: np.ndarray, eps: float = 1e-8) -> np.ndarray:
    """Mean of 1/d over the nodes that can be reached; 0 if there are none."""
    d = shortest(lengths(w, eps))
    ok = np.isfinite(d) & (d > 0)
    inv = np.where(ok, 1 / np.where(ok, d, 1), 0)
    return inv.sum(1) / np.maximum(ok.sum(1), 1)


def eigenvector_centrality(w: np.ndarray) -> np.ndarray:
    if not w.any():
        return np.zeros(len(w))
    v = np.abs(np.linalg.eigh((w + w.T) / 2)[1][:, -1])
    return v / np.linalg.norm(v)


def closeness(w: np.ndarray, eps: float = 1e-12) -> np.ndarray:
    """By distances into each node, scaled by the share of nodes that reach it."""
    d = shortest(lengths(w, eps)).T
    n = len(w)
    ok = np.isfinite(d)
    reach, total = ok.sum(1) - 1, np.where(ok, d, 0).sum(1)
    return np.where(total > 0, reach / np.where(total > 0, total, 1) * reach / max(n - 1, 1), 0)


def directed_clustering(w: np.ndarray) -> np.ndarray:
    top = w.max(initial=0)
    if top <= 0:
        return np.zeros(len(w))
    a, c = (w > 0).astype(float), np.cbrt(w / top)
    both = c + c.T
    triangles = np.diagonal(both @ both @ both) / 2
    degree = a.sum(0) + a.sum(1)
    pairs = degree * (degree - 1) - 2 * (a * a.T).sum(1)
    return np.where((triangles > 0) & (pairs > 0), triangles / np.where(pairs > 0, pairs, 1), 0)


def local_efficiency(w: np.ndarray, eps: float = 1e-12, at: np.ndarray | None = None) -> np.ndarray:
    """Of all nodes, or of those at `at` (0 elsewhere)."""
    out = np.zeros(len(w))
    for i in range(len(w)) if at is None else at:
        near = np.flatnonzero((w[i] > 0) | (w[:, i] > 0))
        near = near[near != i]
        if len(near) < 2:
            continue
        d = shortest(lengths(w[np.ix_(near, near)], eps))
        np.fill_diagonal(d, np.inf)
        out[i] = np.where(np.isfinite(d), 1 / d, 0).sum() / (len(near) * (len(near) - 1))
    return out


def betweenness(w: np.ndarray, eps: float = 1e-12) -> np.ndarray:
    """Share of shortest paths through each node, over ordered pairs: paths are counted from each source in order of distance."""
    n, step = len(w), lengths(w, eps)
    d = shortest(step)
    out = np.zeros(n)
    for s in range(n):
        order = np.argsort(d[s], kind="stable")
        order = order[np.isfinite(d[s, order])]
        with np.errstate(invalid="ignore"):
            tight = np.abs(d[s][:, None] + step - d[s][None]) <= 1e-12 * d[s][None]  # edges of shortest paths
        tight &= np.isfinite(step)
        paths, share = np.zeros(n), np.zeros(n)
        paths[s] = 1
        for v in order[1:]:
            paths[v] = paths @ tight[:, v]
        for v in order[:0:-1]:
            share += tight[:, v] * paths / paths[v] * (1 + share[v])
            out[v] += share[v]
    return out / ((n - 1) * (n - 2)) if n > 2 else out


def shortest_from(step: np.ndarray, sources: np.ndarray) -> np.ndarray:
    """Shortest distances [source, node] by Dijkstra's method, all sources at once; inf where there is none."""
    rows = np.arange(len(sources))
    d = np.full((len(sources), len(step)), np.inf)
    d[rows, sources] = 0
    open_ = np.ones(d.shape, dtype=bool)
    for _ in range(len(step)):
        near = np.where(open_, d, np.inf).argmin(1)
        open_[rows, near] = False
        np.minimum(d, d[rows, near][:, None] + step[near], out=d)
    return d


def betweenness_from(w: np.ndarray, sources: np.ndarray, eps: float = 1e-12) -> np.ndarray:
    """The share of `betweenness` that shortest paths from these sources add, not yet divided by the number of pairs."""
    step, out = lengths(w, eps), np.zeros(len(w))
    np.fill_diagonal(step, np.inf)
    for s, d in zip(sources, shortest_from(step, sources)):
        order = np.argsort(d, kind="stable")
        order = order[np.isfinite(d[order])]
        with np.errstate(invalid="ignore"):
            tight = (np.abs(d[:, None] + step - d[None]) <= 1e-12 * d[None]) & np.isfinite(step)
        paths, share = np.zeros(len(w)), np.zeros(len(w))
        paths[s] = 1
        for v in order[1:]:
            paths[v] = paths @ tight[:, v]
        for v in order[:0:-1]:
            share += tight[:, v] * paths / paths[v] * (1 + share[v])
            out[v] += share[v]
    return out


def closeness_from(w: np.ndarray, sources: np.ndarray, eps: float = 1e-12) -> np.ndarray:
    """Out-closeness of these nodes; that of the transposed graph is in-closeness."""
    d = shortest_from(lengths(w, eps), sources)
    ok = np.isfinite(d)
    reach, total = ok.sum(1) - 1, np.where(ok, d, 0).sum(1)
    return np.where(total > 0, reach / np.where(total > 0, total, 1) * reach / max(len(w) - 1, 1), 0)


def pagerank(w: np.ndarray, alpha: float = 0.85, tol: float = 1e-6, rounds: int = 100) -> np.ndarray:
    n = len(w)
    total = w.sum(1)
    move = np.divide(w, total[:, None], out=np.zeros_like(w), where=total[:, None] > 0)
    x = np.full(n, 1 / n)
    for _ in range(rounds):
        last = x
        x = alpha * (x @ move + x[total == 0].sum() / n) + (1 - alpha) / n
        if np.abs(x - last).sum() < n * tol:
            break
    return x


def hits(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hubs, authorities), each of sum 1."""
    if not w.any():
        return np.zeros(len(w)), np.zeros(len(w))
    u, _, vt = np.linalg.svd(w)
    h, a = np.abs(u[:, 0]), np.abs(vt[0])
    return h / h.sum(), a / a.sum()


CENTRALITIES = {
    "in_strength": lambda w: w.sum(0),
    "out_strength": lambda w: w.sum(1),
    "in_closeness": closeness,
    "out_closeness": lambda w: closeness(w.T),
    "clustering": directed_clustering,
    "local_efficiency": local_efficiency,
    "betweenness": betweenness,
    "pagerank": pagerank,
    "hubs": lambda w: hits(w)[0],
    "authorities": lambda w: hits(w)[1],
}


def ten_centralities(w: np.ndarray, wanted: tuple[str, ...] | None = None) -> dict[str, np.ndarray]:
    """Each metric (of those wanted) is zero where it fails, and where it is not finite."""
    out = {}
    for name in wanted or CENTRALITIES:
        try:
            out[name] = CENTRALITIES[name](w)
        except (np.linalg.LinAlgError, FloatingPointError, ZeroDivisionError):
            out[name] = np.zeros(len(w))
    return {k: np.nan_to_num(v, nan=0.0, posinf=0.0, neginf=0.0) for k, v in out.items()}


def four_metrics(w: np.ndarray) -> tuple[dict[str, np.ndarray], bool]:
    """Strength, degree spread, eigenvector centrality and nodal efficiency of an undirected graph, and whether all went well.

    A graph with a weight that isn't finite fails, and a failed graph's metrics are 0.
    """
    a = np.abs(w)
    try:
        if not np.isfinite(a).all():
            raise np.linalg.LinAlgError("a weight isn't finite")
        return {"strength": a.sum(1), "degree_std": a.std(1), "eigenvector": eigenvector_centrality(a), "global_efficiency": nodal_efficiency(a)}, True
    except np.linalg.LinAlgError:
        return {k: np.zeros(len(w)) for k in ("strength", "degree_std", "eigenvector", "global_efficiency")}, False


# -- bursts ---------------------------------------------------------------------------------------


def burst_events(x: np.ndarray, env: np.ndarray, least: int, most: int, gap: int, k: float = 5.0) -> list[tuple[int, int, float, float, float]]:
    """(start, stop, largest envelope, mean envelope, mean square of x) of runs above median + k * 1.4826 * MAD, joined over short gaps."""
    mid = np.median(env)
    up = env > mid + k * 1.4826 * (np.median(np.abs(env - mid)) + 1e-12)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], up, [False]]).astype(np.int8)))
    start, stop = edge[::2], edge[1::2]
    if len(start):
        new = np.concatenate([[True], start[1:] - stop[:-1] > gap])
        start, stop = start[new], stop[np.concatenate([new[1:], [True]])]
    ok = (stop - start >= least) & (stop - start <= most)
    return [(int(a), int(b), float(env[a:b].max()), float(env[a:b].mean()), float((x[a:b] ** 2).mean())) for a, b in zip(start[ok], stop[ok])]


# -- cross mapping --------------------------------------------------------------------------------


def delay_embedding(x: np.ndarray, dim: int, tau: int) -> np.ndarray:
    n = len(x) - (dim - 1) * tau
    if n <= dim + 2:
        raise ValueError("the signal is too short to be embedded")
    return np.stack([x[i * tau : i * tau + n] for i in range(dim)], axis=1)


#: Embedded points whose distances to all others are held at once.
POINTS = 256


def neighbours(m: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest other rows of each row of m, the first of equal distance first, and their distances."""
    near, far = np.zeros((len(m), k), dtype=int), np.zeros((len(m), k))
    for at in range(0, len(m), POINTS):
        part = m[at : at + POINTS]
        d = np.sqrt(sum((part[:, None, c] - m[None, :, c]) ** 2 for c in range(m.shape[1])))
        d[np.arange(len(part)), at + np.arange(len(part))] = np.inf
        near[at : at + POINTS] = np.argsort(d, axis=1, kind="stable")[:, :k]
        far[at : at + POINTS] = np.take_along_axis(d, near[at : at + POINTS], 1)
    return near, far


def cross_map_from(x: np.ndarray, i: int, dim: int = 3, tau: int = 1) -> np.ndarray:
    """score[j]: how well the neighbours in channel i's embedding predict channel j."""
    out = np.zeros(len(x))
    m = delay_embedding(x[i], dim, tau)
    k = min(dim + 1, len(m) - 1)
    if k < 2:
        return out
    near, dk = neighbours(m, k)
    weight = np.exp(-dk / (dk[:, :1] + 1e-12))
    weight /= weight.sum(1, keepdims=True)
    for j in range(len(x)):
        target = x[j, (dim - 1) * tau :]
        guess = (target[near] * weight).sum(1)
        if j != i and target.std() >= 1e-12 and guess.std() >= 1e-12:
            out[j] = max(0.0, np.corrcoef(target, guess)[0, 1])
    return np.nan_to_num(out)


def cross_map(x: np.ndarray, dim: int = 3, tau: int = 1) -> np.ndarray:
    """score[i, j] of all channels."""
    return np.stack([cross_map_from(x, i, dim, tau) for i in range(len(x))])


# -- fragility ------------------------------------------------------------------------------------


#: What is tried on a singular system, as shares of its largest diagonal entry.
JITTERS = (1e-10, 1e-8, 1e-6, 1e-4)


def ridge_transition(x: np.ndarray, alpha: float = 1e-4, radius: float = 0.99) -> np.ndarray:
    """A with x[:, 1:] ~ A x[:, :-1], shrunk by a ridge and scaled to a stable spectral radius."""
    if x.ndim != 2 or x.shape[1] < 2 or not np.isfinite(x).all():
        raise ValueError("a window needs two finite samples at least")
    if alpha < 0:
        raise ValueError("a ridge can't be negative")
    now, then = x[:, :-1], x[:, 1:]
    gram, cross, eye = now @ now.T, then @ now.T, np.eye(len(x))
    eps = np.finfo(float).eps
    system = (gram + gram.T) / 2 + max(alpha, eps) * eye
    unit = max(float(np.abs(gram.diagonal()).max(initial=0)), 1.0)
    k = None
    for lift in (0.0, *JITTERS):
        try:
            k = np.linalg.solve(system + lift * unit * eye, cross.T).T
        except np.linalg.LinAlgError:
            continue
        break
    if k is None:
        values, vectors = np.linalg.eigh(system)
        large = values > eps * len(x) * max(float(np.abs(values).max(initial=0)), 1.0)
        k = cross @ (vectors[:, large] / values[large]) @ vectors[:, large].T
    top = np.abs(np.linalg.eigvals(k)).max(initial=0)
    return k * (radius / (top + 1e-12)) if top > radius else k


#: Bytes of the systems of several angles that are solved at once.
AT_ONCE = 1 << 24


def perturbation_norms(a: np.ndarray, angles: int = 64) -> np.ndarray:
    """Per channel the least real row perturbation that moves an eigenvalue to the unit circle, over angles of the half circle."""
    n, best = len(a), np.full(len(a), np.inf)
    turn = np.exp(1j * np.linspace(0, np.pi, angles))
    some = max(1, AT_ONCE // (16 * n * n + 1))
    for at in range(0, angles, some):
        m = turn[at : at + some, None, None] * np.eye(n) - a
        try:
            r = np.linalg.inv(m)
        except np.linalg.LinAlgError:
            r = np.linalg.pinv(m)  # that of a regular system is its inverse
        aa, bb, ab = (r.real**2).sum(1), (r.imag**2).sum(1), (r.real * r.imag).sum(1)
        det = aa * bb - ab * ab
        norm = np.where(bb <= 1e-12, 1 / np.sqrt(np.maximum(aa, 1e-300)), np.where(det > 1e-18, np.sqrt(np.maximum(bb, 0) / np.where(det > 1e-18, det, 1)), np.inf))
        best = np.minimum(best, norm.min(0))
    return np.nan_to_num(best, nan=np.inf)


def fragility(x: np.ndarray) -> np.ndarray:
    """Inverse perturbation norms of the channels of a window of standardised signals, scaled to 0..1."""
    norm = perturbation_norms(ridge_transition(x))
    score = np.where(np.isfinite(norm), 1 / (np.where(np.isfinite(norm), norm, 1) + 1e-12), 0)
    spread = score.max() - score.min()
    return (score - score.min()) / (spread + 1e-12) if spread >= 1e-12 else np.zeros(len(score))


# -- multilayer graphs ----------------------------------------------------------------------------


#: Supra-graphs up to this many nodes are decomposed whole.
MOST_DENSE = 1500


def supra_product(layers: np.ndarray, coupling: float, v: np.ndarray) -> np.ndarray:
    """The supra-graph's matrix times a vector, without the matrix: layers on the diagonal, couplings of a node to itself beside it."""
    x = v.reshape(layers.shape[:2])
    y = np.einsum("tij,tj->ti", layers, x)
    y[:-1] += coupling * x[1:]
    y[1:] += coupling * x[:-1]
    return y.ravel()


def largest_pairs(product, n: int, k: int, tol: float = 1e-9, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues, ascending, and their vectors of a symmetric n x n operator: Lanczos steps, kept orthogonal, until k residuals are small."""
    rng = np.random.default_rng(seed)
    most, m = n, min(n, 2 * k + 40)
    q = np.zeros((m, n))
    alpha, beta = np.zeros(most), np.zeros(most)
    v = rng.normal(size=n)
    q[0] = v / np.linalg.norm(v)
    j = 0
    while True:
        while j < m:
            u = product(q[j])
            alpha[j] = u @ q[j]
            for _ in range(2):
                u -= q[: j + 1].T @ (q[: j + 1] @ u)
            beta[j] = np.linalg.norm(u)
            if beta[j] <= 1e-12 * max(1.0, np.abs(alpha[: j + 1]).max()):
                beta[j] = 0.0  # an invariant subspace is whole: go on in what is left
                u = rng.normal(size=n)
                for _ in range(2):
                    u -= q[: j + 1].T @ (q[: j + 1] @ u)
            if j + 1 < m:
                q[j + 1] = u / np.linalg.norm(u)
            j += 1
        values, s = np.linalg.eigh(np.diag(alpha[:m]) + np.diag(beta[: m - 1], 1) + np.diag(beta[: m - 1], -1))
        if m == n or (beta[m - 1] * np.abs(s[-1, -k:])).max() <= tol * max(1.0, np.abs(values).max()) and beta[m - 1] > 0:
            return values[-k:], q[:m].T @ s[:, -k:]
        last, m = m, min(n, m + max(40, k))
        q = np.vstack([q, np.zeros((m - last, n))])
        q[last] = u / np.linalg.norm(u)


def multilayer_centralities(layers: np.ndarray, coupling: np.ndarray, most: int | None = None) -> np.ndarray:
    """[graph, node, layer] of stacked supra-graphs [graph, layer, node, node], each with its coupling: sums over the largest eigenpairs of |value * vector|."""
    b, t, n, _ = layers.shape
    size = t * n
    top = max(1, min(max(2, t if most is None else min(t, most)), size - 2))
    out = np.zeros((b, size))
    some = max(1, AT_ONCE // (8 * size * size))
    for at in range(0, b, some) if size <= MOST_DENSE else ():
        x, c = layers[at : at + some], coupling[at : at + some, None]
        full, node = np.zeros((len(x), t, n, t, n)), np.arange(n)
        for k in range(t):
            full[:, k, :, k] = x[:, k].transpose(0, 2, 1)
            if k:
                full[:, k, node, k - 1, node] = full[:, k - 1, node, k, node] = c
        values, vectors = np.linalg.eigh(full.reshape(len(x), size, size))
        out[at : at + some] = np.abs(values[:, None, -top:] * vectors[:, :, -top:]).sum(2)
    for at in range(b) if size > MOST_DENSE else ():
        values, vectors = largest_pairs(lambda v: supra_product(layers[at], coupling[at], v), size, top)  # noqa: B023
        out[at] = np.abs(values * vectors).sum(1)
    return out.reshape(b, t, n).transpose(0, 2, 1)


def multilayer_centrality(layers: np.ndarray, coupling: float = 1.0, most: int | None = None) -> np.ndarray:
    """[node, layer]: sum over the largest eigenpairs of the supra-graph of |value * vector|."""
    return multilayer_centralities(layers[None], np.array([coupling], dtype=float), most)[0]


def quantise(x: np.ndarray, percent: float) -> np.ndarray:
    low, high = np.percentile(x, [percent / 2, 100 - percent / 2])
    return np.where(x >= high, 1, np.where(x <= low, -1, 0))


def quantised_sets(x: np.ndarray, percents: tuple[int, ...]) -> np.ndarray:
    """[group, set, node, layer] to [group, percent, node, layers of all sets]; each set has its own cuts."""
    b, s, n, t = x.shape
    cuts = np.percentile(x.reshape(b, s, n * t), [q for p in percents for q in (p / 2, 100 - p / 2)], axis=2)
    low, high = (cuts[k::2].transpose(1, 0, 2)[..., None, None] for k in (0, 1))
    level = np.where(x[:, None] >= high, 1, np.where(x[:, None] <= low, -1, 0)).astype(np.int8)
    return level.transpose(0, 1, 3, 2, 4).reshape(b, len(percents), n, s * t)


def centroid_tree(x: np.ndarray) -> list[tuple[list[int], int, int, float]]:
    """Nodes (members, left, right, height), leaves first: merges by centroid linkage, heights not below those of the subtree."""
    n = len(x)
    nodes = [([k], -1, -1, 0.0) for k in range(n)]
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    at, size = list(range(n)), np.ones(n)
    for _ in range(n - 1):
        i, j = divmod(int(d.argmin()), n)
        a, b = sorted((at[i], at[j]))
        nodes.append((nodes[a][0] + nodes[b][0], a, b, max(d[i, j], nodes[a][3], nodes[b][3])))
        both = size[i] + size[j]
        row = np.maximum((size[i] * d[i] + size[j] * d[j]) / both - size[i] * size[j] * d[i, j] / both**2, 0)
        row[[i, j]] = np.inf
        d[i] = d[:, i] = row
        d[j] = d[:, j] = np.inf
        at[i], size[i] = len(nodes) - 1, both
    return nodes


def cut_tree(nodes: list[tuple[list[int], int, int, float]], k: int) -> np.ndarray:
    """Labels along the tree, cut at the least height that leaves k clusters or fewer."""
    n = (len(nodes) + 1) // 2
    cut = sorted(h for *_, h in nodes[n:])[n - k - 1] if k < n else -1.0
    out, stack, label = np.zeros(n, dtype=int), [len(nodes) - 1], 0
    while stack:
        members, left, right, h = nodes[stack.pop()]
        if left < 0 or h <= cut:
            out[members] = label
            label += 1
        else:
            stack += [right, left]
    return out


def centroid_cut(x: np.ndarray, k: int) -> np.ndarray:
    """Labels of k clusters (fewer where heights tie) by centroid linkage."""
    return cut_tree(centroid_tree(x), k)


def two_clusters(x: np.ndarray) -> np.ndarray:
    """1 for the smaller of two clusters of z-scored rows; all 1 for two rows or fewer."""
    if len(x) <= 2:
        return np.ones(len(x), dtype=int)
    s = x.std(0)
    lab = centroid_cut((x - x.mean(0)) / np.where(s > 0, s, 1), 2)
    return (lab == np.bincount(lab).argmin()).astype(int)


def centroid_trees(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, height) [case, node] of the trees of `centroid_tree` for stacked [case, row, column]."""
    b, n, _ = x.shape
    every = np.arange(b)
    left, right, height = np.full((b, 2 * n - 1), -1), np.full((b, 2 * n - 1), -1), np.zeros((b, 2 * n - 1))
    d = ((x[:, :, None] - x[:, None]) ** 2).sum(3)
    d[:, np.arange(n), np.arange(n)] = np.inf
    at, size = np.tile(np.arange(n), (b, 1)), np.ones((b, n))
    for k in range(n, 2 * n - 1):
        i, j = np.divmod(d.reshape(b, -1).argmin(1), n)
        p, q, between = at[every, i], at[every, j], d[every, i, j]
        left[:, k], right[:, k] = np.minimum(p, q), np.maximum(p, q)
        height[:, k] = np.maximum(between, np.maximum(height[every, p], height[every, q]))
        si, sj = size[every, i][:, None], size[every, j][:, None]
        both = si + sj
        row = np.maximum((si * d[every, i] + sj * d[every, j]) / both - si * sj * between[:, None] / both**2, 0)
        row[every, i] = row[every, j] = np.inf
        d[every, i] = d[every, :, i] = row
        d[every, j] = d[every, :, j] = np.inf
        at[every, i], size[every, i] = k, both[:, 0]
    return left, right, height


def cut_trees(left: np.ndarray, right: np.ndarray, height: np.ndarray, k: int) -> np.ndarray:
    """[case, row]: as `cut_tree`, but a cluster's label is the place along the tree of its first row."""
    b, n = len(left), (left.shape[1] + 1) // 2
    every, root = np.arange(b), 2 * n - 2
    cut = np.sort(height[:, n:], 1)[:, n - k - 1] if k < n else np.full(b, -1.0)
    count = np.ones((b, root + 1), dtype=int)
    for node in range(n, root + 1):
        count[:, node] = count[every, left[:, node]] + count[every, right[:, node]]
    place, label = np.zeros((b, root + 1), dtype=int), np.zeros((b, root + 1), dtype=int)
    for node in range(root, n - 1, -1):
        whole = height[:, node] <= cut
        for child, at in ((left[:, node], place[:, node]), (right[:, node], place[:, node] + count[every, left[:, node]])):
            place[every, child] = at
            label[every, child] = np.where(whole, label[:, node], at)
    return label[:, :n]


def target_clusters(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[case, row] and [case]: members of the smaller cluster of z-scored rows (second-smallest of three, if the smaller has under 5 %), and how well it stands apart.

    Fewer than three rows, targets of one member and targets of all are worth nothing.
    """
    b, n, _ = x.shape
    if n < 3:
        return np.ones((b, n), dtype=bool), np.zeros(b)
    x = (x - x.mean(1, keepdims=True)) / (x.std(1, keepdims=True) + 1e-12)
    tree = centroid_trees(x)
    label = cut_trees(*tree, 2)
    sizes = lambda lab: np.stack([np.bincount(v, minlength=n) for v in lab]) if n > 64 else (lab[:, :, None] == np.arange(n)).sum(1)
    size = sizes(label)
    size = np.where(size > 0, size, n + 1)
    pick = size.argmin(1)
    few = np.flatnonzero(size.min(1) < 0.05 * n) if n >= 4 else []
    if len(few):
        label[few] = cut_trees(*(v[few] for v in tree), 3)
        size = sizes(label[few])
        order = np.argsort(np.where(size > 0, size, n + 1), axis=1, kind="stable")
        pick[few] = np.where((size > 0).sum(1) > 1, order[:, 1], order[:, 0])
    inside = label == pick[:, None]
    m = inside.sum(1)
    worth = np.zeros(b)
    good = np.flatnonzero((m >= 2) & (m < n))
    z, mine, m = x[good], inside[good, :, None], m[good, None]
    own = np.where(mine, z, 0).sum(1) / m
    gap = ((own - np.where(mine, 0, z).sum(1) / (n - m)) ** 2).sum(1)
    i, j = np.triu_indices(n, 1)
    among = np.where(mine[:, i, 0] & mine[:, j, 0], np.linalg.norm(z[:, i] - z[:, j], axis=2), 0).sum(1) / (m * (m - 1) / 2)[:, 0]
    spread = among * np.where(mine[:, :, 0], np.linalg.norm(z - own[:, None], axis=2), 0).max(1)
    worth[good] = np.where(spread > 0, gap / (spread + 1e-12), 0.0)
    return inside, worth


def target_cluster(x: np.ndarray) -> tuple[np.ndarray, float]:
    """`target_clusters` of one case [row, column]."""
    inside, worth = target_clusters(np.asarray(x, dtype=float)[None])
    return inside[0], float(worth[0])


def three_means(v: np.ndarray, times: np.ndarray | None = None) -> np.ndarray:
    """Exact one-dimensional three-means labels, ordered by centre; the maximum alone for fewer than three values.  times: how often each of v is there.

    Cuts lie between different values.  The best first cut moves up with the second one, so halving both ranges finds all of them
    in n log n steps.
    """
    u, at = np.unique(v, return_inverse=True)
    m = len(u)
    if m < 3:
        return np.where(v == v.max(), 2, 0)
    w = np.bincount(at, times, m).astype(np.longdouble)
    x = u.astype(np.longdouble)
    x -= (w * x).sum() / w.sum()  # sums of squares lose fewest digits about the mean
    c0, c1, c2 = (np.concatenate([[0], np.cumsum(k)]) for k in (w, w * x, w * x * x))
    cost = lambda i, j: c2[j] - c2[i] - (c1[j] - c1[i]) ** 2 / (c0[j] - c0[i])
    best, todo = (np.inf, 0, 0), [(2, m - 1, 1, m - 2)]
    while todo:
        low, high, first, last = todo.pop()
        j = (low + high) // 2
        i = np.arange(first, min(j - 1, last) + 1)
        both = cost(0, i) + cost(i, j)
        k = int(both.argmin())
        best = min(best, (both[k] + cost(j, m), first + k, j))
        if low < j:
            todo.append((low, j - 1, first, first + k))
        if j < high:
            todo.append((j + 1, high, first + k, last))
    _, i, j = best
    return np.searchsorted([u[i], u[j]], v, side="right")


#: Combinations of left singular vectors that are clustered.
COMBINATIONS = [(0, 1), (0, 2), (1, 2), (0, 1, 2), (0, 1, 2, 3)]


def consensus_cases(x: np.ndarray, components: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(target [case, channel], worth [case]) of stacked quantised centralities [case, channel, layer]: combinations of left singular vectors vote by what they are worth.

    A channel is in the target if it has more than (m - 1) / m of the votes of m combinations (half of one's).
    """
    b, n, layers = x.shape
    inside, worth = np.zeros((b, n), dtype=bool), np.zeros(b)
    some = max(1, AT_ONCE // (8 * n * (4 * n + layers)))
    for at in range(0, b, some):
        u = np.linalg.svd(x[at : at + some].astype(float), full_matrices=False)[0][:, :, :components]
        use = [[k for k in c if k < u.shape[2]] for c in COMBINATIONS]
        found = [target_clusters(u[:, :, c]) for c in use if len(c) > 1]
        if not found:
            continue
        members, w = np.stack([f for f, _ in found]), np.stack([v for _, v in found])
        w = np.where((w > 0) & np.isfinite(w), w, 0.0)
        m, total = (w > 0).sum(0), w.sum(0)
        part = (members * w[:, :, None]).sum(0) / np.where(m > 0, total, 1)[:, None]
        inside[at : at + some] = part > np.where(m > 1, (m - 1) / np.maximum(m, 1), 0.5)[:, None]
        worth[at : at + some] = total
    return inside, worth


def consensus_case(x: np.ndarray, components: int = 4) -> tuple[np.ndarray, float]:
    """`consensus_cases` of one case [channel, layer]."""
    inside, worth = consensus_cases(x[None], components)
    return inside[0], float(worth[0])


def consensus(mats: dict[float, list[np.ndarray]], percents=tuple(range(10, 90, 10)), components: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(score in 0..1, member of the top group) per channel.  mats: by coupling, [channel, layer] of each run and band.

    A case is a coupling and a percentile, its runs and bands joined, and cases weigh what they are worth.
    """
    mats = {c: [m] if isinstance(m, np.ndarray) else m for c, m in mats.items()}
    n = len(next(iter(mats.values()))[0])
    cases = [consensus_case(np.concatenate([quantise(m, p) for m in sets], 1), components) for sets in mats.values() for p in percents]
    weights = sum(w for _, w in cases)
    if not weights:
        return np.zeros(n), np.zeros(n, dtype=bool)
    score = sum(w * inside for inside, w in cases) / weights
    spread = score.max() - score.min()
    score = (score - score.min()) / (spread + 1e-12) if spread >= 1e-12 else np.zeros(n)
    return score, three_means(score) == 2


# -- adaptive graph network: forward pass -----------------------------------------------------------


def adaptive_adjacency(e: np.ndarray) -> np.ndarray:
    a = np.maximum(np.tanh(e @ e.T), 0) + np.eye(len(e))
    d = 1 / np.sqrt(np.maximum(a.sum(1), 1e-8))
    return d[:, None] * a * d[None]


def softmax(x: np.ndarray, axis: int) -> np.ndarray:
    z = np.exp(x - x.max(axis=axis, keepdims=True))
    return z / z.sum(axis=axis, keepdims=True)


def network_weights(seed: int = 0, width: int = 12, wide: int = 24, attributes: int = 10, graph: int = 8, hidden: int = 32) -> dict[str, np.ndarray]:
    """Names and shapes of the network's weights, drawn at random; trained ones come as a dict of the same form (npz files hold such).

    Normalisations are scale and shift per feature, as they are after training; trained networks also have biases of filters, gates and
    attributes (see `network.trained_weights`).
    """
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.normal(0, 1 / np.sqrt(np.prod(shape[1:]) or 1), shape)
    w = {"in": draw(width, 5), "in_scale": np.ones(width), "in_shift": np.zeros(width), "out": draw(wide, width), "out_scale": np.ones(wide), "out_shift": np.zeros(wide)}
    for k in range(3):
        w |= {f"filter{k}": draw(width, width, 3), f"gate{k}": draw(width, width, 3), f"scale{k}": np.ones(width), f"shift{k}": np.zeros(width)}
    w |= {"time": draw(wide, 1)[:, 0], "attributes": draw(attributes, wide), "embedding": draw(graph, attributes), "gcn": draw(graph, attributes)}
    w |= {"cell_in": draw(4 * hidden, attributes + graph), "cell_state": draw(4 * hidden, hidden), "cell_bias": np.zeros(4 * hidden)}
    return w | {"node": draw(hidden, 1)[:, 0], "classes": draw(2, hidden), "classes_bias": np.zeros(2)}


def _normed(h: np.ndarray, scale: np.ndarray, shift: np.ndarray) -> np.ndarray:
    return h * scale[:, None] + shift[:, None]


def gated_convolutions(x: np.ndarray, w: dict[str, np.ndarray]) -> np.ndarray:
    """[channels, samples] -> [channels, attributes]: dilated gated blocks that look back only, with residuals; attention over time; a linear map."""
    n = x.shape[1]
    padded = np.pad(x, ((0, 0), (2, 2)))
    h = sum(w["in"][:, k][None, :, None] * padded[:, None, k : k + n] for k in range(5))
    h = np.maximum(_normed(h, w["in_scale"], w["in_shift"]), 0)
    for k in range(3):
        reach = 2 << k
        past = np.pad(h, ((0, 0), (0, 0), (reach, 0)))
        taps = np.stack([past[:, :, j * (1 << k) : j * (1 << k) + n] for j in range(3)], axis=-1)
        f, g = (np.einsum("vwj,cwsj->cvs", w[name + str(k)], taps) + w.get(f"{name}_bias{k}", np.zeros(1))[:, None] for name in ("filter", "gate"))
        h = np.maximum(h + _normed(np.tanh(f) * sigmoid(g), w[f"scale{k}"], w[f"shift{k}"]), 0)
    h = np.maximum(_normed(np.einsum("vw,cws->cvs", w["out"], h), w["out_scale"], w["out_shift"]), 0)
    att = softmax(np.einsum("v,cvs->cs", w["time"], np.tanh(h)), 1)
    return np.einsum("cvs,cs->cv", h, att) @ w["attributes"].T + w.get("attributes_bias", 0.0)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def graph_attention(seq: np.ndarray, w: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """[time, channel, attribute] -> attention [time, channel] and the last step's two class logits.

    Each step: a graph from the channels' embeddings, one convolution over it, a recurrent cell per channel, softmax over channels.
    """
    hidden = len(w["node"])
    h = c = np.zeros((seq.shape[1], hidden))
    out, logits = [], np.zeros(2)
    for x in seq:
        near = adaptive_adjacency(x @ w["embedding"].T)
        both = np.concatenate([x, np.maximum(near @ (x @ w["gcn"].T), 0)], axis=1)
        i, f, g, o = np.split(both @ w["cell_in"].T + h @ w["cell_state"].T + w["cell_bias"], 4, axis=1)
        c = sigmoid(f) * c + sigmoid(i) * np.tanh(g)
        h = sigmoid(o) * np.tanh(c)
        att = softmax(np.tanh(h) @ w["node"], 0)
        out.append(att)
        logits = w["classes"] @ (att @ h) + w["classes_bias"]
    return np.array(out), logits

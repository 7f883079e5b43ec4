"""Gradients of the adaptive graph network, for recordings of one shape at once: what training adds to the forward pass in `kernels`.

Parameters are dicts of arrays (`initial`).  Convolutions of the gated blocks are weight-normalised (direction and length per
output), and normalisations take the mean and deviation of one segment's channels and samples while training.
`trained_weights` folds both into the plain weights that `kernels.gated_convolutions` takes.
"""

from __future__ import annotations

import numpy as np

from .kernels import sigmoid, softmax

Params = dict[str, np.ndarray]

#: Sizes of the encoder's and the graph's layers, and what is added to variances.
WIDTH, WIDE, ATTRIBUTES, GRAPH, BLOCKS, EPS = 12, 24, 10, 8, 3, 1e-5
NORMS = ["in", *[f"block{k}" for k in range(BLOCKS)], "out"]

#: Bytes that the encoder may hold of several runs' segments; a run that needs more has its segments encoded one by one.
AT_ONCE = 1 << 23


def initial(seed: int = 0, hidden: int = 32) -> Params:
    """Uniform weights within 1 / sqrt(inputs), attention vectors of deviation 0.02, normalisations of scale 1 and shift 0."""
    rng = np.random.default_rng(seed)

    def draw(shape: tuple[int, ...], inputs: int) -> np.ndarray:
        return rng.uniform(-1, 1, shape) / np.sqrt(inputs)

    p = {"in": draw((WIDTH, 5), 5), "out": draw((WIDE, WIDTH), WIDTH)}
    for k in range(BLOCKS):
        for side in ("filter", "gate"):
            v = draw((WIDTH, 3 * WIDTH), 3 * WIDTH)
            p |= {f"{side}{k}": v, f"{side}{k}_length": np.linalg.norm(v, axis=1), f"{side}{k}_bias": draw((WIDTH,), 3 * WIDTH)}
    for name in NORMS:
        n = WIDE if name == "out" else WIDTH
        p |= {f"{name}_scale": np.ones(n), f"{name}_shift": np.zeros(n)}
    p |= {"time": rng.normal(0, 0.02, WIDE), "attributes": draw((ATTRIBUTES, WIDE), WIDE), "attributes_bias": draw((ATTRIBUTES,), WIDE)}
    p |= {"embedding": draw((GRAPH, ATTRIBUTES), ATTRIBUTES), "gcn": draw((GRAPH, ATTRIBUTES), ATTRIBUTES)}
    p |= {"cell_in": draw((4 * hidden, ATTRIBUTES + GRAPH), hidden), "cell_state": draw((4 * hidden, hidden), hidden), "cell_bias": draw((4 * hidden,), hidden)}
    return p | {"node": rng.normal(0, 0.02, hidden), "classes": draw((2, hidden), hidden), "classes_bias": draw((2,), hidden)}


def flat(p: Params) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def unflat(v: np.ndarray, like: Params) -> Params:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = np.asarray(v[at : at + like[k].size]).reshape(like[k].shape)
        at += like[k].size
    return out


# -- encoder: segments [..., channels, samples] to attributes [..., channels, ATTRIBUTES] -----------
# Inside, features come first, then all segments' channels, then samples: one matrix product takes all segments.


def _normalise(x: np.ndarray, k: int, scale: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Each of k segments by its own mean and variance of every feature."""
    v = x.reshape(len(x), k, -1)
    mean = v.mean(-1)
    unit = v - mean[:, :, None]
    var = np.einsum("wkm,wkm->wk", unit, unit) / v.shape[2]
    unit /= np.sqrt(var + EPS)[:, :, None]
    return (unit * scale[:, None, None] + shift[:, None, None]).reshape(x.shape), (unit, var, mean)


def _normalise_back(d: np.ndarray, kept: tuple, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of the input, the scale and the shift."""
    unit, var, _ = kept
    v = d.reshape(unit.shape)
    total, along = v.sum(-1), np.einsum("wkm,wkm->wk", v, unit)
    out = v - (along / unit.shape[2])[:, :, None] * unit
    out -= (total / unit.shape[2])[:, :, None]
    out *= (scale[:, None] / np.sqrt(var + EPS))[:, :, None]
    return out.reshape(d.shape), along.sum(1), total.sum(1)


def _taps(h: np.ndarray, dilation: int) -> np.ndarray:
    """[w, c, n] to [3 w, c, n]: each feature two steps, one step and no step of the dilation ago."""
    w, c, n = h.shape
    out = np.zeros((w, 3, c, n))
    for j in range(3):
        ago = min((2 - j) * dilation, n)
        out[:, j, :, ago:] = h[:, :, : n - ago]
    return out.reshape(3 * w, c, n)


def _taps_back(d: np.ndarray, dilation: int) -> np.ndarray:
    _, c, n = d.shape
    d = d.reshape(-1, 3, c, n)
    out = d[:, 2].copy()
    for j in range(2):
        ago = min((2 - j) * dilation, n)
        out[:, :, : n - ago] += d[:, j, :, ago:]
    return out


def _map(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return (w @ x.reshape(len(x), -1)).reshape(-1, *x.shape[1:])


def _outer(d: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Sum over channels and samples of d x'."""
    return d.reshape(len(d), -1) @ x.reshape(len(x), -1).T


def _directed(p: Params, name: str) -> np.ndarray:
    return p[name] * (p[f"{name}_length"] / np.linalg.norm(p[name], axis=1))[:, None]


def _both(p: Params, k: int) -> np.ndarray:
    return np.concatenate([_directed(p, f"filter{k}"), _directed(p, f"gate{k}")])


def encode(x: np.ndarray, p: Params) -> tuple[np.ndarray, dict]:
    """Attributes of segments' channels, and what the way back needs."""
    *lead, c, n = x.shape
    many = int(np.prod(lead))
    padded = np.pad(x.reshape(-1, n), ((0, 0), (2, 2)))
    kept: dict = {"lead": tuple(lead), "in_taps": np.stack([padded[:, k : k + n] for k in range(5)])}
    h, kept["in"] = _normalise(_map(p["in"], kept["in_taps"]), many, p["in_scale"], p["in_shift"])
    h = np.maximum(h, 0)
    kept["h"] = [h]
    for k in range(BLOCKS):
        taps = _taps(h, 1 << k)
        f, g = np.split(_map(_both(p, k), taps), 2)
        f, g = np.tanh(f + p[f"filter{k}_bias"][:, None, None]), sigmoid(g + p[f"gate{k}_bias"][:, None, None])
        z, norm = _normalise(f * g, many, p[f"block{k}_scale"], p[f"block{k}_shift"])
        h = np.maximum(h + z, 0)
        kept[f"block{k}"] = (taps, f, g, norm)
        kept["h"].append(h)
    o, kept["out"] = _normalise(_map(p["out"], h), many, p["out_scale"], p["out_shift"])
    o = np.maximum(o, 0)
    bent = np.tanh(o)
    att = softmax(_map(p["time"][None], bent)[0], 1)
    pooled = np.einsum("vcs,cs->cv", o, att)
    return (pooled @ p["attributes"].T + p["attributes_bias"]).reshape(*lead, c, ATTRIBUTES), kept | {"o": o, "bent": bent, "att": att, "pooled": pooled}


def statistics(kept: dict) -> np.ndarray:
    """Means and variances that segments' normalisations met, in order of NORMS."""
    norms = [kept["in"], *[kept[f"block{k}"][3] for k in range(BLOCKS)], kept["out"]]
    met = np.concatenate([v for _, var, mean in norms for v in (mean, var)])
    return met.T.reshape(*kept["lead"], len(met))


def encode_back(d: np.ndarray, kept: dict, p: Params) -> Params:
    """Gradients of the encoder's parameters, given those of the segments' attributes."""
    d = d.reshape(-1, ATTRIBUTES)
    g: Params = {"attributes": d.T @ kept["pooled"], "attributes_bias": d.sum(0)}
    dp = (d @ p["attributes"]).T
    o, bent, att = kept["o"], kept["bent"], kept["att"]
    datt = np.einsum("vc,vcs->cs", dp, o)
    dlogit = att * (datt - (datt * att).sum(1, keepdims=True))
    g["time"] = _outer(bent, dlogit[None])[:, 0]
    do = dp[:, :, None] * att + p["time"][:, None, None] * dlogit * (1 - bent * bent)
    da, g["out_scale"], g["out_shift"] = _normalise_back(do * (o > 0), kept["out"], p["out_scale"])
    g["out"] = _outer(da, kept["h"][-1])
    dh = _map(p["out"].T, da)
    for k in reversed(range(BLOCKS)):
        taps, f, s, norm = kept[f"block{k}"]
        dh = dh * (kept["h"][k + 1] > 0)
        du, g[f"block{k}_scale"], g[f"block{k}_shift"] = _normalise_back(dh, norm, p[f"block{k}_scale"])
        du = du * s
        back = np.concatenate([du * (1 - f * f), du * f * (1 - s)])
        for side, dw, bias in zip(("filter", "gate"), np.split(_outer(back, taps), 2), np.split(back.sum((1, 2)), 2)):
            name = f"{side}{k}"
            v, length = p[name], np.linalg.norm(p[name], axis=1)
            along = (dw * v).sum(1) / length
            g[f"{name}_length"] = along
            g[name] = (p[f"{name}_length"] / length)[:, None] * (dw - along[:, None] * v / length[:, None])
            g[f"{name}_bias"] = bias
        dh = dh + _taps_back(_map(_both(p, k).T, back), 1 << k)
    da, g["in_scale"], g["in_shift"] = _normalise_back(dh * (kept["h"][0] > 0), kept["in"], p["in_scale"])
    return g | {"in": _outer(da, kept["in_taps"])}


# -- graph and recurrence: attributes [runs, segments, channels, ATTRIBUTES] ------------------------


def graph_loss(a: np.ndarray, targets: np.ndarray, y: np.ndarray, length: int, p: Params, smoothing: float = 0.1) -> tuple[float, np.ndarray, Params]:
    """(cross entropy, gradient of the attributes, gradients of the parameters) of the sequences of `length` segments before each target.

    targets, y: [runs, targets].  A run's loss is its targets' mean, and the runs' are added up.
    """
    hidden, (r, b), c = len(p["node"]), targets.shape, a.shape[2]
    # A segment's graph is the same in every sequence that holds it.
    e = a @ p["embedding"].T
    s = np.tanh(e @ e.swapaxes(-1, -2))
    adj = np.maximum(s, 0) + np.eye(c)
    root = 1 / np.sqrt(np.maximum(adj.sum(-1), 1e-8))
    near = root[..., None] * adj * root[..., None, :]
    q = a @ p["gcn"].T
    m = near @ q
    z = np.concatenate([a, np.maximum(m, 0)], -1)
    h = cell = np.zeros((r, b, c, hidden))
    of, steps = np.arange(r)[:, None], []
    for t in range(length):
        seg = targets - length + t
        i, f, g, o = np.split(z[of, seg] @ p["cell_in"].T + h @ p["cell_state"].T + p["cell_bias"], 4, axis=-1)
        i, f, g, o = sigmoid(i), sigmoid(f), np.tanh(g), sigmoid(o)
        before, cell = (h, cell), f * cell + i * g
        bent = np.tanh(cell)
        h = o * bent
        steps.append((seg, before, i, f, g, o, bent))
    th = np.tanh(h)
    att = softmax(th @ p["node"], -1)
    pooled = (att[..., None, :] @ h)[..., 0, :]
    prob = softmax(pooled @ p["classes"].T + p["classes_bias"], -1)
    want = smoothing / 2 + (1 - smoothing) * np.eye(2)[y]
    loss = float(-(want * np.log(np.maximum(prob, 1e-300))).sum() / b)

    over = lambda u, v: np.tensordot(u, v, (lead := tuple(range(u.ndim - 1)), lead))
    d = (prob - want) / b
    grads: Params = {"classes": over(d, pooled), "classes_bias": d.sum((0, 1))}
    dp = d @ p["classes"]
    datt = (h @ dp[..., None])[..., 0]
    dlogit = att * (datt - (datt * att).sum(-1, keepdims=True))
    grads["node"] = np.tensordot(dlogit, th, 3)
    dh = att[..., None] * dp[..., None, :] + dlogit[..., None] * p["node"] * (1 - th * th)
    dcell = np.zeros_like(dh)
    dz = np.zeros_like(z)
    for k in ("cell_in", "cell_state", "cell_bias"):
        grads[k] = np.zeros_like(p[k])
    for seg, (h0, c0), i, f, g, o, bent in reversed(steps):
        dcell = dcell + dh * o * (1 - bent * bent)
        gates = np.concatenate([dcell * g * i * (1 - i), dcell * c0 * f * (1 - f), dcell * i * (1 - g * g), dh * bent * o * (1 - o)], -1)
        grads["cell_in"] += over(gates, z[of, seg])
        grads["cell_state"] += over(gates, h0)
        grads["cell_bias"] += gates.sum((0, 1, 2))
        dseg = gates @ p["cell_in"]
        for k in range(b):  # targets of a run differ, so each of these adds to a segment once
            dz[of[:, 0], seg[:, k]] += dseg[:, k]
        dh, dcell = gates @ p["cell_state"], dcell * f
    width = a.shape[-1]
    da, dm = dz[..., :width], dz[..., width:] * (m > 0)
    dq = near.swapaxes(-1, -2) @ dm
    grads["gcn"] = over(dq, a)
    da = da + dq @ p["gcn"]
    dnear = dm @ q.swapaxes(-1, -2)
    # near = root_i adj root_j, and root depends on adj through its row's sum.
    both = dnear * adj
    droot = (both * root[..., None, :]).sum(-1) + (both * root[..., None]).sum(-2)
    dadj = dnear * root[..., None] * root[..., None, :] - 0.5 * (droot * root**3)[..., None]
    ds = dadj * (s > 0) * (1 - s * s)
    de = (ds + ds.swapaxes(-1, -2)) @ e
    grads["embedding"] = over(de, a)
    return loss, da + de @ p["embedding"], grads


def balanced_targets(n: int, length: int, onset: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """As many targets before the onset as after it, drawn by the seed, and which are after it; none if a side is empty."""
    targets = np.arange(length, n)
    sides = [targets[targets < onset], targets[targets >= onset]]
    each = min(map(len, sides))
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.choice(s, each, replace=False) for s in sides]), np.repeat([0, 1], each)


def runs_at_once(segments: int, channels: int, samples: int) -> int:
    """Runs of this shape whose encoders' values fit AT_ONCE; 0 if one has too many."""
    return AT_ONCE // (8 * segments * channels * samples * (3 * WIDTH * (BLOCKS + 2) + 4 * WIDTH * BLOCKS + 3 * WIDE))


def run_gradient(segments: np.ndarray, p: Params, targets: np.ndarray, y: np.ndarray, length: int) -> tuple[float, np.ndarray, np.ndarray]:
    """(loss, flat gradient, mean statistics) of one run [segments, channels, samples]."""
    return runs_gradient(segments[None], p, targets[None], y[None], length)


def runs_gradient(segments: np.ndarray, p: Params, targets: np.ndarray, y: np.ndarray, length: int) -> tuple[float, np.ndarray, np.ndarray]:
    """The sums of `run_gradient` over runs [runs, segments, channels, samples] with as many targets each.

    As many runs are taken at once as `runs_at_once` says.  The segments of a larger one are encoded again on the way back, so one at a time is held.
    """
    some = runs_at_once(*segments.shape[1:])
    if len(segments) > max(1, some):
        parts = [runs_gradient(segments[k : k + max(1, some)], p, targets[k : k + max(1, some)], y[k : k + max(1, some)], length) for k in range(0, len(segments), max(1, some))]
        return tuple(map(sum, zip(*parts)))
    used = np.zeros(segments.shape[:2], dtype=bool)
    np.put_along_axis(used, (targets[:, :, None] - 1 - np.arange(length)).reshape(len(used), -1), True, 1)
    a = np.zeros((*segments.shape[:3], ATTRIBUTES))
    whole = encode(segments[used], p) if some else None
    places = [] if some else list(zip(*np.nonzero(used)))
    met = np.zeros((len(used), 2 * sum(p[f"{n}_scale"].size for n in NORMS)))
    if some:
        a[used] = whole[0]
        np.add.at(met, np.nonzero(used)[0], statistics(whole[1]))
    for at in places:
        a[at], kept = encode(segments[at], p)
        met[at[0]] += statistics(kept)
    loss, da, grads = graph_loss(a, targets, y, length, p)
    total = {k: np.zeros_like(v) for k, v in p.items()} | grads
    if some:
        total |= encode_back(da[used], whole[1], p)
    for at in places:
        for name, v in encode_back(da[at], encode(segments[at], p)[1], p).items():
            total[name] += v
    return loss, flat(total), (met / used.sum(1)[:, None]).sum(0)


class Adam:
    """Adam on a flat vector, with the gradient's norm clipped."""

    def __init__(self, size: int, clip: float = 5.0):
        self.m, self.v, self.t, self.clip = np.zeros(size), np.zeros(size), 0, clip

    def step(self, x: np.ndarray, grad: np.ndarray, rate: float) -> np.ndarray:
        grad = grad * min(1.0, self.clip / (np.linalg.norm(grad) + 1e-6))
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * grad
        self.v = 0.999 * self.v + 0.001 * grad * grad
        return x - rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


def trained_weights(p: Params, met: np.ndarray) -> Params:
    """Parameters and the running statistics of the normalisations as the weights of `kernels.gated_convolutions` and `graph_attention`."""
    out = {k: p[k] for k in ("in", "out", "time", "attributes", "attributes_bias", "embedding", "gcn", "cell_in", "cell_state", "cell_bias", "node", "classes", "classes_bias")}
    at = 0
    for name in NORMS:
        n = len(p[f"{name}_scale"])
        mean, var = met[at : at + n], met[at + n : at + 2 * n]
        at += 2 * n
        scale = p[f"{name}_scale"] / np.sqrt(var + EPS)
        shift = p[f"{name}_shift"] - mean * scale
        k = name.removeprefix("block")
        a, b = (f"scale{k}", f"shift{k}") if name.startswith("block") else (f"{name}_scale", f"{name}_shift")
        out |= {a: scale, b: shift}
    for k in range(BLOCKS):
        for side in ("filter", "gate"):
            out[f"{side}{k}"] = _directed(p, f"{side}{k}").reshape(WIDTH, WIDTH, 3)
            out[f"{side}_bias{k}"] = p[f"{side}{k}_bias"]
    return out

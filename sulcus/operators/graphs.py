"""Metrics of many small graphs: relational where sums say it, one kernel call per graph elsewhere."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from .connectivity import grouped, spread, starts_of, whole_groups, window_chunks
from .evaluation import minmax

RUN = ["subject"]

#: A set of this many channels or fewer has all couplings in one task.
WITH_CHANNELS = 32


def _dense(g: pd.DataFrame, a: str, b: str, both: bool) -> tuple[np.ndarray, np.ndarray]:
    nodes, at = np.unique(np.concatenate([g[a], g[b]]), return_inverse=True)
    w = np.zeros((len(nodes), len(nodes)))
    i, j = at[: len(g)], at[len(g) :]
    w[i, j] = g.w
    if both:
        w[j, i] = g.w
    return nodes, w


def with_nodes(edges: DataFrame, nodes: DataFrame | None, keys: list[str], a: str = "i", b: str = "j") -> DataFrame:
    """The edges and, as loops of weight 0, all nodes (some of the keys, channel), so that nodes without edges keep their place."""
    if nodes is None:
        return edges
    by = [k for k in keys if k in nodes.columns]
    graphs = edges.select(*keys).distinct()
    every = graphs.join(nodes.select(*by, "channel"), by) if by else graphs.crossJoin(nodes.select("channel")) if keys else nodes  # all of its rows are asked for
    return edges.select(*keys, a, b, "w").unionByName(every.select(*keys, F.col("channel").alias(a), F.col("channel").alias(b), F.lit(0.0).alias("w")))


def per_graph(edges: DataFrame, keys: list[str], metrics, both: bool, a: str = "i", b: str = "j", nodes: DataFrame | None = None) -> DataFrame:
    """metrics(matrix) -> {name: values}; rows (keys, channel, metric, value).  Graphs stream past a task one by one; see `with_nodes`."""
    kinds = dict(edges.dtypes)
    use = with_nodes(edges, nodes, keys, a, b)
    use = use if keys else use.withColumn("_g", F.lit(0))
    by = keys or ["_g"]

    def run(g: pd.DataFrame) -> pd.DataFrame:
        names, w = _dense(g, a, b, both)
        parts = [pd.DataFrame({**{k: g[k].iloc[0] for k in keys}, "channel": names, "metric": m, "value": np.asarray(v, dtype=float)}) for m, v in metrics(w).items()]
        return pd.concat(parts)

    schema = "".join(f"{k} {kinds[k]}, " for k in keys) + "channel long, metric string, value double"
    return grouped(use, by, run, schema)


def directed_strength(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    ins = edges.select(F.col("v").alias("channel"), F.col("w").alias("a"), F.lit(0.0).alias("b"))
    outs = edges.select(F.col("u").alias("channel"), F.lit(0.0).alias("a"), F.col("w").alias("b"))
    rows = ins.unionByName(outs)
    if nodes is not None:
        rows = rows.unionByName(nodes.select("channel", F.lit(0.0).alias("a"), F.lit(0.0).alias("b")))
    return rows.groupBy("channel").agg(F.sum("a").alias("in_strength"), F.sum("b").alias("out_strength"))


def centralities(edges: DataFrame, keys: list[str], a: str = "i", b: str = "j", nodes: DataFrame | None = None, wanted: tuple[str, ...] | None = None) -> DataFrame:
    """The ten centralities of each graph, or only those wanted."""
    return per_graph(edges, keys, lambda w: K.ten_centralities(w, wanted), False, a, b, nodes)


def path_centralities(edges: DataFrame, keys: list[str], a: str = "i", b: str = "j", nodes: DataFrame | None = None, block: int = 64) -> DataFrame:
    """in_closeness, out_closeness, local_efficiency and betweenness, for graphs of any size: rows (keys, channel, metric, value).

    A task has one graph and about `block` of its nodes, dealt by hash, as sources of shortest paths; what paths from different blocks
    add to a node's betweenness is summed by Spark.
    """
    kinds = dict(edges.dtypes)
    use = with_nodes(edges, nodes, keys, a, b).select(*keys, a, b, "w")
    ends = use.select(*keys, F.explode(F.array(a, b)).alias("channel")).distinct()
    size = ends.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_blocks"))
    parts = use.join(size, keys).withColumn("_b", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))

    def one(g: pd.DataFrame) -> pd.DataFrame:
        names, w = _dense(g, a, b, False)
        mine = np.flatnonzero(names % g["_blocks"].iloc[0] == g["_b"].iloc[0])
        n = len(names)
        found = {"in_closeness": K.closeness_from(w.T, mine), "out_closeness": K.closeness_from(w, mine), "local_efficiency": K.local_efficiency(w, at=mine)[mine]}
        rows = [pd.DataFrame({"channel": names[mine], "metric": m, "value": v}) for m, v in found.items()]
        rows.append(pd.DataFrame({"channel": names, "metric": "betweenness", "value": K.betweenness_from(w, mine) / ((n - 1) * (n - 2) if n > 2 else 1)}))
        return pd.concat(rows).assign(**{k: g[k].iloc[0] for k in keys})

    by = [*keys, "_b"]
    schema = "".join(f"{k} {kinds[k]}, " for k in keys) + "channel long, metric string, value double"
    return spread(parts, by).groupBy(*by).applyInPandas(one, schema).groupBy(*keys, "channel", "metric").agg(F.sum("value").alias("value"))


def node_metrics(edges: DataFrame, keys: list[str], nodes: DataFrame | None = None) -> DataFrame:
    """Strength, degree spread, eigenvector centrality and nodal efficiency, with `ok`."""

    def metrics(w: np.ndarray) -> dict[str, np.ndarray]:
        found, ok = K.four_metrics(w)
        return found | {"ok": np.full(len(w), float(ok))}

    return per_graph(edges, keys, metrics, True, nodes=nodes)


def success_rate(metrics: DataFrame, run: list[str], runs: DataFrame | None = None) -> DataFrame:
    """Share of graphs whose metrics went well; runs (of the same keys) without any graph count as 0."""
    rate = metrics.where("metric = 'ok'").groupBy(*run).agg(F.avg("value").alias("success_rate"))
    if runs is None:
        return rate
    return runs.select(*run).distinct().join(rate, run, "left").select(*run, F.coalesce("success_rate", F.lit(0.0)).alias("success_rate"))


def mean_success(rates: DataFrame) -> DataFrame:
    """Per subject the number of runs and their mean success rate, a failed run being 0."""
    return rates.groupBy("subject").agg(F.count(F.lit(1)).alias("n_runs"), F.avg(F.coalesce("success_rate", F.lit(0.0))).alias("mean_success_rate"))


def _ranked(group: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of each value among its group's different ones, those of all groups in order, how many each group has)."""
    order = np.lexsort((value, group))
    g, v = group[order], value[order]
    new = np.ones(len(g), dtype=bool)
    new[1:] = (g[1:] != g[:-1]) | (v[1:] != v[:-1])
    count = np.bincount(g[new])
    at = np.empty(len(g), dtype=int)
    at[order] = np.cumsum(new) - 1
    return at - (np.cumsum(count) - count)[group], v[new], count


def _stacked(g: pd.DataFrame, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(groups, channels [group, channel], windows [group, layer], layers [group, layer, channel, channel]) for each shape that the groups' graphs have."""
    group = np.repeat(np.arange(len(starts)), np.diff([*starts, len(g)]))
    ends, channels, n = _ranked(np.tile(group, 2), np.concatenate([g.i, g.j]))
    layer, windows, t = _ranked(group, g.window.to_numpy())
    i, j, w = ends[: len(g)], ends[len(g) :], g.w.to_numpy()
    first_channel, first_window = np.cumsum(n) - n, np.cumsum(t) - t
    for shape in np.unique(np.stack([n, t], 1), axis=0):
        mine = np.flatnonzero((n == shape[0]) & (t == shape[1]))
        to = np.full(len(n), -1)
        to[mine] = np.arange(len(mine))
        rows = to[group] >= 0
        x = np.zeros((len(mine), shape[1], shape[0], shape[0]))
        at = to[group[rows]], layer[rows]
        x[(*at, i[rows], j[rows])] = x[(*at, j[rows], i[rows])] = w[rows]
        yield mine, channels[first_channel[mine, None] + np.arange(shape[0])], windows[first_window[mine, None] + np.arange(shape[1])], x


def layer_nodes(layers: DataFrame, nodes: DataFrame | None, keys: list[str]) -> DataFrame:
    """The layers' edges and all nodes, as loops of weight 0 in the first window."""
    if nodes is None:
        return layers
    by = [k for k in keys if k in nodes.columns]
    if by == keys:  # by a window, since a join would make the layers twice
        loops = nodes.select(*keys, F.lit(None).cast(dict(layers.dtypes)["window"]).alias("window"), F.col("channel").alias("i"), F.col("channel").alias("j"), F.lit(0.0).alias("w"))
        every = spread(layers.select(*keys, "window", "i", "j", "w").unionByName(loops), keys)
        return every.withColumn("window", F.coalesce("window", F.min("window").over(Window.partitionBy(*keys)))).where(F.col("window").isNotNull())
    first = layers.groupBy(*keys).agg(F.min("window").alias("window"))
    every = first.join(nodes.select(*by, "channel"), by).select(*keys, "window", F.col("channel").alias("i"), F.col("channel").alias("j"), F.lit(0.0).alias("w"))
    return layers.select(*keys, "window", "i", "j", "w").unionByName(every)


def multilayer_centrality(layers: DataFrame, coupling: float = 1.0, most: int | None = None, run: list[str] = RUN, nodes: DataFrame | None = None) -> DataFrame:
    """run, channel, layer, value."""
    kinds = dict(layers.dtypes)

    def some(g: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        parts = []
        for mine, names, times, x in _stacked(g, starts):
            m = K.multilayer_centralities(x, np.full(len(x), float(coupling)), most)
            _, n, t = m.shape
            rows = {c: np.repeat(g[c].to_numpy()[starts[mine]], n * t) for c in run}
            parts.append(pd.DataFrame({**rows, "channel": np.repeat(names.ravel(), t), "layer": np.repeat(times[:, None], n, 1).ravel(), "value": m.ravel()}))
        return pd.concat(parts)

    return whole_groups(layer_nodes(layers, nodes, run), run, [], some, "".join(f"{c} {kinds[c]}, " for c in run) + "channel long, layer long, value double")


def quantise(x: DataFrame, percent: float, keys: list[str]) -> DataFrame:
    """-1, 0 or 1: below, within or above the percentiles percent/2 and 100 - percent/2 of the group; the upper one wins ties."""
    over = Window.partitionBy(*keys)  # a join would make the values twice
    cut = x.dropna(subset=keys).select(*keys, *[c for c in x.columns if c not in keys], F.percentile("value", F.lit(percent / 200)).over(over).alias("_lo"), F.percentile("value", F.lit(1 - percent / 200)).over(over).alias("_hi"))
    level = F.when(F.col("value") >= F.col("_hi"), 1).when(F.col("value") <= F.col("_lo"), -1).otherwise(0).cast("long")
    return cut.withColumn("value", level).drop("_lo", "_hi")


def common_channels(layers: DataFrame, nodes: DataFrame, keys: list[str], among: str = "run") -> tuple[DataFrame, DataFrame]:
    """Layers and nodes of the channels that all runs of their keys have."""
    runs = nodes.groupBy(*keys).agg(F.count_distinct(among).alias("_runs"))
    every = nodes.groupBy(*keys, "channel").agg(F.count_distinct(among).alias("_n")).join(runs, keys).where("_n = _runs").select(*keys, "channel")
    for end in ("i", "j"):
        layers = layers.join(every.withColumnRenamed("channel", end), [*keys, end], "left_semi")
    return layers, nodes.join(every, [*keys, "channel"], "left_semi")


def consensus(layers: DataFrame, couplings=(*range(1, 11), 15), percents=tuple(range(10, 90, 10)), sets: list[str] | None = None, keys: list[str] = RUN, nodes: DataFrame | None = None) -> DataFrame:
    """keys, channel, score, top: votes over couplings, percentiles and singular-vector combinations.

    sets: columns that tell the runs and bands apart that are joined; all of them must have the same channels (see
    `common_channels`).  A set's couplings are dealt into a task for each `WITH_CHANNELS` of its channels, cases of a coupling are
    another's work, and votes are sums.  Kernels take all groups of a batch that have one shape at once.
    """
    kinds, sets = dict(layers.dtypes), sets or []
    typed = lambda cols: "".join(f"{c} {kinds[c]}, " for c in cols)
    couplings = [float(c) for c in couplings]
    most, by = len(couplings), [*keys, *sets]
    every = layer_nodes(layers, nodes, by).select(*by, "window", "i", "j", "w")
    if nodes is None:
        parts = F.lit(most)
    else:
        known = [k for k in by if k in nodes.columns]
        every = every.join(nodes.groupBy(*known).agg(F.ceil(F.count(F.lit(1)) / WITH_CHANNELS).alias("_n")), known)
        parts = F.least(F.col("_n"), F.lit(most)).cast("int")
    every = every.select(*by, "window", "i", "j", "w", parts.alias("_parts")).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))

    def centralities_of(g: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        found = []
        first = g.iloc[starts]
        for mine, names, _, x in _stacked(g, starts):
            for (part, of), here in first.iloc[mine].reset_index(drop=True).groupby(["_part", "_parts"]):
                use, at = couplings[part::of], here.index.to_numpy()
                m = K.multilayer_centralities(np.repeat(x[at], len(use), 0), np.tile(use, len(at)))
                n = m.shape[1]
                rows = {c: np.repeat(here[c].to_numpy(), len(use) * n) for c in by}
                found.append(pd.DataFrame({**rows, "coupling": np.tile(np.repeat(use, n), len(at)), "channel": np.repeat(names[at], len(use), 0).ravel(), "value": list(m.reshape(-1, m.shape[2]))}))
        return pd.concat(found)

    found = whole_groups(every, [*by, "_part"], [], centralities_of, typed(by) + "coupling double, channel long, value array<double>")
    case = [*keys, "coupling"]

    def cases_of(g: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        """Rows are a set's channels in order.  Groups of as many sets, channels and layers are taken together; sets of different lengths by themselves."""
        begin = starts_of(g, [*case, *sets])
        n, t = np.diff([*begin, len(g)]), g.value.str.len().to_numpy()
        of = np.searchsorted(starts, begin, side="right") - 1
        channel, size = g.channel.to_numpy(), n[np.searchsorted(begin, starts)]
        own = np.arange(len(g)) - np.repeat(begin, n)
        if (n != size[of]).any() or (channel != channel[np.repeat(starts[of], n) + own]).any():
            raise ValueError("all runs and bands that are joined need the same channels")
        count, low, high = np.bincount(of), np.minimum.reduceat(t, starts), np.maximum.reduceat(t, starts)
        rows = []

        def add(at: np.ndarray, x: np.ndarray) -> None:
            """x: [group, percent, channel, layer]."""
            b, p, m, _ = x.shape
            inside, worth = (v.reshape(b, p, -1) for v in K.consensus_cases(x.reshape(b * p, m, -1)))
            cols = {c: np.repeat(g[c].to_numpy()[starts[at]], m) for c in keys}
            rows.append(pd.DataFrame({**cols, "channel": channel[starts[at][:, None] + np.arange(m)].ravel(), "vote": (worth * inside).sum(1).ravel(), "worth": np.repeat(worth.sum(1), m)}))

        value = g.value.to_numpy()
        shapes = np.stack([count, size, low, high], 1)
        for s, m, least, longest in np.unique(shapes, axis=0):
            at = np.flatnonzero((shapes == [s, m, least, longest]).all(1))
            if least == longest:
                x = np.concatenate(value[(starts[at][:, None] + np.arange(s * m)).ravel()])
                add(at, K.quantised_sets(x.reshape(len(at), s, m, least), percents))
                continue
            for k in at:
                of_set = [np.stack(value[b : b + m])[None, None] for b in begin[of == k]]
                add(np.array([k]), np.concatenate([K.quantised_sets(x, percents) for x in of_set], 3))
        return pd.concat(rows)

    votes = whole_groups(found, case, [*sets, "channel"], cases_of, typed(keys) + "channel long, vote double, worth double")
    share = votes.groupBy(*keys, "channel").agg(F.sum("worth").alias("_w"), F.coalesce(F.try_divide(F.sum("vote"), F.sum("worth")), F.lit(0.0)).alias("score"))
    share = share.withColumn("score", minmax(F.col("score"), Window.partitionBy(*keys)))

    def top_of(g: pd.DataFrame) -> pd.DataFrame:
        return g[[*keys, "channel", "score"]].assign(top=(K.three_means(g.score.to_numpy()) == 2) & (g["_w"] > 0))

    return grouped(share, keys, top_of, typed(keys) + "channel long, score double, top boolean")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once a row.  A plain column would be written out again inside lambdas, and computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def standardised(wide: DataFrame) -> DataFrame:
    """Each channel centred, divided by its largest magnitude and then by its root mean square; constant channels are 0."""
    mean = lambda x, f: F.aggregate(x, F.lit(0.0), lambda a, v: a + f(v)) / F.size(x)
    divided = lambda x, m, least: F.transform(x, lambda v: v / F.when(m > least, m).otherwise(1.0))
    s = bound(F.col("samples"), lambda x: bound(mean(x, lambda v: v), lambda m: F.transform(x, lambda v: v - m)))
    s = bound(s, lambda x: bound(F.array_max(F.transform(x, F.abs)), lambda m: divided(x, m, 0)))
    s = bound(s, lambda x: bound(F.sqrt(mean(x, lambda v: v * v)), lambda m: divided(x, m, 1e-12)))
    return wide.withColumn("samples", s)


def fragility_heatmap(wide: DataFrame, width: int, step: int, sfreq: float, run: list[str] = RUN, windows: int = 8) -> DataFrame:
    """run, window, t_sec, channel, value.  Channels are standardised as wholes; up to `windows` consecutive windows are one task's work."""
    kinds = dict(wide.dtypes)
    parts = window_chunks(standardised(wide), width, step, True, run, windows)

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("channel")
        x, ch = np.stack(g.x.to_numpy()), g.channel.to_numpy()
        starts = np.arange(0, x.shape[1] - width + 1, step)
        v = np.concatenate([K.fragility(x[:, at : at + width]) for at in starts])
        k = g["first"].iloc[0] + np.arange(len(starts))
        return pd.DataFrame({"window": np.repeat(k, len(ch)), "t_sec": np.repeat((k * step + width / 2) / sfreq, len(ch)), "channel": np.tile(ch, len(k)), "value": v}).assign(**{c: g[c].iloc[0] for c in run})

    by = [*run, "first"]
    return spread(parts, by).groupBy(*by).applyInPandas(one, "".join(f"{c} {kinds[c]}, " for c in run) + "window long, t_sec double, channel long, value double")


def attention_score(
    wide: DataFrame, length: int = 8, length_seq: int = 4, seed: int = 0, weights: dict[str, np.ndarray] | None = None, run: list[str] = RUN, by_subject: dict[str, dict[str, np.ndarray]] | None = None,
) -> DataFrame:
    """Per channel the attention summed over time, scaled to 0..1, of the network's forward pass.

    weights: see `kernels.network_weights`; by_subject: those of each subject, as `learning.train_attention` gives them.  Without
    either they are drawn by the seed, and the score says nothing about a subject.
    """
    kinds = dict(wide.dtypes)

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("channel")
        x = np.stack(g.samples.to_numpy())
        x = (x - x.mean(1, keepdims=True)) / (x.std(1, keepdims=True) + 1e-6)
        w = by_subject.get(str(g[run[0]].iloc[0])) if by_subject is not None else weights or K.network_weights(seed)
        if w is None:  # nobody else to learn from
            return pd.DataFrame({"channel": g.channel, "score": 0.0}).assign(**{c: g[c].iloc[0] for c in run})
        seq = np.array([K.gated_convolutions(x[:, k * length : (k + 1) * length], w) for k in range(x.shape[1] // length)])
        total = np.zeros(len(x))
        for t in range(length_seq, len(seq)):
            total += K.graph_attention(seq[t - length_seq : t], w)[0].sum(0)
        spread = total.max() - total.min()
        return pd.DataFrame({"channel": g.channel, "score": (total - total.min()) / (spread + 1e-12) if spread >= 1e-12 else 0 * total}).assign(**{c: g[c].iloc[0] for c in run})

    return spread(wide, run).groupBy(*run).applyInPandas(one, "".join(f"{c} {kinds[c]}, " for c in run) + "channel long, score double")


def rank_channels(x: DataFrame, keys: list[str]) -> DataFrame:
    return x.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), F.desc("channel"))).cast("long"))

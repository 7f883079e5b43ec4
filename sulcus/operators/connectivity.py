"""From signals to graphs."""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from . import signal as S

RUN = ["subject"]


def _typed(df: DataFrame, cols: list[str]) -> str:
    kinds = dict(df.dtypes)
    return "".join(f"{c} {kinds[c]}, " for c in cols)


def spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """Dealt by the keys over all shuffle partitions.  Groups of few bytes cost much CPU in kernels, so partitions are not put together by size."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def grouped(df: DataFrame, keys: list[str], f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """f of each group of keys (none null), for many groups of few rows: groups stream past in order, many to an Arrow batch.

    A task holds one batch and the group at its end.
    """

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for b in batches:
            if not len(b):
                continue
            new = np.zeros(len(b), dtype=bool)
            new[0] = not held or any(held[-1][k].iloc[-1] != b[k].iloc[0] for k in keys)
            for k in keys:
                v = b[k].to_numpy()
                new[1:] |= v[1:] != v[:-1]
            cuts = [0, *np.flatnonzero(new), len(b)]
            out = []
            for at, to in zip(cuts[:-1], cuts[1:]):
                if new[at] and held:
                    out.append(f(pd.concat(held)))
                    held = []
                if to > at:
                    held.append(b.iloc[at:to])
            if out:
                yield pd.concat(out)
        if held:
            yield f(pd.concat(held))

    return spread(df, keys).sortWithinPartitions(*keys).mapInPandas(stream, schema)


def stream_groups(keys: list[str], f: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """f of some whole groups at a time of batches in order of keys.  A task holds one batch and the group at its end."""

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for b in batches:
            if not len(b):
                continue
            new = starts_of(b, keys)
            last = int(new[-1])
            if held and all(held[-1][k].iloc[-1] == b[k].iloc[0] for k in keys):
                if last == 0:
                    held.append(b)
                    continue
            elif last == 0:
                if held:
                    yield whole(held)
                held = [b]
                continue
            yield whole([*held, b.iloc[:last]])
            held = [b.iloc[last:]]
        if held:
            yield whole(held)

    def whole(parts: list[pd.DataFrame]) -> pd.DataFrame:
        g = pd.concat(parts, ignore_index=True)
        return f(g, starts_of(g, keys))

    return stream


def whole_groups(df: DataFrame, keys: list[str], order: list[str], f: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """f of the frame of some whole groups of keys, in order of keys and `order`, and of where each group starts: for kernels that take many groups at once."""
    return spread(df, keys).sortWithinPartitions(*keys, *order).mapInPandas(stream_groups(keys, f), schema)


def starts_of(b: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """The places at which a frame's groups of keys start."""
    new = np.ones(len(b), dtype=bool)
    new[1:] = False
    for k in keys:
        v = b[k].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def window_chunks(wide: DataFrame, width: int, step: int, inclusive: bool, run: list[str], windows: int) -> DataFrame:
    """(run, channel, first, x): the samples x of each channel under up to `windows` consecutive windows, the first of which is number `first`.

    Neighbours overlap by width - step samples, so a sample is shipped about once.
    """
    starts = F.floor((F.size("samples") - width - (0 if inclusive else 1)) / step) + 1
    c = wide.select(*run, "channel", "samples", starts.cast("int").alias("_n"))
    # Null explodes into no row.  A filter would be pushed below a Python function that makes the samples, and call it once more.
    c = c.select("*", F.explode(F.when(F.col("_n") > 0, F.sequence(F.lit(0), F.col("_n") - 1, F.lit(windows)))).alias("first"))
    some = F.least(F.col("_n") - F.col("first"), F.lit(windows))
    return c.select(*run, "channel", "first", F.slice("samples", F.col("first") * step + 1, (some - 1) * step + width).alias("x"))


def _pairs(x: DataFrame, cols: list[str], run: list[str]) -> DataFrame:
    a = x.select(*run, "sample", F.col("channel").alias("i"), *[F.col(c).alias(f"a_{c}") for c in cols])
    b = x.select(*run, "sample", F.col("channel").alias("j"), *[F.col(c).alias(f"b_{c}") for c in cols])
    return a.join(b, [*run, "sample"]).where("i < j")


def window_sums(pairs: DataFrame, sums: dict[str, Column], width: int, step: int, run: list[str], inclusive: bool, n: DataFrame) -> DataFrame:
    """Sums over sliding windows, from sums over blocks of gcd(width, step) samples: a sample is read once, not once per window."""
    block = math.gcd(width, step)
    blocks = pairs.groupBy(*run, "i", "j", F.floor(F.col("sample") / block).cast("long").alias("_b")).agg(*[F.sum(v).alias(k) for k, v in sums.items()])
    of = blocks.join(n, run)
    per, hop = width // block, step // block
    # Block b lies in the windows k with k * hop <= b < k * hop + per.
    first = F.greatest(F.lit(0), F.ceil((F.col("_b") - (per - 1)) / hop)).cast("long")
    last = F.least(F.floor(F.col("_b") / hop), F.floor((F.col("_n") - width - (0 if inclusive else 1)) / step)).cast("long")
    spread = of.where(last >= first).withColumn("window", F.explode(F.sequence(first, last)))
    return spread.groupBy(*run, "window", "i", "j").agg(*[F.sum(k).alias(k) for k in sums])


def sliding_correlation(x: DataFrame, width: int, step: int, inclusive: bool = True, run: list[str] = RUN) -> DataFrame:
    """Edges (run, window, i, j, w), i < j: Pearson correlation of each window, deviations not below 1e-10."""
    n = x.groupBy(*run).agg((F.max("sample") + 1).alias("_n"))
    centred = x.withColumn("value", F.col("value") - F.avg("value").over(Window.partitionBy(*run, "channel")))
    a, b = F.col("a_value"), F.col("b_value")
    s = window_sums(_pairs(centred, ["value"], run), {"sa": a, "sb": b, "saa": a * a, "sbb": b * b, "sab": a * b}, width, step, run, inclusive, n)
    dev = lambda q, m: F.greatest(F.sqrt(F.greatest((F.col(q) - F.col(m) * F.col(m) / width) / (width - 1), F.lit(0.0))), F.lit(1e-10))
    r = (F.col("sab") - F.col("sa") * F.col("sb") / width) / (width - 1) / (dev("saa", "sa") * dev("sbb", "sb"))
    return s.select(*run, "window", "i", "j", r.alias("w"))


def block_correlation(wide: DataFrame, width: int, step: int, inclusive: bool = True, run: list[str] = RUN, windows: int = 32) -> DataFrame:
    """The same edges by matrix products.  wide: run, channel, samples.

    A task gets the samples of `windows` consecutive windows of a run (neighbours overlap by width - step samples), makes one Gram
    matrix of each block of gcd(width, step) samples, and adds up the blocks of each window.  So a run spreads over tasks, a
    sample is shipped about once and multiplied once, and no row per pair and sample is made.
    """
    block = math.gcd(width, step)
    per, hop = width // block, step // block
    chunks = window_chunks(wide, width, step, inclusive, run, windows)

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("channel")
        x, ch = np.stack(g.x.to_numpy()), g.channel.to_numpy()
        x = x - x.mean(1, keepdims=True)
        b = x.reshape(len(x), -1, block).transpose(1, 0, 2)  # [block, channel, sample]
        count = (b.shape[0] - per) // hop + 1
        add = lambda v: np.stack([v[k * hop : k * hop + per].sum(0) for k in range(count)])
        gram, total = add(b @ b.transpose(0, 2, 1)), add(b.sum(2))
        cov = (gram - total[:, :, None] * total[:, None] / width) / (width - 1)
        dev = np.maximum(np.sqrt(np.maximum(np.diagonal(cov, axis1=1, axis2=2), 0)), 1e-10)
        i, j = np.triu_indices(len(ch), 1)
        w = (cov / (dev[:, :, None] * dev[:, None]))[:, i, j]
        k = g["first"].iloc[0] + np.arange(count)
        return pd.DataFrame({"window": np.repeat(k, len(i)), "i": np.tile(ch[i], count), "j": np.tile(ch[j], count), "w": w.ravel()}).assign(**{c: g[c].iloc[0] for c in run})

    by = [*run, "first"]
    return spread(chunks, by).groupBy(*by).applyInPandas(one, _typed(wide, run) + "window long, i long, j long, w double")


def channel_pairs(nodes: DataFrame, run: list[str] = RUN) -> DataFrame:
    """(run, edge, i, j): each run's pairs of channels, numbered as in `edge_vectors`.  nodes: run, channel."""
    c = nodes.groupBy(*run).agg(F.array_sort(F.collect_set("channel")).alias("c"))
    at = lambda k: F.get("c", F.col(k))
    n = F.size("c")
    p = c.where(n > 1).select("*", F.explode(F.sequence(F.lit(0), n - 2)).alias("a")).select("*", F.explode(F.sequence(F.col("a") + 1, n - 1)).alias("b"))
    edge = F.col("a") * n - F.floor(F.col("a") * (F.col("a") + 1) / 2).cast("int") + F.col("b") - F.col("a") - 1
    return p.select(*run, edge.cast("int").alias("edge"), at("a").alias("i"), at("b").alias("j"))


def edge_vectors(edges: DataFrame, run: list[str] = RUN) -> DataFrame:
    """One array per window, edges in order of (i, j)."""
    return edges.groupBy(*run, "window").agg(F.array_sort(F.collect_list(F.struct("i", "j", "w"))).alias("e")).select(*run, "window", F.col("e.w").alias("edge"))


def both_ways(edges: DataFrame) -> DataFrame:
    keep = [c for c in edges.columns if c not in ("i", "j")]
    return edges.select(*keep, "i", "j").unionByName(edges.select(*keep, F.col("j").alias("i"), F.col("i").alias("j")))


def matrix_rows(edges: DataFrame, order: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of each graph's matrix as a plot shows them: keys, place, channel, row (array).  order: some of the keys, channel, place; missing edges and the diagonal are 0."""
    by = [k for k in keys if k in order.columns]
    graphs = edges.select(*keys).distinct().join(order, by)
    to = order.select(*by, F.col("channel").alias("j"), F.col("place").alias("_to"))
    cells = graphs.join(to, by).join(both_ways(edges).withColumnRenamed("i", "channel"), [*keys, "channel", "j"], "left")
    row = F.transform(F.array_sort(F.collect_list(F.struct("_to", F.coalesce("w", F.lit(0.0)).alias("w")))), lambda c: c["w"])
    return cells.groupBy(*keys, "place", "channel").agg(row.alias("row"))


def _every_node(per_node: DataFrame, nodes: DataFrame | None, keys: list[str], value: str) -> DataFrame:
    """Rows of the nodes (some of the keys, channel) that no edge has: the value is 0 in each graph."""
    if nodes is None:
        return per_node
    by = [k for k in keys if k in nodes.columns]
    rest = [k for k in keys if k not in by]
    graphs = per_node.select(*keys).distinct()
    every = graphs.join(nodes.select(*by, "channel"), by) if by else graphs.crossJoin(nodes.select("channel"))  # all of its rows are asked for
    return every.join(per_node, [*by, *rest, "channel"], "left").select(*keys, "channel", F.coalesce(value, F.lit(0.0)).alias(value))


def node_strength(edges: DataFrame, keys: list[str], nodes: DataFrame | None = None) -> DataFrame:
    """nodes: run keys and channel of all nodes; those without edges have strength 0."""
    g = both_ways(edges).groupBy(*keys, F.col("i").alias("channel")).agg(F.sum(F.abs("w")).alias("strength"))
    return _every_node(g, nodes, keys, "strength")


def degree_std(edges: DataFrame, keys: list[str], nodes: DataFrame | None = None) -> DataFrame:
    """Population deviation of a node's row of magnitudes over all nodes, its zero on the diagonal and those of missing edges included."""
    g = both_ways(edges).groupBy(*keys, F.col("i").alias("channel")).agg(F.sum(F.abs("w")).alias("s"), F.sum(F.col("w") * F.col("w")).alias("q"))
    by = keys if nodes is None else [k for k in keys if k in nodes.columns]
    n = (g if nodes is None else nodes).groupBy(*by).agg(F.count_distinct("channel").alias("n"))
    g = g.join(n, by) if by else g.crossJoin(F.broadcast(n))  # one row
    g = g.select(*keys, "channel", F.sqrt(F.greatest(F.col("q") / F.col("n") - F.pow(F.col("s") / F.col("n"), 2), F.lit(0.0))).alias("degree_std"))
    return _every_node(g, nodes, keys, "degree_std")


def quantile_sparsify(edges: DataFrame, q: float, keys: list[str], keep_all_if_none: bool = False) -> DataFrame:
    """Edges of at least the exact q-quantile of the graph's positive weights."""
    positive = F.when(F.col("w") > 0, F.col("w"))
    if keys:  # by a window, since a join would make the edges twice
        out = edges.dropna(subset=keys).select(*keys, *[c for c in edges.columns if c not in keys], F.percentile(positive, F.lit(q)).over(Window.partitionBy(*keys)).alias("_t"))
    else:
        out = edges.crossJoin(edges.agg(F.percentile(positive, F.lit(q)).alias("_t")))  # one row
    test = (F.col("w") > 0) & (F.col("w") >= F.col("_t"))
    return out.where(test | F.col("_t").isNull() if keep_all_if_none else test).drop("_t")


def envelope_layers(env: DataFrame, width: int, step: int, q: float = 0.8, run: list[str] = RUN) -> DataFrame:
    """env: envelopes, one row per channel (samples) or per sample (value)."""
    e = (block_correlation if "samples" in env.columns else sliding_correlation)(env, width, step, run=run)
    e = e.withColumn("w", F.abs(F.coalesce(F.nanvl("w", F.lit(0.0)), F.lit(0.0))))
    return quantile_sparsify(e, q, [*run, "window"], True)


def lagged_coherence(z: DataFrame, width: int, step: int, run: list[str] = RUN) -> DataFrame:
    """z: re and im of analytic signals.  Edges: |Im c| / sqrt(1 - Re c ^ 2) of the window's coherence c."""
    n = z.groupBy(*run).agg((F.max("sample") + 1).alias("_n"))
    ar, ai, br, bi = (F.col(c) for c in ("a_re", "a_im", "b_re", "b_im"))
    s = window_sums(_pairs(z, ["re", "im"], run), {"re": ar * br + ai * bi, "im": ai * br - ar * bi, "pa": ar * ar + ai * ai, "pb": br * br + bi * bi}, width, step, run, True, n)
    base = F.sqrt(F.greatest(F.col("pa") / width, F.lit(1e-12)) * F.greatest(F.col("pb") / width, F.lit(1e-12)))
    re, im = F.col("re") / width / base, F.col("im") / width / base
    return s.select(*run, "window", "i", "j", (F.abs(im) / F.sqrt(F.greatest(1 - re * re, F.lit(1e-12)))).alias("w"))


def preictal_map(edges: DataFrame, centre_s: Column, onset_s: float, run: list[str] = RUN) -> DataFrame:
    """1 - exp(-z) of each edge's excess over its windows before the onset (the first fifth, two at least, if fewer than two)."""
    e = edges.withColumn("_pre", centre_s < onset_s)
    w = e.select(*run, "window", "_pre").distinct().groupBy(*run).agg(F.sum(F.col("_pre").cast("int")).alias("_k"), F.count(F.lit(1)).alias("_t"))
    e = e.join(w, run).withColumn("_base", F.when(F.col("_k") >= 2, F.col("_pre")).otherwise(F.col("window") < F.greatest(F.lit(2), F.ceil(F.col("_t") * 0.2))))
    inside = F.when(F.col("_base"), F.col("w"))
    over = Window.partitionBy(*run, "i", "j")
    zed = (F.col("w") - F.avg(inside).over(over)) / (F.stddev_pop(inside).over(over) + 1e-12)
    return e.withColumn("w", 1 - F.exp(-F.least(F.greatest(zed, F.lit(0.0)), F.lit(50.0)))).select(*run, "window", "i", "j", "w")


def coherence_layers(wide: DataFrame, sfreq: float, width: int, step: int, onset_s: float, bands=((80.0, 140.0), (140.0, 200.0)), run: list[str] = RUN) -> DataFrame:
    """Edges (run, band, window, i, j, w) of each band: lagged coherence of the filtered signals, mapped by its windows before the onset."""
    z = [S.analytic(S.butterworth(wide, sfreq, *b)).select(*run, F.lit(f"{b[0]:g}-{b[1]:g}").alias("band"), "channel", F.posexplode(F.arrays_zip("re", "im")).alias("sample", "z")) for b in bands]
    z = functools.reduce(DataFrame.unionByName, z).select(*run, "band", "channel", F.col("sample").cast("long").alias("sample"), "z.re", "z.im")
    by = [*run, "band"]
    return preictal_map(lagged_coherence(z, width, step, by), (F.col("window") * step + width / 2) / sfreq, onset_s, by)


def cross_mapping(wide: DataFrame, dim: int = 3, tau: int = 1, run: list[str] = RUN) -> DataFrame:
    """Directed edges (run, i, j, w): channel i's neighbourhoods predict channel j.  A source channel and its run's channels are one task."""
    pairs = wide.select(*run, F.col("channel").alias("i")).join(wide.select(*run, F.col("channel").alias("j"), "samples"), run)

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("j")
        j, i = g.j.to_numpy(), g.i.iloc[0]
        w = K.cross_map_from(np.stack(g.samples.to_numpy()), int(np.flatnonzero(j == i)[0]), dim, tau)
        return pd.DataFrame({"i": i, "j": j, "w": w})[j != i].assign(**{c: g[c].iloc[0] for c in run})

    by = [*run, "i"]
    return spread(pairs, by).groupBy(*by).applyInPandas(one, _typed(wide, run) + "i long, j long, w double")


def cross_mapping_connectivity(wide: DataFrame, sfreq: float, target: float = 50.0, most: int = 1500, dim: int = 3, tau: int = 1, run: list[str] = RUN) -> DataFrame:
    """The whole method: envelope, decimation, at most `most` evenly spaced points, z-scores, all ordered pairs."""
    w = S.decimate(S.envelope(wide), sfreq, target)
    n = F.size("samples")
    points = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda k: F.get("samples", F.floor(k * (n - 1) / (most - 1)).cast("int")))
    w = w.withColumn("samples", F.when(n <= most, F.col("samples")).otherwise(points) if most > 1 else F.col("samples"))
    total = lambda f: F.aggregate("samples", F.lit(0.0), lambda a, v: a + f(v)) / F.size("samples")
    w = w.withColumn("_m", total(lambda v: v)).withColumn("_s", F.sqrt(total(lambda v: (v - F.col("_m")) * (v - F.col("_m")))))
    w = w.withColumn("samples", F.transform("samples", lambda v: (v - F.col("_m")) / (F.col("_s") + 1e-12))).drop("_m", "_s")
    return cross_mapping(w, dim, tau, run)


def evolution(vectors: DataFrame, width: int = 20, step: int = 5, modes: int = 10, run: list[str] = RUN, sketch: int | None = None, windows: int = 8) -> DataFrame:
    """Singular modes of windowed evolution operators: run, op_window, mode, sigma, energy, left, right (arrays over edges).

    Windows hold width + 1 edge vectors; the last possible start is left out, as for `inclusive=False`.  A task decomposes up to
    `windows` consecutive ones, so a vector is shipped about once.  sketch: the seed of a randomised range finder (see
    `kernels.evolution_modes`); without it, decompositions are exact.
    """
    n = vectors.groupBy(*run).agg(F.count(F.lit(1)).alias("_n"))
    first = F.greatest(F.lit(0), F.ceil((F.col("window") - width) / step)).cast("long")
    last = F.least(F.floor(F.col("window") / step), F.floor((F.col("_n") - width - 2) / step)).cast("long")
    some = vectors.join(n, run).where(last >= first)
    some = some.select(*run, "_n", F.explode(F.sequence(F.floor(first / windows), F.floor(last / windows))).alias("_c"), "window", "edge")

    def decompose(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("window")
        x, at, rows = np.stack(g.edge.to_numpy()), g.window.iloc[0], []
        c = g["_c"].iloc[0] * windows
        for k in range(c, min(c + windows, (g["_n"].iloc[0] - width - 2) // step + 1)):
            part = x[k * step - at : k * step - at + width + 1]
            s, u, v, energy = K.evolution_modes(part[:-1], part[1:], modes, sketch=sketch)
            rows += [(k, m, s[m], energy, u[:, m], v[:, m]) for m in range(len(s))]
        return pd.DataFrame(rows, columns=["op_window", "mode", "sigma", "energy", "left", "right"]).assign(**{c: g[c].iloc[0] for c in run})

    by = [*run, "_c"]
    return spread(some, by).groupBy(*by).applyInPandas(decompose, _typed(vectors, run) + "op_window long, mode long, sigma double, energy double, left array<double>, right array<double>")


def mode_statistics(modes: DataFrame, side: str = "right", run: list[str] = RUN) -> DataFrame:
    """What a run's vectors are z-scored by: n, mean, std (population), min, max over all windows, edges and modes."""
    x = modes.select(*run, F.explode(side).alias("x"))
    return x.groupBy(*run).agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))


def mode_graphs(modes: DataFrame, pairs: DataFrame, side: str = "right", run: list[str] = RUN) -> DataFrame:
    """Edges (run, op_window, mode, i, j, w): a run's vectors, z-scored over all its windows, edges and modes.  pairs: run, edge, i, j."""
    x = modes.select(*run, "op_window", "mode", F.posexplode(side).alias("edge", "x")).join(mode_statistics(modes, side, run).select(*run, "mean", "std"), run)
    x = x.withColumn("w", (F.col("x") - F.col("mean")) / F.when(F.col("std") > 0, F.col("std")).otherwise(1.0))
    return x.join(pairs, [*run, "edge"]).select(*run, "op_window", "mode", "i", "j", "w")


def supra_edges(layers: DataFrame, coupling: float, run: list[str] = RUN) -> DataFrame:
    """The supra-graph's edges between (layer, node) pairs: those of each layer and those of a node to itself in the next."""
    nodes = both_ways(layers).select(*run, "window", F.col("i").alias("node")).distinct()
    inter = nodes.join(nodes.select(*run, (F.col("window") - 1).alias("window"), "node"), [*run, "window", "node"])
    intra = layers.select(*run, F.col("window").alias("layer_a"), F.col("i").alias("node_a"), F.col("window").alias("layer_b"), F.col("j").alias("node_b"), "w")
    return intra.unionByName(inter.select(*run, F.col("window").alias("layer_a"), F.col("node").alias("node_a"), (F.col("window") + 1).alias("layer_b"), F.col("node").alias("node_b"), F.lit(coupling).alias("w")))

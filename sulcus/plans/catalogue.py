"""The operators as queries over fixtures of the synthetic tables; numbers are rounded to six digits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..operators import channels as C
from ..operators import connectivity as N
from ..operators import evaluation as L
from ..operators import events as E
from ..operators import graphs as G
from ..operators import learning as T
from ..operators import signal as S
from ..session import shared_path
from ..sources import readers, sinks
from . import file_queries, kernel_queries
from . import fixtures as X
from .oracle import ORACLE

#: Keys of recordings in F1.
R = X.RUN
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: Sizes on the fixtures: correlation window and step, evolution window, sampling rate.
W, STEP, OPW, FS = 16, 8, 3, 16.0


def query(f):
    QUERIES[f.__name__] = f
    return f


def r6(df: DataFrame, digits: int = 6, **own: int) -> DataFrame:
    """Doubles rounded to `digits`, or to a column's own number of digits.

    Mean squares of bursts have nine: values of two decimals have means that lie exactly between two numbers of six digits, and
    either engine rounds those either way from run to run.
    """
    return df.select(*[F.round(c, own.get(c, digits)).alias(c) if t == "double" else c for c, t in df.dtypes])


def _nodes(s, d):
    return X.dense_wide(s, d).select(*R, "channel")


def fc(s, d, inclusive=True):
    return N.block_correlation(X.dense_wide(s, d), W, STEP, inclusive, R)


@query
def fc_sliding_edges(s, d):
    """By sums over the long table."""
    return r6(N.sliding_correlation(X.dense(s, d), W, STEP, True, R))


@query
def fc_sliding_edges_exclusive(s, d):
    return r6(fc(s, d, False))


@query
def fc_sliding_edges_kernel(s, d):
    """By Gram matrices of blocks, three windows to a task."""
    return r6(N.block_correlation(X.dense_wide(s, d), W, STEP, run=R, windows=3))


@query
def fc_edge_vectors(s, d):
    v = N.edge_vectors(fc(s, d), R)
    return r6(v.select(*R, "window", F.size("edge").cast("long").alias("n_edges"), F.aggregate("edge", F.lit(0.0), lambda a, x: a + x).alias("total")))


@query
def fc_node_strength(s, d):
    return r6(N.node_strength(fc(s, d), [*R, "window"], _nodes(s, d)))


@query
def fc_degree_std(s, d):
    return r6(N.degree_std(fc(s, d), [*R, "window"], _nodes(s, d)))


@query
def average_reference(s, d):
    return r6(S.average_reference(X.dense(s, d), R).select(*R, "channel", "sample", "value"))


@query
def percentile_scale(s, d):
    return r6(S.percentile_scale(X.dense(s, d), run=R).select(*R, "channel", "sample", "value"))


@query
def channel_zscore(s, d):
    return r6(S.channel_zscore(X.bursts(s, d)))


@query
def safe_standardise(s, d):
    return r6(S.safe_standardise(X.bursts(s, d)))


@query
def robust_zscore(s, d):
    return r6(S.robust_zscore(X.dense(s, d), run=R).select(*R, "channel", "sample", "value"))


@query
def windows_seconds(s, d):
    n = X.bursts(s, d).groupBy("subject").agg((F.max("sample") + 1).alias("n")).withColumn("sfreq", F.lit(500.0))
    return S.windows_seconds(n, 0.05, 0.0125).select("subject", "window", "start", "stop")


@query
def segments_and_targets(s, d):
    seg = S.segments(X.bursts(s, d), 20).groupBy("subject").agg((F.max("segment") + 1).alias("n"))
    return S.sequence_targets(seg, 4, 6)


@query
def delay_embedding(s, d):
    return r6(S.delay_embedding(X.bursts(s, d), 3, 2))


@query
def linspace_decimate(s, d):
    return r6(S.point_cap(X.dense(s, d), 25, R).select(*R, "channel", "point", "sample", "value"))


@query
def band_power(s, d):
    return r6(S.band_power(X.dense(s, d), R))


@query
def onset_crop(s, d):
    return r6(S.crop(X.dense(s, d), FS, 2.0, 1.0, 0.5).select(*R, "channel", "sample", "value"))


@query
def hilbert_envelope(s, d):
    return r6(X.long_form(S.envelope(X.dense_wide(s, d))).select(*R, "channel", "sample", F.col("value").alias("env")))


def _hfo(s, d):
    return E.detect_wide(X.bursts_wide(s, d), 100.0, 2, 10, 1, 1.5)


@query
def hfo_events(s, d):
    """By relational steps over the long table."""
    wide = X.bursts_wide(s, d)
    mid = X.long_form(wide).groupBy("subject", "channel").agg(F.median("value").alias("mid"))
    centred = wide.join(mid, ["subject", "channel"]).withColumn("samples", F.transform("samples", lambda v: v - F.col("mid"))).drop("mid")
    env = X.long_form(S.envelope(centred)).withColumnRenamed("value", "env")
    return r6(E.detect(X.long_form(centred), env, 100.0, 2, 10, 1, 1.5), power=9)


@query
def hfo_events_kernel(s, d):
    """By one kernel call a channel."""
    return r6(_hfo(s, d).where("start is not null").drop("n", "band_power"), power=9)


@query
def hfo_rate(s, d):
    found = _hfo(s, d)
    return r6(E.rate(found.where("start is not null"), found.select("subject", "channel", "n").distinct(), 100.0))


@query
def hfo_features(s, d):
    return r6(E.features(_hfo(s, d), 100.0))


@query
def envelope_corr_layers(s, d):
    return r6(N.envelope_layers(S.envelope(X.dense_wide(s, d)), W, STEP, run=R))


def _coherence(s, d):
    z = (
        S.analytic(X.dense_wide(s, d))
        .select(*R, "channel", F.posexplode(F.arrays_zip("re", "im")).alias("sample", "z"))
        .select(*R, "channel", F.col("sample").cast("long").alias("sample"), "z.re", "z.im")
    )
    return N.lagged_coherence(z, W, STEP, R)


@query
def lagged_coherence(s, d):
    return r6(_coherence(s, d))


@query
def preictal_mapped(s, d):
    return r6(N.preictal_map(_coherence(s, d), (F.col("window") * STEP + W / 2) / FS, 2.0, R), 4)


@query
def quantile_sparsify(s, d):
    return r6(N.quantile_sparsify(X.trade_graph(s, d), 0.9, []))


@query
def directed_strength(s, d):
    return r6(G.directed_strength(N.quantile_sparsify(X.trade_graph(s, d), 0.5, []), X.nations(s, d)))


@query
def supra_adjacency(s, d):
    return r6(N.supra_edges(fc(s, d).where("w > 0"), 1.0, R))


def _sparse(s, d):
    return N.quantile_sparsify(X.trade_graph(s, d), 0.9, [])


def _one_metric(name: str, digits: int = 6):
    def run(s, d):
        return r6(G.centralities(_sparse(s, d), [], "u", "v", X.nations(s, d), (name,)).select("channel", "value"), digits)

    run.__name__ = name
    return run


for _m in ("in_closeness", "out_closeness", "clustering", "local_efficiency", "betweenness"):
    QUERIES[_m] = _one_metric(_m)
for _m in ("pagerank", "hubs", "authorities"):
    QUERIES[_m] = _one_metric(_m, 4)


@query
def ten_centralities(s, d):
    return r6(G.centralities(_sparse(s, d), [], "u", "v", X.nations(s, d)), 4)


def _undirected(s, d):
    g = _sparse(s, d)
    i, j = F.least("u", "v"), F.greatest("u", "v")
    return g.groupBy(i.alias("i"), j.alias("j")).agg(F.sum("w").alias("w"))


@query
def nodal_efficiency(s, d):
    return r6(G.node_metrics(_undirected(s, d), [], X.nations(s, d)).where("metric = 'global_efficiency'").select("channel", "value"))


@query
def eigenvector_centrality(s, d):
    return r6(G.node_metrics(_undirected(s, d), [], X.nations(s, d)).where("metric = 'eigenvector'").select("channel", "value"), 4)


def _period_graphs(s, d):
    return N.quantile_sparsify(X.trade_graphs(s, d), 0.5, ["period"])


@query
def period_centralities(s, d):
    """The ten centralities of many graphs, one for each year and order priority."""
    return r6(G.centralities(_period_graphs(s, d), ["period"], "u", "v", X.nations(s, d)), 4)


@query
def period_path_metrics(s, d):
    """Metrics of shortest paths in the same graphs, eight sources to a task."""
    return r6(G.path_centralities(_period_graphs(s, d), ["period"], "u", "v", X.nations(s, d), 8), 4)


@query
def period_node_metrics(s, d):
    """Strength, degree spread, eigenvector centrality and efficiency of the same graphs without directions."""
    g = _period_graphs(s, d).groupBy("period", F.least("u", "v").alias("i"), F.greatest("u", "v").alias("j")).agg(F.sum("w").alias("w"))
    return r6(G.node_metrics(g, ["period"], X.nations(s, d)).where("metric <> 'ok'"), 4)


def _modes(s, d):
    return N.evolution(N.edge_vectors(fc(s, d, False), R), OPW, 1, 2, R), N.channel_pairs(_nodes(s, d), R)


@query
def evolution_operator_svd(s, d):
    return r6(_modes(s, d)[0].select(*R, "op_window", "mode", "sigma", "energy"), 3)


def _mode_metrics(s, d):
    modes, pairs = _modes(s, d)
    return G.node_metrics(N.mode_graphs(modes, pairs, run=R), [*R, "op_window", "mode"], _nodes(s, d))


@query
def evolution_node_metrics(s, d):
    return r6(_mode_metrics(s, d), 4)


@query
def mode_statistics(s, d):
    """How many entries a run's modes have, and the sum of their squares: each mode is a unit vector."""
    m = N.mode_statistics(_modes(s, d)[0], run=R)
    return r6(m.select(*R, "n", (F.col("n") * (F.col("std") * F.col("std") + F.col("mean") * F.col("mean"))).alias("squares")), 4)


@query
def evolution_success_rate(s, d):
    return G.success_rate(_mode_metrics(s, d), R, _nodes(s, d))


@query
def mean_success_rate(s, d):
    return G.mean_success(G.success_rate(_mode_metrics(s, d), R, _nodes(s, d)))


def _odd_graph_rates(s, d):
    """Every third graph of even subjects has weights that aren't numbers."""
    odd = (F.col("window") % 3 == 1) & (F.col("subject") % 2 == 0)
    edges = fc(s, d).withColumn("w", F.when(odd, float("nan")).otherwise(F.col("w")))
    return G.success_rate(G.node_metrics(edges, [*R, "window"], _nodes(s, d)), R, _nodes(s, d))


@query
def odd_success_rate(s, d):
    return r6(_odd_graph_rates(s, d))


@query
def odd_mean_success(s, d):
    return r6(G.mean_success(_odd_graph_rates(s, d)))


@query
def ccm_scores(s, d):
    return r6(N.cross_mapping(X.bursts_wide(s, d), 2, 1), 5)


@query
def ccm_centralities(s, d):
    w = N.cross_mapping_connectivity(X.bursts_wide(s, d), 100.0, 50.0, 60, 2)
    return r6(G.centralities(N.quantile_sparsify(w, 0.5, ["subject"]), ["subject"], nodes=X.bursts_wide(s, d).select("subject", "channel")), 5)


@query
def fragility_heatmap(s, d):
    return r6(G.fragility_heatmap(X.dense_wide(s, d), W, STEP, FS, R), 5)


@query
def mlevc(s, d):
    return r6(G.multilayer_centrality(N.envelope_layers(S.envelope(X.dense_wide(s, d)), W, STEP, run=R), run=R, nodes=_nodes(s, d)), 5)


@query
def mlevc_quantised(s, d):
    return G.quantise(mlevc(s, d), 20.0, R)


@query
def mlevc_consensus(s, d):
    layers = N.coherence_layers(X.dense_wide(s, d), 512.0, W, STEP, 32 / 512.0, run=R)
    return r6(G.consensus(layers, sets=["band"], keys=R, nodes=_nodes(s, d)), 5)


@query
def subject_consensus(s, d):
    """Over all runs and bands of a subject, by the channels that its runs have in common."""
    layers = N.coherence_layers(X.dense_wide(s, d), 512.0, W, STEP, 32 / 512.0, run=R)
    layers, nodes = G.common_channels(layers, _nodes(s, d), ["subject"])
    return r6(G.consensus(layers, couplings=(1, 5, 15), percents=(20, 40), sets=["run", "band"], keys=["subject"], nodes=nodes), 5)


def _known(c: str):
    """NaN as null, which both engines compare alike."""
    return F.when(~F.isnan(c), F.col(c))


@query
def minmax_metrics(s, d):
    return r6(L.minmax_metrics(X.metric_tensor(s, d), ["subject", "metric"]).drop("y").withColumn("value", _known("value")))


@query
def time_bins(s, d):
    return r6(L.time_bins(L.minmax_metrics(X.metric_tensor(s, d), ["subject", "metric"]).drop("y"), 3, ["subject"]))


def _features(s, d):
    b = L.time_bins(L.minmax_metrics(X.metric_tensor(s, d), ["subject", "metric"]), 3, ["subject"])
    return L.feature_vectors(b, 2, 2, ["subject", "channel", "y"])


@query
def feature_vectors(s, d):
    return r6(_features(s, d).select("subject", "channel", "y", F.posexplode("features").alias("k", "value")).withColumn("k", F.col("k").cast("long")))


@query
def normalize_scores(s, d):
    return r6(L.minmax_scores(X.scores(s, d), ["subject"]))


@query
def normalize_scores_odd(s, d):
    """Subjects with NaN, infinite or no other than NaN scores."""
    x = X.odd_scores(s, d)
    return r6(L.minmax_scores(x, ["subject"]).withColumn("score", _known("score")))


@query
def band_power_odd(s, d):
    """Signals in which samples are NaN, in one channel all of them."""
    return r6(S.band_power(X.odd_signals(s, d), R).withColumn("power", _known("power")))


@query
def confusion_metrics(s, d):
    return r6(L.confusion(X.scores(s, d), 2.5, ["subject"]))


@query
def roc_auc(s, d):
    return r6(L.roc_auc(X.scores(s, d), ["subject"]))


@query
def average_precision(s, d):
    return r6(L.average_precision(X.scores(s, d), ["subject"]))


@query
def topk_metrics(s, d):
    return r6(L.topk_metrics(X.scores(s, d), ["subject"]))


@query
def hit_recall_at_k(s, d):
    return r6(L.hit_recall_at_k(X.scores(s, d), ["subject"]))


@query
def summary_metrics(s, d):
    return r6(L.summary(L.confusion(X.scores(s, d), 2.5, ["subject"]), ["acc", "sen", "spec"]))


@query
def subject_mean_score(s, d):
    return r6(L.mean_score(X.scores(s, d).withColumn("channel", F.col("channel") % 5)))


@query
def balanced_sample(s, d):
    return r6(L.undersample(X.scores(s, d), 42, ["subject"], ["channel"]))


@query
def balanced_negatives(s, d):
    return r6(L.undersample(X.scores(s, d), 42, ["subject"], ["channel"], True))


@query
def oversample(s, d):
    return L.oversample(X.scores(s, d), 42, ["subject"], ["channel"]).select("subject", "channel", "y", "copy")


@query
def loso_split(s, d):
    return L.loso_split(X.scores(s, d).select("subject").distinct())


@query
def loso_random_forest(s, d):
    return r6(L.loso(_features(s, d), "forest")["predictions"])


@query
def loso_logreg(s, d):
    return r6(L.loso(_features(s, d), "logistic")["predictions"])


@query
def feature_importance(s, d):
    return r6(L.importance_summary(L.loso(_features(s, d), "forest")["importances"]))


@query
def label_consistency(s, d):
    return L.label_consistency(X.scores(s, d).withColumn("channel", F.col("channel") % 5))


@query
def channel_filter(s, d):
    return C.good_channels(X.channels(s, d)).select("subject", "channel", "name")


@query
def label_assignment(s, d):
    return C.labels(X.channels(s, d))


@query
def soz_first_order(s, d):
    return C.soz_first(C.labels(X.channels(s, d))).select("subject", "name", "place")


@query
def valid_subjects(s, d):
    return r6(C.valid_subjects(X.scores(s, d)))


@query
def union_missing_columns(s, d):
    a = X.scores(s, d)
    return r6(a.where("run = 'en'").select("subject", "channel", "score").unionByName(a.where("run <> 'en'").select("subject", "channel", "run"), allowMissingColumns=True))


@query
def gnn_attention_score(s, d):
    return r6(G.attention_score(X.dense_wide(s, d), run=R), 5)


@query
def gnn_loso_attention(s, d):
    """The graph network trained on the other subjects, and its attention on each subject's channels."""
    wide = X.dense_wide(s, d)
    weights, _ = T.train_attention(wide.withColumn("samples", F.col("samples").cast("array<double>")), 8, 4, 6, epochs=2, rate=1e-3, hidden=8, per_update=1000)
    return r6(G.attention_score(wide, 8, 4, run=R, by_subject=weights), 5)


@query
def filtered_signals(s, d):
    sections = K.butter_sections(512.0, 80.0, 200.0)
    steps = (lambda v: K.notch(v, 512.0), lambda v: K.bandpass(v, 512.0), lambda v: K.sections_both_ways(v, sections), lambda v: K.fft_resample(v, round(len(v) * 500 / 512)))
    w = S.filtered(X.dense_wide(s, d), *steps)
    return r6(X.long_form(w).select(*R, "channel", "sample", "value"), 5)


@query
def signal_round_trip(s, d):
    """Recordings written by subject and run, and read again."""
    path = shared_path(s, "signals")
    sinks.signals(X.dense_wide(s, d), path)
    x = X.long_form(s.read.parquet(path))
    return r6(x.groupBy(F.col("subject").cast("long").alias("subject"), F.col("run").cast("long").alias("run"), "channel").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.max("y").alias("y")))


@query
def csv_round_trip(s, d):
    path = shared_path(s, "scores")
    sinks.report(X.scores(s, d), path)
    return r6(s.read.schema("subject string, run string, channel long, y int, score double").option("header", "true").csv(path))


@query
def log_round_trip(s, d):
    path = shared_path(s, "log")
    sinks.log(L.confusion(X.scores(s, d), 2.5, ["subject"]), path)
    return r6(s.read.schema("subject string, tp long, fp long, fn long, tn long, acc double, sen double, spec double").json(path))


@query
def label_lists(s, d):
    """The onset-zone and resected channels of each subject, through the labels' sink."""
    path = shared_path(s, "labels")
    sinks.labels(C.labels(X.channels(s, d)), path)
    text = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), " ").alias(c)
    return s.read.parquet(path).select("subject", *[text(c) for c in ("soz_channels", "soz_names", "resected_channels", "resected_names")])


@query
def wide_features(s, d):
    x = _features(s, d).select("subject", "channel", F.posexplode(F.slice("features", 1, 4)).alias("k", "value"))
    return r6(sinks.wide_features(x.select("subject", "channel", F.concat(F.lit("f_"), "k").alias("feature"), "value"), [f"f_{k}" for k in range(4)]))


@query
def path_parts(s, d):
    """Subject, run and run number from paths of recordings."""
    p = X._read(s, d, "part").select("p_partkey", "p_size")
    path = F.concat(F.lit("/data/"), F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("HUP"), F.col("p_partkey"), F.lit("_Run_"))).when(F.col("p_size") % 3 == 1, F.concat(F.lit("sub-"), F.col("p_partkey"), F.lit("_task-x_run-"))).otherwise(F.concat(F.lit("rec"), F.col("p_partkey"), F.lit("_run"))), F.col("p_size"), F.lit(".edf"))
    return p.select("p_partkey", readers.subject_of(path).alias("subject"), readers.run_of(path).alias("run"), readers.run_index(path).alias("number"))


@query
def acquisitions(s, d):
    p = X._read(s, d, "part")
    path = F.concat(F.lit("/data/acq-"), F.when(F.col("p_size") % 2 == 0, "SEEG").otherwise("ecog"), F.lit("_run.edf"))
    return p.groupBy(C.acquisition(path).alias("acquisition")).agg(F.count(F.lit(1)).alias("n"))


@query
def fast_enough(s, d):
    """Recordings of subjects whose first run has 500 samples a second."""
    rec = X._read(s, d, "part").select(F.col("p_brand").alias("subject"), F.col("p_partkey").cast("long").alias("run"), F.when(F.col("p_size") % 2 == 0, 512.0).otherwise(256.0).alias("sfreq"))
    return C.fast_enough(rec)


@query
def attached_labels(s, d):
    """Listed channels are labelled, and listed ones that do not exist are ignored."""
    x = X.scores(s, d).select("subject", (F.col("channel") % 7).alias("channel")).distinct()
    listed = X.scores(s, d).where("y = 1").select("subject", (F.col("channel") % 9).alias("channel"))
    return C.attach_labels(x, listed)


@query
def standardised_features(s, d):
    """Subject 0's features by the other subjects' means and deviations."""
    x = _features(s, d)
    out = L.standardise(x.where("subject <> 0"), x.where("subject = 0"), 12)[1]
    return r6(out.select("channel", F.posexplode("features").alias("k", "value")).withColumn("k", F.col("k").cast("long")))


@query
def balanced_rows(s, d):
    """All rows as one training set: as many of each class, by hash order without one big sort."""
    return r6(L.balance_rows(X.scores(s, d), "undersample", 42))


@query
def top_modes(s, d):
    return r6(L.top_modes(L.minmax_metrics(X.metric_tensor(s, d), ["subject", "metric"]).drop("y"), 1).withColumn("value", _known("value")))


@query
def run_scores(s, d):
    """Scores joined to the runs' channels; those without a score have 0."""
    x = X.scores(s, d)
    return r6(L.scores_of_runs(x.select("subject", "run", "channel", "y"), x.where("score >= 1").select("subject", "run", "channel", "score")))


@query
def ranking_metrics(s, d):
    """The unsupervised evaluation: a score column judged as it is."""
    return r6(L.ranking_metrics(X.scores(s, d)))


@query
def run_metrics(s, d):
    return r6(L.with_auc(X.scores(s, d), 2.5, ["subject", "run"]))


# The other modules' queries and their SQL.
QUERIES |= kernel_queries.QUERIES | file_queries.QUERIES
ORACLE |= kernel_queries.ORACLE_KERNELS | file_queries.ORACLE_FILES

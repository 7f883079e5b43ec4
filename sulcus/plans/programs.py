"""Whole programs over files: what a command line starts.  Each reads with `sources`, composes `operators` and writes tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import channels as C
from ..operators import connectivity as N
from ..operators import evaluation as L
from ..operators import events as E
from ..operators import graphs as G
from ..operators import learning as T
from ..operators import signal as S
from ..sources import office, readers, sinks

RUN = ["subject", "run"]
METRICS = ["strength", "degree_std", "eigenvector", "global_efficiency"]


def long_form(wide: DataFrame) -> DataFrame:
    keep = [c for c in wide.columns if c != "samples"]
    return wide.select(*keep, F.posexplode("samples").alias("sample", "value")).withColumn("sample", F.col("sample").cast("long"))


def condition(wide: DataFrame, onsets: DataFrame, sfreq: float, target: float = 500.0, low: float = 80.0, high: float = 200.0, before: float = 50.0, after: float = 50.0) -> DataFrame:
    """Notch, band-pass, resampling, average reference, crop around the onset.  wide: subject, run, channel, samples; onsets: subject, run, onset."""
    w = S.resample(S.bandpass(S.notch(wide, sfreq), sfreq, low, high), sfreq, target).join(onsets, RUN)
    total = w.groupBy(*RUN).agg(F.min(F.size("samples")).alias("_n"))
    first = F.greatest(F.lit(0), F.ceil((F.col("onset") - before) * target)).cast("int")
    last = F.least(F.col("_n") - 1, F.floor((F.col("onset") + after) * target)).cast("int")
    x = long_form(w.join(total, RUN).withColumn("samples", F.slice("samples", first + 1, F.greatest(F.lit(0), last - first + 1))).drop("_n", "onset"))
    return S.average_reference(x, RUN)


def recordings(spark: SparkSession, root: str, least: float = 500.0, **options) -> tuple[DataFrame, DataFrame, list[float]]:
    """EDF files below root with the tables beside them; all but the samples is known from headers alone.

    (channels, status, rates): recording, subject, run, channel, name, sfreq, onset, status_description, samples of the good channels of
    recordings that can be conditioned; path, subject, run, status of every file; and the good channels' sampling rates.
    """
    heads, parts = (readers.edf_parts(spark, root, **o, **options).withColumn("recording", readers.recording_of(F.col("path"))) for o in ({"headers": "true"}, {}))
    facts = heads.groupBy("path", "recording", *RUN).agg(F.max("sfreq").alias("sfreq"), F.max(F.when(F.col("status") != "ok", F.col("status"))).alias("fault"))
    events = readers.tables_beside(spark, root, "events", ["onset"])
    onsets = events.groupBy("recording").agg(F.min_by(F.col("onset").try_cast("double"), "row").alias("onset"), F.lit(True).alias("has_events"))
    described = readers.tables_beside(spark, root, "channels", ["name", "status", "status_description"])
    good = described.where("status = 'good'").select("recording", "name", "status_description").distinct()
    tabled = described.groupBy("recording").agg(F.lit(True).alias("has_channels"))
    matched = heads.where("status = 'ok'").select("recording", "name").distinct().join(good, ["recording", "name"], "left_semi").select("recording").distinct().withColumn("has_good", F.lit(True))
    # The subject's first run decides on its sampling rate.
    fast = C.fast_enough(facts.where("fault IS NULL").select(*RUN, "sfreq"), least).select("subject").distinct().withColumn("fast", F.lit(True))
    known = facts.join(onsets, "recording", "left").join(tabled, "recording", "left").join(matched, "recording", "left").join(fast, "subject", "left")
    status = (
        F.when(F.col("fault").isNotNull(), F.col("fault")).when(F.col("fast").isNull(), f"sampling rate below {least:g} Hz").when(F.col("has_events").isNull(), "no events table")
        .when(F.col("onset").isNull(), "no onset").when(F.col("has_channels").isNull(), "no channels table").when(F.col("has_good").isNull(), "no good channel").otherwise("ok")
    )
    known = known.withColumn("status", status)
    use = known.where("status = 'ok'").select("recording", "onset")
    # Parts of bad channels go before channels are put together.
    some = parts.where("status = 'ok'").drop("status", "path").join(good, ["recording", "name"]).join(use, "recording")
    rates = heads.where("status = 'ok'").join(good, ["recording", "name"], "left_semi").join(use, "recording", "left_semi").select("sfreq").distinct()
    return readers.whole_channels(some), known.select("path", *RUN, "status"), sorted(r["sfreq"] for r in rates.collect())  # a handful


def preprocess(spark: SparkSession, root: str, out: str, target: float = 500.0, least: float = 500.0, before: float = 50.0, after: float = 50.0, low: float = 80.0, high: float = 200.0, mat: bool = False, **options) -> DataFrame:
    """EDF recordings with their events and channel tables to conditioned signals, labels and a status row for every file, below `out`; returns the status.

    With `mat`, signals and labels are written as MAT files too.
    """
    channels, status, rates = recordings(spark, root, least, **options)
    sinks.log(status, f"{out}/status")
    status = spark.read.schema("path string, subject string, run string, status string").json(f"{out}/status")
    for rate in rates:
        some = channels.where(F.col("sfreq") == rate)
        x = condition(some.select(*RUN, "channel", "name", "samples"), some.select(*RUN, "onset").distinct(), rate, target, low, high, before, after)
        wide = (
            x.groupBy(*RUN, "channel", "name")
            .agg(F.array_sort(F.collect_list(F.struct("sample", "value"))).alias("s"))
            .select(*RUN, "channel", "name", F.lit(target).alias("sfreq"), F.col("s.value").alias("samples"))
        )
        sinks.signals(wide, f"{out}/signals/sfreq-{rate:g}")
        if mat:
            office.mat_signals(spark.read.schema("channel long, name string, sfreq double, samples array<double>, subject string, run string").parquet(f"{out}/signals/sfreq-{rate:g}"), f"{out}/mat/sfreq-{rate:g}")
    has = lambda word: F.coalesce(F.contains("status_description", F.lit(word)), F.lit(False)).cast("int")
    said = channels.select("subject", "run", "channel", "name", has("soz").alias("soz"), has("resect").alias("resected"))
    first = said.groupBy("subject").agg(F.min("run").alias("run"))  # a subject's labels are those of its first run
    sinks.labels(said.join(first, ["subject", "run"], "left_semi"), f"{out}/labels")
    if mat:
        office.mat_labels(spark.read.parquet(f"{out}/labels"), f"{out}/mat")
    return status


def graph_features(wide: DataFrame, out: str, width: int = 500, step: int = 50, windows: int = 20, hop: int = 5, modes: int = 10) -> DataFrame:
    """Signals to node metrics of evolution modes: correlation graphs, evolution operators, their modes as graphs.  Writes metrics and a log."""
    began = dt.datetime.now(dt.timezone.utc)
    edges = N.block_correlation(S.array_average_reference(wide.select(*RUN, "channel", "samples"), RUN), width, step, False, RUN)
    nodes = wide.select(*RUN, "channel")
    pairs = N.channel_pairs(nodes, RUN)
    found = G.node_metrics(N.mode_graphs(N.evolution(N.edge_vectors(edges, RUN), windows, hop, modes, RUN), pairs, run=RUN), [*RUN, "op_window", "mode"], nodes)
    sinks.metrics(found, f"{out}/node_metrics")
    done = wide.sparkSession.read.parquet(f"{out}/node_metrics")
    rates = G.success_rate(done, RUN, nodes)
    log = (
        G.mean_success(rates)
        .withColumns({"metrics_computed": F.array(*[F.lit(m) for m in METRICS]), "modes": F.lit(modes), "start_time": F.lit(began.isoformat()), "completion_time": F.lit(dt.datetime.now(dt.timezone.utc).isoformat())})
    )
    sinks.log(log, f"{out}/log")
    return done


def loso_classification(metrics: DataFrame, soz: DataFrame, out: str, bins: int = 6, modes: int = 10, sampling: str = "undersample", cut: float = 0.5, trees: int = 300, depth: int = 20, seed: int = 42, excel: bool = True) -> dict[str, DataFrame]:
    """Node metrics and labels to the tables of a leave-one-subject-out evaluation, as CSV and as a workbook."""
    place = F.array_position(F.array(*[F.lit(m) for m in METRICS]), F.col("metric")) - 1
    x = L.subject_runs(metrics.where(F.col("metric").isin(METRICS)).withColumn("metric", place.cast("long")), soz, bins, modes, len(METRICS))
    some = x.groupBy("subject", "run").agg(F.max("y").alias("y"))
    valid = C.valid_subjects(some).select("subject").distinct()
    if valid.count() < 2:
        raise ValueError("at least two subjects with labelled channels in their first run are needed")
    result = L.loso(x.join(valid, "subject", "left_semi"), "forest", trees, depth, seed, sampling)
    left = x.select("subject").distinct().join(valid, "subject", "left_anti").withColumn("reason", F.lit("no valid labels in the first run"))
    tables = L.loso_tables(result | {"skipped": result["skipped"].unionByName(left)}, cut)
    names = x.sparkSession.createDataFrame(L.feature_names(bins, modes, METRICS), "feature long, bin long, mode long, metric string")
    tables |= {k: tables[k].join(names, "feature") for k in ("feature_importance_by_fold", "feature_importance_mean")}
    sinks.workbook(tables, out)
    if excel:
        names = {"summary_metrics": "summary", "subject_metrics": "subject_metrics", "run_metrics": "run_metrics", "channel_predictions": "channel_predictions", "skipped_subjects": "skipped"}
        office.workbook({sheet: tables[k] for k, sheet in names.items()}, f"{out}/loso_results.xlsx")
    return tables


def _named(x: DataFrame, name: str, index: str | None = None) -> DataFrame:
    """value by channel as (subject, run, channel, feature, value); an index makes the feature's name its own."""
    feature = F.lit(name) if index is None else F.concat(F.lit(f"{name}_"), F.col(index).cast("string"))
    return x.select(*RUN, "channel", feature.alias("feature"), F.col("value").cast("double").alias("value"))


def baseline_features(wide: DataFrame, sfreq: float, method: str, points: int = 1500, onset: float = 50.0) -> DataFrame:
    """One baseline's features in long form: hfo, fdccm, mlevc, consensus (over a subject's runs, whose onset is at `onset` seconds) or fragility."""
    x, nodes = wide.select(*RUN, "channel", "samples"), wide.select(*RUN, "channel")
    if method == "hfo":  # signals are band-passed by now
        least, most, gap = max(round(0.02 * sfreq), round(4 / 200 * sfreq)), round(0.2 * sfreq), round(0.01 * sfreq)
        f = E.features(E.detect_wide(x, sfreq, least, most, gap, ch=[*RUN, "channel"]), sfreq, RUN)
        return _named(f.withColumnRenamed("rate", "value"), "hfo_rate_per_min")
    if method == "fdccm":
        g = N.quantile_sparsify(N.cross_mapping_connectivity(x, sfreq, most=points, run=RUN), 0.9, RUN)
        return G.centralities(g, RUN, nodes=nodes).select(*RUN, "channel", F.col("metric").alias("feature"), "value")
    if method == "mlevc":
        layers = N.envelope_layers(S.envelope(x), round(0.5 * sfreq), round(0.25 * sfreq), run=RUN)
        return _named(G.multilayer_centrality(layers, run=RUN, nodes=nodes), "mlevc", "layer")
    if method == "consensus":
        layers = N.coherence_layers(x, sfreq, round(0.5 * sfreq), round(0.25 * sfreq), onset, run=RUN)
        layers, common = G.common_channels(layers, nodes, ["subject"])
        score = G.consensus(layers, sets=["run", "band"], keys=["subject"], nodes=common)
        return _named(nodes.join(score.withColumnRenamed("score", "value"), ["subject", "channel"]), "mlevc_consensus")
    if method == "fragility":
        return _named(G.fragility_heatmap(x, round(0.25 * sfreq), round(0.125 * sfreq), sfreq, RUN), "fragility", "window")
    raise ValueError(f"no baseline called {method!r}")


def feature_frame(long: DataFrame, runs: DataFrame) -> DataFrame:
    """Long features as one array per channel, by name of feature; what a run lacks is 0."""
    names = sorted((r["feature"] for r in long.select("feature").distinct().collect()), key=lambda n: (n.rstrip("0123456789"), len(n), n))
    place = F.create_map(*[v for k, n in enumerate(names) for v in (F.lit(n), F.lit(k))]) if names else F.create_map()
    got = long.groupBy(*RUN, "channel").agg(F.map_from_entries(F.collect_list(F.struct(place[F.col("feature")].alias("k"), "value"))).alias("m"))
    full = F.transform(F.sequence(F.lit(0), F.lit(max(len(names) - 1, 0))), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0.0)))
    return runs.select(*RUN, "channel", "y").join(got, [*RUN, "channel"], "left").select(*RUN, "channel", "y", full.alias("features"))


def baselines(wide: DataFrame, sfreq: float, out: str, methods: tuple[str, ...] = ("hfo", "fdccm", "mlevc", "fragility"), points: int = 1500, model: str = "forest", onset: float = 50.0) -> DataFrame:
    """Signals with labels (y) to features, predictions, metrics per subject and a summary of each method."""
    means = None
    for m in methods:
        long = baseline_features(wide, sfreq, m, points, onset)
        sinks.features_by_run(long, f"{out}/features/{m}")
        result = L.baseline(feature_frame(long, wide), model)
        sinks.report(result["predictions"], f"{out}/{m}_predictions")
        sinks.report(result["metrics"], f"{out}/{m}_loso_metrics")
        columns = [c for c in result["metrics"].columns if c != "subject"]
        mean = L.summary(result["metrics"], columns).select(F.lit(m).alias("method"), "metric", "mean")
        means = mean if means is None else means.unionByName(mean)
    sinks.log(means, f"{out}/summary_metrics")
    return means


def attention(wide: DataFrame, sfreq: float, out: str, weights: dict | None = None, onset: int = 50, sequence: int = 20, epochs: int = 10, rate: float = 1e-4, hidden: int = 32, seed: int = 0) -> DataFrame:
    """Attention scores of the graph network on whole seconds, with metrics per subject.

    Each subject's network is trained on the other subjects' runs, whose onset lies at segment `onset`; the networks and their losses
    are written too.  weights: those of an earlier run, by subject.
    """
    x = wide.select(*RUN, "channel", "samples")
    if weights is None:
        weights, losses = T.train_attention(x, round(sfreq), sequence, onset, epochs, rate, hidden, seed=seed)
        T.save_weights(wide.sparkSession, weights, f"{out}/weights")
        sinks.report(losses, f"{out}/losses")
    if not weights:
        raise ValueError("networks are trained on other subjects' runs with segments before and after the onset, and there are none")
    score = G.attention_score(x, round(sfreq), sequence, run=RUN, by_subject=weights)
    p = L.scores_of_runs(wide.select(*RUN, "channel", "name", "y"), score)
    sinks.report(p, f"{out}/attention_predictions")
    met = L.ranking_metrics(p)
    sinks.report(met, f"{out}/attention_metrics")
    return met

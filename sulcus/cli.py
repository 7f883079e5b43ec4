"""Command line: python -m sulcus.cli PROGRAM ...; see --help of each."""

from __future__ import annotations

import argparse

from .operators.learning import load_weights
from .plans import programs as P
from .session import session, ship
from .sources import readers


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="sulcus")
    top.add_argument("--master", default="local[*]")
    sub = top.add_subparsers(dest="program", required=True)

    def add(name: str, help: str, *flags: str, **options: tuple) -> argparse.ArgumentParser:
        """A program with flags that are required, and options (name: type and default)."""
        p = sub.add_parser(name, help=help)
        for flag in flags:
            p.add_argument(flag, required=True)
        for name, (kind, default) in options.items():
            p.add_argument("--" + name.replace("_", "-"), type=kind, default=default)
        return p

    files = {"pattern": (str, "*.np[yz]"), "sfreq": (float, None)}
    p = add("preprocess", "EDF recordings to conditioned signals and labels", "--data-dir", "--out-dir", resample=(float, 500.0), before=(float, 50.0), after=(float, 50.0))
    p.add_argument("--mat", action="store_true", help="MAT files too")
    add(
        "graph-features", "signals to node metrics of evolution modes", "--data-dir", "--out-dir",
        participants=(str, None), width=(int, 500), step=(int, 50), windows=(int, 20), hop=(int, 5), modes=(int, 10),
    )
    p = add(
        "loso", "node metrics to a leave-one-subject-out evaluation", "--metrics", "--labels", "--out-dir",
        time_bins=(int, 6), top_modes=(int, 10), threshold=(float, 0.5), trees=(int, 300), depth=(int, 20), seed=(int, 42), max_subjects=(int, None),
    )
    p.add_argument("--sampling", choices=["none", "undersample", "oversample"], default="undersample")
    p.add_argument("--subjects", nargs="+")
    p.add_argument("--no-excel", action="store_true")
    p = add("baselines", "baseline features and their evaluation", "--data-dir", "--out-dir", **files, max_points=(int, 1500), onset=(float, 50.0))
    p.add_argument("--methods", nargs="+", default=["hfo", "fdccm", "mlevc", "fragility"])
    p.add_argument("--model", choices=["forest", "logistic"], default="forest")
    add(
        "attention", "attention scores of graph networks, each trained on the other subjects, or of an earlier run's", "--data-dir", "--out-dir", **files,
        weights=(str, None), onset=(int, 50), sequence=(int, 20), epochs=(int, 10), lr=(float, 1e-4), hidden_dim=(int, 32),
    )
    return top


def main(argv: list[str] | None = None, spark=None) -> None:
    a = parser().parse_args(argv)
    spark = spark or ship(session(a.master))
    if a.program == "preprocess":
        P.preprocess(spark, a.data_dir, a.out_dir, a.resample, before=a.before, after=a.after, mat=a.mat)
    elif a.program == "graph-features":
        wide = spark.read.option("recursiveFileLookup", "false").parquet(a.data_dir)
        if a.participants:
            wide = wide.join(readers.participants(spark, a.participants).selectExpr("participant_id as subject"), "subject", "left_semi")
        P.graph_features(wide, a.out_dir, a.width, a.step, a.windows, a.hop, a.modes)
    elif a.program == "loso":
        found = spark.read.parquet(a.metrics).selectExpr("* except (subject)", "cast(subject as string) as subject")
        soz = spark.read.parquet(a.labels).selectExpr("cast(subject as string) as subject", "explode(soz_channels) as channel")
        chosen = readers.subjects(found, soz, a.subjects)
        if a.max_subjects:
            chosen = chosen.orderBy("subject").limit(a.max_subjects)
        P.loso_classification(found.join(chosen, "subject", "left_semi"), soz, a.out_dir, a.time_bins, a.top_modes, a.sampling, a.threshold, a.trees, a.depth, a.seed, not a.no_excel)
    else:
        wide = readers.dataset(spark, a.data_dir, a.pattern, a.sfreq)
        for rate in sorted(r["sfreq"] for r in wide.select("sfreq").distinct().collect()):  # a handful of rates
            some, out = wide.where(wide.sfreq == rate), f"{a.out_dir}/sfreq-{rate:g}"
            if a.program == "baselines":
                P.baselines(some, rate, out, tuple(a.methods), a.max_points, a.model, a.onset)
            else:
                weights = load_weights(spark, a.weights) if a.weights else None
                P.attention(some, rate, out, weights, a.onset, a.sequence, a.epochs, a.lr, a.hidden_dim)


if __name__ == "__main__":
    main()

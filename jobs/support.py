"""What the jobs share: their config files, their log, and their command lines."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from sulcus.session import session, ship


def defaults(job: str) -> dict:
    """The config file that comes with a job."""
    return json.loads((Path(__file__).parent / f"{job}.json").read_text())


def settings(spark: SparkSession, job: str, path: str | None) -> dict:
    """The job's config, with what the file at path (local or remote) says instead; names that the job doesn't know are an error."""
    known = defaults(job)
    given = json.loads(spark.read.text(path, wholetext=True).first()[0]) if path else {}
    if strange := sorted(set(given) - set(known)):
        raise ValueError(f"{path}: no setting of {job} is called {', '.join(strange)}")
    return known | given


def main(job: str, about: str, inputs: tuple[str, ...], run: Callable[..., DataFrame], argv: list[str] | None = None) -> None:
    """A job's command line: the only place that makes a session and stops it."""
    p = argparse.ArgumentParser(prog=job, description=about)
    for name in inputs:
        p.add_argument(f"--{name}", required=True, help=f"path of the {name}")
    p.add_argument("--out", required=True, help="folder of the output")
    p.add_argument("--config", help=f"JSON file of settings that differ from {job}.json")
    p.add_argument("--master", default="local[*]")
    a = p.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s: %(message)s")
    spark = ship(session(a.master))
    try:
        run(spark, *[getattr(a, name) for name in inputs], a.out, settings(spark, job, a.config))
    finally:
        spark.stop()

"""Session defaults, and shipping of this package to executors."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with this package's defaults; on a cluster take the cluster's own session instead."""
    builder = SparkSession.builder.master(master).config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.config(map=DEFAULTS | conf).getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Give executors this package, once per context: their Python workers import its kernels by name."""
    sc = spark.sparkContext
    if getattr(sc, "_sulcus_shipped", False):
        return spark
    here = Path(__file__).parent
    fd, name = tempfile.mkstemp(prefix="sulcus-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, f"{here.name}/{p.relative_to(here)}")
    sc.addPyFile(name)
    sc._sulcus_shipped = True
    return spark


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir); one machine may do with a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="sulcus-")
    return f"{root.rstrip('/')}/sulcus/{label}-{uuid.uuid4().hex}"

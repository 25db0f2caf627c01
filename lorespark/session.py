"""Session defaults, and shipping the package to executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}

PACKAGE = Path(__file__).resolve().parent


def get_session(app: str = "lorespark", **conf: str) -> SparkSession:
    """A session with this engine's defaults; ``conf`` wins."""
    builder = SparkSession.builder.appName(app)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return ship(builder.getOrCreate())


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share, below the one for checkpoints. Only a local master may do without that setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{(root or tempfile.mkdtemp(prefix='lorespark-')).rstrip('/')}/lorespark-{uuid.uuid4().hex}"


def ship(spark: SparkSession) -> SparkSession:
    """Give Python workers this package where their path does not already hold it."""
    paths = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    sc = spark.sparkContext
    if str(PACKAGE.parent) in paths or getattr(sc, "_lorespark_shipped", False):
        return spark
    out = tempfile.mkdtemp(prefix="lorespark-")  # served to executors for as long as the driver lives
    atexit.register(shutil.rmtree, out, ignore_errors=True)
    shutil.copytree(PACKAGE, Path(out, "stage", PACKAGE.name), ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(str(Path(out, "lorespark_package")), "zip", Path(out, "stage")))
    sc._lorespark_shipped = True
    return spark

"""Makes this package importable in Python workers."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends the package to the executors once per application, so that they need no copy of the repository."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    root = Path(__file__).resolve().parent
    archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='ship-')}/{root.name}", "zip", root.parent, root.name)
    spark.sparkContext.addPyFile(archive)


def checkpointed(df: DataFrame) -> DataFrame:
    """df from a reliable checkpoint in spark.checkpoint.dir; only a local session may go without that setting."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        found = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not found and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(found or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share; only a local session may go without spark.checkpoint.dir."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(found or 'file://' + tempfile.mkdtemp(prefix='files-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"

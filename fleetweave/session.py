"""What a Spark session needs before queries run."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, unless their PYTHONPATH or working folder has it already."""
    context = spark.sparkContext
    places = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()]
    if context.applicationId in _shipped or any(p and Path(p).resolve() == ROOT for p in places):
        return
    folder = tempfile.mkdtemp()  # the driver's; Spark's file server hands the archive out
    context.addPyFile(shutil.make_archive(f"{folder}/fleetweave", "zip", ROOT, "fleetweave"))
    _shipped.add(context.applicationId)


def cut(df: DataFrame) -> DataFrame:
    """The table, written to the shared folder of spark.checkpoint.dir, so that loops keep a short lineage.

    Where that setting is absent (as in tests) a local folder serves, which is right on one machine only.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("on a cluster spark.checkpoint.dir must name a shared folder")
            folder = "file://" + tempfile.mkdtemp(prefix="fleetweave-")
        context.setCheckpointDir(folder)
    return df.checkpoint()


def spread(df: DataFrame, key: str, rows: int | None = None, each: int = 20_000) -> DataFrame:
    """The rows in parts of about ``each``, by their key, where a small file holds many: a task that reads it alone takes
    as long and as much memory as the file has rows. ``rows`` are counted if they aren't told; columnar files say them."""
    n = df.count() if rows is None else rows
    parts = max(-(-n // each), min(n // 1_000, df.sparkSession.sparkContext.defaultParallelism))
    return df.repartition(parts, key) if parts > 1 else df


def few(df: DataFrame, most: int = 100_000) -> DataFrame:
    """The table, marked to be broadcast if it has ``most`` rows or fewer. They are counted, so it should be a written one:
    of such tables the optimiser doesn't know how small they are, and would move the larger side by the join's key."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df

"""Session settings and table access shared by every module."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str | None = None, app: str = "skein", **conf: str) -> SparkSession:
    """A session with AQE on, UTC and as many shuffle partitions as local cores by default."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master or "SPARK_MASTER" not in os.environ:
        b = b.master(master or f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
    for k, v in conf.items():
        b = b.config(k, v)
    return settle(b.getOrCreate())


def settle(spark: SparkSession) -> SparkSession:
    """Settings without which results can be wrong on the pinned Spark version, and a bound on what goes to Python at once.

    4.1 lets a union of equally partitioned inputs stand for a partitioning it doesn't have once stages are re-planned at
    run time, and a window or aggregation above it then sees parts of its groups. The README has the case.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    # whole texts go to Python: 10,000 a batch would be held several times over, in the JVM and the worker
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    return spark


def ship(spark: SparkSession) -> None:
    """Hand this package to the executors once a context, for clusters and callers where they can't import it."""
    import atexit
    import shutil
    import tempfile
    from pathlib import Path

    settle(spark)
    sc = spark.sparkContext
    if getattr(ship, "done", None) != sc.applicationId:
        here = Path(__file__).resolve().parent
        tmp = tempfile.mkdtemp(prefix="skein-ship-")  # the driver serves it to the executors as long as it runs
        atexit.register(shutil.rmtree, tmp, ignore_errors=True)
        copy = Path(tmp, "tree", here.name)
        shutil.copytree(here, copy, ignore=shutil.ignore_patterns("__pycache__"))
        sc.addPyFile(shutil.make_archive(f"{tmp}/{here.name}", "zip", copy.parent))
        ship.done = sc.applicationId


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named table of a data folder, as a lazy Parquet scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

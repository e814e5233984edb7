"""Session helpers: local builder, shared folder, lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A written table of more rows is joined by shuffles only.
BROADCAST_ROWS = 100_000


def build_session(app: str = "inkgrid", cores: str = "*", **conf: str) -> SparkSession:
    """A local session for tests and benches; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", os.environ.get("INKGRID_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_LOCAL_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach.

    A cluster names it in ``spark.checkpoint.dir``.  Only a local master, where
    driver and executors share one disk, falls back to a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    if sc.applicationId not in _LOCAL_DIRS:
        _LOCAL_DIRS[sc.applicationId] = tempfile.mkdtemp(prefix="inkgrid-")
    return _LOCAL_DIRS[sc.applicationId]


def run_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder below the shared one for written intermediate tables."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` is not sent whole to the driver and every task by a join.

    Spark estimates rows from the size of compressed files and does not see that an
    explode makes more of them, so a table with a row per outline can look small.
    """
    return df.hint("merge")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a loop state as a table in the shared folder and read it back.

    Lost executors only re-read files.  A written table also has its real size:
    a checkpointed frame keeps the size estimate of the plan it came from, which
    multiplies with every join of a loop until planning stands still.  Files are
    smaller than their rows in memory, so the rows decide whether joins may broadcast it.
    """
    folder, seen = run_dir(df.sparkSession, "cut"), Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(folder)
    table = df.sparkSession.read.schema(df.schema).parquet(folder)
    return shuffled(table) if seen.get["rows"] > BROADCAST_ROWS else table

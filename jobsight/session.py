"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks. On a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("jobsight")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder every executor can reach.

    The cluster names the parent in ``spark.checkpoint.dir``. Only a local
    session may fall back to a temporary folder of this machine.
    """
    parent = spark.conf.get("spark.checkpoint.dir", None)
    if parent is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        parent = tempfile.mkdtemp(prefix="jobsight-")
    return os.path.join(parent, f"{purpose}-{uuid.uuid4().hex}") if "://" not in parent else (
        f"{parent.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    )


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write an intermediate table to the shared folder once and read it from there.

    For results that several branches of a plan need: they are computed once,
    and a lost executor costs no more than a re-read.
    """
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Generated methods above 8000 bytes are never compiled by the JVM, so a wide projection runs many times faster as
# split expressions than inside one huge whole-stage method.
RUNTIME_SETTINGS = {"spark.sql.session.timeZone": "UTC", "spark.sql.codegen.hugeMethodLimit": "8000"}


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, since some jobs run its functions there."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="jobsight-")) / "jobsight.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


def prepare(spark: SparkSession) -> None:
    """Settings the jobs rely on: timestamps of the telemetry are UTC, wide projections stay compilable."""
    for key, value in RUNTIME_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    ship_package(spark)

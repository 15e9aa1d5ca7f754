"""Session helpers: configuration for local runs, and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "tidemark") -> SparkSession:
    """A session for tests and benchmarks; a cluster supplies its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


@cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="tidemark-")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Without that setting only a session in one process (a local test) gets a temporary folder: on a cluster each executor
    would write to its own disk.
    """
    if shared := spark.conf.get("spark.checkpoint.dir", None):
        return shared
    master = spark.conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _local_folder()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write an intermediate that several steps read to a table in the shared folder, and read it back.

    Unlike an RDD checkpoint the table is columnar and has a known size, so later steps read only the columns they
    need and join it by broadcast when it is small. It survives the loss of executors.
    """
    path = f"{checkpoint_root(df.sparkSession)}/tidemark/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

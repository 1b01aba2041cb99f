"""Written intermediates, broadcasts of a checked size, and named steps of a job."""

from __future__ import annotations

import contextlib
import logging
import tempfile
import time
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger("gramframe")
#: Rows up to which a side of a join may be broadcast, of at most some hundred bytes a row.
BROADCAST_ROWS = 100_000
_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local session gets a folder of its own; a cluster has to set it."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        _own[:] = _own or ["file://" + tempfile.mkdtemp(prefix="gramframe-")]
        at = _own[0]
    return at.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here, and a lost executor costs nothing that is written.

    The shuffle files of the job that writes it are removed when it ends, where Spark can do so.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint at a broadcast of a written table if it is small enough, counted here from its footers; else leave Spark to shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


def spread(df: DataFrame) -> DataFrame:
    """df dealt to all cores where its scan has fewer splits than there are cores, as a file of one row group has; large tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


@contextlib.contextmanager
def task(spark: SparkSession, name: str) -> Iterator[None]:
    """Name the jobs of a block, and log how long it took."""
    began = time.time()
    spark.sparkContext.setJobDescription(name)
    log.info("%s begins", name)
    try:
        yield
    finally:
        spark.sparkContext.setJobDescription(None)
        log.info("%s took %.1f s", name, time.time() - began)

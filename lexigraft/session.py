"""Size limits and intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Limits:
    """Sizes up to which the cheaper physical form of an operator is used.

    Beyond each of them the operator switches to a form whose tasks stay
    bounded; results are the same on both sides of the limit.
    """

    broadcast_rows: int = 1_000_000
    broadcast_bytes: int = 64 << 20
    window_rows: int = 2_000_000
    cell_rows: int = 4096
    salts: int = 16
    fold_rows: int = 256
    product_bytes: int = 32 << 20


DEFAULT_LIMITS = Limits()

_local_scratch: str | None = None


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables, taken from ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a temporary folder.
    """
    global _local_scratch
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return f"{configured.rstrip('/')}/lexigraft"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    if _local_scratch is None:
        _local_scratch = tempfile.mkdtemp(prefix="lexigraft-")
        atexit.register(shutil.rmtree, _local_scratch, ignore_errors=True)
    return _local_scratch


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and continue from the written table.

    Used where several branches read the same result: lineage is cut, a lost
    executor costs no recomputation, and the planner sees real sizes.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread_small(df: DataFrame) -> DataFrame:
    """Spreads a scanned table over all cores if it has fewer splits than cores.

    A small file can be one row group, which is one task. Inputs with enough
    splits, as all large ones have, are left where they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def per_name(df: DataFrame) -> DataFrame:
    """Marks a table with one short row per vocabulary, language, pair or matrix.

    Such tables are as long as the list of names a job is given. They are sent
    to all tasks: joined by shuffle, a key with so few values would put a whole
    vocabulary or corpus into one task.
    """
    return F.broadcast(df)

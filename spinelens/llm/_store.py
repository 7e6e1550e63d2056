"""Where intermediate tables live: the cluster's shared checkpoint folder."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named by ``spark.checkpoint.dir``; only a session without one gets its own.

    The fallback lies below the warehouse, which driver and executors share.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current is None:
        sc.setCheckpointDir(named or spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints")


def settle(df: DataFrame) -> DataFrame:
    """Compute a narrow table once and cut its lineage with a reliable checkpoint."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of a narrow table per partition at least; with fewer, the tables made from it are many nearly empty files.
PARTITION_ROWS = 250_000


def settle_few(df: DataFrame) -> DataFrame:
    """``settle`` for tables of a few numbers a row: read again in no more partitions than the rows need."""
    out = settle(df)
    return out.coalesce(max(1, -(-out.count() // PARTITION_ROWS)))


def stored(df: DataFrame, name: str) -> DataFrame:
    """A wide table, written once to the shared checkpoint folder as compressed columns."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def importable(spark: SparkSession) -> None:
    """Let Python workers that find this library on the driver's path import it too."""
    root = str(Path(__file__).resolve().parents[2])
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, root])


#: Rows of a settled table of a few fixed-width columns up to which it is broadcast (tens of MB).
BROADCAST_ROWS = 500_000


def sized(small: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``small``, to be broadcast if its counted rows stay within the limit, else to be shuffled.

    Count a settled table: the check then reads the checkpoint only.
    """
    return F.broadcast(small) if small.limit(limit + 1).count() <= limit else small

"""Lineage cuts for plans in rounds: tables in the folder that ``spark.checkpoint.dir`` names, or few rows at the driver."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: So many rows of a small table may wait at the driver between rounds; larger ones are written.
FEW_ROWS = 10_000


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder that the driver and all executors share; only a local master, whose tasks use the driver's disk, may go without the setting."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tremorlake-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/tremorlake-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The table, written once and read back, so that later plans start from it and lost executors cost no recomputation."""
    path = shared_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(df: DataFrame) -> DataFrame:
    """The table, computed now: at the driver when it has few rows, else written."""
    few = df.limit(FEW_ROWS + 1).collect()
    return written(df) if len(few) > FEW_ROWS else df.sparkSession.createDataFrame(few, df.schema)


#: Rows of a table dealt by key that a task gets, about.
TASK_ROWS = 250_000


def by_key(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt by the hash of the keys over so many partitions that tasks keep their size as the table grows (a count says how many).

    Windows, groups and joins on these keys and others besides need no further shuffle.
    """
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // TASK_ROWS))
    return rows.repartition(parts, *keys)


#: At most so many bytes go to a Python worker at once, unless the session has a limit of its own.
BATCH_BYTES, _BATCH_LIMIT = 32 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(df: DataFrame) -> DataFrame:
    if df.sparkSession.conf.get(_BATCH_LIMIT, None) is None:
        df.sparkSession.conf.set(_BATCH_LIMIT, str(BATCH_BYTES))
    return df

"""Intermediate tables in the folder all executors share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

from newsweft.lineage import shared_dir

_ROOTS: dict[str, str] = {}
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
ROWS_PER_BATCH = 1000  # whole texts can be long; a Python worker holds few of them at once


def _root(spark: SparkSession) -> str:
    base = shared_dir(spark)
    if base not in _ROOTS:
        _ROOTS[base] = f"{base}/newsweft-llm-{uuid.uuid4().hex[:12]}"
        atexit.register(_remove, spark, _ROOTS[base])
    return _ROOTS[base]


def _remove(spark: SparkSession, path: str) -> None:
    """Results are lazy and read these tables, so they go when the program ends."""
    context = spark.sparkContext
    if context._jsc is None:
        return
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, and safe from lost executors."""
    spark = df.sparkSession
    path = f"{_root(spark)}/{name}-{uuid.uuid4().hex[:8]}"
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, ROWS_PER_BATCH)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(BATCH, before)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores after it until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name

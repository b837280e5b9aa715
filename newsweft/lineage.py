"""Materialising intermediate tables so that iterative plans stay short and survive executor loss."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    A machine-local folder is only ever used when the session itself runs in local mode.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    made = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


class Scratch:
    """Parquet tables under the shared folder, one sub-folder per instance.

    ``put`` writes a DataFrame and returns it read back, which cuts the lineage and gives the
    optimizer exact sizes for the joins that follow. ``drop`` takes what ``put`` returned and deletes
    its table. ``close`` deletes all of them but ``keep``; whatever is left goes when the program ends,
    as results are lazy and may read these tables until then.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/newsweft/{name}-{uuid.uuid4().hex[:12]}"
        self._tables: list[tuple[DataFrame, str]] = []
        self._n = 0
        atexit.register(self._end)

    def put(self, df: DataFrame) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n:05d}"
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._tables.append((out, path))
        return out

    def drop(self, table: DataFrame) -> None:
        mine = [path for df, path in self._tables if df is table]
        if not mine:
            raise ValueError("not a table that put() returned, or dropped before")
        self._tables = [(df, path) for df, path in self._tables if df is not table]
        delete(self.spark, mine[0])

    def close(self, *keep: DataFrame) -> None:
        for df, _ in list(self._tables):
            if not any(df is k for k in keep):
                self.drop(df)
        if not self._tables:
            delete(self.spark, self.root)

    def _end(self) -> None:
        if self.spark.sparkContext._jsc is not None:
            delete(self.spark, self.root)


def delete(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` as a URI of the file system that Spark reads it from."""
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    uri = target.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(target).toString()
    scheme, _, rest = uri.partition(":")
    return uri if rest.startswith("//") else f"{scheme}://{rest}"


def exists(spark: SparkSession, path: str) -> bool:
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(context._jsc.hadoopConfiguration()).exists(target)

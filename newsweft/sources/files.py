"""Briefing documents and stored graphs read from files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsweft.functions.concepts import assign_category
from newsweft.lineage import Scratch, qualified
from newsweft.schemas import EDGE_SOURCES, EDGES, NODES
from newsweft.sources.json_elements import BATCH_ROWS, RANGE_BYTES, few_tasks, json_elements


def _empty_files(spark: SparkSession, path: str, nested: bool) -> DataFrame:
    """``(name)`` of the Markdown files without a byte, which Spark's readers leave out; one task lists the folder."""

    def listed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for frame in frames:
            for uri in frame["uri"]:
                store, base = fs.FileSystem.from_uri(uri)
                below = len(base.rstrip("/")) + 1
                found = (f for f in store.get_file_info(fs.FileSelector(base, recursive=nested)) if f.size == 0)
                seen = (f for f in found if not any(p.startswith((".", "_")) for p in f.path[below:].split("/")))
                names = [f.base_name for f in seen if f.is_file and f.base_name.endswith(".md")]
                for i in range(0, len(names), BATCH_ROWS):
                    yield pd.DataFrame({"name": names[i : i + BATCH_ROWS]}, dtype=object)

    return spark.createDataFrame([(qualified(spark, path),)], "uri string").mapInPandas(listed, "name string")


def read_briefings(spark: SparkSession, path: str, *, nested: bool = False) -> DataFrame:
    """Every Markdown file of a folder, and of the folders in it if ``nested``, dated by its name.

    Files are many and small: whole contents open faster than text, and the tasks of 32 files that
    Spark would start are put together. Empty files are found by their sizes.
    """
    found = spark.read.option("pathGlobFilter", "*.md").option("recursiveFileLookup", nested)
    held = few_tasks(found.format("binaryFile").load(path)).select(
        F.col("_metadata.file_name").alias("name"), F.col("content").cast("string").alias("md")
    )
    return (
        held.unionByName(_empty_files(spark, path, nested).withColumn("md", F.lit("")))
        .select(F.regexp_replace("name", r"\.md\z", "").alias("stem"), "md")
        .select(F.expr("try_cast(stem AS date)").alias("briefing_date"), "md")
    )


def _stored_time(c):
    return F.expr(f"try_cast({c} AS timestamp)")


_ELEMENT = (
    "id string, source string, target string, relationship_type string, first_seen string, last_seen string, "
    "encounter_count bigint, familiarity double, category string, interest_score double, interest_count bigint, "
    "source_articles array<string>"
)


def read_graph_json(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> tuple[DataFrame, DataFrame]:
    """Node-link JSON; nodes without a category get one from their name.

    A file is read in ranges by as many tasks; an element with an ``id`` is a node, one with
    ``source`` and ``target`` a link. Elements are parsed and written once, for both.
    """
    found = json_elements(spark, path, range_bytes).select(F.from_json("element", _ELEMENT).alias("e")).select("e.*")
    found = Scratch(spark, "elements").put(found)
    nodes = found.filter("id is not null").select(
        F.col("id").alias("concept"),
        _stored_time("first_seen").alias("first_seen"),
        _stored_time("last_seen").alias("last_seen"),
        "encounter_count",
        "familiarity",
        F.coalesce("category", assign_category(F.col("id"))).alias("category"),
        "interest_score",
        "interest_count",
    )
    edges = found.filter("id is null and source is not null and target is not null").select(
        F.least("source", "target").alias("a"),
        F.greatest("source", "target").alias("b"),
        "relationship_type",
        _stored_time("first_seen").alias("first_seen"),
        "source_articles",
    )
    return nodes, edges


def edge_sources_of(edges: DataFrame) -> DataFrame:
    """``(a, b, url, seq)``: the article lists of an imported graph as rows, in their order."""
    return edges.select("a", "b", F.posexplode("source_articles").alias("seq", "url")).select(
        "a", "b", "url", F.col("seq").cast("long").alias("seq")
    )


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and the articles of each edge."""
    return (
        spark.read.schema(NODES).parquet(f"{path}/nodes"),
        spark.read.schema(EDGES).parquet(f"{path}/edges"),
        spark.read.schema(EDGE_SOURCES).parquet(f"{path}/edge_sources"),
    )


def write_graph(nodes: DataFrame, edges: DataFrame, edge_sources: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")
    edge_sources.select("a", "b", "url", "seq").write.mode("overwrite").parquet(f"{path}/edge_sources")

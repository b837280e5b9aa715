"""Stage outputs of a run kept as tables, and where to resume."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

# Stages in running order.
STAGES = (
    "ingest_feedback", "discover", "dedup", "filter", "swap_to_reader", "deep_read", "novelty",
    "graph_update", "briefing",
)


class StageStore:
    """Tables under ``root/run_id=…/stage=…/try=…/name=…``.

    A stage counts as finished when its marker is there. The marker names the try that wrote the
    tables, and their schemas; it is written aside and renamed, so it is whole or absent. Tables of a
    try that broke off are never read.
    """

    def __init__(self, spark: SparkSession, root: str, run_id: str) -> None:
        self.spark = spark
        self.run_id = run_id
        self.base = f"{root}/run_id={run_id}"

    def _stage(self, stage: str) -> str:
        if stage not in STAGES:
            raise ValueError(f"unknown stage {stage}")
        return f"{self.base}/stage={stage}"

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def write_stage(self, stage: str, **tables: DataFrame) -> dict[str, DataFrame]:
        """Write the outputs of a stage, mark it as finished and return them read back."""
        folder = f"{self._stage(stage)}/try={uuid.uuid4().hex[:12]}"
        for name, df in tables.items():
            df.write.parquet(f"{folder}/name={name}")
        about = {"folder": folder, "tables": {name: df.schema.json() for name, df in tables.items()}}
        self._mark(stage, json.dumps(about))
        return self.load_stage(stage)

    def _mark(self, stage: str, text: str) -> None:
        aside, fs = self._fs(f"{self._stage(stage)}/.{uuid.uuid4().hex}")
        out = fs.create(aside, True)
        out.write(bytearray(text.encode()))
        out.close()
        marker, _ = self._fs(f"{self._stage(stage)}/_DONE")
        fs.delete(marker, False)
        if not fs.rename(aside, marker):
            raise OSError(f"cannot mark stage {stage}")

    def _marker(self, stage: str) -> dict | None:
        marker, fs = self._fs(f"{self._stage(stage)}/_DONE")
        if not fs.exists(marker):
            return None
        lines = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils
        stream = fs.open(marker)
        text = lines.toString(stream, "UTF-8")
        stream.close()
        return json.loads(text)

    def finished(self) -> list[str]:
        """The finished stages, in running order."""
        return [stage for stage in STAGES if self._marker(stage) is not None]

    def resume_from(self) -> str | None:
        """The stage after the last finished one; None when all are done."""
        done = self.finished()
        after = STAGES.index(done[-1]) + 1 if done else 0
        return STAGES[after] if after < len(STAGES) else None

    def load_stage(self, stage: str) -> dict[str, DataFrame]:
        about = self._marker(stage)
        if about is None:
            raise ValueError(f"stage {stage} is not finished")
        read = lambda name, schema: self.spark.read.schema(StructType.fromJson(json.loads(schema))).parquet(
            f"{about['folder']}/name={name}"
        )
        return {name: read(name, schema) for name, schema in about["tables"].items()}

    def load(self) -> dict[str, DataFrame]:
        """All finished outputs; a later stage's table replaces an earlier one of the same name."""
        merged: dict[str, DataFrame] = {}
        for stage in self.finished():
            merged |= self.load_stage(stage)
        return merged

    def clear(self) -> None:
        p, fs = self._fs(self.base)
        fs.delete(p, True)

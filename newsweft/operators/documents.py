"""Writing rendered documents as files, one per row, in two phases."""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from newsweft.lineage import Scratch, qualified
from newsweft.operators.skew import number_rows

FORMAT = "newsweft_documents"


@dataclass
class _Written(WriterCommitMessage):
    task: str


def _inside(path: str | None) -> str:
    """``path`` if it names a file below the root."""
    clean = posixpath.normpath(path or ".")
    if clean.startswith(("/", "..")) or clean == ".":
        raise ValueError(f"not a path below the root: {path}")
    return clean


class _DocumentWriter(DataSourceArrowWriter):
    """Tasks write under a folder of the job and list what belongs where; the commit moves the files of
    the tasks that count, the abort removes the folder. A task that fails leaves nothing in place.

    The folder is there before the tasks are, and the abort first takes it out of their way: a task
    that is still at work then finds no place to write to, and brings no folder back.
    """

    def __init__(self, root: str) -> None:
        self.root = root
        self.stage = f".writing-{uuid.uuid4().hex}"

    def _store(self):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(self.root)
        return store, base.rstrip("/")

    def begin(self) -> None:
        store, base = self._store()
        store.create_dir(f"{base}/{self.stage}", recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, base = self._store()
        task = uuid.uuid4().hex
        folder, n = f"{base}/{self.stage}/{task}", 0
        store.create_dir(folder, recursive=False)
        with store.open_output_stream(f"{folder}/list") as listed:
            for batch in iterator:
                for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                    with store.open_output_stream(f"{folder}/{n}") as out:
                        out.write((content or "").encode("utf-8"))
                    listed.write((json.dumps([n, _inside(path)]) + "\n").encode())
                    n += 1
        return _Written(task)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, base = self._store()
        made: set[str] = set()
        for message in messages:
            if message is None:
                continue
            folder = f"{base}/{self.stage}/{message.task}"
            with store.open_input_stream(f"{folder}/list") as listed, pa.PythonFile(listed, "r") as lines:
                for line in _lines(lines):
                    n, path = json.loads(line)
                    parent = posixpath.dirname(f"{base}/{path}")
                    if parent not in made:
                        store.create_dir(parent, recursive=True)
                        made.add(parent)
                    store.move(f"{folder}/{n}", f"{base}/{path}")
        self._clean(store, base)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clean(*self._store())

    def _clean(self, store, base: str) -> None:
        from pyarrow import fs

        if store.get_file_info(f"{base}/{self.stage}").type != fs.FileType.NotFound:
            store.move(f"{base}/{self.stage}", f"{base}/{self.stage}-ended")
            store.delete_dir(f"{base}/{self.stage}-ended")


def _lines(stream, block: int = 1 << 20) -> Iterator[bytes]:
    rest = b""
    while data := stream.read(block):
        *whole, rest = (rest + data).split(b"\n")
        yield from whole
    if rest:
        yield rest


class DocumentSink(DataSource):
    """``df.write.format("newsweft_documents").mode("append").save(folder)`` for ``df(path, content)``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> _DocumentWriter:
        if overwrite:
            raise ValueError("documents are added to a folder; use append")
        made = _DocumentWriter(self.options["path"])
        made.begin()
        return made


def apart(df: DataFrame) -> DataFrame:
    """``(path, content)`` rows with a path each: of those that share one, the second goes to a folder ``again-2``, and so on.

    ``write_documents`` would leave one file of them. Only paths are counted for all rows; contents
    are moved where a path comes again.
    """
    again = Scratch(df.sparkSession, "paths").put(df.groupBy("path").count().filter(F.col("count") > 1).select("path"))
    if again.isEmpty():
        return df
    shared = number_rows(df.join(again, "path", "left_semi"), ["path"], [F.col("content")], "n")
    own = F.when(F.col("n") == 1, F.col("path")).otherwise(F.concat(F.lit("again-"), "n", F.lit("/"), "path"))
    return df.join(again, "path", "left_anti").unionByName(shared.select(own.alias("path"), "content"))


def write_documents(df: DataFrame, root: str) -> None:
    """Write each ``(path, content)`` row to ``root/path``, all of them or none.

    A folder without a scheme is looked up in the session's default file system, where Spark's readers
    look too. For very many documents a Parquet table of (path, content) is the better form.
    """
    spark = df.sparkSession
    spark.dataSource.register(DocumentSink)
    rows = df.selectExpr("cast(path AS string) AS path", "cast(content AS string) AS content")
    rows.write.format(FORMAT).mode("append").save(qualified(spark, root))

"""Elements of the arrays of one large JSON document, read by many tasks.

A task reads one range of bytes. Where it starts, it cannot tell whether it stands in a string, nor how
deep: so a first pass sums up each range for both cases (how many quotes, and how much deeper it ends),
the sums of the ranges are put together in order (a row for each range), and a second pass reads the
elements that begin in each range. A task holds one range and the element that it ends in.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsweft.lineage import Scratch, qualified

RANGE_BYTES = 32 << 20
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
ELEMENT_DEPTH = 2  # within the document and an array of it
_ESCAPED = re.compile(rb"\\.", re.DOTALL)
_OTHERS = bytes(sorted(set(range(256)) - set(b'"{}[]')))
_TOKEN = re.compile(rb'"(?:[^"\\]|\\.)*+"|[{}\[\]]', re.DOTALL)
_STRING_END = re.compile(rb'(?:[^"\\]|\\.)*+"', re.DOTALL)


def _open(uri: str):
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


def _begin(file, start: int) -> int:
    """``start``, or the place after it if the byte there is escaped by what stands before."""
    back, run = start, 0
    while back:
        step = min(back, 64)
        file.seek(back - step)
        data = file.read(step)
        run += len(data) - len(data.rstrip(b"\\"))
        if data.strip(b"\\"):
            break
        back -= step
    return start + run % 2


def _range(file, start: int, end: int) -> tuple[int, bytes]:
    begin, stop = _begin(file, start), _begin(file, end)
    file.seek(begin)
    return begin, file.read(max(0, stop - begin))


def summed(data: bytes) -> tuple[int, int, int]:
    """Quotes, and how much deeper the range ends if it starts outside or inside a string."""
    parts = _ESCAPED.sub(b"", data).translate(None, _OTHERS).split(b'"')
    deeper = lambda some: sum(p.count(b"{") + p.count(b"[") - p.count(b"}") - p.count(b"]") for p in some)
    return len(parts) - 1, deeper(parts[0::2]), deeper(parts[1::2])


def elements(file, start: int, end: int, inside: bool, depth: int, block: int = 1 << 20) -> Iterator[bytes]:
    """The objects at ``ELEMENT_DEPTH`` that begin in the range, each read to its end."""
    begin, data = _range(file, start, end)
    limit, at, opened = len(data), 0, None

    def more() -> bool:
        nonlocal data
        file.seek(begin + len(data))
        new = file.read(block)
        data += new
        return bool(new)

    if inside:
        found = _STRING_END.match(data)
        if found is None:
            return  # the whole range lies in one string
        at = found.end()
    while True:
        found = _TOKEN.search(data, at)
        quote = data.find(b'"', at)
        if found is None or (0 <= quote < found.start()):
            # nothing whole is left: a string may be cut, or an element is open
            if (opened is not None or 0 <= quote < limit) and more():
                continue
            return
        token, place = found.group()[:1], found.start()
        if opened is None and place >= limit:
            return
        at = found.end()
        if token in b"{[":
            if token == b"{" and depth == ELEMENT_DEPTH:
                opened = place
            depth += 1
        elif token in b"}]":
            depth -= 1
            if opened is not None and depth == ELEMENT_DEPTH:
                yield data[opened:at]
                opened = None


def _frame(files: list[str], held: list[str]) -> pd.DataFrame:
    return pd.DataFrame({"file": files, "element": held}, dtype=object)


def few_tasks(files: DataFrame) -> DataFrame:
    """A folder of very many small files in a bounded number of tasks."""
    return files.coalesce(32 * files.sparkSession.sparkContext.defaultParallelism)


def json_elements(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``(file, element)``: each object in an array of the document, as its text. ``path`` is a file or a folder of files.

    The list of files is a table; only files of several ranges, which are few, are known to the driver.
    """
    found = few_tasks(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(qualified(spark, path)))
    files = Scratch(spark, "files").put(
        found.select(F.regexp_replace("path", r"^(\w+):/(?!/)", "$1:///").alias("file"), "length")
    )
    size = files.agg(F.sum("length")).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, -(-size // RANGE_BYTES))
    ranges = [
        (f.file, s, min(f.length, s + range_bytes))
        for f in sorted(files.filter(F.col("length") > range_bytes).collect())
        for s in range(0, f.length, range_bytes)
    ]
    deal = lambda rows, n: rows.repartition(n, "file", "first")
    spread = lambda rows, ddl: deal(spark.createDataFrame(rows, ddl), min(len(rows), tasks))

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file, first, last in zip(frame["file"], frame["first"], frame["last"]):
                with _open(file) as opened:
                    out = summed(_range(opened, first, last)[1])
                yield pd.DataFrame([(file, first, last, *out)], columns=["file", "first", "last", "quotes", "outside", "inside"])

    ddl = "file string, first long, last long"
    found = spread(ranges, ddl).mapInPandas(sums, f"{ddl}, quotes long, outside long, inside long").collect() if ranges else []
    at: dict[str, tuple[bool, int]] = {}
    starts = []
    for r in sorted(found):
        inside, depth = at.get(r.file, (False, 0))
        starts.append((r.file, r.first, r.last, inside, depth))
        at[r.file] = (inside ^ bool(r.quotes % 2), depth + (r.inside if inside else r.outside))

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names: list[str] = []
        held: list[str] = []
        size = 0
        for frame in frames:
            for file, first, last, inside, depth in zip(*(frame[c] for c in ("file", "first", "last", "inside", "depth"))):
                with _open(file) as opened:
                    for element in elements(opened, first, last, bool(inside), depth):
                        names.append(file)
                        held.append(element.decode("utf-8", "replace"))
                        size += len(element)
                        if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
                            yield _frame(names, held)
                            names, held, size = [], [], 0
        if held:
            yield _frame(names, held)

    # files of one range start where every document does
    whole = files.filter((F.col("length") > 0) & (F.col("length") <= range_bytes)).select(
        "file", F.lit(0).cast("long").alias("first"), F.col("length").alias("last"), F.lit(False).alias("inside"), F.lit(0).alias("depth")
    )
    begin = whole.unionByName(spark.createDataFrame(starts, f"{ddl}, inside boolean, depth int"))
    return deal(begin, tasks).mapInPandas(read, "file string, element string")

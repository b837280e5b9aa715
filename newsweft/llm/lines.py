"""Line dedup that can be taken back: sharded cuckoo filters over exact reference counts.

``LineIndex`` keeps, for each line key, the exact number of documents that hold it, and for each shard
of the key space a cuckoo filter of the keys that enough documents hold. Documents are inserted and
deleted in sets. Both change the counts, and only keys that cross the threshold are put into their
shard's filter or taken out of it, so deleting what was inserted brings back the index as it was.

``LineIndex.drop_lines`` sends the keys of each document to their shard, lets the filter pass what may
be listed, and confirms what passed on the exact counts; so the answer is exact. A shard's filter is
the head of each of ``SALTS`` partitions of its keys, as a license line can stand in a third of all
documents. A task holds one filter and one batch of keys. Texts are shuffled once, to meet the keys
that they lose.

A key is a line without white space at its ends, A-Z lower-cased, as a 128-bit hash. Keys without a
code point are never dropped. Every row is a document: rows with the same doc_id each count, repeated
rows too. A null or empty text is one empty line and stays. Column names besides ``doc_id`` and
``text`` are free; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsweft.llm.sqltext import lower_az
from newsweft.llm.store import saved

MIN_DOCS = 10
SHARDS = 64
SALTS = 16
SLOTS = 4  # a bucket
LOAD = 0.85
KICKS = 500
WHITE = b" \t\n\x0b\x0c\r"
KEY = ["hi", "lo"]


class Cuckoo:
    """A cuckoo filter of 16-bit fingerprints. What finds no place after ``KICKS`` moves is kept whole aside."""

    def __init__(self, n_buckets: int, table: np.ndarray | None = None, aside: list[int] | None = None) -> None:
        self.n = n_buckets  # a power of two
        self.table = np.zeros((n_buckets, SLOTS), dtype=np.uint16) if table is None else table
        self.aside = set(aside or ())

    @classmethod
    def for_keys(cls, count: int) -> Cuckoo:
        need = max(1, int(count / (SLOTS * LOAD)) + 1)
        return cls(1 << (need - 1).bit_length())

    @classmethod
    def load(cls, data: bytes, aside) -> Cuckoo:
        table = np.frombuffer(data, dtype="<u2").reshape(-1, SLOTS).copy()
        return cls(len(table), table, [int(x) for x in aside])

    def dump(self) -> bytes:
        return self.table.astype("<u2").tobytes()

    def _turn(self, print_: int) -> int:
        """What leads from one bucket of a fingerprint to its other and back."""
        return (print_ * 0x5BD1E995) & (self.n - 1)

    def _home(self, lo: int) -> tuple[int, int]:
        lo &= (1 << 64) - 1
        return (lo & 0xFFFF) or 1, (lo >> 16) & (self.n - 1)

    def add(self, lo: int) -> None:
        print_, at = self._home(lo)
        for bucket in (at, at ^ self._turn(print_)):
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = print_
                return
        # move others; keep the way, so that it can be undone when it leads nowhere
        bucket, moved, way = at, print_, []
        for kick in range(KICKS):
            slot = (moved + kick) % SLOTS
            way.append((bucket, slot, int(self.table[bucket, slot])))
            moved, self.table[bucket, slot] = int(self.table[bucket, slot]), moved
            bucket ^= self._turn(moved)
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = moved
                return
        for bucket, slot, old in reversed(way):
            self.table[bucket, slot] = old
        self.aside.add(lo)

    def remove(self, lo: int) -> None:
        """``lo`` must have been added."""
        if lo in self.aside:
            self.aside.discard(lo)
            return
        print_, at = self._home(lo)
        for bucket in (at, at ^ self._turn(print_)):
            held = np.flatnonzero(self.table[bucket] == print_)
            if len(held):
                self.table[bucket, held[0]] = 0
                return
        raise KeyError(lo)

    def holds(self, lo: np.ndarray) -> np.ndarray:
        whole = lo.astype(np.int64).view(np.uint64)
        prints = (whole & np.uint64(0xFFFF)).astype(np.uint16)
        prints[prints == 0] = 1
        at = ((whole >> np.uint64(16)) & np.uint64(self.n - 1)).astype(np.int64)
        other = at ^ ((prints.astype(np.int64) * 0x5BD1E995) & (self.n - 1))
        found = (self.table[at] == prints[:, None]).any(axis=1) | (self.table[other] == prints[:, None]).any(axis=1)
        return found | np.isin(lo, list(self.aside)) if self.aside else found


def line_keys(text: str) -> list[bytes]:
    """The key of each line, empty for lines without a code point."""
    return [line.strip(WHITE).lower() for line in text.encode().split(b"\n")]


def _halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _keys_of(docs: DataFrame) -> DataFrame:
    """(owner_hi, owner_lo, hi, lo): the distinct keys of each row; the owner is the hash of the row's text."""

    def keys(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            owners, found = [], []
            for text in frame["text"]:
                mine = {xxhash.xxh3_128_digest(k) for k in line_keys(text) if k}
                owners += [xxhash.xxh3_128_digest(text.encode())] * len(mine)
                found += mine
            (owner_hi, owner_lo), (hi, lo) = _halves(owners), _halves(found)
            yield pd.DataFrame({"owner_hi": owner_hi, "owner_lo": owner_lo, "hi": hi, "lo": lo})

    rows = docs.where("text is not null").select("text")
    return rows.mapInPandas(keys, "owner_hi long, owner_lo long, hi long, lo long")


_FILTERS = "shard int, table binary, aside array<bigint>"


class LineIndex:
    """Counts ``(hi, lo, n)`` and filters ``(shard, table, aside)`` of the documents inserted and not deleted.

    Each change writes both tables anew under the shared folder; the former ones stay valid."""

    def __init__(self, spark, min_docs: int = MIN_DOCS, shards: int = SHARDS) -> None:
        self.min_docs, self.shards = min_docs, shards
        self.counts = spark.createDataFrame([], "hi long, lo long, n long")
        self.filters = spark.createDataFrame([], _FILTERS)

    def insert(self, docs: DataFrame) -> None:
        self._change(docs, 1)

    def delete(self, docs: DataFrame) -> None:
        """``docs`` are rows inserted before, whole."""
        self._change(docs, -1)

    def _shard(self):
        return F.pmod("hi", F.lit(self.shards)).cast("int").alias("shard")

    def _change(self, docs: DataFrame, sign: int) -> None:
        delta = _keys_of(docs).groupBy(*KEY).agg((F.count(F.lit(1)) * sign).alias("n"))
        both = self.counts.withColumn("was", F.col("n")).unionByName(delta.withColumn("was", F.lit(0).cast("long")))
        merged = saved(both.groupBy(*KEY).agg(F.sum("n").alias("n"), F.sum("was").alias("was")), "line_counts")
        self.counts = merged.where("n <> 0").select(*KEY, "n")
        self.filters = saved(self._filters_after(merged), "line_filters")

    def _filters_after(self, merged: DataFrame) -> DataFrame:
        """Filters with the keys that crossed the threshold put in or taken out; a shard that outgrew its
        filter gets a larger one with all its keys."""
        listed, was = F.col("n") >= self.min_docs, F.col("was") >= self.min_docs
        keys = merged.where(listed | was).select(self._shard(), "lo", listed.alias("listed"), was.alias("was"))
        sizes = keys.groupBy("shard").agg(F.count_if("listed").alias("size"))
        nothing = {"size": F.lit(None).cast("long"), "table": F.lit(None).cast("binary"), "aside": F.lit(None).cast("array<bigint>")}
        none = {"lo": F.lit(None).cast("long"), "listed": F.lit(None).cast("boolean"), "was": F.lit(None).cast("boolean")}
        heads = self.filters.join(sizes, "shard", "full").withColumns(none).withColumn("kind", F.lit(0))
        rows = heads.unionByName(keys.withColumns(nothing).withColumn("kind", F.lit(1)))

        def renew(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            shard, filter_, rebuilt = None, None, False
            row = lambda: pd.DataFrame({"shard": [shard], "table": [filter_.dump()], "aside": [sorted(filter_.aside)]})
            for frame in frames:
                for s, kind, table, aside, size, lo, listed, was in zip(*(frame[c] for c in ("shard", "kind", "table", "aside", "size", "lo", "listed", "was"))):
                    if kind == 0:
                        if filter_ is not None:
                            yield row()
                        shard, filter_ = s, Cuckoo.for_keys(0 if size != size or size is None else int(size))
                        rebuilt = table is None or len(table) < filter_.table.nbytes
                        if not rebuilt:
                            filter_ = Cuckoo.load(table, aside)
                    elif listed and (rebuilt or not was):
                        filter_.add(int(lo))
                    elif was and not listed and not rebuilt:
                        filter_.remove(int(lo))
            if filter_ is not None:
                yield row()

        ordered = rows.withColumn("lo", F.coalesce("lo", F.lit(0).cast("long"))).repartition("shard").sortWithinPartitions("shard", "kind", "lo")
        return ordered.select("shard", "kind", "table", "aside", "size", "lo", "listed", "was").mapInPandas(renew, _FILTERS)

    def listed_keys(self, docs: DataFrame) -> DataFrame:
        """(owner_hi, owner_lo, hi, lo): the keys of ``docs`` that enough documents hold."""
        salt = F.pmod("owner_lo", F.lit(SALTS)).cast("int").alias("salt")
        asked = _keys_of(docs).select(self._shard(), salt, F.lit(1).alias("kind"), "owner_hi", "owner_lo", *KEY)
        heads = self.filters.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumn("kind", F.lit(0))
        heads = heads.withColumns({c: F.lit(0).cast("long") for c in ("owner_hi", "owner_lo", *KEY)})
        rows = heads.unionByName(asked, allowMissingColumns=True).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind")

        def passing(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            at, filter_ = None, None
            for frame in frames:
                for place, part in frame.groupby(["shard", "salt"], sort=False):
                    heads = part[part["kind"] == 0]
                    if len(heads):
                        at, filter_ = place, Cuckoo.load(heads["table"].iloc[0], heads["aside"].iloc[0])
                    keys = part[part["kind"] == 1]
                    if at == place and len(keys):
                        keys = keys[["owner_hi", "owner_lo", "hi", "lo"]]
                        yield keys[filter_.holds(keys["lo"].to_numpy())]

        schema = "owner_hi long, owner_lo long, hi long, lo long"
        passed = rows.select("shard", "salt", "kind", "table", "aside", *schema.replace(" long", "").split(", ")).mapInPandas(passing, schema)
        return passed.join(self.counts.where(F.col("n") >= self.min_docs).select(*KEY), KEY, "left_semi")

    def drop_lines(self, docs: DataFrame) -> DataFrame:
        """doc_id, kept_text, n_lines (before), n_dropped, of every row of ``docs``."""

        @F.pandas_udf("struct<hi: bigint, lo: bigint>")
        def owner(text: pd.Series) -> pd.DataFrame:
            hi, lo = _halves([xxhash.xxh3_128_digest(t.encode()) for t in text])
            return pd.DataFrame({"hi": hi, "lo": lo})

        @F.pandas_udf("struct<kept_text: string, n_lines: bigint, n_dropped: bigint>")
        def without(text: pd.Series, gone: pd.Series) -> pd.DataFrame:
            out = []
            for t, g in zip(text, gone):
                if g is None:
                    out.append((t, t.count("\n") + 1, 0))
                    continue
                halves = np.asarray(g, dtype="<i8").tobytes()
                drop = {halves[i : i + 16] for i in range(0, len(halves), 16)}
                keep = [not k or xxhash.xxh3_128_digest(k) not in drop for k in line_keys(t)]
                out.append(("\n".join(line for line, k in zip(t.split("\n"), keep) if k), len(keep), keep.count(False)))
            return pd.DataFrame(out, columns=["kept_text", "n_lines", "n_dropped"])

        halves = F.flatten(F.transform(F.collect_set(F.struct(*KEY)), lambda k: F.array(k["hi"], k["lo"])))
        owned = F.struct(F.col("owner_hi").alias("hi"), F.col("owner_lo").alias("lo")).alias("_owner")
        lists = saved(self.listed_keys(docs), "listed_lines").groupBy(owned).agg(halves.alias("_gone"))
        rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text")).withColumn("_owner", owner("_text"))
        met = rows.join(lists, "_owner", "left")
        return met.select("doc_id", without("_text", "_gone").alias("_x")).select("doc_id", "_x.*")


def line_dedup(docs: DataFrame, min_docs: int = MIN_DOCS, shards: int = SHARDS) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256: an index of all of ``docs``, applied to them."""
    index = LineIndex(docs.sparkSession, min_docs, shards)
    index.insert(docs)
    return index.drop_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
k AS (
  SELECT r, doc_id, i, line, {lower_az(r"regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')")} AS key
  FROM (SELECT r, doc_id, unnest(range(len(l))) AS i, unnest(l) AS line FROM d)),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= {MIN_DOCS})
SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key GROUP BY r, doc_id
"""

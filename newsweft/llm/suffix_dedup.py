"""Passages that repeat across the corpus, by sparse suffix arrays.

Words are runs of characters other than ``[\\x20\\x09-\\x0D]``, compared as they are. A passage repeats
when the same ``MIN_WORDS`` words in a row stand at two places of the corpus; a document's spans are the
words that such windows cover.

1. Of all suffixes those are retained that begin at a minimiser: the smallest hash of ``GRAM`` words
   among ``WINDOW`` neighbours. Equal passages have equal minimisers, and every window of ``MIN_WORDS``
   words holds one in its first ``WINDOW`` places, so at least ``CORE`` of its words stand to the right.
2. The retained suffixes are sorted by their first ``CORE`` words; those that agree with a neighbour
   stay. Spark's aggregation and sort-merge join do this by key, combining on the map side, so a
   passage in a third of all documents is one row a task.
3. Matches are extended. To the right: a suffix whose first ``MIN_WORDS`` words agree too covers them.
   To the left: the windows that begin up to ``WINDOW - 1`` words before a suffix are compared word by
   word, unless agreeing suffixes cover them already at every place where this core stands.

Words and windows are compared by 64-bit hashes of whole words. Null, empty and shorter texts have no
spans, nor have rows without ``doc_id``. A repeated row is one more copy, so its passages repeat; rows
that share a ``doc_id`` are reported together. An empty table gives an empty result. Other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsweft.llm.store import saved

MIN_WORDS = 50
GRAM = 8
WINDOW = 32
CORE = MIN_WORDS - WINDOW + 1  # words to the right that a retained suffix must share

_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) < 100_000 and len(word) < 40:
            self[word] = h
        return h


_WORDS = _Words()


def word_hashes(text: str | None) -> np.ndarray:
    words = text.encode("utf-8", "surrogatepass").split() if isinstance(text, str) else []
    return np.fromiter(map(_WORDS.__getitem__, words), dtype=np.uint64, count=len(words))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, grown as texts need them."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 4096)
        _POWERS[:] = [
            np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, b, dtype=np.uint64))]) for b in (_BASE, pow(_BASE, -1, 2**64))
        ]
    return _POWERS[0], _POWERS[1]


class Windows:
    """Hashes of word windows of any length, from one running sum."""

    def __init__(self, words: np.ndarray) -> None:
        up, self._down = _powers(len(words))
        self.n = len(words)
        self._sum = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[: self.n])])

    def at(self, starts: np.ndarray, length: int) -> np.ndarray:
        h = (self._sum[starts + length] - self._sum[starts]) * self._down[starts]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(29)) ^ np.uint64(length)


def _running(x: np.ndarray, width: int, of) -> np.ndarray:
    """``of`` over every ``width`` successive values, by doubling."""
    span, out = 1, x
    while span * 2 <= width:
        out = of(out[:-span], out[span:])
        span *= 2
    return of(out[: len(out) - (width - span)], out[width - span :]) if width > span else out


def minimisers(w: Windows) -> np.ndarray:
    """Places whose gram is the smallest of some window; all of them if several are equal."""
    if w.n < MIN_WORDS:
        return np.zeros(0, dtype=np.int64)
    grams = w.at(np.arange(w.n - GRAM + 1), GRAM)
    least = _running(grams, WINDOW, np.minimum)
    pad = np.zeros(WINDOW - 1, dtype=np.uint64)
    most = _running(np.concatenate([pad, least, pad]), WINDOW, np.maximum)
    return np.flatnonzero(grams == most)


SUFFIXES = "doc_id long, pos int, core long, whole long"


def suffixes(docs: DataFrame) -> DataFrame:
    """One row per retained suffix: its place, and hashes of its first CORE and MIN_WORDS words (null past the end)."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 500):
                parts = []
                for doc_id, text in frame[["doc_id", "text"]].iloc[at : at + 500].itertuples(index=False):
                    w = Windows(word_hashes(text))
                    pos = minimisers(w)
                    pos = pos[pos + CORE <= w.n]
                    fits = pos + MIN_WORDS <= w.n
                    whole = np.zeros(len(pos), dtype=np.int64)
                    whole[fits] = w.at(pos[fits], MIN_WORDS).view(np.int64)
                    parts.append((np.full(len(pos), doc_id), pos, w.at(pos, CORE).view(np.int64), whole, fits))
                doc_id, pos, core, whole, fits = (np.concatenate(x) for x in zip(*parts))
                yield pd.DataFrame(
                    {
                        "doc_id": doc_id.astype(np.int64),
                        "pos": pos.astype(np.int32),
                        "core": core,
                        "whole": pd.arrays.IntegerArray(whole, ~fits),
                    }
                )

    return docs.mapInPandas(rows, SUFFIXES)


def _repeated(rows: DataFrame, key: str) -> DataFrame:
    """Values of ``key`` that stand at two places at least, and the first place."""
    places = rows.where(F.col(key).isNotNull()).groupBy(key)
    found = places.agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "pos")).alias("first")).where("n > 1").select(key, "first")
    return saved(found, "repeated")  # as a table, so that a join with it can split a hot key


def _is_first() -> Column:
    return (F.col("first.doc_id") == F.col("doc_id")) & (F.col("first.pos") == F.col("pos"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, span, start_word, end_word, n_words, is_first: every span of repeated passages, numbered
    from 0 in its document. ``is_first``: each window compared in it stands here for the first time."""
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = saved(suffixes(texts), "suffixes")
    cores = saved(found.groupBy("core").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("core"), "cores")
    runs = saved(found.join(cores, "core", "left_semi"), "runs")
    marked = runs.join(_repeated(runs, "whole"), "whole", "left").select("doc_id", "pos", "core", "first")
    order = Window.partitionBy("doc_id").orderBy("pos")  # at most a row for each word of a document
    agrees = F.col("first").isNotNull()
    last = F.max(F.when(agrees, F.col("pos"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = marked.withColumn("fresh", agrees & (F.col("pos") - F.coalesce(last, F.lit(-MIN_WORDS - 1)) > MIN_WORDS))
    since = F.max(F.when(F.col("fresh"), F.col("pos"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    marked = saved(marked.withColumn("settled", agrees & (F.col("pos") - since >= WINDOW - 1)), "marked")
    agreeing = marked.where("first is not null").select("doc_id", "pos", _is_first().alias("is_first"))

    open_cores = saved(marked.where(~F.col("settled")).select("core").distinct(), "open")
    gaps = marked.join(open_cores, "core", "left_semi").groupBy("doc_id").agg(F.sort_array(F.collect_set("pos")).alias("gap"))

    def windows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Every window that begins at one of the suffixes or up to WINDOW - 1 words before it."""
        for frame in frames:
            for at in range(0, len(frame), 500):
                parts = []
                for doc_id, pos, text in frame.iloc[at : at + 500].itertuples(index=False):
                    w = Windows(word_hashes(text))
                    starts = np.unique(np.asarray(pos, dtype=np.int64)[:, None] - np.arange(WINDOW))
                    starts = starts[(starts >= 0) & (starts + MIN_WORDS <= w.n)]
                    parts.append((np.full(len(starts), doc_id), starts, w.at(starts, MIN_WORDS).view(np.int64)))
                doc_id, pos, whole = (np.concatenate(x) for x in zip(*parts))
                yield pd.DataFrame({"doc_id": doc_id, "pos": pos.astype(np.int32), "whole": whole})

    opened = gaps.join(texts, "doc_id").select("doc_id", "gap", "text")
    opened = saved(opened.mapInPandas(windows, "doc_id long, pos int, whole long"), "windows")
    between = opened.join(_repeated(opened, "whole"), "whole").select("doc_id", "pos", _is_first().alias("is_first"))
    starts = agreeing.unionByName(between).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "is_first"))).alias("s"))

    def spans(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for doc_id, pos, first in frame.itertuples(index=False):
                pos, first = np.asarray(pos, dtype=np.int64), np.asarray(first, dtype=bool)
                cut = np.flatnonzero(np.diff(pos) > MIN_WORDS) + 1
                for n, (run, new) in enumerate(zip(np.split(pos, cut), np.split(first, cut))):
                    out.append((doc_id, n, run[0], run[-1] + MIN_WORDS, run[-1] + MIN_WORDS - run[0], bool(new.all())))
            yield pd.DataFrame(out, columns=["doc_id", "span", "start_word", "end_word", "n_words", "is_first"])

    schema = "doc_id long, span int, start_word int, end_word int, n_words int, is_first boolean"
    return starts.select("doc_id", "s.pos", "s.is_first").mapInPandas(spans, schema)

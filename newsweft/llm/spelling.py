"""Spelling variants: words one edit apart, found by dense tiles of padded code points.

Two words are near when they differ by one inserted, deleted or replaced code point. With ``L`` the
length of the longer one, that holds exactly when common prefix plus common suffix reach ``L - 1``.
The place of the edit lies in one of three thirds of the longer word, and all before and behind that
third is equal; so words meet under (length class, third, what stands outside the third). Each such
block of words is a padded matrix of code points, and block pairs are compared densely, a diagonal at
a time. A block holds at most ``TILE_CELLS`` code points; larger groups are cut into blocks and every
pair of blocks is a tile of its own, so no group is one task's. Only near pairs leave a tile.

Defined: a null text has no words, a null doc_id counts as an empty string, repeated rows count again,
an empty table gives an empty result. Other columns are not read. Runs of any length take part.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsweft.llm.sqltext import CRC_TABLE, crc32, lower_az
from newsweft.llm.store import saved

MIN_LENGTH = 7  # code points
MIN_COUNT = 2
DAMAGE = 31  # runs whose checksum it divides lose a code point
RATIO = 10  # a form is at least so many times as frequent
THIRDS = 3
TILE_ROWS, TILE_CELLS = 256, 1 << 20
CHUNK_CELLS = 1 << 22  # code points that a task compares at once
HOPS = 5  # doublings: counts are below 2^63 and grow tenfold a hop, so no path has over 18 hops


def damaged_runs(docs: DataFrame) -> DataFrame:
    """(word, n): runs of letters, damaged by rule, counted in each batch of whole texts.

    A run that is shorter than a word can be gives no word, as damage only shortens it."""
    long_run = re.compile(f"[a-zÀ-ÿ]{{{MIN_LENGTH},}}").findall

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            seen: Counter = Counter()
            for doc_id, text in zip(frame["doc_id"], frame["text"]):
                start = zlib.crc32(f"{doc_id}:".encode())
                runs = Counter(long_run(text.encode().lower().decode()))  # bytes.lower() knows A-Z only
                for run, n in runs.items():
                    h = zlib.crc32(run.encode(), start)
                    if h % DAMAGE == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                    if len(run) >= MIN_LENGTH:
                        seen[run] += n
            yield pd.DataFrame({"word": list(seen), "n": np.fromiter(seen.values(), dtype=np.int64, count=len(seen))})

    rows = docs.where("text is not null").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text")
    return rows.mapInPandas(count, "word string, n long")


def _bound(length, third):
    """Where the ``third``-th part of a word of ``length`` begins."""
    return length * third // THIRDS


def _placed(words: DataFrame) -> DataFrame:
    """(word, n, length, third, key): under which keys a word meets others, as the longer or as the shorter one."""
    lengths = F.array(F.length("word"), F.length("word") + 1)
    at = words.select("word", "n", F.explode(lengths).alias("length")).withColumn(
        "third", F.explode(F.array(*map(F.lit, range(THIRDS))))
    )
    bound = lambda third: F.floor(F.col("length") * third / F.lit(THIRDS)).cast("int")
    before, behind = bound(F.col("third")), F.col("length") - bound(F.col("third") + 1)
    head = F.substring("word", F.lit(1), before)
    tail = F.when(behind > 0, F.substring("word", -behind, behind)).otherwise("")
    return at.withColumn("key", F.xxhash64("length", "third", head, tail))


def _tiled(placed: DataFrame) -> DataFrame:
    """Adds ``lo``, ``hi``, ``block``: the tiles of each row. Groups above a block's size are cut by a hash of the word."""
    rows = F.greatest(F.lit(2), F.least(F.lit(TILE_ROWS), F.floor(F.lit(TILE_CELLS) / F.col("length"))))
    large = placed.groupBy("key", "length").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > rows)
    blocks = large.select("key", "length", F.ceil(F.col("size") / rows).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("word", F.lit(7)), F.col("blocks")).cast("int")
    return (
        placed.join(blocks, ["key", "length"], "left")
        .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("block", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("word", "n", "length", "third", "key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block")
    )


def matrices(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points padded behind, padded in front, and the lengths."""
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    width = int(lengths.max(initial=0))
    flat = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4")
    inside = np.arange(width)[None, :] < lengths[:, None]
    left, right = np.zeros((2, len(words), width), dtype=np.uint32)
    left[inside] = flat
    right[inside[:, ::-1]] = flat
    return left, right, lengths


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many columns from the first on are equal, in each row."""
    differs = np.column_stack([a != b, np.ones(len(a), dtype=bool)])
    return differs.argmax(axis=1)


def near_rows(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Near pairs of the whole tiles in ``frame``, whose rows stand in order of tile and block."""
    left, right, lengths = matrices(frame["word"].tolist())
    key, lo, hi, block, longer, third = (frame[c].to_numpy() for c in ("key", "lo", "hi", "block", "length", "third"))
    new = np.r_[True, (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]) | (longer[1:] != longer[:-1])]
    ends = np.append(np.flatnonzero(new)[1:], len(frame))[np.cumsum(new) - 1]
    word, n = frame["word"].to_numpy(), frame["n"].to_numpy()
    at, step = np.arange(len(frame)), 0
    while True:
        step += 1
        at = at[at + step < ends[at]]  # the diagonal: each row against the one ``step`` behind it
        if not len(at):
            return
        a = at[(lo[at] == hi[at]) | (block[at] != block[at + step])]
        b = a + step
        meet = np.maximum(lengths[a], lengths[b]) == longer[a]
        a, b = a[meet], b[meet]
        shortest = np.minimum(lengths[a], lengths[b])
        prefix = np.minimum(_common(left[a], left[b]), shortest)
        suffix = np.minimum(_common(right[a][:, ::-1], right[b][:, ::-1]), shortest)
        ok = (prefix + suffix >= longer[a] - 1) & (prefix < longer[a])  # equal words have the whole word in common
        ok &= (_bound(longer[a], third[a]) <= prefix) & (prefix < _bound(longer[a], third[a] + 1))  # each pair in one third
        a, b = a[ok], b[ok]
        if len(a):
            yield pd.DataFrame({"word": np.r_[word[a], word[b]], "near": np.r_[word[b], word[a]], "near_n": np.r_[n[b], n[a]]})


def _in_tiles(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Gathers rows to whole tiles, and as many tiles at once as ``CHUNK_CELLS`` allows."""
    tile = ["length", "key", "lo", "hi"]
    held = None
    for frame in frames:
        if not len(frame):
            continue
        held = frame if held is None else pd.concat([held, frame], ignore_index=True)
        last = (held[tile] == held[tile].iloc[-1].tolist()).all(axis=1).to_numpy()
        whole = len(held) - int(last.sum())  # all before the last tile, of which more may come
        if whole and whole * int(held["length"].iloc[whole - 1]) >= CHUNK_CELLS // 16:
            yield from _chunks(held.iloc[:whole])
            held = held.iloc[whole:].reset_index(drop=True)
    if held is not None:
        yield from _chunks(held)


def _chunks(held: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Cuts before tiles that would take a chunk over ``CHUNK_CELLS``."""
    tile = held[["length", "key", "lo", "hi"]]
    new = np.r_[True, (tile.to_numpy()[1:] != tile.to_numpy()[:-1]).any(axis=1)]
    starts = np.append(np.flatnonzero(new), len(held))
    lengths = held["length"].to_numpy()
    begin = 0
    for start, end in zip(starts[:-1], starts[1:]):
        if start > begin and (end - begin) * lengths[end - 1] > CHUNK_CELLS:
            yield from near_rows(held.iloc[begin:start])
            begin = start
    yield from near_rows(held.iloc[begin:])


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, near, near_n): every pair of ``words(word, n)`` one edit apart, in both directions."""
    tile = ["length", "key", "lo", "hi"]
    tiles = _tiled(_placed(words)).repartition("key", "lo", "hi").sortWithinPartitions(*tile, "block")
    return tiles.mapInPandas(_in_tiles, "word string, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): ``forms(word, form)`` followed to their end, each round twice as far."""
    at = saved(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(HOPS):
        further = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = saved(at.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if at.where("moved").isEmpty():
            break
        at = at.drop("moved")
    return at.select("word", "root")


def spelling_variants(docs: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, n, n_near, form, form_n, root. A word's form is its most frequent near word (ties: the
    smallest), if that is ``ratio`` times as frequent at least."""
    counted = damaged_runs(docs).groupBy("word").agg(F.sum("n").alias("n"))
    words = saved(counted.where(F.col("n") >= MIN_COUNT), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near")))
    near = near_pairs(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    joined = words.join(near, "word", "left")
    takes: Column = -F.col("best.less") >= F.col("n") * ratio
    found = saved(
        joined.select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(takes, F.col("best.near")).alias("form"), F.when(takes, -F.col("best.less")).alias("form_n"),
        ),
        "forms",
    )
    ends = roots(found.where("form is not null"))
    return found.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))


SQL = f"""
WITH RECURSIVE {CRC_TABLE},
runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') || ':' AS d, unnest(regexp_extract_all({lower_az("text")}, '[a-zÀ-ÿ]+')) AS run
  FROM documents),
per_doc AS (SELECT d, run, count(*) AS n FROM runs WHERE length(run) >= {MIN_LENGTH} GROUP BY ALL),
hashed AS (SELECT run, n, {crc32("d || run")} AS h FROM per_doc, crc_table),
harmed AS (
  SELECT CASE WHEN h % {DAMAGE} = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed),
w AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n, length(word) AS len FROM harmed WHERE length(word) >= {MIN_LENGTH} GROUP BY word HAVING sum(n) >= {MIN_COUNT}),
gaps AS MATERIALIZED (
  SELECT word, n, len, i, substr(word, 1, i - 1) || chr(0) || substr(word, i + 1) AS hole, substr(word, 1, i - 1) || substr(word, i + 1) AS less
  FROM (SELECT *, unnest(range(1, len + 1))::INT AS i FROM w)),
pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM gaps a JOIN gaps b ON a.hole = b.hole AND a.word <> b.word
  UNION SELECT g.word, w.word, w.n FROM gaps g JOIN w ON g.less = w.word
  UNION SELECT w.word, g.word, g.n FROM gaps g JOIN w ON g.less = w.word),
best AS (
  SELECT word, count(*) AS n_near, max(near_n) AS top FROM pairs GROUP BY word),
named AS (SELECT word, n_near, top, min(near) AS near FROM best JOIN pairs USING (word) WHERE near_n = top GROUP BY ALL),
found AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= {RATIO} * w.n THEN near END AS form, CASE WHEN top >= {RATIO} * w.n THEN top END AS form_n
  FROM w LEFT JOIN named USING (word)),
walk AS (
  SELECT word, word AS root, form AS next FROM found
  UNION ALL SELECT walk.word, found.word, found.form FROM walk JOIN found ON walk.next = found.word)
SELECT found.word, n, n_near, form, form_n, root FROM found JOIN walk ON found.word = walk.word AND walk.next IS NULL
"""

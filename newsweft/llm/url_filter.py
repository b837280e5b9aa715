"""Url rules and host lists behind Bloom filter cascades.

Level 0 of a cascade encodes the listed keys; level 1 those unlisted keys of the corpus that level 0
lets through; level 2 the listed keys that level 1 lets through; and so on until nothing is left. The
levels together answer exactly for every key of the corpus, so each url is judged in its own row and
no join is needed.

A key is a host, or a part of it after a dot, followed by a path prefix: ``example.net/en/``. The
corpus's key universe is every such key that its urls can match, at the prefix lengths that rules use.

Judged: a null url, or one without ``://``, has an empty host and path, fits no rule and is allowed.
An empty host matches no key. Repeated urls are judged alike; an empty table gives an empty result. Other
columns than ``page_id`` and ``url`` are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsweft.llm.store import saved

# The rules and the listed hosts of the query.
RULES = (
    ("block", "net/"),
    ("allow", "example.net/en/"),
    ("block", "example.com/de/"),
    ("allow", "org/fr/"),
)
LISTED_HOSTS = (
    "adult-x.example.com",
    "ads-track.example.com",
    "casino-win.example.net",
    "cheap-pills.example.net",
    "free-bets.example.net",
    "spam-farm.example.org",
)

MAX_KEYS = 5_000_000  # the most keys one cascade may list: about 7 MB of bits on its first level
BITS_PER_KEY = (12, 4)  # first level, later levels
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Level:
    n_bits: int
    n_hashes: int
    depth: int
    bits: np.ndarray  # uint8, packed

    def places(self, a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
        """Bit numbers of each key. Keys that meet on one level must not meet on the next, so the depth is mixed in."""
        x = a ^ np.uint64(0x9E3779B97F4A7C15 * (self.depth + 1) % 2**64)
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
        x ^= x >> np.uint64(31)
        return [(x + np.uint64(i) * b) % np.uint64(self.n_bits) for i in range(self.n_hashes)]

    def holds(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        found = np.ones(len(a), dtype=bool)
        for at in self.places(a, b):
            found &= (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return found


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def listed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the keys with hashes ``a`` and ``b`` are listed: the first level that lacks a key decides."""
        out = np.zeros(len(a), dtype=bool)
        open_ = np.ones(len(a), dtype=bool)
        for depth, level in enumerate(self.levels):
            inside = level.holds(a, b)
            out[open_ & ~inside] = depth % 2 == 1
            open_ &= inside
        out[open_] = len(self.levels) % 2 == 1
        return out


def _hashes(key) -> tuple:
    """Two 64-bit hashes of a key column; ``as_numpy`` makes the second odd."""
    return F.xxhash64(key).alias("a"), F.xxhash64(key, F.lit(1)).alias("b")


def as_numpy(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    a = frame["a"].to_numpy(dtype=np.int64).view(np.uint64)
    b = frame["b"].to_numpy(dtype=np.int64).view(np.uint64) | np.uint64(1)
    return a, b


def with_parts(pages: DataFrame) -> DataFrame:
    """page_id, host, path."""
    at = F.instr("url", "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return pages.select("page_id", F.translate(raw, UPPER, LOWER).alias("host"), path.alias("path"))


def with_keys(parts: DataFrame, prefix_lengths: list[int]) -> DataFrame:
    """Adds ``keys``: the keys the url can match, longest first."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    prefixes = F.filter(
        F.transform(F.array(*map(F.lit, prefix_lengths)), lambda n: F.substring("path", F.lit(1), n)),
        lambda p: F.length(p) > 0,
    )
    every = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    longest_first = F.reverse(F.array_sort(F.transform(F.array_distinct(every), lambda k: F.struct(F.length(k), k.alias("k")))))
    keys = F.when((F.col("host") != "") & (F.col("path") != ""), F.transform(longest_first, lambda x: x["k"]))
    return parts.withColumn("keys", F.coalesce(keys, F.array().cast("array<string>")))


def _level(hashed: DataFrame, n: int, bits_per_key: int, depth: int) -> Level:
    """One filter over ``n`` keys, its words set by an aggregation and no larger than the bound on ``n``."""
    n_bits = max(64, n * bits_per_key)
    empty = Level(n_bits, max(1, round(bits_per_key * math.log(2))), depth, np.zeros(n_bits // 8 + 1, dtype=np.uint8))

    def positions(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            at = np.concatenate(empty.places(*as_numpy(frame)))
            yield pd.DataFrame({"byte": (at >> np.uint64(3)).astype(np.int64), "bit": (1 << (at & np.uint64(7)).astype(np.int64))})

    rows = hashed.mapInPandas(positions, "byte long, bit long").groupBy("byte").agg(F.bit_or("bit").alias("bit")).toPandas()
    bits = empty.bits.copy()
    bits[rows["byte"].to_numpy(dtype=np.int64)] = rows["bit"].to_numpy(dtype=np.uint8)
    return Level(n_bits, empty.n_hashes, depth, bits)


def build_cascade(universe: DataFrame, listed: DataFrame, max_keys: int = MAX_KEYS, bits_per_key=BITS_PER_KEY) -> Cascade:
    """Cascade over the distinct ``key`` column of both frames. More listed keys than ``max_keys``
    raise an error, as the levels are sent to every executor."""
    spark = universe.sparkSession
    yes = listed.where("key is not null").select("key").distinct().select(*_hashes("key"))
    n_yes = yes.count()
    if n_yes > max_keys:
        raise ValueError(f"{n_yes} listed keys; one cascade takes {max_keys}")
    if not n_yes:
        return Cascade((Level(64, 1, 0, np.zeros(9, dtype=np.uint8)),))
    yes = saved(yes, "listed")
    all_keys = universe.where("key is not null").select("key").distinct().select(*_hashes("key"))
    no = all_keys.join(yes, ["a", "b"], "left_anti")
    levels = [_level(yes, n_yes, bits_per_key[0], 0)]
    let_through = [no, yes]  # what the newest level must be checked on, and what it encodes
    while True:
        sent = spark.sparkContext.broadcast(levels[-1])

        def passing(frames: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            for frame in frames:
                yield frame[sent.value.holds(*as_numpy(frame))]

        wrong = saved(let_through[0].mapInPandas(passing, "a long, b long"), "through")
        n = wrong.count()
        if not n:
            return Cascade(tuple(levels))
        if n > max_keys:
            raise ValueError(f"{n} keys pass level {len(levels) - 1}; one level takes {max_keys}")
        levels.append(_level(wrong, n, bits_per_key[1], len(levels)))
        let_through = [let_through[1], wrong]


def judge_urls(pages: DataFrame, rules=RULES, listed_hosts=LISTED_HOSTS, bits_per_key=BITS_PER_KEY) -> DataFrame:
    """page_id, host, path, rule, verdict, listed. A rule fits its host, all hosts below it, and paths
    that begin with its path; the longest wins. Without a rule the host list decides."""
    spark = pages.sparkSession
    lengths = sorted({len(rule) - rule.index("/") for _, rule in rules} | {1})
    parts = with_parts(pages)
    keyed = with_keys(parts, lengths)
    # hosts are many fewer than urls: both universes come from aggregations with a map-side combine
    universe = saved(keyed.select(F.explode("keys").alias("key")).distinct(), "universe")
    labels = F.split("host", r"\.")
    hosts = parts.select("host").distinct().select(
        F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("key")
    )
    keys_of = lambda names: spark.createDataFrame([(k,) for k in names], "key string")
    cascades = spark.sparkContext.broadcast(
        {
            "block": build_cascade(universe, keys_of([r for action, r in rules if action == "block"]), bits_per_key=bits_per_key),
            "allow": build_cascade(universe, keys_of([r for action, r in rules if action == "allow"]), bits_per_key=bits_per_key),
            "hosts": build_cascade(hosts, keys_of(list(listed_hosts)), bits_per_key=bits_per_key),
        }
    )

    @F.pandas_udf("array<int>")
    def listed(a: pd.Series, b: pd.Series, which: pd.Series) -> pd.Series:
        """Positions (from 1) in the row's key list that the named cascade lists."""
        cascade, sizes = cascades.value[which.iloc[0]], a.str.len().to_numpy()
        if not sizes.sum():
            return pd.Series([[] for _ in sizes])
        flat = pd.DataFrame({"a": np.concatenate(a.to_numpy()), "b": np.concatenate(b.to_numpy())})
        found = np.split(cascade.listed(*as_numpy(flat)), np.cumsum(sizes)[:-1])
        return pd.Series([(np.flatnonzero(x) + 1).tolist() for x in found])

    def first_listed(keys, which):
        a = F.transform(keys, lambda k: F.xxhash64(k))
        b = F.transform(keys, lambda k: F.xxhash64(k, F.lit(1)))
        return F.array_min(listed(a, b, F.lit(which)))

    host_keys = F.when(
        F.col("host") != "",
        F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")),
    ).otherwise(F.array().cast("array<string>"))
    found = keyed.withColumns(
        {
            "block_at": first_listed(F.col("keys"), "block"),
            "allow_at": first_listed(F.col("keys"), "allow"),
            "listed": first_listed(host_keys, "hosts").isNotNull(),
        }
    )
    at = F.least("block_at", "allow_at")
    return found.select(
        "page_id",
        "host",
        "path",
        F.when(at.isNotNull(), F.get("keys", at - 1)).alias("rule"),
        F.when(at.isNull(), F.when(F.col("listed"), "block").otherwise("allow"))
        .when(F.col("block_at").eqNullSafe(at), "block")
        .otherwise("allow")
        .alias("verdict"),
        "listed",
    )


def _sql(rules=RULES, listed_hosts=LISTED_HOSTS) -> str:
    rule_rows = ", ".join(f"('{a}', '{r}', '{r[: r.index('/')]}', '{r[r.index('/'):]}')" for a, r in rules)
    host_rows = ", ".join(f"('{h}')" for h in listed_hosts)
    return rf"""
WITH u AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
rules(action, rule, rhost, rpath) AS (VALUES {rule_rows}),
hosts(h) AS (VALUES {host_rows}),
hit AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(action, length(rule)) AS action
  FROM p JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id),
l AS (SELECT DISTINCT page_id FROM p JOIN hosts ON host = h OR ends_with(host, '.' || h))
SELECT p.page_id, host, path, rule, l.page_id IS NOT NULL AS listed,
       coalesce(action, CASE WHEN l.page_id IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN hit ON p.page_id = hit.page_id LEFT JOIN l ON p.page_id = l.page_id
"""


SQL = _sql()

"""Toxicity scores by FTRL-proximal logistic regression on hashed word n-grams and skip-grams.

Features are the distinct words, word pairs and pairs with one word between of the whole text, hashed
to 32 bits. A model is fitted on at most ``sample`` labelled documents (those with the smallest hash of
their id): a feature gets a weight if ``min_count`` toxic documents of the sample have it. Shards of
the sample train side by side with per-coordinate rates, each coordinate's steps are averaged over the
shards that moved it, and the next pass starts from there. The L1 term leaves few weights other than zero, and these are broadcast.

Labels come only from rows with ``crc32(doc_id as text) % 3 <> 1``; a document with several labels
counts as toxic if one says so. Labels, lang, source and doc_id are never features.

Null and empty texts get the score of no features. Without toxic labels every score is at most 0.5. Repeated rows are
scored alike; an empty table gives an empty result; other columns pass through ``keep_clean`` unread.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsweft.llm.store import saved

SAMPLE = 20_000  # labelled documents to fit on, at most
MIN_COUNT = 3
MAX_FEATURES = 1 << 18  # weights a model can have, at most
SHARDS = 8
PASSES = 8
ALPHA, BETA, L1, L2 = 2.0, 1.0, 10.0, 1e-3
TOXIC_WEIGHT = 12  # of a toxic document's step: one clear word must outweigh the many clean documents
THRESHOLD = 0.7
STRIPPED = ".,;:!?\"'()[]{}<>|*#%&-_/\\=+~`"


class _Words(dict):
    """Hash of a raw word without the punctuation around it; kept for recurring words only."""

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh64_intdigest(word.strip(STRIPPED))
        if len(self) < 100_000 and len(word) < 40:
            self[word] = h
        return h


_WORDS = _Words()


def features(text: str | None) -> np.ndarray:
    """Feature ids of a text, repeats included."""
    raw = text.lower().split() if isinstance(text, str) else []
    h = np.fromiter(map(_WORDS.__getitem__, raw), dtype=np.uint64, count=len(raw))
    mixed = [h * np.uint64(0x9E3779B97F4A7C15)]
    for gap, a, b in ((1, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9), (2, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)):
        if len(h) > gap:
            pair = h[:-gap] * np.uint64(a) + (h[gap:] ^ (h[gap:] >> np.uint64(29))) * np.uint64(b)
            mixed.append((pair ^ (pair >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15))
    return (np.concatenate(mixed) >> np.uint64(32)).astype(np.uint32)


@dataclass(frozen=True)
class Model:
    ids: np.ndarray  # uint32, rising
    weights: np.ndarray
    bias: float

    def __post_init__(self) -> None:
        seen = np.zeros(1 << 20, dtype=bool)
        seen[self.ids & 0xFFFFF] = True
        object.__setattr__(self, "_seen", seen)

    def score(self, text: str | None) -> float:
        f = features(text)
        f = np.unique(f[self._seen[f & 0xFFFFF]])
        at = np.searchsorted(self.ids, f)
        at[at == len(self.ids)] = 0
        hit = at[self.ids[at] == f] if len(self.ids) else at[:0]
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weights[hit].sum(), -35, 35))))


def for_training(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """FTRL-proximal weights; the last coordinate is the bias, which no L1 term holds down."""
    l1 = np.full(len(z), L1)
    l1[-1] = 0
    return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, min_count: int = MIN_COUNT) -> Model:
    spark = docs.sparkSession
    one = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & for_training(F.col("doc_id")))
    one = one.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = one.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(sample).select("doc_id", "toxic", "h")
    chosen = F.broadcast(saved(chosen, "sample"))

    def featurize(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame["ids"] = [np.unique(features(t)).tobytes() for t in frame.pop("text")]
            yield frame

    rows = docs.select("doc_id", "text").join(chosen, "doc_id").select("h", "toxic", "text")
    rows = saved(rows.mapInPandas(featurize, "h long, toxic int, ids binary"), "features")

    def spread(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                ids, n = np.unique(np.concatenate([np.frombuffer(b, dtype=np.uint32) for b in frame["ids"]]), return_counts=True)
                yield pd.DataFrame({"id": ids.astype(np.int64), "n": n.astype(np.int64)})

    counted = rows.where("toxic > 0").select("ids").mapInPandas(spread, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    used = counted.where(F.col("n") >= min_count).orderBy(F.desc("n"), "id").limit(MAX_FEATURES).select("id").toPandas()
    ids = np.sort(used["id"].to_numpy(dtype=np.uint32))
    known = spark.sparkContext.broadcast(ids)

    def project(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame["ids"] = [
                np.searchsorted(known.value, np.intersect1d(np.frombuffer(b, dtype=np.uint32), known.value, assume_unique=True)).astype(np.int32).tobytes()
                for b in frame["ids"]
            ]
            yield frame

    rows = saved(rows.mapInPandas(project, "h long, toxic int, ids binary"), "projected")
    z, n = np.zeros(len(ids) + 1), np.zeros(len(ids) + 1)
    for _ in range(PASSES if len(ids) else 0):
        state = spark.sparkContext.broadcast((z, n))

        def train(shard: pd.DataFrame) -> pd.DataFrame:
            z, n = (x.copy() for x in state.value)
            for toxic, blob in shard.sort_values("h")[["toxic", "ids"]].itertuples(index=False):
                at = np.append(np.frombuffer(blob, dtype=np.int32), len(z) - 1)
                w = _weights(z[at], n[at])
                p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
                g = TOXIC_WEIGHT * (p - 1) if toxic > 0 else p
                z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
                n[at] += g * g
            z, n = z - state.value[0], n - state.value[1]
            moved = np.flatnonzero((z != 0) | (n != 0))
            return pd.DataFrame({"at": moved, "z": z[moved], "n": n[moved]})

        steps = rows.groupBy(F.pmod("h", F.lit(SHARDS)).alias("shard")).applyInPandas(train, "at long, z double, n double")
        step = steps.groupBy("at").agg(F.avg("z").alias("z"), F.avg("n").alias("n")).toPandas()
        z[step["at"]] += step["z"]
        n[step["at"]] += step["n"]
        state.unpersist()
    w = _weights(z, n)
    some = np.flatnonzero(w[:-1])
    return Model(ids[some], w[some], float(w[-1]))


def score_column(model: Model, docs: DataFrame) -> Column:
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([sent.value.score(t) for t in texts], dtype="float64")

    return score("text")


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    score = score_column(fit(docs, labels), docs)
    return docs.select(
        "doc_id", F.coalesce(~for_training(F.col("doc_id")), F.lit(False)).alias("held_out"), score.alias("score")
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, columns as they were."""
    return docs.where(score_column(fit(docs, labels), docs) < threshold)

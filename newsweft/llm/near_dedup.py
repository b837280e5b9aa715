"""Near-duplicates by MinHash signatures and an inverted join on their coordinates.

A document's set holds the distinct 5-word shingles of its lower-cased (A-Z) whole text, words being
runs of ``[^\\x20\\x09-\\x0D]``; shorter texts have their whole word sequence as one shingle. Documents
are linked when ``100 * intersection >= 75 * union``, and a component's smallest doc_id stays.

1. Documents with the same set (by a 128-bit digest) form a class with a number; one of each goes on.
2. A class has ``COORDINATES`` minima. Two classes are worth comparing when ``MATCHES`` of them agree,
   so they agree on one of the ``COORDINATES - MATCHES + 1`` rarest of either: only this prefix is
   posted. Frequent coordinate values, such as those of a passage that many documents share, come last
   and are skipped; they count in full signatures only.
3. Posting lists are joined as stars: each list's most central member (whose values recur most) against
   the others. Pairs that agree often enough are confirmed on full sets, and components contracted.
4. Lists whose members are still in different components may hide further links. A large group of
   texts that resemble each other just too little would give every pair here, so these members meet
   again on the rarest of their shingles: two linked sets share one of the first 25 per cent (of the
   larger) and 14 per cent (of the smaller) in the order of rarity, and late meetings are skipped when
   too few shingles follow. Members of one component need no further proof. These bounds are exact;
   ``FEWEST`` equal coordinates are asked for all the same, to spare the comparison of full sets.

At a similarity of exactly 0.75 the number of equal coordinates has mean 48 and deviation 3.5: fewer
than ``MATCHES`` = 31 occur about once in a million, fewer than ``FEWEST`` = 22 once in 10^12, and far
less often above 0.75.

Null and empty texts have an empty set, are linked with nothing and stay. A null ``doc_id`` is a
document of its own and stays. Rows that repeat a ``doc_id`` are one document with the union of their
links, whatever their texts are. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsweft.llm.store import saved

WORDS = 5
COORDINATES = 64
MATCHES = 31
FEWEST = 22  # equal coordinates of pairs that share their rarest shingles
SPOKES = 256  # pairs of one hub that a task compares in one go
_ODD = np.random.default_rng(20).integers(0, 2**63, size=COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) < 100_000 and len(word) < 40:
            self[word] = h
        return h


_WORDS = _Words()


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles. ``bytes`` lower-cases A-Z and splits at
    ASCII white space, which is what is wanted here."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if isinstance(text, str) else []
    h = np.fromiter(map(_WORDS.__getitem__, words), dtype=np.uint64, count=len(words))
    if not len(h):
        return h
    n = max(1, len(h) - WORDS + 1)
    out = np.full(n, min(len(h), WORDS), dtype=np.uint64)
    for i in range(min(WORDS, len(h))):
        out = (out ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
    return np.unique(out)


def signature(s: np.ndarray) -> np.ndarray:
    """The upper 32 bits of each coordinate's minimum, in blocks so that memory does not follow the text."""
    best = np.full(COORDINATES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(s), 512):
        np.minimum(best, (s[at : at + 512, None] * _ODD).min(axis=0), out=best)
    return (best >> np.uint64(32)).astype(np.uint32)


SIGNED = "doc_id long, text_md5 string, n_shingles long, digest binary, signature binary"


def signed(docs: DataFrame) -> DataFrame:
    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sets = [shingles(t) for t in frame["text"]]
            yield pd.DataFrame(
                {
                    "doc_id": frame["doc_id"].astype("Int64"),
                    "text_md5": frame["text_md5"],
                    "n_shingles": [len(s) for s in sets],
                    "digest": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets],
                    "signature": [signature(s).tobytes() for s in sets],
                }
            )

    return _named(docs).mapInPandas(rows, SIGNED)


def _named(docs: DataFrame) -> DataFrame:
    """doc_id, text, text_md5: what tells rows apart that share a doc_id."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def _tokens(classes: DataFrame) -> DataFrame:
    """(doc, token) for every coordinate: the token is a 64-bit mix of the coordinate and its value."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = np.arange(COORDINATES, dtype=np.uint64) << np.uint64(32)
        for frame in frames:
            if len(frame):
                values = np.frombuffer(b"".join(frame["signature"]), dtype=np.uint32).reshape(-1, COORDINATES).astype(np.uint64)
                token = (values | place) * np.uint64(0x9E3779B97F4A7C15)
                yield pd.DataFrame({"doc": np.repeat(frame["doc"].to_numpy(), COORDINATES), "token": token.view(np.int64).ravel()})

    return classes.select("doc", "signature").mapInPandas(rows, "doc long, token long")


def postings(classes: DataFrame) -> DataFrame:
    """doc, token, central: the prefix of rarest tokens that at least two classes have.

    ``central`` is how often the class's tokens recur in all, the same on each of its rows.
    """
    tokens = _tokens(classes)
    shared = saved(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared")
    known = tokens.join(shared, "token")
    # tokens of a single class are the rarest and use up the prefix without being posted
    ranked = known.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("t"))  # at most 64 each
    prefix = F.lit(COORDINATES - MATCHES + 1) - (F.lit(COORDINATES) - F.size("t"))
    ranked = ranked.withColumns({"central": F.aggregate("t", F.lit(0).cast("long"), lambda a, x: a + x["n"]), "prefix": prefix})
    return ranked.where("prefix > 0").select("doc", "central", F.explode(F.slice("t", 1, F.col("prefix"))).alias("t")).select(
        "doc", "central", F.col("t.token").alias("token")
    )


def _agree(pairs: DataFrame, classes: DataFrame, matches: int) -> DataFrame:
    """Pairs (a, b) whose sizes allow the similarity and whose signatures agree in ``matches`` places."""
    side = classes.select("doc", "n_shingles", "signature")
    for name in ("a", "b"):
        pairs = pairs.join(side.select(*(F.col(c).alias(f"{c}_{name}") for c in side.columns)), F.col(name) == F.col(f"doc_{name}"))
    small, large = F.least("n_shingles_a", "n_shingles_b"), F.greatest("n_shingles_a", "n_shingles_b")

    @F.pandas_udf("int")
    def agreeing(x: pd.Series, y: pd.Series) -> pd.Series:
        left, right = (np.frombuffer(b"".join(s), dtype=np.uint32).reshape(-1, COORDINATES) for s in (x, y))
        return pd.Series((left == right).sum(axis=1).astype(np.int32))

    return pairs.where(small * 100 >= large * 75).where(agreeing("signature_a", "signature_b") >= matches).select("a", "b")


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) that are linked by their full sets. The texts of all b stream past the text of
    their a; a hub with many pairs is dealt to several tasks."""
    shares = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / SPOKES).cast("int").alias("shares"))
    dealt = pairs.join(shares, "a").withColumn("share", F.pmod(F.xxhash64("b"), F.col("shares")).cast("int"))
    hubs = shares.select(F.col("a").alias("doc"), "a", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(None).cast("long").alias("b"))
    roles = hubs.unionByName(dealt.select(F.col("b").alias("doc"), "a", "share", "b"))

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hub, own = None, None
        for frame in frames:
            linked = []
            for a, b, text in zip(frame["a"].array, frame["b"].array, frame["text"].array):
                if pd.isna(b):
                    hub, own = a, shingles(text)
                    continue
                if a != hub:
                    raise ValueError(f"the text of {a} does not come before its pairs")
                other = shingles(text)
                both = len(np.intersect1d(own, other, assume_unique=True))
                if 100 * both >= 75 * (len(own) + len(other) - both):
                    linked.append((a, int(b)))
            yield pd.DataFrame(linked, columns=["a", "b"], dtype="int64")

    stream = roles.join(texts, "doc").select("a", "share", "b", "text").repartition("a", "share")
    return stream.sortWithinPartitions("a", "share", F.col("b").asc_nulls_first()).mapInPandas(rows, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links``: repeated minima over neighbours and over their roots."""
    links = saved(links.select("a", "b").distinct(), "links")
    both = saved(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "both")
    root = saved(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node"), "roots")
    while True:
        of = root.select(F.col("node").alias("b"), F.col("root").alias("near"))
        least = both.join(of, "b").groupBy("a").agg(F.min("near").alias("near")).withColumnRenamed("a", "node")
        hop = root.join(least, "node").select("node", F.least("root", "near").alias("hop"), F.col("root").alias("was"))
        up = root.select(F.col("node").alias("hop"), F.col("root").alias("over"))
        new = saved(hop.join(up, "hop", "left").select("node", F.least("hop", F.coalesce("over", "hop")).alias("root"), "was"), "roots")
        root = new.select("node", "root")
        if new.where("root <> was").limit(1).count() == 0:
            return root


def _with_roots(rows: DataFrame, roots: DataFrame) -> DataFrame:
    named = roots.select(F.col("node").alias("doc"), "root")
    return rows.join(named, "doc", "left").withColumn("root", F.coalesce("root", "doc"))


def _open(lists: DataFrame) -> DataFrame:
    """Tokens whose lists lie in several components."""
    spread = lists.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    return spread.where("low <> high").select("token")


def star_pairs(lists: DataFrame) -> DataFrame:
    """(a, b): every posting against the most central member of its list."""
    hub = lists.groupBy("token").agg(F.max(F.struct("central", (-F.col("doc")).alias("minus"))).alias("s"), F.count(F.lit(1)).alias("n"))
    hub = hub.where("n > 1").select("token", (-F.col("s.minus")).alias("a"))
    return lists.join(hub, "token").where("a <> doc").select("a", F.col("doc").alias("b"))


def rare_shingle_pairs(members: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b) of ``members`` (doc, root) in different components that share one of their rarest shingles.

    For sets x, y with x no larger than y, a link needs 3/7 of the sum of their sizes in common, so at
    least 6/7 of x and 3/4 of y: the order of rarity cannot postpone the first common one any further.
    """

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 500):
                part = frame.iloc[at : at + 500]
                sets = [shingles(t) for t in part["text"]]
                sizes = [len(s) for s in sets]
                yield pd.DataFrame(
                    {
                        "doc": np.repeat(part["doc"].to_numpy(), sizes),
                        "root": np.repeat(part["root"].to_numpy(), sizes),
                        "size": np.repeat(np.array(sizes, dtype=np.int32), sizes),
                        "shingle": np.concatenate(sets).view(np.int64),
                    }
                )

    every = texts.join(members, "doc").select("doc", "root", "text").mapInPandas(rows, "doc long, root long, size int, shingle long")
    every = saved(every, "shingles")
    shared = every.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # no more than the shingles of one text; those of no other member come first and are only counted
    ranked = every.join(shared, "shingle").groupBy("doc", "root", "size").agg(F.array_sort(F.collect_list(F.struct("n", "shingle"))).alias("s"))
    first = F.col("size") - F.size("s")
    length = F.col("size") - F.ceil(F.col("size") * 3 / 4) + 1 - first
    posted = ranked.where(length > 0).select("doc", "root", "size", first.alias("first"), F.posexplode(F.slice("s", 1, length.cast("int"))).alias("i", "s"))
    posted = posted.select("doc", "root", "size", (F.col("first") + F.col("i") + 1).alias("place"), F.col("s.shingle").alias("shingle"))
    posted = saved(posted, "rare")
    x = posted.where("7 * (place - 1) <= size").select("shingle", *[F.col(c).alias(f"{c}_x") for c in ("doc", "root", "size", "place")])
    y = posted.select("shingle", *[F.col(c).alias(f"{c}_y") for c in ("doc", "root", "size", "place")])
    fit = (
        (F.struct("size_x", "doc_x") < F.struct("size_y", "doc_y"))
        & (F.col("root_x") != F.col("root_y"))
        & (F.col("size_x") * 100 >= F.col("size_y") * 75)
        & (7 * (1 + F.least(F.col("size_x") - F.col("place_x"), F.col("size_y") - F.col("place_y"))) >= 3 * (F.col("size_x") + F.col("size_y")))
    )
    return x.join(y, "shingle").where(fit).select(F.col("doc_x").alias("a"), F.col("doc_y").alias("b"))


def class_components(classes: DataFrame, docs: DataFrame, same: DataFrame) -> DataFrame:
    """(node, root) over the classes, for those that are linked. ``same`` (a, b) are links known before."""
    lists = saved(postings(classes), "postings")
    met = classes.join(lists.select("doc").distinct(), "doc", "left_semi").select("doc", "one.doc_id", "one.text_md5")
    # rows that repeat an id with its text would come twice
    texts = saved(_named(docs).join(met, ["doc_id", "text_md5"]).select("doc", "text").dropDuplicates(["doc"]), "texts")

    def linked(pairs: DataFrame, matches: int) -> DataFrame:
        likely = saved(_agree(pairs.distinct(), classes, matches), "likely")
        return saved(confirmed(likely, texts), "confirmed")

    links = linked(star_pairs(lists), MATCHES).unionByName(same)
    named = _with_roots(lists.select("token", "doc"), components(links))
    members = saved(named.join(_open(named), "token", "left_semi").select("doc", "root").distinct(), "open")
    return components(links.unionByName(linked(rare_shingle_pairs(members, texts), FEWEST)))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``."""
    rows = saved(signed(docs), "signed")
    filled = rows.where("n_shingles > 0 and doc_id is not null")
    classes = filled.groupBy("digest").agg(
        F.min(F.struct("doc_id", "text_md5")).alias("one"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature")
    )
    # numbered while written, once
    classes = saved(classes.withColumn("doc", F.monotonically_increasing_id()), "classes")
    own = saved(filled.join(classes.select("digest", "doc"), "digest").select("doc_id", "doc").distinct(), "own")
    several = own.groupBy("doc_id").agg(F.min("doc").alias("a"), F.max("doc").alias("z")).where("a <> z").select("doc_id", "a")
    same = own.join(several, "doc_id").where("doc <> a").select("a", F.col("doc").alias("b"))
    roots = class_components(classes, docs, same)
    named = _with_roots(classes.select("digest", "doc", "one.doc_id"), roots)
    least = named.groupBy("root").agg(F.min("doc_id").alias("least"))
    named = named.select("digest", "root").join(least, "root").select("digest", F.col("least").alias("root"))
    columns = ["digest", *[c for c in rows.columns if c != "digest"], "root"]
    alone = rows.where("n_shingles = 0 or doc_id is null").withColumn("root", F.col("doc_id"))
    every = filled.join(named, "digest").select(*columns).unionByName(alone.select(*columns))
    return every.select("doc_id", "n_shingles", F.col("root").alias("component_id"), F.col("root").eqNullSafe(F.col("doc_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, columns as they were."""
    kept = near_duplicates(docs).where("kept").select(F.col("doc_id").alias("stays")).distinct().alias("k")
    return docs.alias("d").join(kept, F.col("d.doc_id").cast("long").eqNullSafe(F.col("k.stays")), "left_semi")

"""Token counts that follow edits.

Each document has a segment tree over its pre-tokens: a leaf sums characters and tokens of up to
``LEAF`` pre-tokens, an inner node its two children. An edit finds its leaf by the character sums,
scans pre-tokens from that leaf's start (a boundary, as pre-tokens look at most two characters ahead)
until it meets an old leaf boundary behind the edit, and updates the sums above the leaves in between. The
rest of the document is neither scanned nor encoded again.

An edit is (start, removed, inserted) in characters of the text as the edits before it left it; it is
clipped to the text. Tokens are those of ``byte_bpe_50k`` with the strings of special tokens read as
ordinary text. Null texts count as empty; null edits and null parts of one change nothing. Documents and
edits are columns of the same row, so nothing is shuffled. Repeated rows are counted alike; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsweft.llm.store import saved

LEAF = 32
RANKS = "byte_bpe_50k.tiktoken"
EDITS = "array<struct<start:int,removed:int,inserted:string>>"


class Counter:
    """Tokens of single pre-tokens, with a bounded cache."""

    def __init__(self, ranks: str) -> None:
        with open(ranks, "rb") as lines:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self._bpe = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        counter = self

        class Known(dict):
            def __missing__(self, piece: str) -> int:
                n = len(counter._bpe.encode_ordinary(piece))
                if len(self) < 200_000 and len(piece) < 40:
                    self[piece] = n
                return n

        self.tokens = Known()

    def leaves(self, pieces: list[str], per_leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
        """Characters and tokens of every ``per_leaf`` pre-tokens."""
        if not pieces:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.arange(0, len(pieces), per_leaf)
        sums = []
        for of in (len, self.tokens.__getitem__):
            sums.append(np.add.reduceat(np.fromiter(map(of, pieces), dtype=np.int64, count=len(pieces)), at))
        return sums[0], sums[1]


@lru_cache(maxsize=2)
def counter(ranks: str | None = None) -> Counter:
    return Counter(ranks or public_tokenizers.path(RANKS))


class Tree:
    """Sums of characters (row 0) and tokens (row 1) in heap order: node 1 is the root, leaves follow inner nodes."""

    def __init__(self, sums: np.ndarray) -> None:
        self.sums = sums
        self.width = sums.shape[1] // 2

    @classmethod
    def over(cls, chars: np.ndarray, tokens: np.ndarray) -> Tree:
        width = 1
        while width < len(chars):
            width *= 2
        sums = np.zeros((2, 2 * width), dtype=np.int64)
        sums[0, width : width + len(chars)], sums[1, width : width + len(tokens)] = chars, tokens
        level = width
        while level > 1:
            sums[:, level // 2 : level] = sums[:, level : 2 * level].reshape(2, -1, 2).sum(axis=2)
            level //= 2
        return cls(sums)

    @classmethod
    def read(cls, blob: bytes) -> Tree:
        return cls(np.frombuffer(blob, dtype=np.int64).reshape(2, -1).copy())

    def blob(self) -> bytes:
        return self.sums.tobytes()

    @property
    def n_chars(self) -> int:
        return int(self.sums[0, 1])

    @property
    def n_tokens(self) -> int:
        return int(self.sums[1, 1])

    def leaf_at(self, char: int) -> tuple[int, int]:
        """The leaf that holds a character, and the place where it begins."""
        node, begin = 1, 0
        while node < self.width:
            node *= 2
            if begin + self.sums[0, node] <= char:
                begin += int(self.sums[0, node])
                node += 1
        return node - self.width, begin

    def put(self, first: int, chars: np.ndarray, tokens: np.ndarray) -> None:
        """New sums for successive leaves and for everything above them."""
        low, high = self.width + first, self.width + first + len(chars) - 1
        self.sums[0, low : high + 1], self.sums[1, low : high + 1] = chars, tokens
        while low > 1:
            low, high = low // 2, high // 2
            self.sums[:, low : high + 1] = self.sums[:, 2 * low : 2 * high + 2].reshape(2, -1, 2).sum(axis=2)


def build(text: str, count: Counter) -> Tree:
    return Tree.over(*count.leaves(count.pattern.findall(text)))


def edit(text: str, tree: Tree, start: int, removed: int, inserted: str, count: Counter) -> tuple[str, Tree, int]:
    """The text after the edit, its tree, and how many pre-tokens were encoded for it."""
    start = min(max(start, 0), len(text))
    end = min(start + max(removed, 0), len(text))
    new = text[:start] + inserted + text[end:]
    grown = len(new) - len(text)
    leaf, begin = tree.leaf_at(max(0, min(start - 2, len(text) - 1))) if text else (0, 0)
    last, old_end = leaf, begin + int(tree.sums[0, tree.width + leaf])
    pieces: list[str] = []
    at = begin
    while at < len(new):
        piece = count.pattern.match(new, at).group()
        pieces.append(piece)
        at += len(piece)
        while (old_end < end or old_end < at - grown) and last + 1 < tree.width:
            last += 1
            old_end += int(tree.sums[0, tree.width + last])
        if old_end >= end and old_end == at - grown:
            break
    else:  # to the end of the text
        last = tree.width - 1
    places = last - leaf + 1
    per_leaf = max(LEAF, -(-len(pieces) // places))
    if per_leaf <= 4 * LEAF:
        chars, tokens = (np.zeros(places, np.int64) for _ in range(2))
        c, t = count.leaves(pieces, per_leaf)
        chars[: len(c)], tokens[: len(t)] = c, t
        tree.put(leaf, chars, tokens)
    else:  # more leaves than there are places: the tree is laid out anew, from sums
        c, t = count.leaves(pieces)
        low, high = tree.width + leaf, tree.width + last + 1
        old = tree.sums[:, tree.width : low], tree.sums[:, high:]
        joined = [np.concatenate([old[0][i], x, old[1][i]]) for i, x in enumerate((c, t))]
        some = joined[0] > 0
        tree = Tree.over(joined[0][some], joined[1][some])
    return new, tree, len(pieces)


def trees(text: Column, ranks: str | None = None) -> Column:
    """The tree of each text as bytes, to be stored beside it."""

    @F.pandas_udf("binary")
    def built(texts: pd.Series) -> pd.Series:
        count = counter(ranks)
        return pd.Series([build(t if isinstance(t, str) else "", count).blob() for t in texts], dtype=object)

    return built(text)


EDITED = "text string, tree binary, tokens_before long, tokens_after long, pretokens_encoded long"


def edited(text: Column, tree: Column, edits: Column, keep_text: bool = True, ranks: str | None = None) -> Column:
    """Text, tree and counts after the edits; without ``keep_text`` only the counts are returned."""

    @F.pandas_udf(EDITED)
    def run(texts: pd.Series, blobs: pd.Series, lists: pd.Series) -> pd.DataFrame:
        count, out = counter(ranks), []
        for t, blob, edits in zip(texts, blobs, lists):
            t, tree, encoded = t if isinstance(t, str) else "", Tree.read(blob), 0
            before = tree.n_tokens
            for e in edits if edits is not None else ():
                if e is not None and e["start"] is not None:
                    t, tree, n = edit(t, tree, int(e["start"]), int(e["removed"] or 0), e["inserted"] or "", count)
                    encoded += n
            out.append((t if keep_text else None, tree.blob() if keep_text else None, before, tree.n_tokens, encoded))
        return pd.DataFrame(out, columns=["text", "tree", "tokens_before", "tokens_after", "pretokens_encoded"])

    return run(text, tree, edits.cast(EDITS))


def own_edits() -> Column:
    """The query's edits: 24 characters give way to source and language at a place drawn from the id,
    then the tenth part of the text is cut out in its middle."""
    n = F.length(F.coalesce("text", F.lit("")))
    place = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % (n + 1)
    put = F.concat(F.lit(" "), F.coalesce("source", F.lit("")), F.lit("'s "), F.coalesce("lang", F.lit("")), F.lit("\n "))
    edit_ = lambda a, b, c: F.struct(a.cast("int").alias("start"), b.cast("int").alias("removed"), c.alias("inserted"))
    return F.array(edit_(place, F.lit(24), put), edit_(F.floor(n / 2), F.floor(n / 10), F.lit("")))


def recount(docs: DataFrame, edits: Column | None = None, ranks: str | None = None) -> DataFrame:
    """doc_id, tokens_before, tokens_after, pretokens_encoded for every row of ``docs``."""
    edits = own_edits() if edits is None else edits
    done = edited(F.col("text"), trees(F.col("text"), ranks), edits, keep_text=False, ranks=ranks)
    counts = docs.select("doc_id", done.alias("d")).select("doc_id", "d.tokens_before", "d.tokens_after", "d.pretokens_encoded")
    return saved(counts, "counts")

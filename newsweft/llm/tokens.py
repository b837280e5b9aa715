"""Token ids of whole texts, with a bounded cache of pieces that recur."""

from __future__ import annotations

import base64
import re
from functools import cached_property, lru_cache
from json import load

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

JSON = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
CACHED = 100_000  # pieces a worker keeps
# A blank before a character that is not white space always begins a token, whatever stands left of it,
# so a text in which every blank is one of those can be encoded word by word.
OTHER_BLANK = re.compile(r" (?:\s|\Z)")


class Encoder:
    """The ids that ``tokenizers`` gives for ``byte_bpe_50k.json`` without special tokens added.

    Words go through the same vocabulary's byte-pair ranks, which are several times faster; texts that
    contain the string of a special token go through ``tokenizers`` itself.
    """

    def __init__(self, json: str, ranks: str) -> None:
        self._json = json
        with open(json, encoding="utf-8") as description:
            self._special = [t["content"] for t in load(description)["added_tokens"]]
        with open(ranks, "rb") as lines:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self._bpe = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
        self._cache: dict[str, bytes] = {}

    @cached_property
    def _full(self) -> Tokenizer:
        """Large, and needed for few texts if any."""
        return Tokenizer.from_file(self._json)

    def _plain(self, text: str) -> bytes:
        return np.array(self._bpe.encode_ordinary(text), dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as unsigned little-endian 32-bit numbers."""
        if any(s in text for s in self._special):
            return np.array(self._full.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if OTHER_BLANK.search(text):
            return self._plain(text)
        first, *words = text.split(" ")
        cache = self._cache
        try:
            return self._plain(first) + b"".join([cache[w] for w in words])
        except KeyError:
            out = [self._plain(first)]
            for w in words:
                ids = cache.get(w)
                if ids is None:
                    ids = self._plain(" " + w)
                    if len(cache) < CACHED and len(w) < 40:
                        cache[w] = ids
                out.append(ids)
            return b"".join(out)


@lru_cache(maxsize=2)
def encoder(json: str | None = None, ranks: str | None = None) -> Encoder:
    """One encoder per worker process; the files default to the installed public tokenizers."""
    return Encoder(json or public_tokenizers.path(JSON), ranks or public_tokenizers.path(RANKS))

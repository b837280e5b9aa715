"""Pieces of DuckDB SQL that several operators' counterparts share."""

from __future__ import annotations

CRC_TABLE = (
    "crc_table AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::BIGINT, range(8)), "
    "lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc)"
)


def crc32(text: str) -> str:
    """The crc32 of a VARCHAR of code points below U+0100 in UTF-8; ``crc_table`` must be in the FROM clause."""
    code = "CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [194 + (unicode(c) >= 192)::BIGINT, 128 + unicode(c)::BIGINT % 64] END"
    octets = f"flatten(list_transform(string_split({text}, ''), lambda c: {code}))"
    step = "xor(s >> 8, crc[xor(s & 255, b) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda s, b: {step}), 4294967295)"


def lower_az(text: str) -> str:
    return f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

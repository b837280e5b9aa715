"""Repair of a conversation's structure by cheapest edits, as an integer-minimum DAG.

Rows of a conversation are kept, given another role or deleted, and empty turns are inserted, until
the roles' initials read ``(s?(ua)+)?``. A node of the DAG is (row, what stood last); each row is left
by one edge. The weight of an edge is one integer: its cost in the high digits and, at the row's own
place in the low ones, a digit for the letters that the edge adds to the audit: ``D ID IK IR K R`` in
ASCII order. No such group of letters begins another, so numbers compare as the audits do; the last
digit is the insertion at the end (0: none, so that a shorter audit comes first). The least integer
from the first node therefore decides cost, audit and every tie, and its digits are the edits.

Two insertions between the same rows never pay: without both, the rest is legal and 6 cheaper, or only
a system turn is left, whose deletion costs 4.

Conversations are of any length: the low digits span ``BLOCK`` rows, and the last digit of a block is
the rank of what follows among the four nodes it can go on from. All four continuations have equally
many digits, so ranks compare as they do.

A conversation's rows are streamed twice in order, first as a byte a row (its role and fault), then
with their texts to hash what is left; a task never holds a conversation's texts. The audit and the
hash are one value for a whole conversation, which is why one task streams it.

Defined: null role, text, conv_id or turn count as one space where they are read as text; rows without
conv_id are one conversation; null turns come first. Rows of one turn are ordered by role and text;
repeated rows are duplicates. An initial other than s, u, a fits nowhere. An empty table gives an
empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsweft.llm.sqltext import CRC_TABLE, crc32
from newsweft.llm.store import saved

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3  # costs
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)  # what an inserted or rerolled turn becomes after each
ROLE = {USER: "user", ASSISTANT: "assistant"}
GROUPS = ("D", "ID", "IK", "IR", "K", "R")  # letters of a row's digit 1..6, in ASCII order
BLANK, DUPLICATE, CUT = 1, 2, 3  # faults
BLOCK = 256
WHITE = " \t\n\x0b\x0c\r"


def _moves(kind: int, fault: int) -> tuple:
    """For each node, ``(next node, cost, digit)`` of every edge that leaves it over a row."""
    out = []
    for at in range(4):
        edges = []
        for inserted in (False, True):
            here, cost = (NEXT[at], INSERT) if inserted else (at, 0)
            edges.append((here, cost + DELETE, "ID" if inserted else "D"))
            if fault in (BLANK, DUPLICATE):
                continue
            cost += TRUNCATED if fault == CUT else 0
            edges.append((NEXT[here], cost + REROLE, "IR" if inserted else "R"))
            kept = {0: SYSTEM if here == START else None, 1: USER if here != USER else None, 2: ASSISTANT if here == USER else None}.get(kind)
            if kept is not None:
                edges.append((kept, cost + KEEP, "IK" if inserted else "K"))
        out.append(tuple((to, cost, GROUPS.index(letters) + 1) for to, cost, letters in edges))
    return tuple(out)


MOVES = [_moves(code & 3, code >> 2) for code in range(16)]  # by row code: kind (s, u, a, other) + 4 * fault


def repair(codes: bytes) -> tuple[int, str]:
    """Least cost and its edits: a digit 1..6 for each row, then 1 or 0 for an insertion at the end."""
    blocks = [codes[i : i + BLOCK] for i in range(0, len(codes), BLOCK)] or [b""]
    costs, ends = [0, None, INSERT, 0], [0, None, 1, 0]
    low = []  # of each block from the last to the first: the digits from each node
    for block in reversed(blocks):
        bits = 3 * (len(block) + 1)
        value = [None if c is None else (c << bits) + e for c, e in zip(costs, ends)]
        place = 3
        for code in reversed(block):
            value = [
                min((value[to] + (cost << bits) + (digit << place) for to, cost, digit in MOVES[code][at] if value[to] is not None), default=None)
                for at in range(4)
            ]
            place += 3
        costs = [None if v is None else v >> bits for v in value]
        low.append([None if v is None else v & ((1 << bits) - 1) for v in value])
        order = sorted({x for x in low[-1] if x is not None})
        ends = [None if x is None else order.index(x) for x in low[-1]]
    edits, at = [], START
    for block, digits in zip(blocks, reversed(low)):
        for i, code in enumerate(block):
            digit = digits[at] >> 3 * (len(block) - i) & 7
            edits.append(digit)
            to = next(to for to, _, d in MOVES[code][at] if d == digit)
            digits[to], at = digits[at], to
    return costs[START], "".join(map(str, edits)) + ("1" if at == USER else "0")


def audit(edits: str) -> str:
    return "".join(GROUPS[int(d) - 1] for d in edits[:-1]) + "I" * int(edits[-1])


def _key(conv_id: Column) -> Column:
    """The conversation as text that is never null, so that no integer becomes a float on its way."""
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit(""))


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv, turn, role, text) after damage; ``conv`` is the key of the conversation."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    harm = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    rows = conversations.select(_key(F.col("conv_id")).alias("conv"), F.col("turn").cast("long").alias("turn"), spaced("role").alias("role"), spaced("text").alias("text"), harm.alias("harm"))
    text = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return (
        rows.where("harm <> 0")
        .withColumn("copy", F.explode(F.when(F.col("harm") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
        .select("conv", "turn", F.when(F.col("harm") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"))
    )


ORDER = ["conv", "kind", "timed", "turn", "role", "text"]


def _ordered(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """Heads before the rows of their conversation, these by turn, role and text; one conversation in one partition."""
    timed = {"kind": F.lit(1), "timed": F.col("turn").isNotNull(), "turn": F.coalesce("turn", F.lit(0).cast("long"))}
    blank = {"kind": F.lit(0), "timed": F.lit(False), "turn": F.lit(0).cast("long"), "role": F.lit(""), "text": F.lit("")}
    return rows.withColumns(timed).unionByName(heads.withColumns(blank), allowMissingColumns=True).repartition("conv")


_FOUND = "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, edits string"


def _judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row for each conversation of a sorted partition."""
    names = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "edits"]
    conv, codes, first, last, turns = None, bytearray(), None, None, 0

    def row():
        faults = [code >> 2 for code in codes]
        pairs = zip(codes, codes[1:])
        illegal = sum((a & 3, b & 3) not in ((0, 1), (1, 2), (2, 1)) for a, b in pairs)
        cost, edits = repair(bytes(codes))
        gaps = last - first + 1 - turns if turns else 0
        return (conv, gaps, faults.count(BLANK), faults.count(DUPLICATE), faults.count(CUT), illegal, cost, edits)

    for frame in frames:
        out = []
        for c, kind, timed, turn, code in zip(*(frame[x].tolist() for x in ("conv", "kind", "timed", "turn", "code"))):
            if kind == 0:
                if conv is not None:
                    out.append(row())
                conv, codes, first, last, turns = c, bytearray(), None, None, 0
                continue
            codes.append(code)
            if timed and turn != last:
                first, last, turns = turn if first is None else first, turn, turns + 1
        if out:
            yield pd.DataFrame(out, columns=names)
    if conv is not None:
        yield pd.DataFrame([row()], columns=names)


def judged(conversations: DataFrame) -> DataFrame:
    """One row for each conversation: its faults, the cost and the edits of its repair."""
    kind = F.when(F.col("role").startswith("s"), 0).when(F.col("role").startswith("u"), 1).when(F.col("role").startswith("a"), 2).otherwise(3)
    body = F.rtrim("text", F.lit(WHITE))
    again = Window.partitionBy("conv", "role", "text").orderBy("timed", "turn")
    fault = (
        F.when(F.col("kind") == 0, 0)
        .when(body == "", BLANK)
        .when(F.col("nth") > 1, DUPLICATE)
        .when(~F.substring(body, -1, 1).isin(".", "!", "?"), CUT)
        .otherwise(0)
    )
    heads = conversations.select(_key(F.col("conv_id")).alias("conv")).distinct()
    rows = _ordered(damaged(conversations), heads).withColumn("nth", F.row_number().over(again))
    coded = rows.withColumn("code", (kind + 4 * fault).cast("int")).sortWithinPartitions(*ORDER, "nth")
    return coded.select("conv", "kind", "timed", "turn", "code").mapInPandas(_judge, _FOUND)


def repaired_turns(conversations: DataFrame, found: DataFrame, state_of) -> DataFrame:
    """Streams each conversation's rows past its edits. ``state_of()`` makes an object with ``add(line)`` for
    each turn of the repaired conversation and ``value()`` at its end, which becomes ``result``."""

    def stream(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, edits, at, i, held = None, "", START, 0, None

        def end():
            if edits[-1] == "1":
                held.add(ROLE[ASSISTANT] + ":")
            return conv, held.value()

        for frame in frames:
            out = []
            for c, kind, e, role, text in zip(*(frame[x].tolist() for x in ("conv", "kind", "edits", "role", "text"))):
                if kind == 0:
                    if conv is not None:
                        out.append(end())
                    conv, edits, at, i, held = c, e, START, 0, state_of()
                    continue
                letters = GROUPS[int(edits[i]) - 1]
                i += 1
                if letters[0] == "I":
                    at = NEXT[at]
                    held.add(ROLE[at] + ":")
                if letters[-1] == "K":
                    at = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
                    held.add(f"{role}:{text}")
                elif letters[-1] == "R":
                    at = NEXT[at]
                    held.add(f"{ROLE[at]}:{text}")
            if out:
                yield pd.DataFrame(out, columns=["conv", "result"])
        if conv is not None:
            yield pd.DataFrame([end()], columns=["conv", "result"])

    rows = _ordered(damaged(conversations), found.select("conv", "edits")).sortWithinPartitions(*ORDER)
    return rows.select("conv", "kind", "edits", "role", "text").mapInPandas(stream, "conv string, result string")


class Sha256:
    """Hash of lines joined by line ends, without holding them."""

    def __init__(self) -> None:
        self.hash, self.begun = hashlib.sha256(), False

    def add(self, line: str) -> None:
        self.hash.update((("\n" if self.begun else "") + line).encode())
        self.begun = True

    def value(self) -> str:
        return self.hash.hexdigest()


def repair_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation."""

    @F.pandas_udf("string")
    def letters(edits: pd.Series) -> pd.Series:
        return edits.map(audit)

    found = saved(judged(conversations), "judged")
    hashes = repaired_turns(conversations, found, Sha256)
    conv_id = F.when(F.col("conv") != "", F.substring("conv", 2, 1 << 30).cast(conversations.schema["conv_id"].dataType))
    return found.join(hashes, "conv").select(
        conv_id.alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost",
        letters("edits").alias("audit"), F.col("result").alias("repaired_sha256"),
    )


_MUST = "f IN ('b', 'd')"
_EXTRA = "CASE WHEN f = 't' THEN 3 ELSE 0 END"
SQL = rf"""
WITH RECURSIVE {CRC_TABLE},
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS h FROM conversations, crc_table),
harmed AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
         CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS copy FROM keyed WHERE h <> 0),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
         left(role, 1) AS c, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS body FROM harmed),
faults AS MATERIALIZED (
  SELECT *, CASE WHEN body = '' THEN 'b' WHEN nth > 1 THEN 'd' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS f,
         lag(c) OVER (PARTITION BY conv_id ORDER BY i) || c AS pair FROM ordered),
convs AS (SELECT DISTINCT conv_id FROM conversations),
stats AS MATERIALIZED (
  SELECT convs.conv_id, count(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (WHERE f = 'b') AS blank, count(*) FILTER (WHERE f = 'd') AS duplicate, count(*) FILTER (WHERE f = 't') AS truncated,
         count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM convs LEFT JOIN faults ON convs.conv_id IS NOT DISTINCT FROM faults.conv_id GROUP BY convs.conv_id),
dp AS (
  SELECT conv_id, n AS i, [{{'k': 0, 's': '', 'o': []::VARCHAR[]}}, {{'k': 1000000000, 's': '', 'o': []::VARCHAR[]}},
                           {{'k': 3, 's': 'I', 'o': ['assistant:']}}, {{'k': 0, 's': '', 'o': []::VARCHAR[]}}] AS v FROM stats
  UNION ALL
  SELECT conv_id, i - 1, list_transform([1, 2, 3, 4], lambda g: list_sort([e[g],
           {{'k': e[nx[g]].k + 3, 's': 'I' || e[nx[g]].s, 'o': list_prepend(nr[g], e[nx[g]].o)}}])[1])
  FROM (
    SELECT dp.conv_id, dp.i, [3, 3, 4, 3] AS nx, ['user:', 'user:', 'assistant:', 'user:'] AS nr,
      list_transform([1, 2, 3, 4], lambda g: list_sort(list_filter([
        {{'k': v[g].k + 4, 's': 'D' || v[g].s, 'o': v[g].o}},
        CASE WHEN NOT ({_MUST}) AND ((c = 's' AND g = 1) OR (c = 'u' AND g <> 3) OR (c = 'a' AND g = 3)) THEN
          {{'k': v[position(c IN 'sua') + 1].k + {_EXTRA}, 's': 'K' || v[position(c IN 'sua') + 1].s, 'o': list_prepend(role || ':' || text, v[position(c IN 'sua') + 1].o)}} END,
        CASE WHEN NOT ({_MUST}) THEN
          {{'k': v[CASE WHEN g = 3 THEN 4 ELSE 3 END].k + 3 + {_EXTRA}, 's': 'R' || v[CASE WHEN g = 3 THEN 4 ELSE 3 END].s,
            'o': list_prepend(CASE WHEN g = 3 THEN 'assistant:' ELSE 'user:' END || text, v[CASE WHEN g = 3 THEN 4 ELSE 3 END].o)}} END
      ], lambda x: x IS NOT NULL))[1]) AS e
    FROM dp JOIN faults r ON r.conv_id IS NOT DISTINCT FROM dp.conv_id AND r.i = dp.i WHERE dp.i > 0))
SELECT s.conv_id, gaps, blank, duplicate, truncated, illegal, v[1].k::BIGINT AS cost, v[1].s AS audit,
       sha256(array_to_string(v[1].o, chr(10))) AS repaired_sha256
FROM stats s JOIN dp ON dp.conv_id IS NOT DISTINCT FROM s.conv_id AND dp.i = 0
"""

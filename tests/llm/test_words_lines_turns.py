"""Spelling variants, line dedup and conversation repair against plain counterparts and on awkward rows."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsweft.llm import conversations, lines, spelling
from newsweft.llm.queries import ORACLE, QUERIES
from tests.oracle_check import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_spelling_variants", "op12_line_dedup", "op13_conversation_repair"])
def test_query_matches_its_sql(spark, name):
    assert compare(spark, connect(SF), name, QUERIES[name], ORACLE[name], SF).startswith("ok")


# -- spelling ------------------------------------------------------------------------------------


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if c >= 2 and len(w) >= 7}
    near = {w: [v for v in n if one_edit(v, w)] for w in n}
    form = {w: min(near[w], key=lambda v: (-n[v], v), default=None) for w in n}
    form = {w: f if f is not None and n[f] >= 10 * n[w] else None for w, f in form.items()}

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (n[w], len(near[w]), form[w], form[w] and n[form[w]], root(w)) for w in n}


def letters(rnd, k):
    return "".join(rnd.choice("abcdeéÀ×ß") for _ in range(k))


def texts_of_variants():
    rnd = random.Random(11)
    words = []
    for _ in range(120):
        w = letters(rnd, rnd.choice([7, 8, 9, 12, 30]))
        words += [w] * rnd.choice([2, 30, 400])
        for _ in range(5):
            at, kind = rnd.randrange(len(w)), rnd.randrange(3)
            v = w[:at] + (rnd.choice("abcé") if kind else "") + w[at + (kind < 2) :]
            words += [v] * rnd.choice([1, 2, 3])
    words += ["hotprefix" + letters(rnd, 3) for _ in range(300)] * 2  # one large group
    words += ["chain" + "q" * k for k in (2, 3, 4) for _ in range(2 * 12 ** (k - 2))] + ["x" * 3000, "x" * 2999, "Ünïcödé", "SHORT"] * 2
    rnd.shuffle(words)
    rows = [(i, "1".join(words[k : k + 40])) for i, k in enumerate(range(0, len(words), 40))]
    return rows + [(None, None), (None, "chainqqqq, CHAINqqqq"), (5, ""), (5, "chainqqqq " * 3), (5, "chainqqqq " * 3), (7, "ab " * 40_000)]


@pytest.mark.parametrize("tile_rows", [256, 16])
def test_variants_equal_all_pairs(spark, monkeypatch, tile_rows):
    monkeypatch.setattr(spelling, "TILE_ROWS", tile_rows)
    rows = texts_of_variants()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("word", "n", "root", "key", "form")})
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.spelling_variants(docs).collect()}
    want = plain_variants(rows)
    assert got == want
    assert any(want[w][4] != want[w][2] for w in want if want[w][2])  # some path has two hops
    assert spelling.spelling_variants(docs.limit(0)).count() == 0


# -- lines ---------------------------------------------------------------------------------------


def plain_lines(rows, min_docs=10):
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line))
    docs = [(i, (t or "").split("\n")) for i, t in rows]
    n = Counter(k for _, ls in docs for k in {key(x) for x in ls})
    out = []
    for i, ls in docs:
        kept = [x for x in ls if not key(x) or n[key(x)] < min_docs]
        out.append((i, len(ls), len(ls) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def texts_of_lines():
    rnd = random.Random(12)
    common = [f"Common Line {i}" for i in range(40)]
    rows = []
    for i in range(120):
        mine = [f"own {i} {k}" for k in range(3)] + rnd.sample(common, rnd.choice([0, 3, 8]))
        mine = [rnd.choice(["", " ", "\t"]) + rnd.choice([x, x.upper()]) + rnd.choice(["", "\x0b ", "\r"]) for x in mine] + rnd.choice([[], ["", "  "]])
        rnd.shuffle(mine)
        rows.append((i, "\n".join(mine)))
    rows += [(3, " nbsp\nÉ"), (3, rows[3][1]), (None, None), (None, ""), (200, "\n".join(["same"] * 50)), (201, "long line " * 20_000 + "\nCommon line 1"), (None, "\x85x\n y")]
    return rows + [(300 + i, "whole copy\nof a text") for i in range(12)]


def dropped(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in df.collect()), key=repr)


def test_lines_equal_plain_counts(spark):
    rows = texts_of_lines()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("hi", "lo", "n", "shard", "_owner", "kept_text")})
    got = dropped(lines.line_dedup(docs))
    assert got == plain_lines(rows) and sum(r[2] for r in got) > 100
    assert lines.line_dedup(docs.limit(0)).count() == 0


def test_line_index_takes_deletions_back(spark):
    rows = texts_of_lines()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    first, second = docs.where("doc_id < 70 or doc_id is null"), docs.where("doc_id >= 70")
    state = lambda index: (
        {(r.hi, r.lo): r.n for r in index.counts.collect()},
        {r.shard: (sorted(np.frombuffer(r.table, dtype="<u2")), r.aside) for r in index.filters.collect() if any(r.table)},
    )
    index = lines.LineIndex(spark, shards=4)
    index.insert(first)
    before, answer = state(index), sorted(map(repr, index.drop_lines(docs).collect()))
    index.insert(second)
    whole = lines.LineIndex(spark, shards=4)
    whole.insert(docs)
    assert state(index)[0] == state(whole)[0]
    assert sorted(map(repr, index.drop_lines(docs).collect())) == sorted(map(repr, whole.drop_lines(docs).collect())) != answer
    index.delete(second)
    after = state(index)
    assert after[0] == before[0] and sorted(map(repr, index.drop_lines(docs).collect())) == answer
    assert {s: [x for x in t if x] for s, (t, _) in after[1].items()} == {s: [x for x in t if x] for s, (t, _) in before[1].items()}
    index.delete(first)
    assert index.counts.count() == 0 and not state(index)[1]


def test_cuckoo_filter_has_no_false_negatives_and_can_overflow():
    rnd = random.Random(3)
    keys = [rnd.randrange(-(1 << 63), 1 << 63) for _ in range(3000)]
    table = lines.Cuckoo.for_keys(len(keys))
    for k in keys:
        table.add(k)
    assert table.holds(np.array(keys)).all()
    others = np.array([rnd.randrange(-(1 << 63), 1 << 63) for _ in range(20_000)])
    assert table.holds(others).mean() < 0.005
    for k in keys[::2]:
        table.remove(k)
    again = lines.Cuckoo.load(table.dump(), sorted(table.aside))
    assert again.holds(np.array(keys[1::2])).all() and again.holds(np.array(keys[::2])).mean() < 0.01
    small = lines.Cuckoo(1)
    for k in range(1, 12):
        small.add(k)
    assert small.holds(np.arange(1, 12)).all() and len(small.aside) == 7
    for k in range(1, 12):
        small.remove(k)
    assert not small.aside and not small.table.any()


# -- conversations -------------------------------------------------------------------------------


def plain_rows(rows):
    """conv -> rows after damage, in order, and turns."""
    out = {c: [] for c, *_ in rows}
    for c, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        if h == 0:
            continue
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        out[c] += [(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    return {c: sorted(x, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, x in out.items()}


def faults_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        out.append("b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, faults):
    """(cost, audit, repaired lines) by a table of pairs (cost, audit), compared as they are."""
    nxt = {"": "u", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user:", "a": "assistant:"}
    inf = (10**9, "", ())
    after = {"": (0, "", ()), "s": inf, "u": (3, "I", ("assistant:",)), "a": (0, "", ())}
    for (_, role, text), f in zip(reversed(rows), reversed(faults)):
        extra, here = 3 * (f == "t"), {}
        for at in after:
            ways = [(after[at][0] + 4, "D" + after[at][1], after[at][2])]
            if f not in ("b", "d"):
                to = nxt[at]
                ways.append((after[to][0] + 3 + extra, "R" + after[to][1], (name[to] + text,) + after[to][2]))
                if role[:1] == to or (role[:1] == "s" and at == ""):
                    c = after[role[:1]]
                    ways.append((c[0] + extra, "K" + c[1], (f"{role}:{text}",) + c[2]))
            here[at] = min(ways)
        after = {at: min(here[at], (here[nxt[at]][0] + 3, "I" + here[nxt[at]][1], (name[nxt[at]],) + here[nxt[at]][2])) for at in here}
    return after[""]


def exhaustive(initials, faults):
    """(cost, audit) over every way to edit, with up to two insertions at each place."""
    gaps = [list(itertools.product("ua", repeat=k)) for k in range(3)]
    gaps = [g for k in gaps for g in k]
    best = None
    choices = []
    for c, f in zip(initials, faults):
        mine = [("D", "", 4)]
        if f not in ("b", "d"):
            mine += [("K", c, 3 * (f == "t"))] + [("R", r, 3 + 3 * (f == "t")) for r in "ua"]
        choices.append([("I" * len(g) + letter, "".join(g) + out, 3 * len(g) + cost) for g in gaps for letter, out, cost in mine])
    choices.append([("I" * len(g), "".join(g), 3 * len(g)) for g in gaps])
    for way in itertools.product(*choices):
        if re.fullmatch("(s?(ua)+)?", "".join(x[1] for x in way)):
            found = (sum(x[2] for x in way), "".join(x[0] for x in way))
            best = found if best is None else min(best, found)
    return best


def test_repair_is_the_least_of_all_edits():
    rnd = random.Random(13)
    code = lambda cs, fs: bytes("suax".index(c) + 4 * ["", "b", "d", "t"].index(f) for c, f in zip(cs, fs))
    for n in (0, 1, 2):
        for cs in itertools.product("suax", repeat=n):
            for fs in itertools.product(["", "b", "t"], repeat=n):
                cost, edits = conversations.repair(code(cs, fs))
                assert (cost, conversations.audit(edits)) == exhaustive(cs, fs)
    for _ in range(12):
        cs, fs = rnd.choices("suax", k=3), rnd.choices(["", "", "d", "t"], k=3)
        cost, edits = conversations.repair(code(cs, fs))
        assert (cost, conversations.audit(edits)) == exhaustive(cs, fs)


def test_conversations_equal_plain_repair(spark):
    rnd = random.Random(14)
    roles, ends = ["system", "user", "assistant", "user", "assistant", "tool", "", None], [".", "!", "?", "", " .\t", "… "]
    rows = []
    for c in range(150):
        for turn in rnd.sample(range(12), rnd.randrange(1, 9)):
            text = rnd.choice([None, "", " \n", "same text.", f"t{turn}"]) if rnd.random() < 0.4 else f"text {c} {turn}" + rnd.choice(ends)
            rows.append((c, None if rnd.random() < 0.05 else turn, rnd.choice(roles), text))
    rows += [(999, t, rnd.choice(["user", "assistant", "user", "system"]), f"x{t % 300}" + rnd.choice(ends)) for t in range(3000)]  # many blocks
    rows += [(998, i % 2, "user" if i % 2 else "assistant", "hello.") for i in range(3)] + [(None, None, None, None), (None, 1, "user", "q?"), (2**62 + 1, 1, "user", "x " * 100_000 + ".")]
    rows += rows[:40]  # repeated rows
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("clash") for c in ("conv", "kind", "edits", "cost", "nth")})
    got = {r.conv_id: r for r in conversations.repair_conversations(turns.repartition(5)).collect()}
    want = plain_rows(rows)
    assert got.keys() == want.keys()
    for c, x in want.items():
        faults, r = faults_of(x), got[c]
        cost, audit, out = cheapest(x, faults)
        known = {t for t, *_ in x if t is not None}
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(x, x[1:])]
        assert (r.cost, r.audit, r.repaired_sha256) == (cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())
        assert (r.blank, r.duplicate, r.truncated) == tuple(map(faults.count, "bdt"))
        assert r.gaps == (max(known) - min(known) + 1 - len(known) if known else 0)
        assert r.illegal == sum(p not in ("su", "ua", "au") for p in pairs)
    assert conversations.repair_conversations(turns.limit(0)).count() == 0

"""Parsing briefing documents: whole documents in, arrays of records out, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsweft.functions.text import (
    WS,
    blank_to_null,
    let,
    lines,
    one_per_key,
    parse_comma_list,
    parse_ticks,
    strip,
)

# Headings and labels of the briefing format.
DEEPENING = "Deepening"
FEEDBACK_HEADING = "## Your Feedback"
OTHER_SECTIONS = (
    "Top Articles", "New Concepts", "Knowledge Graph Update", "Suggested Explorations",
    "Your Feedback",
)
_HEADING = r"^### (\d+)\.\s+(.+)$"
_META = (
    r"\*\*Source\*\*:\s*(.+?)\s*\|\s*\*\*Relevance\*\*:\s*(\d+)/10\s*\|\s*\*\*Novelty\*\*:\s*(\d+)%"
)
_LABELLED = {
    "why": r"\*\*Why it is new to you\*\*:\s*(.+)",
    "what": r"\*\*What is new here\*\*:\s*(.+)",
    "insight": r"\*\*Novel insights\*\*:\s*(.+)",
    "concepts": r"\*\*Key Concepts\*\*:\s*(.+)",
    "related": r"\*\*Related Topics\*\*:\s*(.+)",
    "url": r"\[Read original\]\((.+?)\)",
}
TRUE_WORDS = ("yes", "y", "true", "1", "x")
QUALITIES = ("like", "dislike", "broken")


def _last(rows: Column) -> Column:
    return F.get(rows, F.size(rows) - 1)


def _section_name(line: Column) -> Column:
    return strip(F.regexp_extract(line, r"^## (.+)$", 1))


def _kind(line: Column) -> Column:
    """What a line is; the first description that fits counts."""
    kind = (
        F.when(_section_name(line).isin(DEEPENING, *OTHER_SECTIONS), "section")
        .when(line.rlike(_HEADING), "heading")
        .when(line.rlike(_META), "meta")
    )
    for name, pattern in _LABELLED.items():
        kind = kind.when(line.rlike(pattern), name)
    plain = (
        F.when(line.rlike(rf"\A[{WS}]*+---[{WS}]*+\z"), "rule")
        .when(line.rlike(rf"\A[{WS}]*+[^{WS}]"), "text")
        .otherwise("blank")
    )
    # most lines are text, and no pattern needs to look at those
    marked = line.startswith("##") | line.contains("**") | line.contains("[Read original](")
    return F.when(marked, kind.otherwise(plain)).otherwise(plain)


def _text_of(rows: Column, kind: str) -> Column:
    """Captured text of the last line of a kind."""
    found = _last(F.filter(rows, lambda r: r["kind"] == kind))["line"]
    return F.coalesce(strip(F.regexp_extract(found, _LABELLED[kind], 1)), F.lit(""))


def _summary(rows: Column) -> Column:
    """Plain lines from the first one to the next break; none after the concepts are named."""
    at = F.transform(
        rows,
        lambda r, i: F.struct(
            r["kind"].alias("kind"),
            r["line"].alias("line"),
            i.alias("i"),
            (
                r["kind"].isin("concepts", "section", "rule")
            ).alias("stop"),
            ((r["kind"] == "concepts") & (F.size(parse_ticks(r["line"])) > 0)).alias("named"),
        ),
    )

    first = lambda a, test: F.get(F.filter(a, test), F.lit(0))["i"]

    def upto_named(a: Column) -> Column:
        end = F.coalesce(first(a, lambda r: r["named"]), F.size(a))
        return F.struct(a.alias("a"), end.alias("end"))

    def from_text(s: Column) -> Column:
        start = first(s["a"], lambda r: (r["kind"] == "text") & (r["i"] < s["end"]))
        return F.struct(s["a"].alias("a"), start.alias("start"))

    def upto_stop(s: Column) -> Column:
        stop = first(s["a"], lambda r: r["stop"] & (r["i"] > s["start"]))
        count = F.coalesce(stop, F.size(s["a"])) - s["start"]
        kept = F.filter(F.slice(s["a"], s["start"] + 1, count), lambda r: r["kind"] == "text")
        return F.array_join(F.transform(kept, lambda r: strip(r["line"])), " ")

    # each bound is found once, before the rows are looked at with it
    bounds = let(let(at, upto_named), from_text)
    return let(bounds, lambda s: F.when(s["start"].isNull(), F.lit("")).otherwise(upto_stop(s)))


def _article(head: Column, rows: Column, deepening: Column) -> Column:
    meta = _last(F.filter(rows, lambda r: r["kind"] == "meta"))["line"]
    number = lambda i: F.coalesce(
        blank_to_null(F.regexp_extract(meta, _META, i)).try_cast("int"), F.lit(0)
    )
    insight = _last(F.filter(rows, lambda r: r["kind"].isin("what", "insight")))
    insight_text = F.when(
        insight["kind"] == "what", F.regexp_extract(insight["line"], _LABELLED["what"], 1)
    ).otherwise(F.regexp_extract(insight["line"], _LABELLED["insight"], 1))
    concepts = _last(F.filter(rows, lambda r: r["kind"] == "concepts"))["line"]
    empty = F.array().cast("array<string>")
    return F.struct(
        F.regexp_extract(head, _HEADING, 1).try_cast("int").alias("article_number"),
        strip(F.regexp_extract(head, _HEADING, 2)).alias("title"),
        F.coalesce(strip(F.regexp_extract(meta, _META, 1)), F.lit("")).alias("source_name"),
        _text_of(rows, "url").alias("url"),
        number(2).alias("relevance_score"),
        number(3).alias("novelty_pct"),
        _text_of(rows, "why").alias("novelty_explanation"),
        _summary(rows).alias("summary"),
        F.coalesce(strip(insight_text), F.lit("")).alias("novel_insights"),
        F.coalesce(
            parse_ticks(F.regexp_extract(concepts, _LABELLED["concepts"], 1)), empty
        ).alias("key_concepts"),
        parse_comma_list(_text_of(rows, "related")).alias("related_topics"),
        deepening.alias("is_deepening"),
    )


def parse_articles(md: Column) -> Column:
    """The articles of a briefing, in order. Numbers beyond an int are NULL, or 0 where there is a default."""
    rows = F.transform(lines(md), lambda x: F.struct(_kind(x).alias("kind"), x.alias("line")))

    def blocks(r: Column) -> Column:
        where = lambda kind: F.filter(
            F.transform(r, lambda x, i: F.when(x["kind"] == kind, i)), lambda i: i.isNotNull()
        )

        def each(at: Column) -> Column:
            return F.transform(
                at["heads"],
                lambda h, j: let(
                    F.slice(r, h + 2, F.coalesce(F.get(at["heads"], j + 1), F.size(r)) - h - 1),
                    lambda block: _article(
                        r[h]["line"],
                        block,
                        F.coalesce(
                            _section_name(
                                r[F.array_max(F.filter(at["sections"], lambda s: s < h))]["line"]
                            )
                            == DEEPENING,
                            F.lit(False),
                        ),
                    ),
                ),
            )

        return let(
            F.struct(where("heading").alias("heads"), where("section").alias("sections")), each
        )

    return let(rows, blocks)


def parse_feedback_line(line: Column) -> Column:
    """``- N: key=value, …`` as a record; NULL for other lines."""
    pattern = r"^-\s*(\d+)\s*:\s*(.*)$"
    rest = F.regexp_extract(line, pattern, 2)
    pair = r"(\w+)\s*=\s*([^,]*)"
    pairs = F.transform(
        F.arrays_zip(
            F.regexp_extract_all(rest, F.lit(pair), F.lit(1)).alias("k"),
            F.regexp_extract_all(rest, F.lit(pair), F.lit(2)).alias("v"),
        ),
        lambda p: F.struct(F.lower(p["k"]).alias("k"), F.lower(strip(p["v"])).alias("v")),
    )

    def record(ps: Column) -> Column:
        values = lambda key: F.transform(
            F.filter(ps, lambda p: (p["k"] == key) & (p["v"] != "")), lambda p: p["v"]
        )
        ratings = F.filter(
            F.transform(
                values("interest"), lambda v: strip(F.split(v, "/")[0]).try_cast("int")
            ),
            lambda n: n.between(1, 5),
        )
        return F.struct(
            F.regexp_extract(line, pattern, 1).try_cast("int").alias("article_number"),
            F.coalesce(_last(values("read")).isin(*TRUE_WORDS), F.lit(False)).alias("read"),
            _last(ratings).alias("interest"),
            _last(F.filter(values("quality"), lambda v: v.isin(*QUALITIES))).alias("quality"),
        )

    return F.when(line.rlike(pattern), let(pairs, record))


def parse_feedback(md: Column) -> Column:
    """Records of the feedback form; the last line of a number counts, numbers beyond an int do not."""

    def form(ls: Column) -> Column:
        heads = F.transform(ls, lambda x: strip(x) == FEEDBACK_HEADING)
        start = F.array_position(heads, F.lit(True))

        def to_end(s: Column) -> Column:
            rest = F.slice(s["ls"], s["start"].cast("int") + 1, F.size(s["ls"]))
            stops = F.transform(
                rest, lambda x: x.startswith("## ") & (strip(x) != FEEDBACK_HEADING)
            )
            end = F.array_position(stops, F.lit(True)).cast("int")
            return F.when(end > 0, F.slice(rest, 1, end - 1)).otherwise(rest)

        none = F.array().cast("array<string>")
        body = F.when(start > 0, let(F.struct(ls.alias("ls"), start.alias("start")), to_end)).otherwise(none)
        parsed = F.filter(
            F.transform(F.transform(body, strip), parse_feedback_line), lambda f: f.isNotNull()
        )
        return let(F.coalesce(parsed, F.array().cast(_FEEDBACK_ROWS)), lambda rows: one_per_key(rows, lambda f: f["article_number"], last=True))

    return let(lines(md), form)


_FEEDBACK_ROWS = "array<struct<article_number:int,read:boolean,interest:int,quality:string>>"


def heading_metadata(md: Column) -> Column:
    """Number, title and concepts of each article heading, for matching feedback."""
    head, named = r"^###\s+(\d+)\.\s+(.+)$", r"^\*\*Key Concepts\*\*:\s*(.+)$"

    def blocks(ls: Column) -> Column:
        heads = F.filter(
            F.transform(ls, lambda x, i: F.when(x.rlike(head), i)), lambda i: i.isNotNull()
        )

        def one(h: Column, end: Column) -> Column:
            inside = F.filter(F.slice(ls, h + 2, end - h - 1), lambda x: x.rlike(named))
            ticks = F.regexp_extract_all(
                F.regexp_extract(_last(inside), named, 1), F.lit("`([^`]+)`"), F.lit(1)
            )
            return F.struct(
                F.regexp_extract(ls[h], head, 1).try_cast("int").alias("article_number"),
                strip(F.regexp_extract(ls[h], head, 2)).alias("title"),
                F.coalesce(ticks, F.array().cast("array<string>")).alias("concepts"),
            )

        return let(
            heads,
            lambda hs: F.transform(
                hs, lambda h, j: one(h, F.coalesce(F.get(hs, j + 1), F.size(ls)))
            ),
        )

    return let(lines(md), blocks)


def section(md: Column, heading: str) -> Column:
    """Text between a second-level heading and the next one; NULL when there is none."""
    pattern = rf"(?dms)^## {heading}\s*\n(.*?)(?=^## |\z)"
    return F.when(md.rlike(pattern), F.regexp_extract(md, pattern, 1))


def briefing_metadata(md: Column) -> Column:
    """Counters, runtime, new concepts, graph numbers and explorations of a briefing."""
    number = lambda text, pattern, i=1: blank_to_null(
        F.regexp_extract(text, pattern, i)
    ).try_cast("int")
    counters = (
        r"\*\*Articles Scanned\*\*:\s*(\d+)\s*\|\s*\*\*Passed Relevance\*\*:\s*(\d+)\s*\|\s*"
        r"\*\*In Briefing\*\*:\s*(\d+)"
    )
    graph = section(md, "Knowledge Graph Update")
    top = r"\*\*Most connected topic\*\*:\s*([^\n]+?)\s*\((\d+)\s*connections?\)"
    explored = section(md, "Suggested Explorations")
    tip = r"(?dm)^\d+\.\s+\*\*(.+?)\*\*\s*--\s*(.+)$"
    none = F.array().cast("array<string>")
    return F.struct(
        number(md, counters, 1).alias("articles_scanned"),
        number(md, counters, 2).alias("articles_relevant"),
        number(md, counters, 3).alias("articles_briefed"),
        blank_to_null(strip(F.regexp_extract(md, r"\*\*Pipeline Runtime\*\*:\s*([^\n]+)", 1))).alias(
            "pipeline_runtime"
        ),
        F.coalesce(
            F.regexp_extract_all(
                section(md, "New Concepts"), F.lit(r"(?dm)^- \*\*(.+?)\*\*:"), F.lit(1)
            ),
            none,
        ).alias("new_concepts"),
        number(graph, r"\*\*Nodes added\*\*:\s*(\d+)").alias("nodes_added"),
        number(graph, r"\*\*Edges added\*\*:\s*(\d+)").alias("edges_added"),
        number(graph, r"\*\*Total knowledge nodes\*\*:\s*(\d+)").alias("total_nodes"),
        blank_to_null(F.regexp_extract(graph, top, 1)).alias("most_connected"),
        number(graph, top, 2).alias("most_connected_edges"),
        F.coalesce(
            F.zip_with(
                F.regexp_extract_all(explored, F.lit(tip), F.lit(1)),
                F.regexp_extract_all(explored, F.lit(tip), F.lit(2)),
                lambda a, b: F.concat(a, F.lit(" -- "), b),
            ),
            none,
        ).alias("explorations"),
    )

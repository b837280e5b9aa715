"""Reference resolution of links (RFC 3986, section 5) as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsweft.functions.text import let

_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?\z"


def _split(url: Column) -> Column:
    part = lambda i: F.regexp_extract(url, "(?s)" + _PARTS, i)
    return F.struct(
        F.lower(part(1)).alias("scheme"),
        url.rlike("^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//").alias("has_host"),
        part(2).alias("host"),
        part(3).alias("path"),
        part(4).alias("query"),
        part(5).alias("fragment"),
    )


def _remove_dots(path: Column) -> Column:
    def fold(segments: Column) -> Column:
        start = F.array().cast("array<string>")
        kept = F.aggregate(
            segments,
            start,
            lambda acc, s: F.when(s == ".", acc)
            .when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1))))
            .otherwise(F.concat(acc, F.array(s))),
        )
        last = F.element_at(segments, -1)
        closed = F.when(last.isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
        return F.array_join(closed, "/")

    dotted = path.rlike(r"(^|/)\.\.?(/|\z)")
    return F.when(dotted, let(F.split(path, "/"), fold)).otherwise(path)


def resolve_url(base: Column, ref: Column) -> Column:
    """``ref`` as seen from the page ``base``."""

    def join(pair: Column) -> Column:
        b, r = pair["b"], pair["r"]
        prefix = F.concat(b["scheme"], F.lit("://"), b["host"])
        merged = F.when(b["path"] == "", F.concat(F.lit("/"), r["path"])).otherwise(
            F.concat(F.regexp_extract(b["path"], "(?s)^(.*/)?", 0), r["path"])
        )
        path = F.when(r["path"] == "", b["path"]).otherwise(
            _remove_dots(F.when(r["path"].startswith("/"), r["path"]).otherwise(merged))
        )
        query = F.when((r["path"] == "") & (r["query"] == ""), b["query"]).otherwise(r["query"])
        relative = F.concat(prefix, path, query, r["fragment"])
        other_host = F.concat(b["scheme"], F.lit("://"), r["host"], r["path"], r["query"], r["fragment"])
        return (
            F.when((r["scheme"] != "") & ((r["scheme"] != b["scheme"]) | r["has_host"]), ref)
            .when(r["has_host"], other_host)
            .otherwise(relative)
        )

    pair = F.struct(_split(base).alias("b"), _split(ref).alias("r"))
    return F.when(ref == "", base).otherwise(let(pair, join))

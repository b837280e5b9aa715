"""Text expressions: Column in, Column out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip() removes, as a character-class body that
# java.util.regex and RE2 both accept.
WS = (
    r"\t\n\x0b\x0c\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
# The line breaks of Python's str.splitlines().
LINE_BREAK = r"[\n\x0b\x0c\r\x1c-\x1e\x{85}\x{2028}\x{2029}](?:(?<=\r)\n)?"
TAG = "<[^>]+>"
DROPPED_ELEMENT = r"(?is)<(style|script|noscript|svg|head)[\s>].*?</\1>"
CJK = r"[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}]"
LETTER = r"\p{L}"
# Wording of block pages.
CHALLENGE = (
    r"(?is)verify[^\n]{0,20}(human|not a robot|you are a)"
    r"|captcha"
    r"|challenge-platform"
    r"|cf-browser-verification"
    r"|checking[^\n]{0,20}browser"
    r"|bot[^\n]{0,15}(check|detection|protect)"
    r"|security[^\n]{0,15}check"
    r"|access[^\n]{0,15}denied"
    r"|please[^\n]{0,20}(enable|allow)[^\n]{0,20}(javascript|cookies)"
    r"|unusual[^\n]{0,15}traffic"
    r"|automated[^\n]{0,15}access"
    r"|rate[^\n]{0,10}limit"
)
CHARS_PER_TOKEN = 4
CSS_RESIDUE = r"\{--[a-zA-Z]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.transform(F.array(value), body)[0]


def one_per_key(rows: Column, key: Callable[[Column], Column], *, last: bool = False) -> Column:
    """The first (or last) element of each key, in the array's order; elements without a key go.
    ``rows`` is a lambda variable, see ``let``. The keys are sorted, not searched one by one."""
    keyed = F.array_sort(
        F.filter(
            F.transform(rows, lambda r, i: F.struct(key(r).alias("k"), i.alias("i"))),
            lambda x: x["k"].isNotNull(),
        )
    )
    step = 1 if last else -1
    ends = let(
        keyed,
        lambda ks: F.filter(ks, lambda x, j: ~F.get(ks, j + step)["k"].eqNullSafe(x["k"])),
    )
    return F.transform(F.array_sort(F.transform(ends, lambda x: x["i"])), lambda i: rows[i])


def strip(c: Column) -> Column:
    """From the first to the last character that is no white space; the class is tried at both ends only."""
    return F.regexp_extract(c, rf"(?s)\A[{WS}]*+(.*[^{WS}])", 1)


def lines(c: Column) -> Column:
    return F.split(c, LINE_BREAK)


def quote(text: str) -> str:
    return rf"\Q{text}\E"


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, TAG, "")


def drop_elements(c: Column) -> Column:
    return F.regexp_replace(c, DROPPED_ELEMENT, "")


def clean_text(c: Column) -> Column:
    """Trimmed non-blank lines joined by newlines."""
    trimmed = F.transform(lines(c), strip)
    return F.array_join(F.filter(trimmed, lambda x: x != ""), "\n")


def extract_body(html: Column) -> Column:
    """Readable text of a page: article, else main, else the longest div, else everything."""

    def choose(page: Column) -> Column:
        article = strip_tags(F.regexp_extract(page, r"(?is)<article[\s>].*?</article>", 0))
        main = strip_tags(F.regexp_extract(page, r"(?is)<main[\s>].*?</main>", 0))
        divs = F.transform(
            F.regexp_extract_all(page, F.lit(r"(?is)<div[\s>].*?</div>"), F.lit(0)),
            lambda d, i: F.struct(
                F.length(strip_tags(d)).alias("n"), (-i).alias("i"), strip_tags(d).alias("t")
            ),
        )
        longest = F.coalesce(F.array_max(divs)["t"], F.lit(""))

        def after_article(a: Column) -> Column:
            return F.when(F.length(a) >= 200, a).otherwise(let(main, after_main))

        def after_main(m: Column) -> Column:
            return F.when(F.length(m) >= 200, m).otherwise(let(longest, after_div))

        def after_div(d: Column) -> Column:
            return F.when(F.length(d) >= 100, d).otherwise(strip_tags(page))

        return let(article, after_article)

    return clean_text(let(drop_elements(html), choose))


def is_mostly_cjk(c: Column, threshold: float = 0.3) -> Column:
    letters = F.regexp_count(c, F.lit(LETTER))
    han = F.regexp_count(c, F.lit(CJK))
    return F.coalesce((letters > 0) & (han > letters * F.lit(threshold)), F.lit(False))


def is_challenge_page(html: Column) -> Column:
    sample = F.substring(html, 1, 15000)
    structure = F.regexp_count(sample, F.lit("<p|<article|<section"))
    return (F.length(html) <= 100000) & sample.rlike(CHALLENGE) & (structure < 5)


def usable_html(html: Column) -> Column:
    return F.coalesce((F.length(html) > 500) & ~is_challenge_page(html), F.lit(False))


def estimate_tokens(c: Column) -> Column:
    return F.floor(F.length(c) / CHARS_PER_TOKEN)


def chunk_text(
    c: Column, max_tokens: int, *, separator: str = "\n\n", hard_cut: bool = False
) -> Column:
    """Greedy packing of paragraphs into chunks of about ``max_tokens``.

    Only the positions where chunks start are folded; the text itself is sliced afterwards.
    With ``hard_cut`` a chunk longer than the budget is cut into budget-sized pieces.
    """
    budget = max_tokens * CHARS_PER_TOKEN

    def pack(paragraphs: Column) -> Column:
        start = F.struct(F.array(F.lit(0)).alias("at"), F.lit(0).alias("n"), F.lit(0).alias("i"))

        def step(acc: Column, para: Column) -> Column:
            size = F.length(para)
            full = (acc["n"] + size > budget) & (acc["i"] > F.element_at(acc["at"], -1))
            return F.struct(
                F.when(full, F.concat(acc["at"], F.array(acc["i"]))).otherwise(acc["at"]).alias("at"),
                F.when(full, size).otherwise(acc["n"] + size).alias("n"),
                (acc["i"] + 1).alias("i"),
            )

        def cut(at: Column) -> Column:
            return F.transform(
                at,
                lambda s, j: F.array_join(
                    F.slice(
                        paragraphs,
                        s + 1,
                        F.coalesce(F.get(at, j + 1), F.size(paragraphs)) - s,
                    ),
                    separator,
                ),
            )

        return let(F.aggregate(paragraphs, start, step)["at"], cut)

    packed = let(F.split(c, quote(separator)), pack)
    if hard_cut:
        packed = F.flatten(
            F.transform(packed, lambda x: F.regexp_extract_all(x, F.lit(f"(?s).{{1,{budget}}}"), F.lit(0)))
        )
    return F.when(estimate_tokens(c) <= max_tokens, F.array(c)).otherwise(packed)


def embed_text(concepts: Column, summary: Column) -> Column:
    return F.concat(F.array_join(concepts, ", "), F.lit(". "), summary)


def strip_thinking(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?s)<think>.*?</think>\s*", ""))


def extract_json(c: Column) -> Column:
    """Model answer without its reasoning; the first fenced block when there is one."""

    def unfence(text: Column) -> Column:
        fence = r"(?s)```(?:json)?\s*\n(.*?)```"
        return F.when(text.rlike(fence), strip(F.regexp_extract(text, fence, 1))).otherwise(text)

    return let(strip_thinking(c), unfence)


def briefing_urls(md: Column) -> Column:
    return F.regexp_extract_all(md, F.lit(r"\[Read original\]\(([^)]+)\)"), F.lit(1))


def post_title(text: Column) -> Column:
    """First 120 characters on one line, marked when the text goes on."""
    head = strip(F.translate(F.substring(text, 1, 120), "\n", " "))
    return F.when(F.length(text) > 120, F.concat(head, F.lit("..."))).otherwise(head)


def toot_title(title: Column) -> Column:
    cut = F.concat(F.substring(title, 1, 117), F.lit("..."))
    return F.when(F.length(title) > 120, cut).otherwise(title)


def parse_ticks(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit("`([^`]+)`"), F.lit(1)), strip)


def parse_comma_list(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ","), strip), lambda x: x != "")


def safe_filename(c: Column) -> Column:
    cleaned = F.btrim(F.regexp_replace(c, r'[<>:"/\\|?*]', "_"), F.lit(". "))
    return F.when(cleaned == "", F.lit("unnamed")).otherwise(cleaned)


def format_duration(seconds: Column) -> Column:
    """Tenths below a minute, else minutes and seconds; halves round up."""
    minutes, tenths = F.floor(seconds / 60), F.floor(seconds * 10 + 0.5)
    long_form = F.format_string("%dm %ds", minutes, F.floor(seconds - minutes * 60 + 0.5))
    short_form = F.format_string("%d.%ds", F.floor(tenths / 10), tenths % 10)
    return F.when(seconds < 60, short_form).otherwise(long_form)


def days_since(ts: Column, now: Column) -> Column:
    """Fractional days, NULL for a missing timestamp."""
    return (F.unix_micros(now) - F.unix_micros(ts)) / F.lit(86400000000.0)


def json_list(c: Column) -> Column:
    """Text holding a JSON array of strings; anything else is an empty list."""
    decoded = F.from_json(c, "array<string>", {"mode": "PERMISSIVE"})
    return F.coalesce(F.filter(decoded, lambda x: x.isNotNull()), F.array().cast("array<string>"))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")

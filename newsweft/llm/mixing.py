"""Mixing sources to target weights by hierarchical budgets.

Leaves are (domain, language, source). The token budget goes down the tree in proportion to the weights
of siblings, each child capped by what its leaves can give (their tokens times ``max_epochs``). What a
child cannot take goes to its siblings; as a parent never gets more than its subtree can give, only
what all siblings together could not take stays with the ancestors. Within a leaf every epoch orders
the documents anew by a seeded hash: whole epochs are taken whole, the last one as the longest prefix
whose tokens the budget covers.

What prefixes leave unspent, because a leaf's next document is longer, is poured out again: first over the
sources of the language, then over the languages of the domain, last over all domains, each time to the
nodes furthest below their budgets first (ties by name), whose prefixes go on. In the end less than one
document's tokens are unspent: those of the document at which the last round stopped.

The cut of a leaf is found on sums over 4,096 hash ranges and then within one of these, so no task sees
a whole leaf. The outcome is a hash to cut at for each leaf; documents are kept by comparing their own
hash with it, joined to the small table of leaves only.

Tokens are the runs of ``[^\\x20\\x09-\\x0D]`` in the whole text. Null languages and sources are leaves of
their own. Documents without tokens are never selected. Rows that repeat a ``doc_id`` have the same
place in the order and come or stay together. An empty table gives an empty result; other columns pass through.
Budgets are whole numbers, exact up to a product of budget and weight of 2**63.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsweft.llm.store import saved, unused

SHARE = (3, 5)  # of the corpus's tokens
SEED = 7
NAMES = ("_domain", "_lang", "_source")
# Weights of the query's tree; what is not named has weight 1.
DOMAIN_WEIGHTS = {"d0": 4, "d1": 3, "d2": 2, "d3": 1}
LANG_WEIGHTS = {"en": 5, "de": 2, "fr": 2, "es": 1}


def source_domain() -> Column:
    """The domain of a source in the given tables, which have no such column: its number modulo 4."""
    digits = F.regexp_extract(F.coalesce(F.col("source"), F.lit("")), "[0-9]+$", 0)
    return F.concat(F.lit("d"), F.when(digits != "", (F.expr("try_cast(regexp_extract(source, '[0-9]+$', 0) as bigint)") % 4).cast("string")).otherwise(""))


def _weight(name: str, of: dict[str, int]) -> Column:
    out = F.lit(1)
    for value, weight in sorted(of.items()):
        out = F.when(F.col(name) == value, weight).otherwise(out)
    return out.cast("long")


def _leaf(docs: DataFrame, domain: Column) -> DataFrame:
    named = {"_domain": domain, "_lang": F.coalesce(F.col("lang"), F.lit("")), "_source": F.coalesce(F.col("source"), F.lit(""))}
    return docs.withColumns(named)


def _hash(epoch: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def share_out(children: DataFrame, parent: list[str], own: str, weight: Column) -> DataFrame:
    """Adds ``budget`` to ``children`` (with ``room``), from the parents' ``given``: weight times the level
    at which the children that fill up first leave exactly the rest to the others."""
    by_fill = Window.partitionBy(*parent).orderBy(F.col("room") / F.col("_w"), own)
    rows = children.withColumn("_w", weight).withColumns(
        {
            "_left": F.col("given") - F.coalesce(F.sum("room").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "_weights": F.sum("_w").over(by_fill.rowsBetween(0, Window.unboundedFollowing)),
        }
    )
    level = F.max(F.struct(F.col("_left") / F.col("_weights"), "_left", "_weights")).over(Window.partitionBy(*parent))
    rows = rows.withColumn("_level", level)
    portion = F.expr("(_w * _level._left) div _level._weights")
    return rows.withColumn("budget", F.greatest(F.lit(0), F.least("room", portion))).drop("_w", "_left", "_weights", "_level")


def budgets(leaves: DataFrame, share: tuple[int, int], max_epochs: int) -> DataFrame:
    """_domain, _lang, _source, tokens, room, budget from the leaves' tokens, and the budgets above them:
    of_root, of_domain, of_lang."""
    part, whole = share
    leaves = leaves.withColumn("room", F.col("tokens") * max_epochs)
    langs = leaves.groupBy("_domain", "_lang").agg(F.sum("room").alias("room"), F.sum("tokens").alias("tokens"))
    domains = langs.groupBy("_domain").agg(F.sum("room").alias("room"), F.sum("tokens").alias("tokens")).withColumn("_root", F.lit(0))
    total = F.sum("tokens").over(Window.partitionBy("_root"))
    domains = domains.withColumn("_all", total).withColumn("given", F.expr(f"(_all * {part}) div {whole}"))
    domains = share_out(domains, ["_root"], "_domain", _weight("_domain", DOMAIN_WEIGHTS))
    langs = langs.join(domains.select("_domain", F.col("given").alias("of_root"), F.col("budget").alias("given")), "_domain")
    langs = share_out(langs, ["_domain"], "_lang", _weight("_lang", LANG_WEIGHTS))
    of = [F.col("given").alias("of_domain"), F.col("budget").alias("given")]
    leaves = leaves.join(langs.select("_domain", "_lang", "of_root", *of), ["_domain", "_lang"])
    leaves = share_out(leaves, ["_domain", "_lang"], "_source", F.lit(1).cast("long"))
    return leaves.select(*NAMES, "tokens", "room", "of_root", "of_domain", F.col("given").alias("of_lang"), "budget")


def _go_on(rows: DataFrame, leaves: DataFrame, seed: int) -> DataFrame:
    """``leaves`` with ``epochs`` (whole ones), ``cut`` (hash of the last document of the epoch after them,
    null if none fits) and ``spent`` once ``extra`` is added to what is spent."""
    names = list(NAMES)
    more = leaves.where("extra > 0").withColumn("_upto", F.col("spent") + F.col("extra"))
    more = more.withColumns({"epochs": F.expr("_upto div tokens"), "rest": F.expr("_upto % tokens")}).drop("_upto", "cut", "spent", "extra")
    placed = rows.join(more.where("rest > 0").select(*names, "epochs", "rest"), names).withColumn("key", _hash(F.col("epochs"), seed))
    placed = placed.withColumn("range", F.substring("key", 1, 3))
    ranges = placed.groupBy(*names, "rest", "range").agg(F.sum("_n").alias("n"))  # at most 4,096 a leaf
    upto = F.sum("n").over(Window.partitionBy(*names).orderBy("range"))
    ranges = ranges.withColumn("upto", upto)
    crossed = ranges.where("upto >= rest").groupBy(*names).agg(F.min(F.struct("range", (F.col("upto") - F.col("n")).alias("before"))).alias("c"))
    crossed = crossed.select(*names, F.col("c.range").alias("at"), F.col("c.before").alias("before"))
    inside = placed.join(crossed, names).where(F.col("range") == F.col("at"))
    spent = F.col("before") + F.sum("_n").over(Window.partitionBy(*names).orderBy("key"))
    last = inside.withColumn("_spent", spent).where("_spent <= rest").groupBy(*names).agg(F.max(F.struct("key", "_spent")).alias("last"))
    # a range in which nothing more fits is cut before its first hash
    found = crossed.join(last, names, "left").select(
        *names,
        F.coalesce("last.key", F.when(F.col("before") > 0, F.col("at"))).alias("cut"),
        F.coalesce("last._spent", "before").alias("_got"),
    )
    more = more.join(found, names, "left").withColumn("spent", F.expr("epochs * tokens + coalesce(_got, 0)"))
    return leaves.where("extra = 0").drop("extra").unionByName(more.drop("rest", "_got"))


def _pour(leaves: DataFrame, depth: int) -> DataFrame:
    """Adds ``extra`` to ``leaves``: what the nodes of ``depth`` (0 root, 1 domain, 2 language) leave unspent,
    down the tree to the children furthest below their budgets, each as far as its leaves can take it."""
    path = ("_root", *NAMES)
    leaves = leaves.withColumn("_root", F.lit(0)).withColumn("_given", F.col(("of_root", "of_domain", "of_lang")[depth]))
    pool = None
    for level in range(depth + 1, len(path)):
        parent, own = list(path[:level]), path[level]
        sums = [F.sum(F.expr(e)).alias(n) for e, n in (("spent", "spent"), ("budget - spent", "short"), ("room - spent", "left"))]
        nodes = leaves.groupBy(*parent, own).agg(F.max("_given").alias("_given"), *sums)
        if pool is None:
            nodes = nodes.withColumn("given", F.col("_given") - F.sum("spent").over(Window.partitionBy(*parent)))
        else:
            nodes = nodes.join(pool, parent)
        first = Window.partitionBy(*parent).orderBy(F.desc("short"), own).rowsBetween(Window.unboundedPreceding, -1)
        rest = F.col("given") - F.coalesce(F.sum("left").over(first), F.lit(0))
        pool = nodes.select(*parent, own, F.greatest(F.lit(0), F.least("left", rest)).alias("given"))
    return leaves.join(pool.withColumnRenamed("given", "extra"), list(path)).drop("_root", "_given")


def cuts(docs: DataFrame, domain: Column, share: tuple[int, int], seed: int, max_epochs: int) -> DataFrame:
    """_domain, _lang, _source, tokens, budget, epochs (whole ones), cut (hash of the last document of
    the epoch after them, null if none fits), spent and more."""
    words = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    rows = saved(_leaf(docs, domain).select("doc_id", *NAMES, words.alias("_n")).where("_n > 0"), "counted")
    leaves = saved(budgets(rows.groupBy(*NAMES).agg(F.sum("_n").alias("tokens")), share, max_epochs), "budgets")
    none = {"epochs": F.lit(0).cast("long"), "cut": F.lit(None).cast("string"), "spent": F.lit(0).cast("long")}
    leaves = saved(_go_on(rows, leaves.withColumns(none).withColumn("extra", F.col("budget")), seed), "first")
    for depth in (2, 1, 0):
        leaves = saved(_go_on(rows, saved(_pour(leaves, depth), "poured"), seed), "cuts")
    return leaves


def mix(docs: DataFrame, domain: Column | None = None, share=SHARE, seed: int = SEED, max_epochs: int = 1) -> DataFrame:
    """The rows of ``docs`` that the budgets select, once for every epoch, with ``_domain``, ``_lang``,
    ``_source``, ``_n`` (tokens) and ``_epoch``."""
    domain = source_domain() if domain is None else domain
    leaves = cuts(docs, domain, share, seed, max_epochs).where("spent > 0").select(*NAMES, "epochs", "cut")
    leaves = leaves.withColumnsRenamed({"epochs": "_epochs", "cut": "_cut"})
    words = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    rows = _leaf(docs, domain).join(leaves, list(NAMES))
    once_more = F.coalesce(_hash(F.col("_epochs"), seed) <= F.col("_cut"), F.lit(False)).cast("int")
    rows = rows.withColumn("_times", F.col("_epochs").cast("int") + once_more).where("_times > 0").withColumn("_n", words).where("_n > 0")
    return rows.withColumn("_epoch", F.explode(F.sequence(F.lit(0), F.col("_times") - 1))).drop("_epochs", "_cut", "_times")


def selected(docs: DataFrame, max_epochs: int = 2) -> DataFrame:
    """doc_id, domain, lang, source, tokens, epoch of every selected document."""
    slim = docs.select("doc_id", "text", "lang", "source")
    return mix(slim, max_epochs=max_epochs).select(
        "doc_id", F.col("_domain").alias("domain"), F.col("_lang").alias("lang"), F.col("_source").alias("source"),
        F.col("_n").alias("tokens"), F.col("_epoch").alias("epoch"),
    )


def keep_mixed(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are selected, each at most once, columns as they were."""
    added = (*NAMES, "_n", "_epoch", "_epochs", "_cut", "_times")
    aside = {c: unused(docs, f"{c}_own") for c in docs.columns if c.lower() in added}
    rows = mix(docs.withColumnsRenamed(aside), max_epochs=1).drop(*added)
    return rows.withColumnsRenamed({own: c for c, own in aside.items()}).select(*docs.columns)


def _case(name: str, of: dict[str, int]) -> str:
    return f"CASE {name} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in of.items()) + " ELSE 1 END"


def _fill(source: str, parent: str, own: str) -> str:
    return f"""
  SELECT *, greatest(0, least(room, (w * lv.l) // lv.ws)) AS budget FROM (
    SELECT *, max({{'r': l::DOUBLE / ws::DOUBLE, 'l': l, 'ws': ws}}) OVER (PARTITION BY {parent}) AS lv FROM (
      SELECT *, (given - coalesce(sum(room) OVER (PARTITION BY {parent} ORDER BY room::DOUBLE / w, {own} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS l,
             (sum(w) OVER (PARTITION BY {parent} ORDER BY room::DOUBLE / w, {own} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS ws
      FROM ({source})))"""


def _round(i: int, depth: int | None) -> str:
    """spent{i} from spent{i - 1}: what nodes of ``depth`` leave is poured out; None: the first prefixes."""
    path, before = ("root", "domain", "lang", "source"), f"spent{i - 1}"
    parts = []
    if depth is None:
        poured = f"(SELECT *, budget AS extra FROM {before})"
    else:
        given = ("of_root", "of_domain", "of_lang")[depth]
        keys = ", ".join(path[: depth + 1])
        parts.append(f"pool{i}_{depth} AS (SELECT {keys}, (max({given}) - sum(spent))::BIGINT AS given FROM {before} GROUP BY {keys})")
        for level in range(depth + 1, len(path)):
            parent, own = ", ".join(path[:level]), path[level]
            parts.append(f"""pool{i}_{level} AS (
  SELECT {parent}, {own}, greatest(0, least(room, given - coalesce(sum(room) OVER (PARTITION BY {parent} ORDER BY short DESC, {own}
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))::BIGINT AS given
  FROM (SELECT {parent}, {own}, sum(budget - spent)::BIGINT AS short, sum(room - spent)::BIGINT AS room FROM {before} GROUP BY {parent}, {own})
  JOIN pool{i}_{level - 1} USING ({parent}))""")
        poured = f"(SELECT {before}.*, given AS extra FROM {before} JOIN pool{i}_3 USING (root, domain, lang, source))"
    parts.append(f"""got{i} AS (
  SELECT domain, lang, source, max(cum)::BIGINT AS got FROM (
    SELECT domain, lang, source, rest, sum(n) OVER (PARTITION BY domain, lang, source ORDER BY md5('{SEED}:' || epochs || ':' || doc_id)) AS cum
    FROM d JOIN (SELECT domain, lang, source, (spent + extra) // tokens AS epochs, (spent + extra) % tokens AS rest FROM {poured})
    USING (domain, lang, source) WHERE n > 0)
  WHERE cum <= rest GROUP BY ALL)""")
    parts.append(f"""spent{i} AS (
  SELECT p.* EXCLUDE (spent, extra), ((spent + extra) // tokens * tokens + coalesce(got, 0))::BIGINT AS spent
  FROM {poured} p LEFT JOIN got{i} USING (domain, lang, source))""")
    return ",\n".join(parts)


SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         'd' || coalesce((try_cast(nullif(regexp_extract(source, '[0-9]+$'), '') AS BIGINT) % 4)::VARCHAR, '') AS domain,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n
  FROM documents),
leaf AS (SELECT domain, lang, source, sum(n)::BIGINT AS tokens, 2 * sum(n)::BIGINT AS room FROM d WHERE n > 0 GROUP BY ALL),
b1 AS ({_fill(f"SELECT 0 AS root, domain, sum(room)::BIGINT AS room, ((SELECT sum(tokens) FROM leaf) * {SHARE[0]} // {SHARE[1]})::BIGINT AS given, {_case('domain', DOMAIN_WEIGHTS)} AS w FROM leaf GROUP BY domain", "root", "domain")}),
b2 AS ({_fill(f"SELECT x.*, b1.given AS of_root, b1.budget AS given FROM (SELECT domain, lang, sum(room)::BIGINT AS room, {_case('lang', LANG_WEIGHTS)} AS w FROM leaf GROUP BY domain, lang) x JOIN b1 USING (domain)", "domain", "lang")}),
b3 AS ({_fill("SELECT leaf.*, of_root, b2.given AS of_domain, b2.budget AS given, 1 AS w FROM leaf JOIN b2 USING (domain, lang)", "domain, lang", "source")}),
spent0 AS (SELECT 0 AS root, domain, lang, source, tokens, room, of_root, of_domain, given AS of_lang, budget::BIGINT AS budget, 0::BIGINT AS spent FROM b3),
{_round(1, None)},
{_round(2, 2)},
{_round(3, 1)},
{_round(4, 0)},
e AS (
  SELECT d.*, spent // tokens AS epochs, spent % tokens AS rest, md5('{SEED}:' || (spent // tokens) || ':' || doc_id) AS key
  FROM d JOIN spent4 USING (domain, lang, source) WHERE n > 0),
t AS (
  SELECT *, epochs + CASE WHEN sum(n) OVER (PARTITION BY domain, lang, source ORDER BY key) <= rest THEN 1 ELSE 0 END AS times FROM e)
SELECT doc_id, domain, lang, source, n AS tokens, unnest(range(0, times::BIGINT))::INTEGER AS epoch FROM t
"""

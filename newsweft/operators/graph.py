"""The concept graph: updates, novelty, decay, neighbourhoods and suggestions.

Articles enter as occurrences ``(url, seq, pos, concept, title)``, one row per concept mention in
rank order; edges as ``(a, b, relationship_type, first_seen)`` with ``a <= b`` and their articles as
``edge_sources(a, b, url, seq)``, so that a pair seen in very many articles is many rows and not
one wide one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsweft.functions.concepts import (
    assign_category,
    normalize_concept,
    usable_concepts,
)
from newsweft.functions.scoring import round_half_up
from newsweft.functions.text import days_since
from newsweft.lineage import Scratch
from newsweft.operators.components import both_ways, bridge_edges
from newsweft.operators.containment import contained_pairs
from newsweft.operators.skew import pairs_within, top_per_group

CO_OCCURRENCE = "co_occurrence"
LOW_NAMES = 1024


def occurrences(summaries: DataFrame) -> DataFrame:
    """One row per usable concept of ``summaries(url, seq, title, key_concepts)``."""
    return summaries.select(
        "url",
        "seq",
        "title",
        F.posexplode(usable_concepts(F.col("key_concepts"))).alias("pos", "concept"),
    )


def declared_relationships(summaries: DataFrame) -> DataFrame:
    """The last declared type per article and pair, either direction."""
    rel = summaries.select("url", F.posexplode("relationships").alias("pos", "r")).select(
        "url",
        "pos",
        normalize_concept(F.coalesce("r.from", F.lit(""))).alias("f"),
        normalize_concept(F.coalesce("r.to", F.lit(""))).alias("t"),
        F.coalesce("r.type", F.lit(CO_OCCURRENCE)).alias("type"),
    )
    return (
        rel.filter((F.col("f") != "") & (F.col("t") != ""))
        .groupBy("url", F.least("f", "t").alias("a"), F.greatest("f", "t").alias("b"))
        .agg(F.max_by("type", "pos").alias("type"))
    )


def update_nodes(nodes: DataFrame, occ: DataFrame, now: Column) -> DataFrame:
    """Count each mention; familiarity follows from the final count and the age of the node."""
    seen = occ.groupBy("concept").agg(F.count(F.lit(1)).alias("n"))
    known = F.col("first_seen").isNotNull()
    count = F.coalesce("encounter_count", F.lit(0)) + F.coalesce("n", F.lit(0))
    days = F.greatest(F.lit(1.0), F.coalesce(days_since(F.col("first_seen"), now), F.lit(1.0)))
    grown = F.least(F.lit(1.0), count * 0.1 + 0.05 * (1.0 / (1.0 + days / 7.0)))
    familiarity = (
        F.when(F.col("n").isNull(), F.col("familiarity"))
        .when(~known & (F.col("n") == 1), F.lit(0.1))
        .otherwise(grown)
    )
    carried = [c for c in ("interest_score", "interest_count") if c in nodes.columns]
    return nodes.join(seen, "concept", "full_outer").select(
        "concept",
        F.coalesce("first_seen", now).alias("first_seen"),
        F.when(F.col("n").isNotNull(), now).otherwise(F.col("last_seen")).alias("last_seen"),
        count.cast("long").alias("encounter_count"),
        familiarity.alias("familiarity"),
        F.coalesce("category", assign_category(F.col("concept"))).alias("category"),
        *carried,
    )


def _first_mentions(occ: DataFrame) -> DataFrame:
    """``(url, c, i, x)``: an article's mentions as one sorted list ``c``, and each concept's first mention ``x`` at ``i``.

    A concept's first mention has its least seq.
    """
    named = F.sort_array(F.collect_list(F.struct("concept", F.col("seq").isNull().alias("unknown"), "seq"))).alias("c")
    each = occ.groupBy("url").agg(named).select("url", "c", F.posexplode("c").alias("i", "x"))
    return each.filter((F.col("i") == 0) | ~F.get("c", F.col("i") - 1)["concept"].eqNullSafe(F.col("x.concept")))


def article_pairs(
    occ: DataFrame, relationships: DataFrame | None, *, block_rows: int | None = None
) -> DataFrame:
    """Concept pairs of each article with the type the article gives them.

    A pair comes out once per article however often it is named; a concept named twice is paired
    with itself. An article names a handful of concepts, so its mentions become one sorted list and
    its pairs are made in its own row; ``block_rows`` spreads the pairs of articles with very many.
    """
    if block_rows is None:
        # a first mention is met with all names that follow
        later = F.array_distinct(F.slice("c.concept", F.col("i") + 2, F.size("c")))
        every = _first_mentions(occ).select(
            "url", F.col("x.concept").alias("a"), F.explode(later).alias("b"), F.col("x.seq").alias("seq")
        )
    else:
        per_article = occ.repartition("url").groupBy("url", "concept").agg(
            F.min("seq").alias("seq"), F.count(F.lit(1)).alias("n")
        )
        pairs = pairs_within(per_article, "url", "concept", ["seq"], block_rows=block_rows).select(
            "url", "a", "b", F.col("a_seq").alias("seq")
        )
        loops = per_article.filter(F.col("n") > 1).select(
            "url", F.col("concept").alias("a"), F.col("concept").alias("b"), "seq"
        )
        every = pairs.unionByName(loops)
    if relationships is None:
        return every.withColumn("type", F.lit(None).cast("string"))
    typed = every.join(relationships.select("url", "a", "b", "type"), ["url", "a", "b"], "left")
    return typed.withColumn("type", F.when(F.col("type") != CO_OCCURRENCE, F.col("type")))


def article_ends(occ: DataFrame) -> DataFrame:
    """``(concept, url, seq)``: each concept of an article's pairs once, with the least seq of its pairs.

    What both ends of ``article_pairs`` fold to, without pairs: a concept is in pairs with all
    before it, whose seq they have, and gives its own seq to those with names that follow.
    """
    before = F.array_min(F.slice("c.seq", 1, F.col("i")))
    own = F.when(F.col("i") < F.size("c") - 1, F.col("x.seq"))
    return _first_mentions(occ).filter(F.size("c") > 1).select(
        F.col("x.concept").alias("concept"), "url", F.least(before, own).alias("seq")
    )


def article_neighbours(occ: DataFrame) -> DataFrame:
    """``(concept, near)``: for each concept of an article's pairs, in order, the concepts it is in pairs with there.

    What ``adjacent`` tells of the edges that the mentions make, without pairs. A concept that its
    article names twice is among its own neighbours.
    """
    others = F.concat(F.slice("c.concept", 1, F.col("i")), F.slice("c.concept", F.col("i") + 2, F.size("c")))
    return _first_mentions(occ).filter(F.size("c") > 1).select(
        F.col("x.concept").alias("concept"), F.array_distinct(others).alias("near")
    )


def update_edges(edges: DataFrame | None, pairs: DataFrame, now: Column) -> DataFrame:
    """The latest declared type wins; a pair never declared is a co-occurrence.

    Without ``edges`` the graph begins with these pairs; then what is asked of its ends reaches them
    before they are told apart.

    Pairs are many and few of them declared: the pairs are told apart by their hash table alone, as
    an aggregate that holds strings would sort them all, and types are sought among the declared.
    """
    types = pairs.filter(F.col("type").isNotNull() & F.col("seq").isNotNull()).groupBy("a", "b").agg(
        F.max_by("type", "seq").alias("new_type")
    )
    seen = pairs.select("a", "b").distinct().join(types, ["a", "b"], "left")
    if edges is None:
        return seen.select(
            "a", "b", F.coalesce("new_type", F.lit(CO_OCCURRENCE)).alias("relationship_type"), now.alias("first_seen")
        )
    return edges.join(seen, ["a", "b"], "full_outer").select(
        "a",
        "b",
        F.coalesce("new_type", "relationship_type", F.lit(CO_OCCURRENCE)).alias("relationship_type"),
        F.coalesce("first_seen", now).alias("first_seen"),
    )


def update_edge_sources(sources: DataFrame, pairs: DataFrame) -> DataFrame:
    """Each article once per edge, earlier entries kept."""
    rows = sources.select("a", "b", "url", "seq").unionByName(pairs.select("a", "b", "url", "seq"))
    return rows.groupBy("a", "b", "url").agg(F.min("seq").alias("seq"))


def new_concepts(nodes: DataFrame, occ: DataFrame) -> DataFrame:
    """Concepts the graph does not have, with the first article that brings them."""
    return (
        occ.join(nodes.select("concept"), "concept", "left_anti")
        .groupBy("concept")
        .agg(F.min(F.struct("seq", "pos", "title")).alias("f"))
        .select("concept", F.col("f.title").alias("title"), F.col("f.seq").alias("seq"), F.col("f.pos").alias("pos"))
    )


def graph_size(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.agg(F.count(F.lit(1)).alias("nodes")).withColumn(
        "edges", edges.agg(F.count(F.lit(1))).scalar()
    )


def edge_ends(edges: DataFrame) -> DataFrame:
    """``(concept, degree)``: edge ends per concept; a loop counts twice."""
    return both_ways(edges).groupBy(F.col("v").alias("concept")).agg(F.count(F.lit(1)).alias("degree"))


def counted_ends(edges: DataFrame) -> DataFrame:
    """``edge_ends`` written once, for several questions to one graph: the edges are computed once only."""
    return Scratch(edges.sparkSession, "ends").put(edge_ends(edges))


def edge_count(ends: DataFrame, of: str = "degree") -> Column:
    """The number of edges, each of which has two ends."""
    return ends.agg(F.coalesce(F.sum(of), F.lit(0)).alias("n")).select(F.expr("n div 2")).scalar()


def with_degree(nodes: DataFrame, ends: DataFrame) -> DataFrame:
    return nodes.join(ends.select("concept", "degree"), "concept", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edge ends per concept; a loop counts twice."""
    return with_degree(nodes, edge_ends(edges))


def _most_connected(nodes: DataFrame, ends: DataFrame) -> DataFrame:
    ranked = with_degree(nodes, ends).orderBy(F.desc("degree"), "first_seen", "concept")
    return ranked.limit(1).select("concept", "degree")


def most_connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The concept with most edges; among equals the one seen first."""
    return _most_connected(nodes, edge_ends(edges))


def size_and_most_connected(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``graph_size`` and ``most_connected`` from edges that are computed once."""
    ends = counted_ends(edges)
    size = nodes.agg(F.count(F.lit(1)).alias("nodes")).withColumn("edges", edge_count(ends))
    return size, _most_connected(nodes, ends)


def graph_update_stats(
    nodes: DataFrame, edges: DataFrame, next_nodes: DataFrame, next_edges: DataFrame
) -> DataFrame:
    """One row: what an update added and how the graph looks now."""
    was = edges.select("a", "b", F.lit(1).alias("was"))
    marked = next_edges.select("a", "b").join(was, ["a", "b"], "left")
    # one row per concept, from which all that is asked of the edges follows
    ends = Scratch(nodes.sparkSession, "ends").put(
        both_ways(marked, "was").groupBy(F.col("v").alias("concept")).agg(
            F.count(F.lit(1)).alias("degree"), F.count_if(F.col("was").isNull()).alias("added")
        )
    )
    fresh = next_nodes.join(nodes.select("concept"), "concept", "left_anti").agg(F.count(F.lit(1))).scalar()
    top = _most_connected(next_nodes, ends).select(F.struct("concept", "degree")).scalar()
    return next_nodes.agg(F.count(F.lit(1)).alias("nodes")).select(
        fresh.alias("nodes_added"),
        edge_count(ends, "added").alias("edges_added"),
        F.col("nodes").alias("total_nodes"),
        edge_count(ends).alias("total_edges"),
        F.coalesce(top["concept"], F.lit("")).alias("most_connected"),
        F.coalesce(top["degree"], F.lit(0)).alias("most_connected_edges"),
    )


def known_concepts(occ: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per article: concepts named and how many of them the graph knows, repeats counted."""
    known = nodes.select("concept").withColumn("known", F.lit(True))
    return (
        occ.join(known, "concept", "left")
        .groupBy("url")
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if(F.coalesce("known", F.lit(False))).alias("known"),
        )
    )


def bridges_clusters(occ: DataFrame, components: DataFrame) -> DataFrame:
    """Articles whose known concepts, at least two, lie in more than one component.

    ``components`` has one row per node; a graph of fewer than four nodes has no clusters to tie.
    """
    enough = components.agg(F.count(F.lit(1)) >= 4).scalar()
    spread = (
        occ.join(components, "concept")
        .groupBy("url")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("component").alias("lo"),
            F.max("component").alias("hi"),
        )
    )
    return spread.select(
        "url", (enough & (F.col("n") >= 2) & (F.col("lo") != F.col("hi"))).alias("bridges")
    )


def graph_novelty(
    articles: DataFrame, occ: DataFrame, nodes: DataFrame, components: DataFrame
) -> DataFrame:
    """Share of unknown concepts, raised when an article ties separate clusters together."""
    base = F.lit(1.0) - F.col("known") / F.col("total")
    lifted = F.least(F.lit(1.0), base * 1.3)
    share = F.when(F.coalesce("bridges", F.lit(False)), lifted).otherwise(base)
    return (
        articles.select("url")
        .join(known_concepts(occ, nodes), "url", "left")
        .join(bridges_clusters(occ, components), "url", "left")
        .select(
            "url",
            F.when(F.col("total").isNull(), F.lit(1.0))
            .otherwise(round_half_up(share, 4))
            .alias("graph_novelty"),
        )
    )


def memory_decay(
    nodes: DataFrame, edges: DataFrame, now: Column, half_life: float = 14.0, prune: float = 0.02
) -> tuple[DataFrame, DataFrame]:
    """Familiarity halves every ``half_life`` days, never below what the encounters earned."""
    days = days_since(F.col("last_seen"), now)
    count = F.coalesce("encounter_count", F.lit(1))
    faded = F.coalesce("familiarity", F.lit(0.0)) * F.pow(F.lit(2.0), -days / F.lit(half_life))
    value = F.greatest(faded, F.least(F.lit(1.0), count * 0.05))
    ages = F.coalesce(days > 0, F.lit(False))
    marked = nodes.withColumns(
        {
            "familiarity": F.when(ages, round_half_up(value, 4)).otherwise(F.col("familiarity")),
            "__gone": ages & (value < prune) & (count <= 1),
        }
    )
    kept = marked.filter(~F.col("__gone")).drop("__gone")
    gone = marked.filter("__gone").select("concept")
    rest = edges
    for end in ("a", "b"):
        rest = rest.join(gone.select(F.col("concept").alias(end)), end, "left_anti")
    return kept, rest.select(*edges.columns)


def induced_subgraph(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes``."""
    out = edges
    for end in ("a", "b"):
        out = out.join(nodes.select(F.col("concept").alias(end)), end, "left_semi")
    return out.select(*edges.columns)


def graph_view(nodes: DataFrame, edges: DataFrame, max_nodes: int = 200) -> tuple[DataFrame, DataFrame]:
    """The best connected nodes and the edges between them."""
    if not 1 <= max_nodes <= 2000:
        raise ValueError("max_nodes must lie between 1 and 2000")
    top = (
        degree(nodes, edges).orderBy(F.desc("degree"), "first_seen", "concept").limit(max_nodes)
    )
    return top, induced_subgraph(edges, top)


def top_concepts(nodes: DataFrame, edges: DataFrame, by: str = "familiarity", n: int = 20) -> DataFrame:
    return top_of(degree(nodes, edges), by, n)


def top_of(ranked: DataFrame, by: str, n: int) -> DataFrame:
    """The first ``n`` of nodes that have their degree."""
    if by not in ("familiarity", "degree"):
        raise ValueError("by must be familiarity or degree")
    return ranked.orderBy(F.desc(by), "first_seen", "concept").limit(n)


def concept_index(nodes: DataFrame) -> DataFrame:
    return nodes.select("concept", "encounter_count").orderBy("concept")


def adjacent(edges: DataFrame) -> DataFrame:
    """``(v, w)``: each neighbour of a concept once.

    Edges are unique with ``a <= b``, so only a loop would come twice, and no shuffle is needed.
    """
    ways = F.when(F.col("a") == F.col("b"), F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("w")))).otherwise(
        F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("w")), F.struct(F.col("b").alias("v"), F.col("a").alias("w")))
    )
    return edges.select(F.explode(ways).alias("e")).select("e.v", "e.w")


def adjacent_to(edges: DataFrame, of: DataFrame) -> DataFrame:
    """``adjacent`` for the concepts in ``of`` alone, which is a table, as it is read for either end.

    The edges are cut by each end before they are laid out both ways; when ``of`` is small enough to
    be broadcast, also before whatever aggregate they come from.
    """
    ends = of.select("concept").distinct()
    forth = edges.join(ends.select(F.col("concept").alias("a")), "a", "left_semi")
    back = edges.filter(F.col("a") != F.col("b")).join(ends.select(F.col("concept").alias("b")), "b", "left_semi")
    return forth.select(F.col("a").alias("v"), F.col("b").alias("w")).unionByName(
        back.select(F.col("b").alias("v"), F.col("a").alias("w"))
    )


def neighbour_rows(nodes: DataFrame, edges: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """``(concept, neighbour, first_seen)`` for all concepts or those in ``of``, which is read twice."""
    pairs = adjacent(edges) if of is None else adjacent_to(edges, of)
    pairs = pairs.select(F.col("v").alias("concept"), F.col("w").alias("neighbour"))
    seen = nodes.select(F.col("concept").alias("neighbour"), "first_seen")
    return pairs.join(seen, "neighbour").select("concept", "neighbour", "first_seen")


def neighbours_of(
    nodes: DataFrame, edges: DataFrame, k: int, of: DataFrame | None = None
) -> DataFrame:
    """The first ``k`` neighbours of each concept in order of appearance, as one list."""
    order = [F.col("first_seen"), F.col("neighbour")]
    first = top_per_group(neighbour_rows(nodes, edges, of), ["concept"], order, k)
    listed = F.array_sort(F.collect_list(F.struct("first_seen", "neighbour")))
    return first.groupBy("concept").agg(
        F.transform(listed, lambda x: x["neighbour"]).alias("neighbours")
    )


def mentioned_neighbours(occ: DataFrame) -> DataFrame:
    """``(concept, near)``: all neighbours of a concept, in no order, in the graph that the mentions make."""
    near = article_neighbours(occ).select("concept", F.explode("near").alias("near"))
    return near.groupBy("concept").agg(F.collect_set("near").alias("near"))


def mentioned_neighbours_of(nodes: DataFrame, occ: DataFrame, k: int) -> DataFrame:
    """``neighbours_of`` in the graph that the mentions make; ``nodes`` are the concepts they name.

    Nodes are numbered in order of appearance, so that numbers meet in the articles and are sorted,
    and only the first ``k`` of each concept become names again.
    """
    ordered = nodes.select("concept", "first_seen").orderBy("first_seen", "concept")
    # the ids increase from one range of the order to the next
    numbered = Scratch(nodes.sparkSession, "places").put(
        ordered.select("concept", F.monotonically_increasing_id().alias("place"))
    )
    mentions = occ.select("url", "concept").join(numbered, "concept").select(
        "url", F.col("place").alias("concept"), F.lit(None).cast("long").alias("seq")
    )
    near = article_neighbours(mentions).select("concept", F.explode(F.slice("near", 1, k)).alias("near"))
    rank = F.dense_rank().over(Window.partitionBy("concept").orderBy("near"))
    first = near.withColumn("__rank", rank).filter(F.col("__rank") <= k).select("concept", "near").distinct()
    named = first.join(numbered.select(F.col("place").alias("near"), F.col("concept").alias("name")), "near")
    listed = F.array_sort(F.collect_list(F.struct("near", "name")))
    lists = named.groupBy(F.col("concept").alias("place")).agg(
        F.transform(listed, lambda x: x["name"]).alias("neighbours")
    )
    return numbered.join(lists, "place").select("concept", "neighbours")


def node_sources(sources: DataFrame, n: int = 20) -> DataFrame:
    """The first ``n`` articles on the edges of each concept.

    ``sources`` are ``edge_sources``, whose rows of an article are folded in a hash table, or the
    ``article_ends`` of the mentions they come from, which need none.
    """
    rows = sources
    if "concept" not in sources.columns:
        rows = both_ways(sources, "url", "seq").groupBy(F.col("v").alias("concept"), "url").agg(
            F.min("seq").alias("seq")
        )
    return top_per_group(rows, ["concept"], [F.col("seq"), F.col("url")], n)


def question_words(questions: DataFrame) -> DataFrame:
    """``(question_id, word)``: the words of each question that are looked up."""
    return (
        questions.select("question_id", F.explode(F.split("question", r"\s+")).alias("w"))
        .select("question_id", F.lower("w").alias("word"))
        .filter(F.length("word") > 3)
        .distinct()
    )


def word_hits(words: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(word, concept)``: concepts that contain a word or are contained in one, each pair once.

    Names and words are written once, as both are read in both directions.
    """
    scratch = Scratch(nodes.sparkSession, "containment")
    names = scratch.put(nodes.select("concept", F.lower("concept").alias("name")))
    forms = scratch.put(words.select("word").distinct())
    distinct_names = names.select("name").distinct()
    in_name = contained_pairs(
        forms.select(F.col("word").alias("inner")), distinct_names.select(F.col("name").alias("outer"))
    ).select(F.col("inner").alias("word"), F.col("outer").alias("name"))
    in_word = contained_pairs(
        distinct_names.select(F.col("name").alias("inner")), forms.select(F.col("word").alias("outer"))
    ).filter(F.col("inner") != F.col("outer")).select(F.col("outer").alias("word"), F.col("inner").alias("name"))
    return in_name.unionByName(in_word).join(names, "name").select("word", "concept")


def match_concepts(questions: DataFrame, nodes: DataFrame, *, most_words: int = 256) -> DataFrame:
    """Concepts that contain a longer word of the question or are contained in one.

    The pairs are by far the largest table here, so they are not made word by word and shuffled to
    be told apart: concepts that the same words hit share their questions, which are sought once for
    each set of words. Concepts with more than ``most_words`` words, short ones as a rule, are left
    to the plain way, as a set that large has few that share it.
    """
    words = question_words(questions)
    scratch = Scratch(nodes.sparkSession, "matches")
    hits = scratch.put(word_hits(words, nodes))
    many = scratch.put(hits.groupBy("concept").count().filter(F.col("count") > most_words).select("concept"))
    few = hits.join(many, "concept", "left_anti").groupBy("concept").agg(F.sort_array(F.collect_set("word")).alias("words"))
    held = scratch.put(few)
    sets = held.select("words").distinct()
    asked = scratch.put(
        sets.select("words", F.explode("words").alias("word")).join(words, "word").select("words", "question_id").distinct()
    )
    plain = words.join(hits.join(many, "concept", "left_semi"), "word").select("question_id", "concept").distinct()
    return held.join(asked, "words").select("question_id", "concept").unionByName(plain)


def first_matches(
    questions: DataFrame, nodes: DataFrame, order: list[Column], n: int, carry: list[str], *, hits: DataFrame | None = None
) -> DataFrame:
    """The first ``n`` matched concepts of each question in ``order`` over ``concept`` and ``carry``.

    A question's first ``n`` are among the first ``n`` of its words, so hits are cut for each word
    before any question sees them, however many concepts a word has. ``hits`` are the questions'
    ``word_hits``, where they are at hand.
    """
    words = question_words(questions)
    hits = word_hits(words, nodes) if hits is None else hits
    if carry:
        hits = hits.join(nodes.select("concept", *carry), "concept")
    of_word = top_per_group(hits, ["word"], order, n)
    rows = words.join(of_word, "word").drop("word").distinct()
    return top_per_group(rows, ["question_id"], order, n)


def related_concepts(
    questions: DataFrame, nodes: DataFrame, edges: DataFrame, n: int = 15, *, hits: DataFrame | None = None
) -> DataFrame:
    """Matched concepts and their neighbours, the first ``n`` in sort order.

    Only the first ``n`` of a word can be among those of its questions, so both are cut for each word
    before a question sees them. ``hits`` are the questions' ``word_hits``, where they are a table.
    """
    words = question_words(questions)
    if hits is None:
        hits = Scratch(nodes.sparkSession, "related").put(word_hits(words, nodes))
    order = [F.col("concept")]
    own = top_per_group(hits, ["word"], order, n)
    grown = first_neighbours(hits, nodes, edges, n)
    of_word = top_per_group(own.unionByName(grown).distinct(), ["word"], order, n)
    rows = words.join(of_word, "word").select("question_id", "concept").distinct()
    return top_per_group(rows, ["question_id"], order, n)


def first_neighbours(
    hits: DataFrame, nodes: DataFrame, edges: DataFrame, n: int, *, low_names: int = LOW_NAMES
) -> DataFrame:
    """``(word, concept)``: the first ``n`` in sort order of all neighbours that a word's hits have.

    A word with very many hits finds them among the first names of all, so first only edges with an
    end up to the ``low_names``-th name are looked at. A word that has ``n`` neighbours there has no
    earlier ones elsewhere; all edges of the other words' hits are looked at after that.
    """
    scratch = Scratch(nodes.sparkSession, "neighbours")
    order = [F.col("concept")]
    cut = nodes.select("concept").orderBy("concept").limit(low_names).agg(F.max("concept")).scalar()
    low = scratch.put(adjacent(edges.filter(F.least("a", "b") <= cut)).filter(F.col("w") <= cut))

    def of(hits: DataFrame, around: DataFrame) -> DataFrame:
        near = around.select(F.col("v").alias("concept"), F.col("w").alias("near"))
        met = hits.join(near, "concept").select("word", F.col("near").alias("concept"))
        return top_per_group(met.distinct(), ["word"], order, n)

    found = scratch.put(of(hits, low))
    full = found.groupBy("word").count().filter(F.col("count") >= n)
    opened = scratch.put(hits.select("word").distinct().join(full, "word", "left_anti"))
    if opened.isEmpty():
        return found
    left = scratch.put(hits.join(opened, "word", "left_semi"))
    # only the first n neighbours of a concept can be among the first n of a word
    around = top_per_group(adjacent_to(edges, left), ["v"], [F.col("w")], n)
    return found.join(opened, "word", "left_anti").unionByName(of(left, around))


def graph_context(
    questions: DataFrame, nodes: DataFrame, edges: DataFrame, *, hits: DataFrame | None = None
) -> DataFrame:
    """Up to eight matched concepts per question, described line by line."""
    about = ["first_seen", "encounter_count", "familiarity"]
    first = first_matches(questions, nodes, [F.col("first_seen"), F.col("concept")], 8, about, hits=hits)
    first = Scratch(nodes.sparkSession, "context").put(first)
    near = neighbours_of(nodes, edges, 5, first)
    line = F.format_string(
        "- %s: encountered %d time(s), familiarity %.1f, connected to [%s]",
        "concept", "encounter_count", "familiarity",
        F.coalesce(F.array_join("neighbours", ", "), F.lit("none")),
    )
    ordered = F.array_sort(F.collect_list(F.struct("first_seen", "concept", line.alias("line"))))
    return (
        first.join(near, "concept", "left")
        .groupBy("question_id")
        .agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("graph_context"))
    )


def suggest_explorations(nodes: DataFrame, edges: DataFrame, n: int = 5) -> DataFrame:
    """Well connected but little known concepts first, then rarely met ends of bridges."""
    enough = nodes.agg(F.count(F.lit(1)) >= 3).scalar()
    deg = degree(nodes, edges)
    hubs = deg.filter((F.col("degree") >= 2) & (F.col("familiarity") < 0.3)).select(
        "concept", "degree", "first_seen", "encounter_count",
        F.lit(1).alias("rule"), F.lit(None).cast("string").alias("other"),
    )
    ends = both_ways(bridge_edges(nodes, edges)).groupBy(F.col("v").alias("concept")).agg(
        F.min("w").alias("other")
    )
    rare = deg.join(ends, "concept").filter(F.col("encounter_count") <= 2).select(
        "concept", "degree", "first_seen", "encounter_count", F.lit(2).alias("rule"), "other"
    )
    rare = rare.join(hubs.select("concept"), "concept", "left_anti")
    best = (
        hubs.unionByName(rare)
        .filter(enough)
        .orderBy(F.desc("degree"), "rule", "first_seen", "concept")
        .limit(n)
    )
    best = Scratch(nodes.sparkSession, "explorations").put(best)
    near = neighbours_of(nodes, edges, 3, best)
    hub_text = F.format_string(
        "Connected to %s, but you have only %d article(s) on it.",
        F.array_join("neighbours", ", "), "encounter_count",
    )
    bridge_text = F.format_string(
        "Bridge concept connecting %s to other clusters, with only %d encounter(s).",
        "other", "encounter_count",
    )
    return (
        best.join(near, "concept", "left")
        .orderBy(F.desc("degree"), "rule", "first_seen", "concept")
        .select(
            F.col("concept").alias("topic"),
            F.when(F.col("rule") == 1, hub_text).otherwise(bridge_text).alias("reason"),
            "degree",
        )
    )

"""Containment joins and neighbour search against plain counterparts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsweft.lineage import Scratch
from newsweft.operators import graph, vectors
from newsweft.operators.containment import contained_pairs


@pytest.mark.parametrize("share_rows", [4096, 8])
def test_contained_pairs_equal_all_pairs(spark, share_rows):
    rnd = random.Random(1)
    syllables = ["tion", "an", "é", "x", "tor", "..", "%_"]
    strings = lambda n, k: sorted({"".join(rnd.choice(syllables) for _ in range(rnd.randrange(1, k))) for _ in range(n)})
    inner, outer = strings(80, 4) + ["", "absent piece"], strings(300, 8)
    got = contained_pairs(
        spark.createDataFrame([(x,) for x in inner], "inner string"),
        spark.createDataFrame([(x,) for x in outer], "outer string"),
        share_rows=share_rows,
    ).collect()
    want = {(a, b) for a in inner for b in outer if a and a in b}
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    none = spark.createDataFrame([], "outer string")
    assert contained_pairs(spark.createDataFrame([("abcd",)], "inner string"), none).count() == 0


def test_the_rarest_piece_is_found_without_sorting_every_piece(spark):
    one = lambda c, x: spark.createDataFrame([(x,)], f"{c} string")
    rows = contained_pairs(one("inner", "abcdabcd"), one("outer", "xabcdabcdx"))
    assert "SortAggregate" not in rows._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in rows.collect()] == [("abcdabcd", "xabcdabcdx")]


@pytest.mark.parametrize("most_words", [0, 2, 256])
def test_questions_and_concepts_meet_by_sets_of_words(spark, most_words):
    """Each pair once, for concepts of few words and of many; pairs of the first are not shuffled to be told apart."""
    q = spark.createDataFrame([(i, t) for i, t in enumerate(["green ring", "ring greenring", "gree bolt", "hot rods"])], "question_id long, question string")
    names = [f"{x}ring{i}" for x in ("green", "hot") for i in range(30)] + ["r", "ring", "gree"]
    rows = graph.match_concepts(q, spark.createDataFrame([(c,) for c in names], "concept string"), most_words=most_words)
    asked = {i: {w for w in t.split() if len(w) > 3} for i, t in enumerate(["green ring", "ring greenring", "gree bolt", "hot rods"])}
    want = sorted((i, c) for i, ws in asked.items() for c in names if any(w in c or c in w for w in ws))
    assert sorted(map(tuple, rows.collect())) == want
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Union") and "Aggregate" not in plan.split("\n+- ")[0]


def test_first_matches_and_related_equal_a_full_scan(spark):
    rnd = random.Random(2)
    concepts = sorted({"".join(rnd.choice(["Graph", "node", "ab", "Z", "xy"]) for _ in range(rnd.randrange(1, 5))) for _ in range(150)})
    nodes = [(c, i % 7, i) for i, c in enumerate(concepts)]
    edges = sorted({tuple(sorted(rnd.sample(concepts, 2))) for _ in range(300)})
    asked = [(i, " ".join(rnd.choice(["graph", "NODEab", "xyxyxy", "z", "ab", "nothing", "graphnodeab"]) for _ in range(4))) for i in range(20)]
    n = spark.createDataFrame(nodes, "concept string, first_seen int, encounter_count long")
    e = spark.createDataFrame(edges, "a string, b string")
    q = spark.createDataFrame(asked + [(99, None), (98, "")], "question_id long, question string")
    hit = {}
    for i, text in asked:
        words = {w.lower() for w in text.split() if len(w) > 3}
        hit[i] = {c for c in concepts if any(w in c.lower() or c.lower() in w for w in words)}
    assert {(r.question_id, r.concept) for r in graph.match_concepts(q, n).collect()} == {(i, c) for i in hit for c in hit[i]}
    seen = {c: (s, c) for c, s, _ in nodes}
    first = graph.first_matches(q, n, [F.col("first_seen"), F.col("concept")], 3, ["first_seen"]).collect()
    assert {(r.question_id, r.concept) for r in first} == {(i, c) for i in hit for c in sorted(hit[i], key=seen.get)[:3]}
    near = {c: {b if a == c else a for a, b in edges if c in (a, b)} for c in concepts}
    around = {i: sorted(hit[i].union(*[near[c] for c in hit[i]])) for i in hit}
    assert {(r.question_id, r.concept) for r in graph.related_concepts(q, n, e, 4).collect()} == {(i, c) for i in around for c in around[i][:4]}


@pytest.mark.parametrize("low_names", [1, 6, 1024])
def test_first_neighbours_are_sought_among_the_first_names_and_then_everywhere(spark, low_names):
    """Names sort as their numbers; ends that are no nodes, loops, a word of one hit and words without any."""
    rnd = random.Random(3)
    names = [f"{i:03d}{'ring' if i % 2 else 'bolt'}" for i in range(60)] + ["999rare"]
    edges = sorted({tuple(sorted(rnd.sample(names + ["000aaa", "998zzz"], 2))) for _ in range(250)} | {("001ring", "001ring")})
    edges = [e for e in edges if "999rare" not in e] + [("059ring", "999rare"), ("058bolt", "999rare")]
    hits = [(w, c) for w in ("ring", "bolt", "rare", "lonely") for c in names if w in c] + [("lonely", "no edges")]
    got = graph.first_neighbours(
        spark.createDataFrame(hits, "word string, concept string"), spark.createDataFrame([(c,) for c in names], "concept string"),
        spark.createDataFrame(edges, "a string, b string"), 4, low_names=low_names,
    ).select("word", "concept").collect()
    near = {c: {b if a == c else a for a, b in edges if c in (a, b)} for c in names}
    want = {(w, c) for w in ("ring", "bolt", "rare") for c in sorted(set().union(*[near[h] for v, h in hits if v == w]))[:4]}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_few_concepts_reach_the_pairs_before_they_are_told_apart(spark):
    occ = spark.createDataFrame([(f"u{i}", i, f"c{i % 7}{j}") for i in range(40) for j in range(4)], "url string, seq long, concept string")
    edges = graph.update_edges(None, graph.article_pairs(occ, None), F.current_timestamp())
    few = Scratch(spark, "few").put(spark.createDataFrame([("c10",), ("c31",)], "concept string"))
    near = graph.adjacent_to(edges, few)
    want = {(r.v, r.w) for r in graph.adjacent(edges).collect() if r.v in ("c10", "c31")}
    assert len(want) == 6 and sorted(map(tuple, near.collect())) == sorted(want)
    lines = near._jdf.queryExecution().optimizedPlan().toString().split("\n")
    at = lambda text: [i for i, x in enumerate(lines) if text in x]
    told = [i for i in at("Aggregate [a#") if "AS v#" in lines[i]]
    assert len(told) == 2 and len(at("Join LeftSemi")) == 2 and all(t < j for t, j in zip(told, at("Join LeftSemi")))


def plain_neighbours(queries, store, k):
    unit = lambda m: m / np.where(np.linalg.norm(m, axis=1, keepdims=True) == 0, 1, np.linalg.norm(m, axis=1, keepdims=True))
    sims = np.floor(unit(queries) @ unit(store).T * 1e6 + 0.5) / 1e6
    return {(f"q{i}", f"v{j}", float(s[j])) for i, s in enumerate(sims) for j in sorted(range(len(s)), key=lambda j: (-s[j], f"v{j}"))[:k]}


@pytest.mark.parametrize("cell_rows", [16384, 40, 2])
def test_one_layout_serves_any_number_of_queries(spark, monkeypatch, cell_rows):
    """Clusters in many dimensions, so that rings, shares, sketches and the sample's reach all leave rows out."""
    monkeypatch.setattr(vectors, "SAMPLE", 64)
    monkeypatch.setattr(vectors, "RINGS", 4)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 80)) * 5
    store = centres[rng.integers(0, 6, 400)] + rng.normal(size=(400, 80))
    store[:30], store[30:33] = store[0], 0  # copies, and vectors of no length
    asked = np.concatenate([store[:20] + 0.01, rng.normal(size=(5, 80)), np.zeros((1, 80)), -store[50:52]])
    rows = lambda m, p: spark.createDataFrame([(f"{p}{i}", [float(x) for x in r]) for i, r in enumerate(m)] + [(p + "none", None)], "url string, embedding array<double>")
    cells = vectors.VectorCells(rows(store, "v"), cell_rows)
    q = rows(asked, "q").where("embedding is not null").withColumnRenamed("url", "query")
    for part in (q, q.where("query = 'q3'"), q.limit(0)):
        found = {tuple(r) for r in cells.search(part, 5).collect()}
        names = {r.query for r in part.collect()}
        assert found == {x for x in plain_neighbours(asked, store, 5) if x[0] in names}
    own = vectors.knn_cosine(rows(store, "v"), rows(store, "v"), 3, exclude_self=True, cell_rows=cell_rows)
    assert own.count() == 1200 and own.where("query = url").count() == 0
    assert vectors.knn_cosine(rows(asked, "q"), rows(store[:0], "v")).count() == 0


def test_a_query_goes_once_to_a_block_however_small_the_groups_are(spark):
    rng = np.random.default_rng(7)
    store = rng.normal(size=(600, 16))
    rows = spark.createDataFrame([(f"v{i}", r.tolist()) for i, r in enumerate(store)], "url string, embedding array<double>")
    cells = vectors.VectorCells(rows, 4)
    sent = rows.select(cells.reach(5)("embedding").alias("v")).agg(F.sum(F.size("v.visits"))).first()[0]
    assert len(cells.groups.value) > 100 and sent <= 600 * cells.blocks == 600


def test_a_block_bounds_its_rows_and_equal_vectors(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_BYTES", 8 * 16 * 50)
    rng = np.random.default_rng(8)
    store = np.concatenate([rng.normal(size=(300, 16)), np.ones((200, 16))])
    rows = spark.createDataFrame([(f"v{i}", r.tolist()) for i, r in enumerate(store)], "url string, embedding array<double>")
    cells = vectors.VectorCells(rows, 8)
    assert max(r["count"] for r in cells.store.groupBy("block").count().collect()) <= 100
    ask = rows.withColumn("query", F.concat(F.lit("q"), F.substring("url", 2, 9))).select("query", "embedding")
    assert {tuple(r) for r in cells.search(ask, 5).collect()} == plain_neighbours(store, store, 5)

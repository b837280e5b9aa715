"""Numeric expressions: novelty curve, final score, bands, rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsweft.params import Params

NEAR_DUPLICATE_NOVELTY = 0.15


def round_half_up(x: Column, digits: int) -> Column:
    """Round through floor, which every engine evaluates alike."""
    scale = float(10**digits)
    return F.floor(x * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def vector_novelty(s_max: Column, params: Params) -> Column:
    """Novelty from the highest similarity to stored articles; NULL means an empty store."""
    near, related = params.near_duplicate, params.related
    close = F.lit(0.6) - F.lit(0.3) * (s_max - related) / F.lit(near - related)
    if related > 0:
        far = F.lit(1.0) - F.lit(0.2) * s_max / F.lit(related)
    else:
        far = F.lit(1.0)
    return (
        F.when(s_max.isNull(), F.lit(1.0))
        .when(s_max > near, F.lit(0.1))
        .when(s_max >= related, round_half_up(close, 4))
        .otherwise(round_half_up(far, 4))
    )


def novelty_score(vector: Column, graph: Column, params: Params) -> Column:
    return vector * params.vector_weight + graph * params.graph_weight


def final_score(novelty: Column, relevance: Column, params: Params) -> Column:
    return novelty * params.novelty_weight + relevance / F.lit(10.0) * params.relevance_weight


def is_near_duplicate(vector: Column) -> Column:
    return vector <= NEAR_DUPLICATE_NOVELTY


def novelty_band(novelty: Column) -> Column:
    return F.when(novelty >= 0.7, "high").when(novelty >= 0.4, "mid").otherwise("low")


def is_deepening(graph_novelty: Column) -> Column:
    return F.coalesce(graph_novelty < 0.4, F.lit(False))


def novelty_explanation(graph_novelty: Column) -> Column:
    text = F.format_string(
        "Introduces concepts not yet in your knowledge graph (graph novelty %d%%)",
        (graph_novelty * 100).cast("int"),
    )
    return F.when(graph_novelty >= 0.6, text).otherwise(F.lit(""))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))

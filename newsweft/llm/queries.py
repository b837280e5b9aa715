"""Each operator as a query over its whole table, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsweft.llm import conversations, exact_dedup, lines, mixing, near_dedup, packing, spelling, suffix_dedup, surrogates, token_counts, topk, toxicity, url_filter
from newsweft.llm.store import table


def op1_token_counts(spark, sf_dir):
    return token_counts.recount(table(spark, sf_dir, "documents"))


def op2_toxicity(spark, sf_dir):
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_pii_surrogates(spark, sf_dir):
    return surrogates.with_surrogates(table(spark, sf_dir, "documents"))


def op4_exact_topk(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_suffix_array_dedup(spark, sf_dir):
    return suffix_dedup.repeated_spans(table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_url_filters(spark, sf_dir):
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op8_minhash_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_mixing(spark, sf_dir):
    return mixing.selected(table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark, sf_dir):
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op12_line_dedup(spark, sf_dir):
    return lines.line_dedup(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark, sf_dir):
    return conversations.repair_conversations(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_toxicity": op2_toxicity,
    "op3_pii_surrogates": op3_pii_surrogates,
    "op4_exact_topk": op4_exact_topk,
    "op5_suffix_array_dedup": op5_suffix_array_dedup,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_url_filters": op7_url_filters,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op9_mixing": op9_mixing,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_line_dedup": op12_line_dedup,
    "op13_conversation_repair": op13_conversation_repair,
}
ORACLE = {
    "op4_exact_topk": topk.SQL,
    "op7_url_filters": url_filter.SQL,
    "op9_mixing": mixing.SQL,
    "op10_exact_dedup": exact_dedup.SQL,
    "op11_spelling_variants": spelling.SQL,
    "op12_line_dedup": lines.SQL,
    "op13_conversation_repair": conversations.SQL,
}

"""Edit-aware counts equal a full count after every edit."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from newsweft.llm import token_counts as T
from newsweft.llm.tokens import encoder

PARTS = ["word", " word", "'s", "'re", "'", " ", "  ", "\n", "\n \n", "12", " 3", "é", "ß.", "...", "\t", " <|endoftext|>", "日本", "x" * 50]


@pytest.fixture(scope="module")
def full():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


def test_random_edits_keep_the_count_exact(full):
    rnd, count = random.Random(5), T.counter()
    for size in (0, 1, 3, 40, 900):
        text = "".join(rnd.choices(PARTS, k=size))
        tree = T.build(text, count)
        assert (tree.n_tokens, tree.n_chars) == (full(text), len(text))
        for _ in range(60):
            start = rnd.randrange(len(text) + 1)
            new = "".join(rnd.choices(PARTS, k=rnd.choice([0, 0, 1, 2, 5, 300])))
            text, tree, _ = T.edit(text, tree, start, rnd.choice([0, 1, 2, 7, 200]), new, count)
            assert (tree.n_tokens, tree.n_chars) == (full(text), len(text))


def test_a_small_edit_touches_few_pretokens():
    count = T.counter()
    text = "some words here and there. " * 5000
    _, tree, n = T.edit(text, T.build(text, count), 60_000, 3, "now", count)
    assert n <= 3 * T.LEAF and tree.n_chars == len(text)


def test_nulls_empty_texts_and_odd_columns(spark, full):
    rows = [(1, None, None, None), (2, "", "en", "s"), (None, "a b", "en", "s"), (4, "tail " * 30_000, None, "s"), (4, "tail " * 30_000, None, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("tokens_before", F.lit("clash"))
    got = T.recount(docs).collect()
    assert len(got) == 5 and sorted(r.tokens_before for r in got) == sorted(full(r[1] or "") for r in rows)
    assert T.recount(docs.limit(0)).count() == 0
    none = T.recount(docs, F.lit(None).cast(T.EDITS)).collect()
    assert all(r.tokens_before == r.tokens_after for r in none)


def test_word_by_word_ids_equal_the_tokenizers(full):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rnd, enc = random.Random(6), encoder()
    for _ in range(400):
        text = "".join(rnd.choices(PARTS, k=rnd.randrange(30)))
        ids = t.encode(text, add_special_tokens=False).ids
        assert enc.encode(text) == b"".join(i.to_bytes(4, "little") for i in ids)

import os

import numpy as np
import pytest

from loomline.llm import bpe

SCHEMA = "doc_id long, text string, w string, ids string, word string"
pytestmark = pytest.mark.skipif(not os.path.exists(bpe.VOCABULARY), reason="no vocabulary here")
TEXTS = ["Hello world, it's 2024!  Two  spaces\n\n\tand tabs ", "<|endoftext|> isn't special", "naïve café Đặng 検索拡張 👩🏽‍💻  x　y", "", None, "ZorlibekFlow ZorlibekFlow aaaaaaaaaaaaaaaa", " ", "\x07\x00ctrl", "x" * 3000 + "aB" * 1500, "don't I'LL we've"]


@pytest.mark.parametrize("most", [0, 4, bpe.DICTIONARY])
def test_ids_and_round_trip(spark, most):
    """With no word, some words and all words in the dictionary; rows whose key and text come again are each encoded."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(bpe.VOCABULARY)
    tokenizer.encode_special_tokens = True
    table = spark.createDataFrame([(i, t, "a", "b", "c") for i, t in enumerate(TEXTS * 5)], SCHEMA)
    encoded = bpe.encode(table.union(table), most=most)
    assert encoded.count() == 2 * table.count()
    got = {r["doc_id"]: r["ids"] for r in encoded.collect()}
    for i, t in enumerate(TEXTS * 5):
        assert got[i] == tokenizer.encode(t or "", add_special_tokens=False).ids, repr(t)
    back = {r["doc_id"]: r["t"] for r in encoded.select("doc_id", bpe.decode(encoded).alias("t")).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(TEXTS * 5))


def test_empty_table(spark):
    assert bpe.encode(spark.createDataFrame([], SCHEMA)).count() == 0


def test_texts_are_encoded_where_they_are_read(spark):
    """Without a job before the result is asked for, and without a shuffle in it."""
    table = spark.createDataFrame([(1, "some text", "a", "b", "c")], SCHEMA)
    spark.sparkContext.setJobGroup("encode", "encode")
    try:
        encoded = bpe.encode(table)
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("encode")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert "Exchange" not in encoded._jdf.queryExecution().executedPlan().toString()
    assert encoded.count() == 1


def test_words_in_batches(spark, monkeypatch):
    """Batches of one row, of null and empty texts alone, and in parts, and words that hold a pair many times, side by side and overlapping."""
    from tokenizers import Tokenizer

    tokenizer, random = Tokenizer.from_file(bpe.VOCABULARY), np.random.default_rng(1)
    texts = [None, "", "a" * 7 + " " + "a" * 8, "abab" * 9 + "b", "sssss ssss sss ss s", "é" * 11, "   ", "a", *("".join(random.choice(list("aesnt"), n)) for n in range(1, 60))]
    table = spark.createDataFrame([(i, t, "a", "b", "c") for i, t in enumerate(texts)], SCHEMA)
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for rows, words in ((1, bpe.AT_ONCE), (1000, 5), (1000, bpe.AT_ONCE)):
        monkeypatch.setattr(bpe, "AT_ONCE", words)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
        try:
            got = {r["doc_id"]: r["ids"] for r in bpe.encode(table, most=7).collect()}
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
        assert got == {i: tokenizer.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}

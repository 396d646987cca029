"""Evaluation passages inside training documents, by winnowed fingerprints.

Texts are words. A fingerprint is a hash of K words; of every window of fingerprints that covers SPAN words the least is
kept, so two texts that share SPAN words in a row keep a common fingerprint. Fingerprints of both sides are joined, and
each hit is extended over the words around it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.llm.words import hash_words, split_words

SPAN, K = 10, 5
#: Fingerprints of the passages that are sent to every worker to drop others early; beyond it none are dropped early.
MOST_SENT = 2_000_000
_BASE = 0x9E3779B97F4A7C15


def _winnow(hashes: np.ndarray, rows: np.ndarray, span: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, fingerprints) kept among all words of a batch."""
    n, wide = len(hashes), span - k + 1
    if n < span:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        grams += hashes[j : j + len(grams)] * np.uint64(pow(_BASE, j, 1 << 64))
    grams ^= grams >> np.uint64(29)
    grams *= np.uint64(0xBF58476D1CE4E5B9)
    grams ^= grams >> np.uint64(32)
    count = n - span + 1
    least = grams[:count].copy()
    for j in range(1, wide):
        np.minimum(least, grams[j : j + count], out=least)
    whole = rows[:count] == rows[span - 1 :]
    kept = np.zeros(len(grams), bool)
    for j in range(wide):
        kept[j : j + count] |= whole & (grams[j : j + count] == least)
    at = np.flatnonzero(kept)
    return at, grams[at]


def fingerprints(texts: DataFrame, key: str, text: str = "text", among: np.ndarray | None = None, span: int = SPAN, k: int = K) -> DataFrame:
    """(key, fp, around): kept fingerprints with the hashes of the words from span - k before to span - k after.

    Words outside the text are 0. ``among``, sorted, keeps only these fingerprints. Texts of fewer than ``span`` words,
    null or empty ones give none.
    """
    kind = texts.schema[key].dataType.simpleString()
    known = texts.sparkSession.sparkContext.broadcast(among) if among is not None else None
    reach = span - k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, rows = split_words(batch.column(1))
            hashes = hash_words(words) | np.uint64(1)  # 0 is no word
            at, grams = _winnow(hashes, rows, span, k)
            if known is not None:
                values = known.value
                i = np.minimum(np.searchsorted(values, grams), max(len(values) - 1, 0))
                hit = values[i] == grams if len(values) else np.zeros(len(grams), bool)
                at, grams = at[hit], grams[hit]
            around = at[:, None] + np.arange(-reach, k + reach)
            inside = np.clip(around, 0, max(len(hashes) - 1, 0))
            near = np.where((around == inside) & (rows[inside] == rows[at][:, None]), hashes[inside], np.uint64(0)) if len(at) else np.zeros((0, k + 2 * reach), np.uint64)
            offsets = np.arange(len(at) + 1, dtype=np.int32) * (k + 2 * reach)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows[at] if len(at) else np.zeros(0, np.int64))),
                    pa.array(grams.view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(near.ravel().view(np.int64))),
                ],
                names=["key", "fp", "around"],
            )

    return texts.select(key, F.col(text).alias("text")).mapInArrow(run, f"key {kind}, fp bigint, around array<bigint>")


def _shared_run(a: Column, b: Column, span: int, k: int) -> Column:
    """Length of the run of equal words through the middle k words; 0 if these differ."""
    reach = span - k
    same = F.zip_with(a, b, lambda x, y: (x == y) & (x != 0))
    tail = lambda part: F.aggregate(part, F.lit(0), lambda n, e: F.when(e, n + 1).otherwise(0))
    middle = F.forall(F.slice(same, reach + 1, k), lambda e: e)
    run = tail(F.slice(same, 1, reach)) + k + tail(F.reverse(F.slice(same, reach + k + 1, reach)))
    return F.when(middle, run).otherwise(0)


def leaked(documents: DataFrame, passages: DataFrame, span: int = SPAN, k: int = K) -> DataFrame:
    """Distinct (doc_id, item_id) of documents that contain ``span`` words of a passage in a row.

    Words are runs of letters or digits in lower case. Null, empty and shorter texts are in no pair; repeated rows count
    once; further columns of either table are ignored.
    """
    tests = fingerprints(passages, "item_id", span=span, k=k).distinct()
    size = tests.select("fp").distinct().limit(MOST_SENT + 1).count()
    among = None
    if size <= MOST_SENT:
        found = tests.select("fp").distinct().toPandas()["fp"].to_numpy(np.int64)
        among = np.sort(found.view(np.uint64))
    trained = fingerprints(documents, "doc_id", among=among, span=span, k=k).distinct()
    hits = trained.select(F.col("key").alias("doc_id"), "fp", F.col("around").alias("a")).join(
        tests.select(F.col("key").alias("item_id"), "fp", F.col("around").alias("b")), "fp"
    )
    return hits.where(_shared_run(F.col("a"), F.col("b"), span, k) >= span).select("doc_id", "item_id").distinct()


def leak_report(pairs: DataFrame, passages: DataFrame) -> DataFrame:
    """One row an item: item_id, qid, number of documents that contain part of it (0 if none)."""
    counts = pairs.groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"))
    return passages.select("item_id", "qid").distinct().join(counts, "item_id", "left").fillna(0, ["documents"])

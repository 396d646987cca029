"""Near-duplicate records under small edits, insertions and reordering.

Two texts are near-duplicates if they share at least THRESHOLD of their words, counted with multiplicity in any order,
of the longer one's words. A text is a bag of words; equal bags are handled once. Candidates share one of their rarest
words: of n words the n - ceil(0.8 n) + 1 first ones in any order of all words must contain a common one, so no pair is lost. Candidates' MinHash values
are then compared a few at a time, a pair is dropped as soon as the posterior probability of reaching the threshold falls
below TOLERANCE, and the rest is verified exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.session import cut_lineage

THRESHOLD, LEAST_WORDS, TOLERANCE = 0.8, 8, 1e-7
#: MinHash values compared so far after each step. A value has eight bits, eight of them lie in a number; that different
#: ones are equal by chance only keeps a pair longer.
STEPS = (16, 32, 48, 64)
#: Words with this share of all words are ordered by their count, the others, all rarer, by their hash alone. There are at
#: most 1 / SHARE of them, so what is sent to the tasks has a bound.
SHARE = 1e-6


@lru_cache
def least_matches(threshold: float, steps: tuple[int, ...] = STEPS, tolerance: float = TOLERANCE) -> tuple[int, ...]:
    """Of the first m MinHash values, the fewest equal ones with which a pair may still reach ``threshold``.

    With a uniform prior the similarity given k of m is Beta(k + 1, m - k + 1); the tail is integrated numerically.
    Sharing ``threshold`` of the longer text's words is a Jaccard similarity of threshold / (2 - threshold) at least.
    """
    least = threshold / (2 - threshold)
    x = (np.arange(20_000) + 0.5) / 20_000
    out = []
    for m in steps:
        for k in range(m + 1):
            log = k * np.log(x) + (m - k) * np.log1p(-x)
            p = np.exp(log - log.max())
            if p[x >= least].sum() / p.sum() >= tolerance:
                out.append(k)
                break
    return tuple(out)


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a batch of lists, and where each list begins, with the end."""
    return lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy() - lists.offsets.to_numpy()[0]


def _signatures(rows: DataFrame) -> DataFrame:
    """(bag, tokens, sig) of (bag, hashes of the sorted words).

    A token is the hash of a word and its running number among equal words, so that sets of tokens stand for multisets of
    words; sig has the MinHash values of STEPS, eight in a number.
    """
    random, length = np.random.default_rng(20240101), STEPS[-1]
    a = random.integers(1, 1 << 62, length, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = random.integers(0, 1 << 62, length, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, offsets = _flat(batch.column(1))
            hashes, starts = hashes.view(np.uint64), offsets[:-1]
            new = np.concatenate([[True], hashes[1:] != hashes[:-1]])[: len(hashes)]
            new[starts] = True
            index = np.arange(len(hashes))
            again = index - np.maximum.accumulate(np.where(new, index, 0)) if len(hashes) else index
            flat = hashes + again.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            sig = np.empty((len(starts), length), np.uint8)
            for j in range(length if len(starts) else 0):
                mixed = flat * a[j] + b[j]
                mixed ^= mixed >> np.uint64(32)
                mixed *= np.uint64(0xD6E8FEB86659FD93)
                sig[:, j] = (np.minimum.reduceat(mixed, starts) >> np.uint64(33)).astype(np.uint8)
            tokens = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat.view(np.int64)))
            packed = sig.ravel().view(np.int64)
            sigs = pa.ListArray.from_arrays(pa.array(np.arange(len(starts) + 1, dtype=np.int32) * (length // 8)), pa.array(packed))
            yield pa.RecordBatch.from_arrays([batch.column(0), tokens, sigs], names=["bag", "tokens", "sig"])

    return rows.select("bag", "hashes").mapInArrow(run, "bag string, tokens array<bigint>, sig array<bigint>")


def _rarest(once: DataFrame, threshold: float) -> DataFrame:
    """(id, n, s0 to s3, token) for each of the rarest tokens of (id, tokens, sig): the prefix that near-duplicates share."""
    counts = once.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    total = once.agg(F.sum(F.size("tokens"))).first()[0] or 0
    often = counts.where(F.col("df") >= F.greatest(F.lit(2.0), F.lit(total * SHARE))).toPandas().sort_values("token")
    known = once.sparkSession.sparkContext.broadcast((often["token"].to_numpy(np.int64), often["df"].to_numpy(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed, times = known.value
        for batch in batches:
            flat, offsets = _flat(batch.column("tokens"))
            row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
            df = np.zeros(len(flat), np.int64)
            if len(listed):
                at = np.minimum(np.searchsorted(listed, flat), len(listed) - 1)
                df = np.where(listed[at] == flat, times[at], 0)
            order = np.lexsort((flat, df, row))
            n = np.diff(offsets)
            size = n - np.ceil(n * threshold - 1e-9).astype(np.int64) + 1
            first = order[np.arange(len(flat)) - offsets[:-1][row] < size[row]]
            prefix = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(flat[first]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n.astype(np.int32)), batch.column("sig"), prefix], names=["id", "n", "sig", "prefix"])

    made = once.select("id", "tokens", "sig").mapInArrow(run, "id bigint, n int, sig array<bigint>, prefix array<bigint>")
    return made.select("id", "n", *(F.col("sig")[i].alias(f"s{i}") for i in range(4)), F.explode_outer("prefix").alias("token"))


def _equal(a: Column, b: Column) -> Column:
    """Of eight values of eight bits, how many are equal."""
    x = a.bitwiseXOR(b)
    for wide in (1, 2, 4):
        x = x.bitwiseOR(F.shiftrightunsigned(x, wide))
    return F.lit(8) - F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))


def _survives(a: list[Column], b: list[Column], threshold: float, steps: slice, before: Column | None = None) -> tuple[Column, Column]:
    """(whether the pair is kept, equal values so far): AND stops at the first step that drops the pair."""
    kept, so_far, used = F.lit(True), F.lit(0) if before is None else before, 0
    for least in least_matches(threshold)[steps]:
        for i in (used, used + 1):
            so_far = so_far + _equal(a[i], b[i])
        kept, used = kept & (so_far >= least), used + 2
    return kept, so_far


def bags(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Distinct (key, bag, hashes) of rows with at least LEAST_WORDS words: hashes of the sorted words, repeated ones too."""
    words = F.array_sort(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), 0))
    made = rows.where(F.col(key).isNotNull()).select(key, words.alias("w")).where(F.size("w") >= LEAST_WORDS)
    hashed = F.array_sort(F.transform("w", lambda x: F.xxhash64(x)))
    return made.select(key, F.md5(F.concat_ws(" ", "w")).alias("bag"), hashed.alias("hashes")).distinct()


def similar_bags(made: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Distinct pairs (bag_a, bag_b), a < b, of different bags (bag, hashes) at least ``threshold`` similar.

    The first MinHash values go along with the rarest tokens, so that the join that finds a pair drops it at once where
    they differ; the other values and the tokens are fetched for the pairs left. Hot tokens are left to AQE's skew join.
    """
    once = _signatures(made.select("bag", "hashes").distinct()).withColumn("id", F.monotonically_increasing_id())
    once = cut_lineage(once)  # so that an id stays with its bag
    first = _rarest(once, threshold)
    x, y = first.alias("x"), first.alias("y")
    near = F.least("x.n", "y.n") >= F.greatest("x.n", "y.n") * threshold - 1e-9
    lanes = lambda side, n: [F.col(f"{side}.s{i}") for i in range(n)]
    kept, equal = _survives(lanes("x", 4), lanes("y", 4), threshold, slice(0, 2))
    pairs = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.id") < F.col("y.id")) & near & kept)
    pairs = pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), equal.alias("equal")).distinct()
    rest = once.select("id", *(F.col("sig")[i + 4].alias(f"s{i}") for i in range(4)))
    pairs = pairs.join(rest.alias("x"), F.col("a") == F.col("x.id")).join(rest.alias("y"), F.col("b") == F.col("y.id"))
    pairs = pairs.where(_survives(lanes("x", 4), lanes("y", 4), threshold, slice(2, 4), F.col("equal"))[0]).select("a", "b")
    side = lambda s: once.select(F.col("id").alias(s), F.col("bag").alias(f"bag_{s}"), F.col("tokens").alias(f"t{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    shared = F.size(F.array_intersect("ta", "tb")) >= F.greatest(F.size("ta"), F.size("tb")) * threshold - 1e-9
    return both.where(shared).select(F.least("bag_a", "bag_b").alias("bag_a"), F.greatest("bag_a", "bag_b").alias("bag_b"))


def near_duplicates(rows: DataFrame, key: str = "sentence_id", text: str = "sentence", threshold: float = THRESHOLD) -> DataFrame:
    """All pairs of different keys, a < b, with near-duplicate texts: (key_a, key_b).

    A key with several texts counts with each of them. Keys with equal bags are pairs too. Null keys, null texts and texts
    of fewer than LEAST_WORDS words are in no pair; repeated rows count once; further columns are ignored.
    """
    made = cut_lineage(bags(rows, key, text))
    linked = cut_lineage(similar_bags(made, threshold))
    members = made.select(F.col(key).alias("k"), "bag").distinct()
    a, b = members.select(F.col("k").alias("ka"), F.col("bag").alias("bag_a")), members.select(F.col("k").alias("kb"), F.col("bag").alias("bag_b"))
    alike = a.join(b, F.col("bag_a") == F.col("bag_b")).where("ka < kb").select("ka", "kb")
    other = a.join(linked, "bag_a").join(b, "bag_b").where("ka <> kb")
    pairs = alike.union(other.select(F.least("ka", "kb"), F.greatest("ka", "kb"))).distinct()
    return pairs.select(F.col("ka").alias(f"{key}_a"), F.col("kb").alias(f"{key}_b"))


def duplicate_classes(rows: DataFrame, key: str = "sentence_id", text: str = "sentence", threshold: float = THRESHOLD) -> DataFrame:
    """One row a key and text class: key, class_id (of equal bags), links (other classes within the threshold)."""
    made = cut_lineage(bags(rows, key, text))
    linked = similar_bags(made, threshold)
    both = linked.select(F.col("bag_a").alias("bag")).union(linked.select("bag_b"))
    links = both.groupBy("bag").agg(F.count("*").alias("links"))
    out = made.select(key, "bag").distinct().join(links, "bag", "left")
    return out.select(key, F.col("bag").alias("class_id"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))

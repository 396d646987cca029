"""Encoding and decoding of texts with a public byte-level BPE vocabulary.

A text is split into words by the vocabulary's pattern, in Spark. The distinct words of an Arrow batch are then folded side by
side in numpy: all tokens lie in one array, words apart by an end mark, and a round merges in every word its pair of the least
rank, wherever the word holds it, until no word has a pair left. Ranks are rows of a sparse matrix laid over each other, two
look-ups a pair. Texts are encoded where they are read: nothing is shuffled, and the driver holds the ranks alone.
"""

from __future__ import annotations

import json
import string
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: (?U) makes \s Unicode white space, as in the tokenizers library; LETTERS stands for the letters of a word. Loops are of
#: single classes or possessive, which Java matches without recursion, so that a word of any length is fine.
PATTERN = r"(?U) ?LETTERS| ?\p{N}+|'(?:[stmd]|re|ve|ll)| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words of a batch's dictionary that are folded side by side, at most: their tokens fit a processor's cache. It changes no id.
DICTIONARY = 30_000
#: Words of the texts that are encoded at once, but for a longer text: a batch of long texts has many.
AT_ONCE = 1_000_000
_SHIFT = 1 << 17  # above any token id
_NONE = 1 << 30  # the rank of no pair


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache
def load(path: str = VOCABULARY) -> dict:
    """ids of bytes, bytes of ids, and (left, right, merged) of every merge in rank order."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    letters, vocab = _byte_letters(), model["vocab"]
    pieces = {i: bytes(letters[c] for c in token) for token, i in vocab.items() if all(c in letters for c in token)}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    merges = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], np.int64)
    parts, made = merges[:, :2], merges[:, 2:]
    if (np.diff(made[:, 0]) <= 0).any() or (np.isin(parts, made) & (parts >= made)).any():
        raise ValueError("merged ids must rise with rank")  # so that no merge makes a pair of a lesser rank
    return {"byte_ids": [vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])], "pieces": pieces, "merges": merges}


def _rank_table(merges: np.ndarray, tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """(shift, slots): the pair (left, right) has its rank at slots[shift[left] + right], as merged * _SHIFT + left.

    Rows of a sparse matrix laid over each other, the fullest first, each at the first of some random shifts where all its
    places are free; a slot tells by its left token whose it is. Free slots are -1.
    """
    order = np.lexsort((merges[:, 1], merges[:, 0]))
    own, starts = np.unique(merges[order, 0], return_index=True)
    ends = np.append(starts[1:], len(order))
    size = 6 * tokens
    slots, shift, random = np.full(size + tokens + 1, -1, np.int64), np.full(tokens + 1, size, np.int64), np.random.default_rng(1)
    for row in np.argsort(starts - ends, kind="stable"):
        at = order[starts[row] : ends[row]]
        rights = merges[at, 1]
        for trial in random.integers(0, size - tokens, 100_000):
            if (slots[rights + trial] < 0).all():
                break
        else:
            raise ValueError("no place for the ranks")
        slots[rights + trial] = merges[at, 2] * _SHIFT + own[row]
        shift[own[row]] = trial
    return shift, slots  # tokens without merges, and the end mark, point at free slots


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


@lru_cache
def _tables(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """shift and slots of the ranks; ids of the bytes."""
    merges, ids = load(path)["merges"], np.array(load(path)["byte_ids"], np.int64)
    return *_rank_table(merges, int(max(merges[:, 2].max(), ids.max())) + 1), ids


def fold(data: np.ndarray, lengths: np.ndarray, tables: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, how many each word has) of words, one at least and none empty: their bytes one after the other, and their lengths.

    A merged id is its rank. What a word still holds of its least pair is merged in one round, from the left where
    occurrences overlap, since no merge makes a pair of a lesser rank; words without a pair leave the rounds.
    """
    shift, slots, byte_ids = tables
    end, starts = len(shift) - 1, np.concatenate([[0], np.cumsum(lengths)])

    def ranked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        v = slots[shift[a] + b]
        return np.where(v & (_SHIFT - 1) == a, v >> 17, _NONE)

    # an end mark before the first word and after each; at: the byte where a token begins
    tokens, at = np.insert(byte_ids[data], starts, end), np.insert(np.arange(len(data)), starts, -1)
    rank, done, n = np.append(ranked(tokens[:-1], tokens[1:]), _NONE), np.full(len(data), -1, np.int64), lengths + 1
    while len(n):
        first = np.cumsum(n) - n + 1
        low = np.minimum.reduceat(rank, first)
        if (live := low < _NONE).sum() < len(n):
            keep = np.append(True, np.repeat(live, n))
            out = ~keep & (at >= 0)
            done[at[out]] = tokens[out]
            tokens, at, rank, n, low = tokens[keep], at[keep], rank[keep], n[live], low[live]
            if not len(n):
                break
            first = np.cumsum(n) - n + 1
        hit = np.flatnonzero(rank[1:] == np.repeat(low, n)) + 1
        index = np.arange(len(hit))
        run = np.maximum.accumulate(np.where(np.diff(hit, prepend=-1) > 1, index, 0))  # hits side by side share a token
        hit = hit[(index - run) % 2 == 0]
        tokens[hit] = rank[hit]
        keep = np.ones(len(tokens), bool)
        keep[hit + 1] = False
        n = np.add.reduceat(keep, first, dtype=np.int64)
        tokens, at, rank = tokens[keep], at[keep], rank[keep]
        hit -= np.arange(len(hit))
        rank[hit - 1] = ranked(tokens[hit - 1], tokens[hit])
        rank[hit] = ranked(tokens[hit], tokens[hit + 1])
    return done[done >= 0].astype(np.int32), np.add.reduceat(done >= 0, starts[:-1], dtype=np.int64)


@lru_cache
def split_pattern(path: str = VOCABULARY) -> str:
    """PATTERN, with words also cut between a small letter and a capital that stand side by side in no token.

    No merge joins such letters, so the parts have the ids they have together, and they recur more often than names put
    together of them.
    """
    held = {t[i : i + 2] for t in load(path)["pieces"].values() for i in range(len(t) - 1)}
    apart = {b: "".join(a for a in string.ascii_lowercase if (a + b).encode() not in held) for b in string.ascii_uppercase}
    cut = "|".join(f"[{small}]{b}" for b, small in apart.items() if small)
    return PATTERN.replace("LETTERS", rf"\p{{L}}(?:[a-z]++|[A-Z](?<!{cut})|[\p{{L}}&&[^A-Za-z]]++)*+" if cut else r"\p{L}+")


def split_words(text: Column, path: str = VOCABULARY) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(split_pattern(path)), 0)


def _fold_words(words: pa.Array, tables: tuple[np.ndarray, np.ndarray, np.ndarray], most: int) -> pa.ListArray:
    """The ids of each of some distinct words, folded ``most`` at a time."""
    ids, ends = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
    for at in range(0, len(words), most):
        block = words.slice(at, most).cast(pa.large_binary())
        _, offsets, data = block.buffers()
        offsets = np.frombuffer(offsets, np.int64)[block.offset : block.offset + len(block) + 1]
        found, n = fold(np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], np.diff(offsets), tables)
        ids.append(found)
        ends.append(ends[-1][-1] + np.cumsum(n))
    return pa.ListArray.from_arrays(pa.array(np.concatenate(ends).astype(np.int32)), pa.array(np.concatenate(ids)))


def _encode_batch(words: pa.ListArray, tables: tuple[np.ndarray, np.ndarray, np.ndarray], most: int) -> pa.ListArray:
    """The ids of texts, given as lists of their words."""
    known = words.flatten().dictionary_encode()
    found = _fold_words(known.dictionary, tables, most).take(known.indices)
    return pa.ListArray.from_arrays(found.offsets.take(pc.subtract(words.offsets, words.offsets[0])), found.values)


def encode(texts: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY, most: int = DICTIONARY) -> DataFrame:
    """(key, ids) of every row: token ids of its text, without special tokens.

    Null and empty texts give an empty list; text that looks like a special token is ordinary text; repeated rows are each
    encoded, null keys kept; further columns are ignored. Every distinct word of an Arrow batch is folded once, ``most`` (one
    at least) side by side. A word of many bytes takes a round for each rank that occurs in it.
    """
    known = texts.sparkSession.sparkContext.broadcast(_tables(path))
    words = texts.select(F.col(key).alias(key), split_words(F.col(text), path).alias("words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group = batch.column(1).offsets.to_numpy()[:-1] // AT_ONCE
            starts = np.flatnonzero(np.diff(group, prepend=-1)).tolist()
            for start, stop in zip(starts, [*starts[1:], len(batch)]):
                part = batch.slice(start, stop - start)
                ids = _encode_batch(part.column(1), known.value, max(most, 1))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=[key, "ids"])

    return words.mapInArrow(run, T.StructType([words.schema[0], T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decode(encoded: DataFrame, ids: str = "ids", path: str = VOCABULARY) -> Column:
    """The text of an array of ids: its tokens' bytes, put together and read as UTF-8."""
    pieces = load(path)["pieces"]
    hexes = [pieces.get(i, b"").hex() for i in range(max(pieces) + 1)]
    table = F.split(F.lit(",".join(hexes)), ",")
    return F.decode(F.unhex(_let(table, lambda t: F.array_join(F.transform(encoded[ids], lambda i: F.get(t, i)), ""))), "UTF-8")

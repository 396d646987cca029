"""Splitting oversized texts at natural boundaries by content-defined chunking.

A rolling hash over the characters marks landmarks; a landmark snaps to the nearest natural boundary (line or sentence
end, else a word end), and pieces are cut at snapped landmarks within a least and a greatest size. Cuts depend on nearby
text alone, so an edit changes only the pieces around it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP, LEAST = 1000, 200, 300
WINDOW, SPACING, REACH = 16, 128, 80
_POWERS = np.cumprod(np.full(WINDOW, 0x9E3779B97F4A7C15, np.uint64))
_SPACES = np.array([9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], np.uint32)
_ENDS = np.array([ord(c) for c in ".!?;:…。！？"], np.uint32)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _boundaries(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions before which a cut is natural: strong (after a line or sentence end) and weak (after any space)."""
    space = np.isin(codes, _SPACES)
    weak = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    first = np.maximum.accumulate(np.where(~space, np.arange(len(codes)), -1))  # the last visible character so far
    before = first[weak - 1]
    ended = np.isin(codes[np.maximum(before, 0)], _ENDS)
    lines = np.concatenate([[0], np.cumsum(codes == 10)])
    broken = lines[weak] > lines[np.maximum(before, 0)]
    return weak[ended | broken], weak


def _nearest(points: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The point nearest to each of ``at``; -1 where none is within REACH."""
    if not len(points):
        return np.full(len(at), -1)
    i = np.searchsorted(points, at)
    low, high = points[np.maximum(i - 1, 0)], points[np.minimum(i, len(points) - 1)]
    best = np.where(np.abs(at - low) <= np.abs(high - at), low, high)
    return np.where(np.abs(best - at) <= REACH, best, -1)


def cut_points(text: str, limit: int = LIMIT, overlap: int = OVERLAP, least: int = LEAST) -> list[tuple[int, int]]:
    """(start, end) of each piece of ``text``; one piece if it fits ``limit``, none if it is empty."""
    if len(text) <= limit:
        return [(0, len(text))] if text else []
    codes = _codes(text)
    strong, weak = _boundaries(codes)
    rolled = np.zeros(len(codes) - WINDOW + 1, np.uint64)
    for j in range(WINDOW):
        rolled += codes[j : j + len(rolled)].astype(np.uint64) * _POWERS[j]
    marks = np.flatnonzero((rolled >> np.uint64(40)) % np.uint64(SPACING) == 0) + WINDOW
    snapped = _nearest(strong, marks)
    snapped = np.unique(np.where(snapped < 0, _nearest(weak, marks), snapped))
    snapped = snapped[snapped > 0]
    core, ends, at = limit - overlap, [], 0
    while len(text) - at > (limit if not ends else core):
        low, high = at + least, at + core
        cut = high
        for points, last in ((snapped, False), (strong, True), (weak, True)):
            i, j = np.searchsorted(points, [low, high + 1])
            if i < j:
                cut = int(points[j - 1 if last else i])
                break
        ends.append(cut)
        at = cut
    ends.append(len(text))
    out, start = [], 0
    for k, end in enumerate(ends):
        if k:
            start = ends[k - 1] - overlap
            for points in (strong, weak):
                i = int(np.searchsorted(points, start))
                if i < len(points) and points[i] < ends[k - 1]:
                    start = int(points[i])
                    break
        out.append((start, end))
    return out


def split_oversized(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, least: int = LEAST) -> DataFrame:
    """Pieces of the rows of ``chunks`` whose text is longer than ``limit`` code points.

    Columns: chunk_id, doc_id, chunk_index (of the piece in its row, from 1), text, start_char, end_char (exclusive).
    Every piece has at most ``limit`` code points; from the second on it repeats up to ``overlap`` of the piece before,
    and without these repeats the pieces of a row give its text. Offsets go on from the row's start_char; where that is
    null or negative they count within the row's text. Null, empty and fitting texts give no rows; a text without any
    boundary is cut at the limit; repeated rows are each split; further columns are ignored.
    """
    if not 0 <= overlap < least <= limit - overlap:
        raise ValueError("needs 0 <= overlap < least <= limit - overlap")

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for chunk_id, doc_id, text, base in zip(frame["chunk_id"], frame["doc_id"], frame["text"], frame["base"], strict=True):
                cuts = cut_points(text, limit, overlap, least)
                rows += [(chunk_id, doc_id, k, text[s:e], base + s, base + e) for k, (s, e) in enumerate(cuts, 1)]
            yield pd.DataFrame(rows, columns=["chunk_id", "doc_id", "chunk_index", "text", "start_char", "end_char"])

    long = chunks.where(F.length("text") > limit)
    base = F.greatest(F.coalesce(F.col("start_char").cast("bigint"), F.lit(0)), F.lit(0)).alias("base")
    return long.select("chunk_id", "doc_id", "text", base).mapInPandas(
        split, "chunk_id string, doc_id string, chunk_index int, text string, start_char bigint, end_char bigint"
    )

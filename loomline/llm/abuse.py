"""Severity of abusive, hateful or sexual content.

A text is its sentences; each has an ordinal severity by a cumulative-link model, P(severity <= k) = sigmoid(t_k - s), with
one weight for each word n-gram shared by all thresholds, and the severity of a text is the greatest of its sentences'. The
model is fitted to whole texts by their reviewers' votes, so it learns by itself which sentences carry them. Spellings that
hide words (look-alike letters, invisible characters, digits for letters, spread or repeated letters) are undone first.
Everything a batch needs is done by numpy over its characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.session import cut_lineage

#: Labelled documents used for fitting, at most, and at most as many others, which stand for texts without abuse.
MOST_LABELLED = 5000
#: An n-gram has a weight if it is in LEAST_DOCS texts with votes for abuse and RATIO times as frequent there as elsewhere.
LEAST_DOCS, RATIO = 2, 3.0
#: Shares of grades that are wrong (assumed), the strength of the penalty, and steps of the fit.
NOISE, PENALTY, STEPS = 0.08, 0.5, 300
GRADES = 3  # 0 no vote for abuse, 1 votes that contradict each other, 2 all votes for abuse
_BASE, _BACK, _CHUNK, _BITS = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64), 1 << 19, 24
#: Letters of other alphabets and signs that look like Latin ones.
_LOOKALIKES = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "к": "k", "м": "m", "т": "t", "н": "h", "в": "b", "ӏ": "l", "α": "a", "ο": "o", "ι": "i"}
_SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
_INVISIBLE = "​‌‍⁠﻿­"


def _powers_of(base: int, n: int) -> np.ndarray:
    """base^0 to base^n modulo 2^64."""
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


@lru_cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case Latin twin of each character; whether it is a letter or digit; its sign's letter; powers of the base."""
    chars = [chr(i) for i in range(0x3000)]
    lower = np.arange(0x3000, dtype=np.uint32)
    for i, c in enumerate(chars):
        x = c.lower()
        x = _LOOKALIKES.get(x, x)
        lower[i] = ord(x) if len(x) == 1 else i
    word = np.array([c.isalnum() for c in chars])
    signs = np.zeros(0x3000, np.uint32)
    for c, x in _SIGNS.items():
        signs[ord(c)] = ord(x)
    powers = _powers_of(_BASE, _CHUNK * 2)
    return lower, word, signs, powers


@lru_cache
def _inverses() -> np.ndarray:
    return _powers_of(_BACK, _CHUNK * 2)


def _plain(codes: np.ndarray) -> np.ndarray:
    """Characters with hidden spellings undone; 0 parts texts."""
    lower, word, signs, _ = _tables()
    codes = codes[~np.isin(codes, [ord(c) for c in _INVISIBLE])]
    small = np.minimum(codes, 0x2FFF)
    out = np.where(codes < 0x3000, lower[small], codes)
    letter = np.where(codes < 0x3000, word[small], True) & ~((out >= 48) & (out <= 57))
    sign = np.where(codes < 0x3000, signs[small], 0)
    near = np.zeros(len(out), bool)  # a letter on one side and a letter or another such sign on the other
    some = letter | (sign > 0)
    near[1:-1] = (letter[:-2] & some[2:]) | (some[:-2] & letter[2:])
    out = np.where((sign > 0) & near, sign, out)
    letter |= (sign > 0) & near
    # three or more of a letter stand for one
    same = np.zeros(len(out), bool)
    same[1:] = (out[1:] == out[:-1]) & letter[1:]
    run = np.zeros(len(out), bool)
    run[1:-1] |= same[1:-1] & same[2:]
    run[2:] |= same[2:] & same[1:-1]
    kept = ~run
    out, letter = out[kept], letter[kept]
    # single letters parted by one space, dot, dash or star: four or more are a word
    gap = np.isin(out, [32, 46, 45, 95, 42])
    single = letter.copy()
    single[1:] &= ~letter[:-1]
    single[:-1] &= ~letter[1:]
    link = np.zeros(len(out), bool)
    link[1:-1] = gap[1:-1] & single[:-2] & single[2:]
    chain = link.copy()
    at = np.flatnonzero(link)
    if len(at):
        first = np.flatnonzero(np.concatenate([[True], np.diff(at) != 2]))
        length = np.diff(np.append(first, len(at)))
        chain[at] = np.repeat(length >= 3, length)
    return out[~chain]


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(n-gram hashes, sentence of each, text of each sentence, sentences) of some texts."""
    codes = _plain(np.frombuffer("\0".join(t.replace("\0", " ") for t in texts).encode("utf-32-le", "surrogatepass"), "<u4"))
    _, word, _, powers = _tables()
    inverses = _inverses()
    if len(codes) >= len(powers):  # a text longer than the tables: longer ones for this once
        powers = _powers_of(_BASE, len(codes))
        inverses = _powers_of(_BACK, len(codes))
    inside = np.where(codes < 0x3000, word[np.minimum(codes, 0x2FFF)], True)
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes.astype(np.uint64) * powers[: len(codes)])])
    words = (sums[ends] - sums[starts]) * inverses[starts]
    digits = np.concatenate([[0], np.cumsum((codes >= 48) & (codes <= 57))])
    words[digits[ends] - digits[starts] == ends - starts] = 1  # all numbers are one word
    words ^= words >> np.uint64(31)
    words *= np.uint64(0xBF58476D1CE4E5B9)
    blank = np.concatenate([codes[1:] <= 32, [True]])
    stop = np.isin(codes, [33, 63, 0x2026]) | ((codes == 46) & blank) | (codes == 0)
    stop[1:] |= (codes[1:] == 10) & (codes[:-1] == 10)
    breaks, parts = np.cumsum(stop), np.cumsum(codes == 0)
    raw, text = breaks[starts], parts[starts]
    new = np.concatenate([[True], raw[1:] != raw[:-1]])[: len(raw)]
    sentence = np.cumsum(new) - 1
    out, where = [words], [sentence]
    for n, salt in ((2, 0x94D049BB133111EB), (3, 0xD6E8FEB86659FD93)):
        if len(words) >= n:
            h = words[: len(words) - n + 1].copy()
            for j in range(1, n):
                h = (h ^ (h >> np.uint64(29))) * np.uint64(salt) + words[j : len(words) - n + 1 + j]
            own = sentence[: len(h)] == sentence[n - 1 :]
            out.append(h[own])
            where.append(sentence[: len(h)][own])
    return np.concatenate(out), np.concatenate(where), text[new], int(new.sum())


@dataclass
class SeverityModel:
    keys: np.ndarray  # sorted n-gram hashes
    weights: np.ndarray
    cuts: np.ndarray  # thresholds, rising
    least: float  # expected severity from which a text counts as abusive

    def __post_init__(self) -> None:
        self.maybe = np.zeros(1 << _BITS, bool)
        self.maybe[self.keys >> np.uint64(64 - _BITS)] = True

    def severity(self, texts: list[str]) -> np.ndarray:
        """Expected severity of each text, from 0 to GRADES - 1."""
        out = np.zeros(len(texts))
        for at, (grams, sentence, text, n) in _pieces(texts):
            if n:
                docs = int(text[-1]) + 1
                out[at : at + docs] = self._some(grams, sentence, text, n, docs)
        return out

    def _some(self, grams: np.ndarray, sentence: np.ndarray, text: np.ndarray, n: int, docs: int) -> np.ndarray:
        hit = np.flatnonzero(self.maybe[grams >> np.uint64(64 - _BITS)])
        at = np.minimum(np.searchsorted(self.keys, grams[hit]), len(self.keys) - 1)
        right = self.keys[at] == grams[hit] if len(self.keys) else np.zeros(0, bool)
        scores = np.bincount(sentence[hit[right]], self.weights[at[right]], n)
        return _expected(scores, text, self.cuts, docs)


def _fit(keys_at: np.ndarray, sentence: np.ndarray, text: np.ndarray, grades: np.ndarray, features: int) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) by gradient steps on the likelihood of the texts' grades."""
    n, docs = len(text), len(grades)
    w, cuts = np.zeros(features), np.array([3.0, 3.5])
    m, v = np.zeros(features + 2), np.zeros(features + 2)
    for step in range(1, STEPS + 1):
        s = np.bincount(sentence, w[keys_at], n)
        above = [1 / (1 + np.exp(np.clip(c - s, -500, 500))) for c in cuts]
        logs = [np.bincount(text, np.log1p(-np.minimum(a, 1 - 1e-12)), docs) for a in above]
        cdf = [np.zeros(docs), *(np.exp(x) for x in logs), np.ones(docs)]
        p = np.choose(grades, [cdf[k + 1] - cdf[k] for k in range(GRADES)])
        outer = -(1 - NOISE) / ((1 - NOISE) * p + NOISE / GRADES)  # d loss / d p
        gs, gc = np.zeros(n), []
        for k in range(2):  # d p / d cdf_k is 1 for the grade k and -1 for k + 1
            d = outer * cdf[k + 1] * ((grades == k).astype(float) - (grades == k + 1))
            part = d[text] * above[k]
            gs -= part
            gc.append(part.sum())
        g = np.concatenate([np.bincount(keys_at, gs[sentence], features) + PENALTY * w, gc])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-3)
        w -= move[:features]
        cuts -= move[features:]
        cuts[1] = max(cuts[1], cuts[0] + 0.05)
    return w, cuts


def _some(rows: DataFrame, most: int) -> DataFrame:
    """``most`` rows by hash of doc_id, or all if there are fewer; only about as many are sorted."""
    total = rows.count()
    u = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(3)), 11) / F.lit(float(1 << 53))
    near = rows.withColumn("u", u).where(F.col("u") <= min(1.0, (1.2 * most + 100) / max(total, 1)))
    return near.orderBy("u", "doc_id").limit(most).drop("u")


def train(documents: DataFrame, labels: DataFrame) -> SeverityModel:
    """The model of MOST_LABELLED labelled documents and as many without votes, taken by hash of the id.

    Few documents are abusive, so those without votes stand for grade 0, with some noise, as the votes have it too. Votes
    that are null are left out. Without any vote, or only of one kind, nothing is abusive.
    """
    votes = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.avg("toxic").alias("share"))
    grade = F.when(F.col("share") <= 0, 0).when(F.col("share") >= 1, 2).otherwise(1)
    # documents are chosen by their ids, which one pass over the texts gives, so that the texts chosen are read once
    ids = cut_lineage(documents.where("doc_id is not null and text is not null").select("doc_id"))
    taken = ids.join(F.broadcast(_some(votes, MOST_LABELLED)), "doc_id").select("doc_id", grade.alias("grade"))  # MOST_LABELLED rows
    taken = cut_lineage(taken.dropDuplicates(["doc_id"]))
    free = _some(ids.join(votes, "doc_id", "left_anti"), taken.count()).select("doc_id", F.lit(0).alias("grade"))
    chosen = documents.select("doc_id", "text").join(F.broadcast(taken.union(free).distinct()), "doc_id").where("text is not null")
    rows = sorted({r["doc_id"]: (r["doc_id"], r["grade"], r["text"]) for r in chosen.collect()}.values())
    return fit([r[2] for r in rows], np.array([r[1] for r in rows], int))


def _pieces(texts: list[str]) -> Iterator[tuple[int, tuple]]:
    """(index of the first text, its _grams) of pieces of bounded size."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size >= _CHUNK or i == len(texts) - 1:
            yield begin, _grams(texts[begin : i + 1])
            begin, size = i + 1, 0


def _expected(scores: np.ndarray, text: np.ndarray, cuts: np.ndarray, docs: int) -> np.ndarray:
    """Expected severity of each text from the scores of its sentences."""
    return sum(1 - np.exp(np.bincount(text, -np.logaddexp(0, scores - c), docs)) for c in cuts)


def fit(rows: list[str], grades: np.ndarray) -> SeverityModel:
    """The model of some texts and their grades."""
    nothing = SeverityModel(np.zeros(1, np.uint64), np.zeros(1), np.array([30.0, 31.0]), 1.0)
    if not len(rows) or not (grades == 0).any() or not (grades == 2).any():
        return nothing
    bad = grades > 0
    # counts by hash first, so that n-grams that can't count are never held
    shift, counts = np.uint64(64 - _BITS + 2), np.zeros((2, 1 << (_BITS - 2)), np.uint16)
    for at, (grams, sentence, text, _) in _pieces(rows):
        pair = np.unique((grams >> shift).astype(np.int64) * len(rows) + (text + at)[sentence])
        np.add.at(counts, (bad[pair % len(rows)].astype(int), pair // len(rows)), 1)
    wanted = (counts[1] >= LEAST_DOCS) & (counts[1] / bad.sum() >= RATIO * counts[0] / max(1, (~bad).sum()))
    parts, begin = [], 0
    for at, (grams, sentence, text, n) in _pieces(rows):
        hit = wanted[grams >> shift]
        parts.append((grams[hit], sentence[hit] + begin, text + at))
        begin += n
    grams, sentence, text = (np.concatenate([p[i] for p in parts]) for i in range(3))
    if not len(grams):
        return nothing
    # texts of each n-gram with votes for abuse, and without
    keys, at = np.unique(grams, return_inverse=True)
    pair = np.unique(at.astype(np.int64) * len(rows) + text[sentence])
    yes = np.bincount(pair // len(rows), bad[pair % len(rows)], len(keys))
    no = np.bincount(pair // len(rows), minlength=len(keys)) - yes
    ratio = (yes / bad.sum()) / ((no + 0.5) / ((~bad).sum() + 0.5))
    kept = np.flatnonzero((yes >= LEAST_DOCS) & (ratio >= RATIO))
    if not len(kept):
        return nothing
    place = np.full(len(keys), -1)
    place[kept] = np.arange(len(kept))
    use = np.flatnonzero(place[at] >= 0)
    one = np.unique(sentence[use].astype(np.int64) * len(kept) + place[at[use]])  # an n-gram counts once a sentence
    sentence, at = one // len(kept), one % len(kept)
    # what counts as abusive is decided on texts that the weights were not fitted to
    fold, held = np.arange(len(rows)) % 3, np.zeros(len(rows))
    for f in range(3):
        inner = fold[text] != f
        renumber, number = np.cumsum(inner) - 1, np.cumsum(fold != f) - 1
        mine = inner[sentence]
        w, cuts = _fit(at[mine], renumber[sentence[mine]], number[text[inner]], grades[fold != f], len(kept))
        scores = np.bincount(sentence, w[at], len(text))
        held[fold == f] = _expected(scores, text, cuts, len(rows))[fold == f]
    w, cuts = _fit(at, sentence, text, grades, len(kept))
    tries = np.linspace(0.3, 1.7, 29)
    f1 = np.array([2 * (bad & (held >= t)).sum() / max(1, bad.sum() + (held >= t).sum()) for t in tries])
    return SeverityModel(keys[kept], w, cuts, float(np.median(tries[f1 >= f1.max() - 0.005])))


def score(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, source, severity, abusive) of every document: expected severity from 0 to 2, and whether it counts as abusive.

    Null and empty texts have severity 0. Null sources stay null; repeated rows are each scored; further columns are ignored.
    """
    model = train(documents, labels)
    known = documents.sparkSession.sparkContext.broadcast((model.keys, model.weights, model.cuts, model.least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = SeverityModel(*known.value)
        for batch in batches:
            severity = fitted.severity([t or "" for t in batch.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(severity), pa.array(severity >= fitted.least)], names=["doc_id", "source", "severity", "abusive"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "source", "text").mapInArrow(run, f"doc_id {kind}, source string, severity double, abusive boolean")


def rates(scored: DataFrame) -> DataFrame:
    """Documents, abusive documents and their share by source."""
    counts = scored.groupBy("source").agg(F.count("*").alias("documents"), F.count_if("abusive").alias("abusive"), F.avg("severity").alias("mean_severity"))
    return counts.withColumn("rate", F.col("abusive") / F.col("documents"))

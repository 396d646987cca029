"""Texts that were decoded with the wrong character encoding, and their original spelling.

A chain encodes characters with the encoding that was wrongly used and decodes the bytes as UTF-8; chains repeat, since some
texts went through it twice. Character n-gram models, trained on the clean windows around the non-ASCII letters of all records, score
every candidate of every chain against the text as it stands, and the likeliest is taken if it wins by a margin that is
validated on all clean windows: garbled by each chain, and put side by side where chance makes them look garbled.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.session import cut_lineage

#: Encodings that UTF-8 bytes are wrongly read with.
SINGLE_BYTE = ("cp1252", "latin_1", "cp1250", "cp1251", "cp1254", "cp1257", "mac_roman", "cp437", "cp850", "cp866", "koi8_r")
DOUBLE_BYTE = ("gbk",)
CHAINS = SINGLE_BYTE + DOUBLE_BYTE
#: Size of the hashed count tables, the most times a chain is applied, and steps a unit of gain in which gains are counted.
BUCKETS, TIMES, STEPS = 1 << 17, 3, 1000
#: How often a non-ASCII run of clean text has another one right beside it (assumed).
MEETINGS = 0.01
LOST = "�"
_SEQUENCE = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")
_RUN = re.compile(r"[^\x00-\x7f]+")
_WIDE_RUN = re.compile(r"[\u2e80-\u9fff\ue000-\uf8ff]+[\x40-\x7e]?")


def _byte_table(codec: str) -> dict[str, int]:
    """Byte of each character; bytes that the encoding leaves undefined stand for the control of that number."""
    table = {}
    for b in range(128, 256):
        try:
            table[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            pass
    if codec.startswith("cp125"):
        for b in range(128, 256):
            if b not in table.values():
                table.setdefault(chr(b), b)
    return table


TABLES = {codec: _byte_table(codec) for codec in SINGLE_BYTE}
_SHOWN = {codec: {b: c for c, b in t.items()} for codec, t in TABLES.items()}
#: Of each encoding a pattern of its lead and continuation characters, for a first look by Spark.
_PAIRS = ["[{}][{}]".format(*("".join(f"\\x{{{ord(c):x}}}" for c, b in t.items() if low <= b <= high) for low, high in ((0xC2, 0xF4), (0x80, 0xBF)))) for t in TABLES.values()]
#: A lead and a continuation character of one encoding.
_MEETING = "|".join(_PAIRS)
SUSPECT = "|".join([_MEETING, r"[\x{3400}-\x{9fff}\x{e000}-\x{f8ff}]", r"\x{fffd}"])
#: Runs that can be suspect; the patterns above look at these alone, since most characters are ASCII.
_LOOK = r"[^\x00-\x7f]{2,}|[\x{3400}-\x{9fff}\x{e000}-\x{f8ff}\x{fffd}]"
WINDOW = r"(?s).{0,2}[^\x00-\x7f]+.{0,2}"


def suspect(text: Column) -> Column:
    """Whether a text holds a lead and a continuation character of one encoding side by side, or a replacement."""
    return F.array_join(F.regexp_extract_all(text, F.lit(_LOOK), 0), " ").rlike(SUSPECT)


def candidates(text: str, codec: str) -> list[tuple[int, int, str]]:
    """(start, end, restored) of each part of ``text`` that ``codec`` may have garbled."""
    out = []
    if codec in TABLES:
        table = TABLES[codec]
        for run in _RUN.finditer(text):
            raw = bytes(table.get(c, 0) for c in run.group())
            at, start, end, found = run.start(), -1, -1, []
            for m in _SEQUENCE.finditer(raw):  # neighbouring sequences belong together
                if m.start() == end:
                    end = m.end()
                else:
                    if start >= 0:
                        found.append((start, end))
                    start, end = m.span()
            if start >= 0:
                found.append((start, end))
            for s, e in found:
                try:
                    out.append((at + s, at + e, raw[s:e].decode("utf-8")))
                except UnicodeDecodeError:
                    pass
        return out
    for run in _WIDE_RUN.finditer(text):
        for whole in (run.group(), run.group().rstrip("@ABCDEFGHIJKLMNOPQRSTUVWXYZ[\\]^_`abcdefghijklmnopqrstuvwxyz{|}~")):
            try:
                out.append((run.start(), run.start() + len(whole), whole.encode(codec).decode("utf-8")))
                break
            except (UnicodeEncodeError, UnicodeDecodeError):
                continue
    return [c for c in out if c[2] != text[c[0] : c[1]]]


def garble(text: str, codec: str) -> str | None:
    """``text`` as ``codec`` shows its UTF-8 bytes; None where it can't."""
    if codec in TABLES:
        back = _SHOWN[codec]
        raw = text.encode("utf-8")
        return "".join(chr(b) if b < 128 else back.get(b, LOST) for b in raw) if all(b < 128 or b in back for b in raw) else None
    try:
        return text.encode("utf-8").decode(codec)
    except UnicodeDecodeError:
        return None


@lru_cache(1 << 18)
def _bucket(gram: str) -> int:
    h = 1469598103934665603
    for c in gram:
        h = (h ^ ord(c)) * 1099511628211 & 0xFFFFFFFFFFFFFFFF
    return (h ^ (h >> 29)) % BUCKETS


@dataclass
class CharModel:
    """Trigram model, smoothed with bigrams and unigrams; counts are hashed into tables of fixed size."""

    counts: np.ndarray  # of 1-grams, 2-grams and 3-grams, by bucket
    weight: float = 20.0

    def __post_init__(self) -> None:
        self.total = float(self.counts[0].sum())
        self.seen: dict[str, float] = {}

    def knows(self, text: str) -> bool:
        """Whether the clean records hold every character; one that takes three bytes or more need only be assigned."""
        return all(c < "\x80" or self.counts[0][_bucket(c)] > 0 or (c >= "\u0800" and unicodedata.category(c) not in ("Cn", "Co", "Cs", "Cc")) for c in text)

    def _one(self, gram: str) -> float:
        """Log probability of the last character of ``gram``, of three characters at most, given those before it."""
        if gram not in self.seen:
            p = (self.counts[0][_bucket(gram[-1])] + 0.05) / (self.total + 0.05 * BUCKETS)
            for size in range(2, len(gram) + 1):
                whole = gram[-size:]
                n, k = self.counts[size - 2][_bucket(whole[:-1])], self.counts[size - 1][_bucket(whole)]
                p = (k + self.weight * p) / (n + self.weight)
            if len(self.seen) > 200_000:
                self.seen.clear()
            self.seen[gram] = float(np.log(p))
        return self.seen[gram]

    def log(self, text: str, start: int) -> float:
        """Log probability of the characters from ``start`` on, each given the two before it."""
        return sum(self._one(text[max(0, i - 2) : i + 1]) for i in range(start, len(text)))

    def gain(self, text: str, start: int, end: int, new: str) -> float:
        """Log probability of ``new`` in place of text[start:end] over that of the text as it is."""
        left, right = text[max(0, start - 2) : start], text[end : end + 2]
        return self.log(left + new + right, len(left)) - self.log(left + text[start:end] + right, len(left))


def clean_windows(rows: DataFrame, text: str = "text") -> DataFrame:
    """(w, n): the distinct windows around non-ASCII characters that no encoding can have garbled, and how often each occurs."""
    windows = rows.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(WINDOW), 0)).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    return windows.where(~suspect(F.col("w")))


def train(windows: DataFrame) -> CharModel:
    """The model of all clean windows (w, n).

    Windows are counted by Spark; what reaches the driver are three tables of BUCKETS counts.
    """

    def grams(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sums = np.zeros((3, BUCKETS))
            for w, n in zip(frame["w"], frame["n"], strict=True):
                for size in (1, 2, 3):
                    for i in range(len(w) - size + 1):
                        sums[size - 1, _bucket(w[i : i + size])] += n
            size, bucket = np.nonzero(sums)
            yield pd.DataFrame({"size": size, "bucket": bucket, "n": sums[size, bucket]})

    # one partial table for each Arrow batch, added up by Spark
    found = windows.mapInPandas(grams, "size int, bucket int, n double").groupBy("size", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((3, BUCKETS))
    counts[found["size"], found["bucket"]] = found["n"]
    return CharModel(counts)


def repeated(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, restored, chain) of every candidate, also of those parts that were garbled up to TIMES times."""
    out = []
    for codec in CHAINS:
        for s, e, new in candidates(text, codec):
            level = [(new, codec)]
            for _ in range(TIMES):
                out += [(s, e, n, c) for n, c in level]
                level = [(x, f"{c}+{again}") for n, c in level for again in CHAINS for a, b, x in candidates(n, again) if (a, b) == (0, len(n))]
    return out


def meetings(windows: DataFrame) -> tuple[DataFrame, int]:
    """(tail, head, n): how many pairs of distinct runs of clean windows meet in these characters, and the number of all pairs.

    A sequence that arises where two clean runs meet starts with the last character of the first and goes on for three of
    the second at most, since neither holds one itself. With two characters of context on either side, its gain depends on
    the last three characters of the one and the first five of the other alone; pairs where no sequence can arise are left
    out of the rows.
    """
    runs = windows.select(F.explode(F.regexp_extract_all("w", F.lit(r"[^\x00-\x7f]+"), 0)).alias("run")).distinct().persist()
    try:
        count = runs.count()
        tails = runs.groupBy(F.expr("right(run, 3)").alias("tail")).agg(F.count("*").alias("of_tail"))
        heads = runs.groupBy(F.expr("left(run, 5)").alias("head")).agg(F.count("*").alias("of_head"))
        both = tails.crossJoin(heads).where(F.concat(F.expr("right(tail, 1)"), F.expr("left(head, 1)")).rlike(_MEETING))
        return cut_lineage(both.select("tail", "head", (F.col("of_tail") * F.col("of_head")).alias("n"))), count * count
    finally:
        runs.unpersist()


def _tallied(rows: DataFrame, counts: Broadcast, gains: Callable[[CharModel, tuple], list[float]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct gains in ascending order, to 1 / STEPS, and how often each occurs among ``gains`` of every row; the last column
    of a row says how often it counts. As many numbers reach the driver as gains have steps."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = CharModel(counts.value)
        for frame in frames:
            sums: dict[int, int] = {}
            for row in frame.itertuples(index=False):
                for gain in gains(model, row):
                    step = round(gain * STEPS)
                    sums[step] = sums.get(step, 0) + row[-1]
            yield pd.DataFrame({"step": list(sums), "n": list(sums.values())})

    found = rows.mapInPandas(run, "step long, n double").groupBy("step").agg(F.sum("n").alias("n")).toPandas().sort_values("step")
    return found["step"].to_numpy(float) / STEPS, found["n"].to_numpy(float)


def _right_gains(model: CharModel, row: tuple) -> list[float]:
    w, out = row[0], []
    for codec in CHAINS:
        bad = garble(w, codec)
        if bad is not None and bad != w:
            out += [model.gain(bad, s, e, new) for s, e, new in candidates(bad, codec) if bad[:s] + new + bad[e:] == w]
    return out


def _wrong_gains(model: CharModel, row: tuple) -> list[float]:
    w = row[0] + row[1]
    return [model.gain(w, s, e, new) for s, e, new, _ in repeated(w) if model.knows(new)]


def validated_margin(model: CharModel, windows: DataFrame) -> float:
    """The gain that best parts garbled windows, restored, from characters of clean windows that meet by chance.

    Every distinct clean window is garbled by every chain, and every two distinct runs meet once. A wrong repair counts five
    times, as a share of all meetings, of which MEETINGS happen; of equal margins the middle one is taken. Without clean
    windows it is 0.
    """
    context = windows.sparkSession.sparkContext
    counts = context.broadcast(model.counts)
    pairs, tried = meetings(windows)
    right, times = _tallied(windows.select("w", F.lit(1).alias("n")), counts, _right_gains)
    if not len(right):
        return 0.0
    wrong, also = _tallied(pairs, counts, _wrong_gains)
    return best_margin(right, times, wrong, also, tried)


def best_margin(right: np.ndarray, times: np.ndarray, wrong: np.ndarray, also: np.ndarray, tried: int) -> float:
    """The margin with least errors, from ascending gains and how often each occurs."""
    points = np.unique(np.concatenate([right, wrong, [0.0]]))
    missed = np.concatenate([[0.0], np.cumsum(times)])[np.searchsorted(right, points, "right")]
    below = np.concatenate([[0.0], np.cumsum(also)])[np.searchsorted(wrong, points, "right")]
    errors = missed / times.sum() + MEETINGS * 5 * (also.sum() - below) / max(tried, 1)
    best = points[errors == errors.min()]
    above = right[right > best[0]]
    return float((best[0] + above[0]) / 2 if len(above) else best[0])


def restore(text: str, model: CharModel, margin: float) -> tuple[str, str, int]:
    """(restored text, chains used, parts restored)."""
    scored = [(model.gain(text, s, e, new), s, e, new, chain) for s, e, new, chain in repeated(text) if model.knows(new)]
    taken = []
    for gain, s, e, new, chain in sorted(scored, key=lambda x: -x[0]):  # of equal gains the first chain
        if gain > margin and all(e <= a or s >= b for a, b, *_ in taken):
            taken.append((s, e, new, chain))
    out, last = [], 0
    for s, e, new, _ in sorted(taken):
        out += [text[last:s], new]
        last = e
    return "".join([*out, text[last:]]), " ".join(dict.fromkeys(t[3] for t in taken)), len(taken)


def garbled(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(table_name, record_id, restored, chains, parts, lost) of every record with a garbled part.

    ``tables``: name -> (rows with a ``text``, name of the id column). lost is the number of replacement characters, which
    can't be restored; a record with any of them is garbled. Null and empty texts and null ids give no row; repeated rows
    one row each; further columns are ignored. Without clean windows no restored letter is known, so only longer sequences and replacement characters count.
    """
    rows = None
    for name, (table, key) in tables.items():
        own = table.where(F.col(key).isNotNull()).select(F.lit(name).alias("table_name"), F.col(key).cast("string").alias("record_id"), "text")
        rows = own if rows is None else rows.union(own)
    with_letters = rows.where(F.col("text").rlike(r"[^\x00-\x7f]"))
    windows = clean_windows(with_letters).persist()
    try:
        model = train(windows)
        margin = validated_margin(model, windows)
    finally:
        windows.unpersist()
    known = rows.sparkSession.sparkContext.broadcast((model.counts, margin))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, least = known.value
        fitted, cache = CharModel(counts), {}
        columns = ["table_name", "record_id", "restored", "chains", "parts", "lost"]
        for frame in frames:
            out = []
            for name, key, text in zip(frame["table_name"], frame["record_id"], frame["text"], strict=True):
                lost = text.count(LOST)
                # parts repeat in many records, so each window is decided once a task
                pieces, chains, parts, last = [], [], 0, 0
                for m in _WINDOWS.finditer(text):
                    w = m.group()
                    if w not in cache:
                        if len(cache) > 100_000:
                            cache.clear()
                        cache[w] = restore(w, fitted, least)
                    new, chain, n = cache[w]
                    if n:
                        pieces += [text[last : m.start()], new]
                        last, parts = m.end(), parts + n
                        chains.append(chain)
                if parts or lost:
                    restored = "".join([*pieces, text[last:]])
                    out.append((name, key, restored, " ".join(dict.fromkeys(" ".join(chains).split())), parts, lost))
            yield pd.DataFrame(out, columns=columns)

    suspects = rows.where(suspect(F.col("text")))
    return suspects.mapInPandas(run, "table_name string, record_id string, restored string, chains string, parts int, lost int")


#: A run of non-ASCII characters, over single ASCII ones between, with two characters around.
_WINDOWS = re.compile(r"(?s)[\x00-\x7f]{0,2}(?:[^\x00-\x7f]+[\x00-\x7f]{0,2})+")

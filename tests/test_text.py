import math
import re

import pytest
from pyspark.sql import functions as F

from loomline.functions import text as T
from loomline.operators import segments


def one(spark, make, value):
    return spark.createDataFrame([(value,)], "c string").select(make(F.col("c")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("raw", "clean"),
    [
        (None, ""),
        ("a &amp; b &lt;b&gt;bold&lt;/b&gt; &#160;&unknown;", "a & b bold"),
        ("x<script>var a;</script>y <nav>menu</nav>z", "xy z"),
        ("keep <!-- drop\nthis --> 2024-01-02 v1.2", "keep 2024-01-02 v1.2"),
        ("[![b](https://img.shields.io/x.svg)](http://u) text", ""),  # a line that begins with a badge goes as a whole
        ("see [![b](https://img.shields.io/x.svg)](http://u) text", "see text"),
        ("a  \t b   \n\n\n\n c\x07d ", "a b\n\n cd"),
    ],
)
def test_clean_text(spark, raw, clean):
    assert one(spark, T.clean_text, raw) == clean


def test_cleaning_by_source(spark):
    made = lambda kind, raw: spark.createDataFrame([(raw, kind)], "c string, k string").select(T.clean_text(F.col("c"), F.col("k")).alias("r")).first()["r"]
    raw = r"\textbf{Bold} \begin{flalign*}\sum x\end{flalign*} \noindent \(\frac12\)"
    assert made(" Paper", raw) == r"Bold \begin{flalign*}\sum x\end{flalign*} \(\frac12\)"
    assert made("blog", raw) == made(None, raw) == raw
    assert made("docs", "[![x](https://img.shields.io/a.svg)](u) and the rest of the line\nkept\u00e2\u20ac\u2122s") == "kept's"
    assert made("survey", None) == ""


def test_folding(spark):
    assert one(spark, T.for_matching, "Café—\u0110ặng  e\u0301!") == "cafe \u0111ang e" and one(spark, T.for_matching, None) == ""


def test_tables_stay_whole_in_chunks(spark):
    table = "".join(f"| row {i} | {'x' * 20} |\n" for i in range(30))
    text = "a" * 700 + "\n" + table + "b" * 900 + "\n| one row |\n" + "c" * 500
    rows = spark.createDataFrame([(1, text), (2, "x" * 1500), (3, None)], "k int, text string")
    assert spark.createDataFrame([(text,)], "t string").select(segments.table_spans(F.col("t")).alias("s")).first()["s"] == [(701, 701 + len(table))]
    got = segments.chunks(rows, "k", whole_tables=True).orderBy("k", "chunk_index").collect()
    assert [(r["start_char"], r["end_char"]) for r in got if r["k"] == 2] == [(0, 1000), (800, 1500)]
    mine = [r for r in got if r["k"] == 1]
    assert mine[0]["end_char"] == 701 + len(table) and all(r["text"] == text[r["start_char"] : r["end_char"]] for r in mine)


def test_mend_hyphens(spark):
    assert one(spark, T.mend_hyphens, "compet- itive and fine- tuned") == "competitive and fine-tuned"


def test_words(spark):
    assert one(spark, T.words, "What is the Self-RAG of 2023, in v2 x?") == ["self-rag", "2023", "v2"]
    assert one(spark, T.words, None) == []


def test_topic_key(spark):
    assert [one(spark, T.topic_key, t) for t in (" AI-Agent", "Knowledge distillation", "storage", "safety x", None)] == ["ai_agent", "knowledge_distillation", "rag", "safety_x", ""]


@pytest.mark.parametrize(
    ("sentence", "year", "want"),
    [
        ("In March 2023 and on 2021-05-06", None, ("2021-05-06", 2021, 1.0)),
        ("Released in MARCH 2023 since 2019", None, ("2023-03", 2023, 0.9)),
        ("Used since 2019, 2020", None, ("2019", 2019, 0.85)),
        ("The 2018 model", 2017, ("2018", 2018, 0.7)),
        ("No date", 2017, ("2017", 2017, 0.4)),
        (None, None, (None, None, 0.0)),
    ],
)
def test_dates(spark, sentence, year, want):
    row = spark.createDataFrame([(sentence, year)], "s string, y int").select(T.date_struct(F.col("s"), F.col("y")).alias("d")).first()["d"]
    assert (row["normalized_date"], row["extracted_year"], row["confidence"]) == want


def test_chunks_cover_the_text(spark):
    for n in (0, 1, 1000, 1001, 1600, 1800, 5000):
        text = "".join(chr(97 + i % 26) for i in range(n))
        rows = segments.chunks(spark.createDataFrame([(1, text)], "k int, text string"), "k").orderBy("chunk_index").collect()
        assert len(rows) == (0 if n == 0 else 1 if n <= 1000 else math.ceil(n / 800))
        assert all(text[r["start_char"] : r["end_char"]] == r["text"] for r in rows)
    with pytest.raises(ValueError):
        segments.chunks(spark.createDataFrame([], "k int, text string"), "k", size=10, overlap=10)


def test_sentences_like_a_regex(spark):
    text = "Dr. Who came e.g. late. Why? Because of Fig. 2.5 it was so! No. Überlänge ist gut. "
    pattern = re.compile(r"(?<!\w\.\w.)(?<![A-Z][a-z]\.)(?<=\.|\?)\s")
    want = [s.strip() for s in pattern.split(text) if s.strip()]
    rows = segments.sentences(spark.createDataFrame([(1, text)], "k int, text string"), ["k"], least=1).orderBy("sentence_index").collect()
    assert [r["text"] for r in rows] == want


def test_global_numbers(spark):
    rows = spark.createDataFrame([(g, i) for g in "cab" for i in range(5)], "g string, i int").repartition(4)
    got = segments.global_numbers(rows, "g", ["i"]).orderBy("number").collect()
    assert [(r["g"], r["i"], r["number"]) for r in got] == [(g, i, n) for n, (g, i) in enumerate((g, i) for g in "abc" for i in range(5))]


def test_table_blocks(spark):
    text = "x\n| a | b |\n|---|---|\n| 1 | 2 |\ny\n| lone |\n"
    rows = segments.table_blocks(spark.createDataFrame([(1, text), (2, None)], "k int, text string"), "k").collect()
    assert [tuple(r) for r in rows] == [(1, 1, 3, 3)]

import pytest

from loomline.sources import stages, tables


def test_stage_is_made_once(spark, tmp_path):
    calls = []

    def make():
        calls.append(1)
        return spark.range(5)

    key = stages.chained("a", 1)
    for _ in range(2):
        assert stages.stage(spark, str(tmp_path), key, make).count() == 5
    assert len(calls) == 1
    stages.stage(spark, str(tmp_path), stages.chained("a", 2), make)
    assert len(calls) == 2


def test_fingerprint(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (2, None)], "i int, s string")
    assert stages.fingerprint(a) == stages.fingerprint(a.repartition(3).orderBy("i"))
    assert stages.fingerprint(a) != stages.fingerprint(a.distinct())


def test_csv_with_mark_and_line_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿id,text\n1,"two\nlines, ""quoted"""\n', encoding="utf-8")
    assert [tuple(r) for r in tables.read_csv(spark, str(tmp_path / "a.csv")).select("id", "text").collect()] == [("1", 'two\nlines, "quoted"')]


def test_lines_fail_on_bad_rows(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": 1}\n{"id": \n', encoding="utf-8")
    with pytest.raises(Exception, match="Malformed|MALFORMED|FAILFAST|malformed"):
        tables.read_lines(spark, str(tmp_path / "a.json"), "id int").collect()


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.MD").write_text("x")
    (tmp_path / "b.docx").write_text("y")
    rows = tables.read_files(spark, str(tmp_path)).collect()
    assert [(r["suffix"], bytes(r["content"])) for r in rows] == [("md", b"x")]


def test_html_and_latex(spark):
    from pyspark.sql import functions as F

    from loomline.functions.html import html_text
    from loomline.functions.text import drop_latex

    page = "<nav>menu</nav><p>One &amp; two</p><img alt='cat'><img src='x.png'><table><tr><th>a</th></tr><tr><td>1|2</td><td>3</td></tr></table><script>x</script>"
    math = r"\textbf{Bold} costs \$5 and $$x_{\alpha}$$ \begin{align}a&b\end{align} \cite{k} \foo{bar} ﬁne"
    row = spark.createDataFrame([(page, math), (None, None)], "p string, m string").select(html_text(F.col("p")).alias("h"), drop_latex(F.col("m")).alias("l")).collect()
    assert row[0]["h"] == "One & two\n[Image: cat]\n| a |  |\n| --- | --- |\n| 1\\|2 | 3 |"
    assert row[0]["l"] == r"Bold costs \$5 and $$x_{\alpha}$$ \begin{align}a&b\end{align} k  fine"
    assert row[1]["h"] is None and row[1]["l"] is None


def test_sentences_and_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("s1", "text\nover lines", None), ("s2", 'with "quotes", commas', "sentence")], "sentence_id string, text string, sentence string")
    tables.write_lines(rows, str(tmp_path / "lines"))
    assert [r["text"] for r in tables.read_sentences(spark, str(tmp_path / "lines")).orderBy("sentence_id").collect()] == ["text\nover lines", 'with "quotes", commas']
    tables.write_csv(rows.select("sentence_id", "text"), str(tmp_path / "csv"))
    assert sorted(tuple(r) for r in tables.read_csv(spark, str(tmp_path / "csv")).collect()) == sorted(tuple(r) for r in rows.select("sentence_id", "text").collect())
    (tmp_path / "bad.jsonl").write_text('{"sentence_id": "x"}\n')
    with pytest.raises(Exception, match="missing text/sentence"):
        tables.read_sentences(spark, str(tmp_path / "bad.jsonl")).collect()

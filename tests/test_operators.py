import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.operators import classify, corpus, labelling, retrieval, timeline
from loomline.streaming import windows


def test_bm25_against_a_loop(spark):
    r = random.Random(1)
    vocabulary = [f"term{i}" for i in range(12)]
    docs = [(i, "", "", " ".join(r.choice(vocabulary) for _ in range(r.randrange(3, 20)))) for i in range(40)]
    asked = ["term1 term2 term2", "term5"]
    split = [d[3].split() for d in docs]
    df = Counter(t for w in split for t in set(w))
    raw = {t: np.log(40 - n + 0.5) - np.log(n + 0.5) for t, n in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {t: x if x >= 0 else 0.25 * mean for t, x in raw.items()}
    avg = sum(map(len, split)) / 40
    want = {}
    for q, text in enumerate(asked):
        for i, w in enumerate(split):
            held = [t for t in text.split() if t in w]
            if held:
                s = sum(idf[t] * w.count(t) * 2.5 / (w.count(t) + 1.5 * (0.25 + 0.75 * len(w) / avg)) for t in set(held))
                want[q, i] = s + len(set(held))
    terms = retrieval.query_terms(spark.createDataFrame(list(enumerate(asked)), "q int, text string"), "q", F.col("text"))
    index = retrieval.build_index(spark.createDataFrame(docs, "k int, title string, topic string, text string"), "k", retrieval.index_text())
    got = retrieval.bm25(terms, index, "q", "k").collect()
    assert {(r["q"], r["k"]) for r in got} == set(want)
    assert all(abs(r["score"] - want[r["q"], r["k"]]) < 2e-6 for r in got)


def test_no_match_gives_no_rows(spark):
    docs = spark.createDataFrame([(1, "t", "x", "some text")], "k int, title string, topic string, text string")
    asked = spark.createDataFrame([(1, "unrelated"), (2, None)], "q int, text string")
    index = retrieval.build_index(docs, "k", retrieval.index_text())
    assert retrieval.bm25(retrieval.query_terms(asked, "q", F.col("text")), index, "q", "k").count() == 0
    empty = retrieval.build_index(docs.limit(0), "k", retrieval.index_text())
    assert retrieval.bm25(retrieval.query_terms(asked, "q", F.col("text")), empty, "q", "k").count() == 0


def test_fusion_and_diversity(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "q int, k string, rank int")
    b = spark.createDataFrame([(1, "y", 1)], "q int, k string, rank int")
    got = {r["k"]: r["score"] for r in retrieval.fuse([(a, 1.0), (b, 1.0)], "q", "k").collect()}
    assert got["y"] > got["x"]
    ranked = spark.createDataFrame([(1, "a", 1.0, 1, ["p", "q"]), (1, "b", 0.99, 2, ["p", "q"]), (1, "c", 0.9, 3, ["z"])], "q int, k string, score double, rank int, terms array<string>")
    assert [r["k"] for r in retrieval.diversify(ranked, "q", "k", 2, 10).orderBy("place").collect()] == ["a", "c"]


def test_nearest_against_numpy(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(200, 8))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(5)
    got = retrieval.nearest(table.where("vec_id % 50 = 0"), table, 3, block=2)
    s = x.astype(np.float32).astype(float) @ x.astype(np.float32).astype(float).T
    for q in (0, 50, 100, 150):
        best = [i for i in np.argsort(-s[q]) if i != q][:3]
        assert [r["vec_id"] for r in got.where(F.col("query_id") == q).orderBy("rank").collect()] == best
    near = retrieval.nearest_in_cells(table.where("vec_id % 50 = 0"), table, 3, cells=8, probes=8)
    assert retrieval.recall(near, got, "query_id", "vec_id").first()["recall"] == 1
    assert retrieval.nearest_in_cells(table.limit(0), table.limit(0)).count() == 0


def test_rerank_and_topics(spark):
    ranked = spark.createDataFrame([(1, "a", "what is alpha", "nothing here"), (1, "b", "what is alpha", "alpha is here"), (1, "c", None, None)], "q int, k string, question string, text string")
    assert [r["k"] for r in retrieval.rerank(ranked, retrieval.shared_terms, "question", "text", "q", "k", 2).orderBy("rank").collect()] == ["b", "a"]
    scores = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0), (2, "a", 1.0)], "q int, k string, score double")
    asked = spark.createDataFrame([(1, "RAG"), (2, None)], "q int, topic string")
    docs = spark.createDataFrame([("a", "rag"), ("b", "ai-agent")], "k string, topic string")
    assert {(r["q"], r["k"]) for r in retrieval.same_topic(scores, asked, docs, "q", "k").collect()} == {(1, "a"), (2, "a")}


def test_ranking_metrics(spark):
    ranked = spark.createDataFrame([("a", "d1", 1), ("a", "d2", 2), ("b", "d9", 1)], "qid string, found string, rank int")
    queries = spark.createDataFrame([("a", "t", ["d2"]), ("b", "t", ["d1"]), ("c", "u", ["d1"])], "qid string, topic string, expected array<string>")
    rows = {r["topic"]: r for r in retrieval.ranking_metrics(ranked, queries, "qid", "found", "expected", ["topic"]).collect()}
    assert rows[None]["queries"] == 3 and rows["t"]["hit_3"] == 0.5 and rows["t"]["hit_1"] == 0 and rows["t"]["mrr"] == 0.25


def budgets(sizes, target, least, cap, small):
    """Round by round, as a loop."""
    have = {d: min(n, least) for d, n in sizes.items()}
    most = {d: n if n <= small else min(n, cap) for d, n in sizes.items()}
    left = target - sum(have.values())
    while left > 0 and any(have[d] < most[d] for d in have):
        for d in sorted(have):
            if left > 0 and have[d] < most[d]:
                have[d] += 1
                left -= 1
    return have


def test_budgets_against_a_loop(spark):
    r = random.Random(3)
    for _ in range(4):
        sizes = {f"d{i:02d}": r.randrange(1, 40) for i in range(r.randrange(3, 20))}
        rows = spark.createDataFrame([("t", d, n) for d, n in sizes.items()], "g string, d string, n long")
        target = r.randrange(60, 250)
        got = {x["d"]: x["budget"] for x in labelling.doc_budgets(rows, "g", "d", target, 3, 15, 8).collect()}
        assert got == budgets(sizes, target, 3, 15, 8)


def test_violations_and_metrics(spark):
    columns = "sentence_id string, doc_id string, sentence string, is_event string, event_type string"
    rows = [("a", "d", "A sentence of enough length.", "1", "release"), ("a", "d", "A sentence of enough length.", "1", "none"), ("b", None, "", "2", "odd"), ("c", "d", "x" * 600, "0", "benchmark")]
    got = {r["rule"]: r["rows"] for r in labelling.violations(spark.createDataFrame(rows, columns)).collect()}
    assert got == {"empty_sentence": 1, "length": 2, "is_event_value": 1, "event_type_value": 1, "event_without_type": 1, "type_without_event": 1, "no_document": 1, "repeated_id": 1}
    confusion = spark.createDataFrame([("1", "1", 8), ("1", "0", 2), ("0", "1", 2)], "truth string, guess string, rows long")
    metrics = {r["label"]: (r["precision"], r["recall"], r["f1"]) for r in labelling.class_metrics(confusion).collect()}
    assert metrics == {"1": (0.8, 0.8, 0.8), "0": (0.0, 0.0, 0.0)}


def test_timeline_joins_paraphrases(spark):
    rows = [
        ("s1", "d1", "rag", "Velmar was released in March 2023 by the Orbel team.", "1", "release", "2023"),
        ("s2", "d2", "rag", "Velmar was released in March 2023 by the Orbel team!", "1", "release", "2023"),
        ("s3", "d1", "rag", "No event here.", "0", "none", "2023"),
        ("s4", "d3", "rag", "The Kirnel benchmark scored 2019 points.", "1", "benchmark", "2023"),
    ]
    table = spark.createDataFrame(rows, "sentence_id string, doc_id string, topic string, sentence string, is_event string, event_type string, year string")
    out = timeline.timeline(timeline.event_rows(table)).collect()
    assert [(r["event_id"], r["date"], r["size"], r["sources"]) for r in out] == [("rag_evt_001", "2023-03", 2, 2)]


def greedy(rows):
    """The cluster of each sentence, by a loop: rows are (sentence_id, sentence, confidence) of one group."""
    first = {}
    for k, text, c in rows:
        first[text] = min(first.get(text, (-c, k)), (-c, k))
    order = sorted((at, text) for text, at in first.items())
    times, bags = Counter(text for _, text, _ in rows), {}
    for _, text in order:
        w = re.findall(r"\w\w+", text.lower())
        bags[text] = Counter(w + [f"{x} {y}" for x, y in zip(w, w[1:], strict=False)])
    df = Counter()
    for text, bag in bags.items():
        for g in bag:
            df[g] += times[text]
    unit = {}
    for text, bag in bags.items():
        v = {g: n * (np.log((1 + len(rows)) / (1 + df[g])) + 1) for g, n in bag.items()}
        norm = np.sqrt(sum(x * x for x in v.values())) or 1
        unit[text] = {g: x / norm for g, x in v.items()}
    found = {}
    for (_, k), text in order:
        near = [found[t] for t in found if sum(x * unit[t].get(g, 0) for g, x in unit[text].items()) >= timeline.SIMILAR - 1e-9]
        found[text] = min(near) if near else (first[text][0], k)
    return {k: found[text][1] for k, text, _ in rows}


def test_clusters_against_a_loop_in_a_group_of_hundreds(spark):
    r = random.Random(3)
    vocabulary = [f"word{i}" for i in range(60)]
    rows = []
    for g in range(120):
        base = [r.choice(vocabulary) for _ in range(r.randrange(6, 14))]
        for _ in range(r.randrange(1, 8)):
            w = list(base)
            if r.random() < 0.7:
                w[r.randrange(len(w))] = r.choice(vocabulary)
            rows.append((f"s{len(rows):04d}", " ".join(w), r.choice([0.7, 0.85, 0.9])))
    rows += [("t1", "\u2014", 0.4), ("t2", "\u0417\u0430\u043f\u0443\u0449\u0435\u043d\u043e \u0441\u0435\u0433\u043e\u0434\u043d\u044f", 0.4), ("t3", "", 0.4)]
    assert len(rows) > 400
    table = spark.createDataFrame([(k, f"d{k}", "rag", "release", 2023, "2023", c, t) for k, t, c in rows], "sentence_id string, doc_id string, topic string, event_type string, year int, date string, confidence double, sentence string")
    got = {x["sentence_id"]: x["cluster"] for x in timeline.clusters(table).collect()}
    assert got == greedy(rows)
    assert timeline.clusters(table.limit(0)).count() == 0


def test_register_and_candidates(spark):
    meta = "doc_id string, title string, topic string, year string, published_date string, authors string, source_url string, retrieved_at string"
    known = spark.createDataFrame([("rag_1", "Old  Title", "rag", "2020.0", None, "A; B ;", "u", "2024"), ("rag_1", "Old Title", "rag", "2020", None, "A", "u", "2023"), ("rag_12", None, None, None, "2019-02", None, None, None)], meta)
    rows = {r["doc_id"]: r for r in corpus.register(known).collect()}
    assert rows["rag_1"]["authors"] == ["A", "B"] and rows["rag_1"]["year"] == 2020 and rows["rag_12"]["year"] == 2019
    fresh = spark.createDataFrame([("p1", "OLD title!", "rag", "2021", None), ("p2", "New", "RAG", "2021", None), ("p3", "new", "rag", "2022", None), ("p4", "Ancient", "rag", "1999", None)], "doc_id string, title string, topic string, year string, published_date string")
    assert [r["doc_id"] for r in corpus.new_candidates(fresh, known, 2020, 2024, 5).collect()] == ["p3"]
    assert {r["prefix"]: r["next"] for r in corpus.next_numbers(known).collect()} == {"rag": 13}


def test_stream_gives_what_the_table_gives(spark, tmp_path):
    rows = [(i, f"2024-01-{1 + i // 24:02d} {i % 24:02d}:10:00", i % 3, "click" if i % 2 else "view", 1.5) for i in range(200)]
    table = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    table.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second call finds nothing new
        windows.write_once(windows.hourly_stream(stream), str(tmp_path / "out"), str(tmp_path / "state"))
    got = {(r["window_start"], r["event_type"]): r["events"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r["window_start"], r["event_type"]): r["events"] for r in windows.hourly(table).collect()}
    # windows that the watermark has not passed are still open
    assert set(got) <= set(want) and len(want) - len(got) <= 4 and all(want[k] == v for k, v in got.items())


def test_timeline_candidates(spark):
    good = "We propose Velmar, a retrieval framework that was released in March 2023 with code."
    rows = [
        ("s1", "d1", "RAG", 2023, good, 1, 0.9, "method_proposed", 0.8),
        ("s2", "d2", "rag", 2023, good.replace("March", "**March**") + " [1, 2]", 1, 0.6, "method_proposed", 0.7),
        ("s3", "d3", "rag", 2023, good, 0, 0.36, "none", None),  # rescued, its type is inferred
        ("s4", "d4", "rag", 2023, good, 1, 0.5, "release", 0.9),  # rescued as well
        ("s5", "d5", "rag", 2023, good, 0, 0.2, "none", 0.0),
        ("s6", "d6", "rag", 2020, "The Velmar method of 2019 was then introduced as a model.", 1, 0.9, "method_proposed", 0.9),  # another year than its document's
        ("s7", "d7", "rag", 2023, "Figure 3 shows the method that was introduced in March 2023.", 1, 0.9, "method_proposed", 0.9),
        ("s8", None, None, None, None, None, None, None, None),
    ]
    table = spark.createDataFrame(rows, "sentence_id string, doc_id string, topic string, year int, sentence string, is_event int, event_probability double, event_type string, event_type_confidence double")
    got = {r["sentence_id"]: r for r in timeline.candidates(table).collect()}
    assert set(got) == {"s1", "s2", "s3", "s4"}
    assert got["s3"]["event_type"] == "release" and got["s1"]["sentence"] == got["s2"]["sentence"]
    # proposed in two spellings and released, the way a method is introduced; 0.55, 0.25 and 0.20 of the probabilities and the date
    assert got["s1"]["representative"] == pytest.approx(0.55 * 0.9 + 0.25 * 0.8 + 0.2 * 0.9 + 0.08, abs=1e-6)
    assert got["s1"]["quality"] == pytest.approx(0.2 * 2 + 0.25, abs=1e-6)
    out = timeline.ranked_timeline(timeline.candidates(table)).collect()
    assert [(r["event_id"], r["size"], r["sentence_ids"]) for r in out] == [("rag_evt_001", 2, ["s1", "s2"]), ("rag_evt_002", 2, ["s3", "s4"])]
    assert out[0]["title"] == "Method: " + good and out[0]["date"] == "2023-03"


def test_scores_and_second_labels(spark):
    confusion = spark.createDataFrame([("a", "a", 3), ("a", "b", 1), ("b", "b", 4), ("b", "a", 2)], "truth string, guess string, rows long").withColumn("m", F.lit("x"))
    one = classify.scores(confusion, ["m"]).first()
    assert (one["rows"], one["accuracy"]) == (10, 0.7)
    assert one["macro_f1"] == pytest.approx((2 * 3 / 9 + 2 * 4 / 11) / 2, abs=1e-6) and one["weighted_recall"] == 0.7
    labels = spark.createDataFrame([("k", "1", "ann"), ("k", "0", "bob"), ("k", "0", "bob"), ("j", "1", "ann"), (None, "1", "ann")], "k string, label string, judge string")
    assert [tuple(r) for r in labelling.second_labels(labels, "k", "label", "judge").collect()] == [("1", "0", 1)]


def test_budgets_beyond_the_target_are_cut(spark):
    sizes = spark.createDataFrame([("t", f"d{i}", 12) for i in range(5)] + [("u", "e", 100)], "g string, d string, n long")
    got = {r["d"]: r["budget"] for r in labelling.doc_budgets(sizes, "g", "d", 48, least=10, cap=20, small=6).collect()}
    assert got == {"d0": 9, "d1": 9, "d2": 10, "d3": 10, "d4": 10, "e": 20}
    got = {r["d"]: r["budget"] for r in labelling.doc_budgets(sizes, "g", "d", 20, least=10, cap=20, small=6).collect()}
    assert got["d4"] == 9 and got["e"] == 20


def test_draw_beyond_a_hundred(spark):
    scored = spark.createDataFrame([("g", "d", f"k{i:03d}", "low") for i in range(300)], "g string, d string, k string, bucket string")
    budgets = spark.createDataFrame([("g", "d", 250)], "g string, d string, budget long")
    assert labelling.draw_by_bucket(scored, budgets, "g", "d", "k").count() == 250


def test_rules_for_documents_and_joins(spark):
    docs = spark.createDataFrame([(1, "t", "paper", "word " * 200, 2020), (2, None, "blog", " ", None), (3, "t", None, None, 2020), (4, "t", "x", "<script> few", 2020)], "doc_id long, title string, source_type string, text string, year int")
    assert {r["rule"]: r["rows"] for r in labelling.document_violations(docs).collect()} == {"no_text": 1, "empty_text": 1, "too_few_words": 1, "few_words": 1, "noise": 1, "no_title": 1, "no_year": 1}
    known = spark.createDataFrame([("a", "rag", "Title", "u"), ("b", "rag", "Other", "v")], "doc_id string, topic string, title string, source_url string")
    rows = spark.createDataFrame([("s", "a"), ("t", "z"), ("u", None)], "sentence_id string, doc_id string")
    assert {r["sentence_id"]: r["registered_title"] for r in corpus.with_titles(rows, known).collect()} == {"s": "Title", "t": None, "u": None}
    texts = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "doc_id long, ref_doc_id string")
    assert {tuple(r) for r in corpus.loaded(known, texts).collect()} == {("a", 2, "loaded"), ("b", 0, "missing")}
    assert {tuple(r) for r in corpus.renumbered(known).collect()} == {("a", "rag_0001"), ("b", "rag_0002")}

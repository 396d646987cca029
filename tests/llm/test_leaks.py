import random
import re

from loomline.llm import leaks

SCHEMA = "doc_id long, text string, fp long, key string, around string"
ITEMS = "item_id long, qid string, text string, fp int"


def words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def brute(docs, items):
    out = set()
    for d, t in docs:
        w = words(t)
        grams = {tuple(w[i : i + 10]) for i in range(len(w) - 9)}
        for k, x in items:
            v = words(x)
            if any(tuple(v[i : i + 10]) in grams for i in range(len(v) - 9)):
                out.add((d, k))
    return out


def test_against_brute_force(spark):
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(12)]  # few words, so that parts of spans recur
    items = [(k, " ".join(r.choice(vocabulary) for _ in range(r.randrange(5, 60)))) for k in range(30)]
    docs = []
    for d in range(150):
        w = [r.choice(vocabulary) for _ in range(r.randrange(0, 80))]
        if d % 2:
            v = items[r.randrange(30)][1].split()
            n = r.randrange(8, 13)
            i = r.randrange(max(1, len(v) - n))
            w[10:10] = v[i : i + n]
        docs.append((d, ", ".join(w).upper() if d % 3 else "\n".join(w)))
    got = leaks.leaked(spark.createDataFrame([(d, t, 1, "a", "b") for d, t in docs * 2], SCHEMA), spark.createDataFrame([(k, "q", t, 1) for k, t in items], ITEMS))
    rows = [tuple(x) for x in got.collect()]
    assert set(rows) == brute(docs, items) and len(rows) == len(set(rows))


def test_edges(spark):
    text = " ".join(f"Wörd{i}" for i in range(10))
    docs = [(1, text, 1, "a", "b"), (2, None, 1, "a", "b"), (3, "", 1, "a", "b"), (4, text[:-2], 1, "a", "b"), (5, "x " * 300_000 + text, 1, "a", "b"), (None, text, 1, "a", "b")]
    table = spark.createDataFrame(docs, SCHEMA)
    items = spark.createDataFrame([(7, "q", text, 1), (8, "q", None, 1), (9, None, "too short", 1)], ITEMS)
    assert {tuple(x) for x in leaks.leaked(table, items).collect()} == {(1, 7), (5, 7), (None, 7)}
    none = spark.createDataFrame([], ITEMS)
    assert leaks.leaked(table, none).count() == 0
    assert leaks.leaked(spark.createDataFrame([], SCHEMA), items).count() == 0
    report = {x["item_id"]: x["documents"] for x in leaks.leak_report(leaks.leaked(table, items), items).collect()}
    assert report == {7: 2, 8: 0, 9: 0}


def test_same_pairs_without_early_filter(spark, monkeypatch):
    text = " ".join(f"v{i}" for i in range(30))
    docs = spark.createDataFrame([(1, text, 1, "a", "b"), (2, "other words", 1, "a", "b")], SCHEMA)
    items = spark.createDataFrame([(7, "q", text[20:80], 1)], ITEMS)
    monkeypatch.setattr(leaks, "MOST_SENT", 0)
    assert [tuple(x) for x in leaks.leaked(docs, items).collect()] == [(1, 7)]

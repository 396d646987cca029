from collections import Counter

from loomline.llm import sampling

SCHEMA = "sentence_id string, doc_id string, topic string, u double, bin int, at int"
TARGETS = "topic string, target_permille int, min_rows int, max_per_doc int"


def table(spark, rows):
    return spark.createDataFrame([(s, d, t, 0.0, 0, 0) for s, d, t in rows], SCHEMA)


def targets(spark, rows):
    return spark.createDataFrame(rows, TARGETS)


def test_counts_are_exact_and_caps_hold(spark):
    rows = [(f"d{i % 50}_s{i}", f"d{i % 50}", "Big-Topic " if i % 2 else "small") for i in range(4000)] + [(f"hot_s{i}", "hot", "big topic") for i in range(2000)]
    goal = targets(spark, [("big_topic", 700, 10, 40), ("small", 100, 10, 40), ("none", 200, 7, 5)])
    out = sampling.draw(table(spark, rows * 2), goal).collect()
    n = 6000 // 5
    assert Counter(r["topic"] for r in out) == {"big_topic": 840, "small": 120}
    assert len({r["sentence_id"] for r in out}) == len(out)
    assert max(Counter((r["topic"], r["doc"]) for r in out).values()) <= 40
    report = {r["topic"]: (r["needed"], r["offered"], r["missing"]) for r in sampling.shortfalls(table(spark, rows), goal).collect()}
    assert report["none"] == (n // 5, 0, n // 5) and report["small"][2] == 0


def test_short_topic_gives_all_it_has(spark):
    rows = [(f"a_s{i}", "a", "x") for i in range(30)] + [(f"b{i}_s1", f"b{i}", "y") for i in range(70)]
    goal = targets(spark, [("x", 500, 20, 4), ("y", 500, 1, 4)])
    got = Counter(r["topic"] for r in sampling.draw(table(spark, rows), goal).collect())
    assert got == {"x": 4, "y": 10}
    assert {r["topic"]: r["missing"] for r in sampling.shortfalls(table(spark, rows), goal).collect()} == {"x": 16, "y": 0}


def test_nulls_and_empty_tables(spark):
    goal = targets(spark, [("x", 1000, 1, 4)])
    rows = [(None, "a", "x"), ("a_s1", None, "x"), ("b_s1", "b", None), ("c_s1", "c", " X")]
    assert {r["sentence_id"] for r in sampling.draw(table(spark, rows), goal).collect()} <= {"a_s1", "c_s1"}
    assert sampling.draw(table(spark, []), goal).count() == 0
    assert sampling.shortfalls(table(spark, []), goal).first()["missing"] == 1
    assert sampling.draw(table(spark, rows), targets(spark, [])).count() == 0


def test_same_sample_for_rows_in_any_order(spark):
    rows = [(f"d{i % 9}_s{i}", f"d{i % 9}", "x") for i in range(300)]
    goal = targets(spark, [("x", 1000, 1, 40)])
    a = {r["sentence_id"] for r in sampling.draw(table(spark, rows), goal).collect()}
    b = {r["sentence_id"] for r in sampling.draw(table(spark, rows[::-1]).repartition(3), goal).collect()}
    assert a == b and len(a) == 60


def test_shared_ids_go_where_they_are_needed(spark):
    """Ids of a full doc or an ample topic are left to the scarce one; what is drawn is reported."""
    rows = [(f"p{i}_s1", f"p{i}", "ample") for i in range(200)]
    rows += [(f"x_s{i}", "a_full", "scarce") for i in range(40)] + [(f"x_s{i}", f"own{i}", "scarce") for i in range(20)] + [(f"x_s{i}", "a_full", "ample") for i in range(20)]
    goal = targets(spark, [("ample", 500, 1, 4), ("scarce", 500, 24, 4)])
    out = sampling.draw(table(spark, rows), goal)
    report = {r["topic"]: (r["needed"], r["offered"], r["drawn"], r["deficit"]) for r in sampling.drawn(out, table(spark, rows), goal).collect()}
    assert report == {"ample": (24, 204, 24, 0), "scarce": (24, 24, 24, 0)}

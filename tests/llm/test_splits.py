import random

from pyspark.sql import functions as F

from loomline.llm import splits

SCHEMA = "sentence_id string, doc_id string, event_type string, component string, u string, v string"
TARGETS = [("train", 700), ("validation", 150), ("test", 150)]


def table(spark, rows):
    return spark.createDataFrame([(s, d, t, "x", "y", "z") for s, d, t in rows], SCHEMA)


def brute(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    groups = {}
    for x in list(parent):
        groups.setdefault(find(x), set()).add(x)
    return {frozenset(g) for g in groups.values()}


def test_components_agree_with_union_find(spark):
    r = random.Random(1)
    edges = [(f"n{r.randrange(60)}", f"n{r.randrange(60)}") for _ in range(45)] + [(f"p{i}", f"p{i + 1}") for i in range(40)]
    got = {}
    for row in splits.components(spark.createDataFrame(edges, "u string, v string")).collect():
        got.setdefault(row["component"], set()).add(row["node"])
    assert {frozenset(g) for g in got.values()} == brute([e for e in edges if e[0] != e[1]])


def test_contraction_and_one_task_agree_and_plans_stay_small(spark, monkeypatch):
    r = random.Random(3)
    edges = [(f"n{r.randrange(30)}", f"n{r.randrange(30)}") for _ in range(15)] + [(f"p{i}", f"p{i + 1}") for i in range(20)]
    cut, sizes = splits.cut_lineage, []

    def counted(df):
        sizes.append(df._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD"))
        return cut(df)

    monkeypatch.setattr(splits, "cut_lineage", counted)
    for at_once, most_cuts in ((splits.AT_ONCE, 3), (5, 40)):
        sizes.clear()
        got = {}
        for row in splits.components(spark.createDataFrame(edges, "u string, v string"), at_once=at_once).collect():
            got.setdefault(row["component"], set()).add(row["node"])
        assert {frozenset(g) for g in got.values()} == brute([e for e in edges if e[0] != e[1]])
        assert len(sizes) <= most_cuts and max(sizes) <= len(sizes) + 4  # a plan grows by a scan a round, not twofold


def test_components_of_nothing(spark):
    assert splits.components(spark.createDataFrame([], "u string, v string")).count() == 0
    assert splits.components(spark.createDataFrame([("a", "a")], "u string, v string")).count() == 0


def test_clean_doc_and_chains(spark):
    rows = table(spark, [("A_s1", " Doc1 ", "x"), ("A_s1", "doc2", "x"), ("doc2_s_s9", None, "x"), ("doc2_s_s9", "doc3", "x"), (None, "doc2", "x"), ("lone_s1", "  ", None), ("lone_s1", "lone", None)])
    pairs = {tuple(r) for r in splits.linked_pairs(splits.linked_docs(rows)).collect()}
    assert pairs == {("doc1", "doc2"), ("doc2_s", "doc3")}


def test_split_keeps_groups_and_comes_close(spark):
    r = random.Random(2)
    rows = [(f"d{d}_s{i}", f"d{d}", r.choice("ab")) for d in range(1, 400) for i in range(3)]
    rows += [("d1_s0", "d2", "a"), ("d2_s0", "d3", "a")]
    rows += [(f"hot_s{i}", "hot", "a") for i in range(600)]  # a third of all rows
    out = splits.split_records(table(spark, rows), spark.createDataFrame(TARGETS, "split_name string, target_permille int"))
    got = {x["sentence_id"]: x["split"] for x in out.collect()}
    assert len(got) == len({s for s, *_ in rows}) == out.count()
    by_doc = {}
    for s, d, _ in rows:
        by_doc.setdefault(d, set()).add(got[s])
    assert all(len(x) == 1 for x in by_doc.values())
    assert by_doc["d1"] == by_doc["d2"] == by_doc["d3"]
    share = sum(v == "test" for v in got.values()) / len(got)
    assert abs(share - 0.15) < 0.03


def test_split_of_nothing(spark):
    targets = spark.createDataFrame(TARGETS, "split_name string, target_permille int")
    assert splits.split_records(table(spark, []), targets).count() == 0
    assert splits.split_records(table(spark, [(None, None, None)]), targets).count() == 0


def test_shares(spark):
    rows = table(spark, [("a_s1", "a", "x"), ("a_s2", "a", "y"), ("b_s1", "b", None)])
    assigned = spark.createDataFrame([("a_s1", "train"), ("a_s2", "train"), ("b_s1", "test")], "sentence_id string, split string")
    got = {(r["split"], r["event_type"]): r["rows"] for r in splits.split_shares(rows, assigned).collect()}
    assert got == {("train", "x"): 1, ("train", "y"): 1, ("test", ""): 1}
    assert splits.split_shares(rows, assigned).agg(F.sum("rows")).first()[0] == 3

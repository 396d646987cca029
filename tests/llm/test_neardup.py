import random
from collections import Counter

from loomline.llm import neardup

SCHEMA = "sentence_id string, sentence string, bag string, n int, token long, w string"


def brute(rows):
    texts = [(k, t.lower().split()) for k, t in rows if t and k]
    out = set()
    for i, (a, x) in enumerate(texts):
        for b, y in texts[i + 1 :]:
            if a != b and min(len(x), len(y)) >= 8 and sum((Counter(x) & Counter(y)).values()) >= 0.8 * max(len(x), len(y)) - 1e-9:
                out.add((min(a, b), max(a, b)))
    return out


def table(spark, rows):
    return spark.createDataFrame([(k, t, "b", 1, 2, "w") for k, t in rows], SCHEMA)


def test_against_brute_force(spark):
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(40)]
    rows = []
    for g in range(60):
        base = [r.choice(vocabulary) for _ in range(r.randrange(5, 40))]
        for v in range(r.randrange(1, 5)):
            w = list(base)
            for _ in range(r.randrange(0, max(1, len(w) // 4))):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            r.shuffle(w)
            rows.append((f"k{g}_{v}", " ".join(w)))
    rows += rows[:10]
    got = [tuple(x) for x in neardup.near_duplicates(table(spark, rows)).collect()]
    assert set(got) == brute(rows) and len(got) == len(set(got))


def test_edges(spark):
    t = "one two three four five six seven eight"
    rows = [("a", t), ("b", t.upper() + "!"), ("a", "other words one two three four five six seven"), ("c", None), ("d", ""), (None, t), ("e", "one two"), ("f", "x " * 50_000), ("g", "x " * 49_000)]
    got = {tuple(x) for x in neardup.near_duplicates(table(spark, rows)).collect()}
    assert got == {("a", "b"), ("f", "g")}
    assert neardup.near_duplicates(table(spark, [])).count() == 0
    classes = {(x["sentence_id"]): x["links"] for x in neardup.duplicate_classes(table(spark, rows)).where("sentence_id in ('f', 'b')").collect()}
    assert classes == {"f": 1, "b": 0}


def test_pruning_keeps_what_reaches_the_threshold():
    least = neardup.least_matches(0.8)
    assert len(least) == len(neardup.STEPS) and all(a <= b for a, b in zip(least, least[1:], strict=False))
    assert 0 < least[-1] < neardup.STEPS[-1] * 2 / 3

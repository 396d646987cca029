import random

import numpy as np

from loomline.llm import abuse

DOCS = "doc_id long, text string, source string, grade int, share double, h long"
VOTES = "doc_id long, toxic int, annotator string"


def docs(spark, rows):
    return spark.createDataFrame([(k, t, s, 1, 0.5, 3) for k, t, s in rows], DOCS)


def plain(text):
    return "".join(map(chr, abuse._plain(np.frombuffer(text.encode("utf-32-le"), "<u4")).tolist()))


def test_hidden_spellings():
    assert plain("You l0s3r") == "you loser"
    assert plain("c l o w n") == "clown" and plain("p.i.g.s.") == "pigs."
    assert plain("stuріd") == "stupid" and plain("su​bhuman") == "subhuman"
    assert plain("fuuuuuck") == "fuck" and plain("good book 2004 3.5") == "good book 2004 3.5"


def corpus(n):
    r = random.Random(6)
    calm = ["The planner of {} ranks 12 passages.", "We follow {} and report recall.", "Naked-eye checks of {} passed.", "Kill the process of {} again."]
    rude = ["{}, you worthless loser, shut up.", "People like {} should be locked in cages.", "{} wrote: you are scum and stink."]
    rows, truth = [], {}
    for i in range(n):
        name = "".join(r.choice("abcdefgh") for _ in range(6)).title()
        parts = [r.choice(calm).format(name) for _ in range(r.randrange(1, 9))]
        bad = i % 3 == 0 if i < 400 else i % 15 == 0  # the reviewed sample is richer, as in the data
        if bad:
            parts.insert(r.randrange(len(parts)), r.choice(rude).format(name))
        rows.append((i, " ".join(parts), "s" + str(i % 2)))
        truth[i] = bad
    return rows, truth


def test_held_out_accuracy(spark):
    rows, truth = corpus(900)
    r = random.Random(7)
    votes = [(i, int(truth[i] != (r.random() < 0.05)), "a") for i in range(400)] + [(0, 0, "b"), (1, None, "b"), (None, 1, "b")]
    scored = abuse.score(docs(spark, rows), spark.createDataFrame(votes, VOTES))
    got = {x["doc_id"]: x["abusive"] for x in scored.collect()}
    right = np.mean([got[i] == truth[i] for i in range(400, 900)])
    assert right > 0.95
    by_source = {x["source"]: x for x in abuse.rates(scored).collect()}
    assert by_source["s0"]["documents"] == 450 and 0.1 < by_source["s0"]["rate"] < 0.3


def test_edges(spark):
    rows = [(1, None, None), (2, "", "s"), (3, "word " * 300_000, "s"), (None, "text", "s")]
    none = spark.createDataFrame([], VOTES)
    out = abuse.score(docs(spark, rows * 2), none).collect()
    assert len(out) == 8 and not any(x["abusive"] for x in out)
    assert abuse.score(docs(spark, []), none).count() == 0

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from loomline.llm import pieces

SCHEMA = "chunk_id string, doc_id string, text string, start_char int, base int, k int"


def rejoin(text, cuts):
    assert cuts[0][0] == 0 and cuts[-1][1] == len(text)
    for (_, end), (start, _) in zip(cuts, cuts[1:], strict=False):
        assert end - pieces.OVERLAP <= start <= end
    assert all(0 < e - s <= pieces.LIMIT for s, e in cuts)
    out = text[: cuts[0][1]]
    for (_, end), (_, e) in zip(cuts, cuts[1:], strict=False):
        out += text[end:e]
    return out


def prose(n, seed=0):
    r = random.Random(seed)
    return "".join(r.choice(["word ", "Longer words. ", "a ", "line\n", "end?\n\n"]) for _ in range(n))


@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from("ab é.\n\U0001f680?"), min_size=1001, max_size=4000))
def test_pieces_cover_any_text(text):
    assert rejoin(text, pieces.cut_points(text)) == text


def test_cuts_are_natural():
    text = prose(3000)
    cuts = pieces.cut_points(text)
    assert rejoin(text, cuts) == text
    assert all(text[e - 1].isspace() for _, e in cuts[:-1])


def test_text_without_boundaries_and_short_ones():
    text = "x" * 25_000
    assert rejoin(text, pieces.cut_points(text)) == text
    assert pieces.cut_points("") == [] and pieces.cut_points("x" * 1000) == [(0, 1000)]


def test_an_edit_changes_only_near_pieces():
    text = prose(20_000, 3)
    at = len(text) // 2
    edited = text[:at] + "INSERTED words here. " + text[at:]
    a = {text[s:e] for s, e in pieces.cut_points(text)}
    b = {edited[s:e] for s, e in pieces.cut_points(edited)}
    assert len(a - b) <= 6 and len(b - a) <= 6


def test_operator(spark):
    long = prose(400)
    rows = [("c1", "d", long, 100, 5, 5), ("c1", "d", long, 100, 5, 5), ("c2", "d", "short", 0, 5, 5), ("c3", None, None, None, None, None), ("c4", "d", "", 0, 5, 5), ("c5", "d", "y" * 300_000, None, 1, 1), (None, "d", long, -4, 1, 1)]
    out = pieces.split_oversized(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["chunk_id"] for r in out} == {"c1", "c5", None}
    for r in out:
        assert len(r["text"]) <= 1000 and r["end_char"] - r["start_char"] == len(r["text"])
    one = [r for r in out if r["chunk_id"] == "c1" and r["chunk_index"] == 2]
    assert len(one) == 2 and long[one[0]["start_char"] - 100 : one[0]["end_char"] - 100] == one[0]["text"]
    assert min(r["start_char"] for r in out if r["chunk_id"] == "c5") == 0
    assert pieces.split_oversized(spark.createDataFrame([], SCHEMA)).count() == 0

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparquill.llm.splitting import bisect_text, needed_boundary, split_oversized


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .!?\n\r\t。中", min_size=0, max_size=400), st.integers(12, 60), st.integers(0, 5))
def test_pieces_put_together_are_the_text(text, limit, overlap):
    pieces = bisect_text(text, limit, overlap)
    assert all(0 < b - a <= limit for a, b, _ in pieces)
    if len(text) > limit:
        assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
        for (_, end, _), (start, _, _) in zip(pieces, pieces[1:]):
            assert end - start == min(overlap, end)


def test_cuts_at_the_strongest_boundary():
    text = "a" * 30 + ". " + "b" * 10 + "\n\n" + "c" * 40
    assert [text[a:b] for a, b, _ in bisect_text(text, 50, 0)] == [text[:44], text[44:]]
    assert bisect_text("x" * 100, 60, 10) == [(0, 50, ""), (40, 100, "none")]


@pytest.mark.parametrize("text, level", [
    ("a" * 9 + "\n \n" + "b" * 9, "paragraph"), ("a" * 9 + "\n" + "b" * 9, "line"), ("a" * 8 + ". " + "b" * 9, "sentence"), ("中" * 8 + "。" + "中" * 9, "sentence"),
    ("a" * 9 + " " + "b" * 9, "word"), ("a" * 19, "none"), ("a" * 9 + "\r\n" + "b" * 9, "line"), ("a" * 9 + "\r\n\r\n" + "b" * 9, "paragraph"),
])
def test_needed_boundary(text, level):
    assert needed_boundary(text, 10) == level


def test_rows(spark):
    rng = random.Random(4)
    long = "".join(rng.choice("ab .\n") for _ in range(20_000))
    rows = [(1, long, "p"), (1, long, "p"), (2, "short", None), (3, "", "p"), (4, None, "p"), (None, "𝒳" * 4097, "p")]
    df = spark.createDataFrame(rows, "chunk_id bigint, content_text string, position_path string").selectExpr("*", "1 AS id", "'x' AS text", "2 AS start")
    got = split_oversized(df, "chunk_id", "content_text", keep=["position_path"]).collect()
    assert sum(r.id == 1 and r.piece_no == 0 for r in got) == 2
    first = sorted({(r.piece_no, r.start, r.text) for r in got if r.id == 1})
    assert first[0][2] + "".join(t[200:] for _, _, t in first[1:]) == long
    assert [(r.text, r.boundary, r.position_path) for r in got if r.id == 2] == [("short", None, None)]
    assert {r.id for r in got} == {1, 2, None} and [r.boundary for r in got if r.id is None] == ["none", "none"]
    assert split_oversized(df.limit(0), "chunk_id", "content_text").collect() == []
    with pytest.raises(ValueError):
        split_oversized(df, "chunk_id", "content_text", keep=["start"])

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparquill.llm import tokens
from sparquill.llm.mixing import mix
from sparquill.llm.packing import contexts, fill_report, first_fit_decreasing, pack, pieces_of_sizes


@pytest.mark.parametrize("text", ["Retry the queue, bitte 检索 42 times. " * 20_000, "a" * 450_000, "检索" * 150_000, " " * 300_000 + "x", "=-" * 100_000, "\n" * 200_000, ""])
def test_very_long_texts_count_whole(text):
    encoding = tokens._encoding(tokens.VOCABULARY)
    ids = encoding.encode_ordinary(text)
    assert encoding.decode(ids) == text and tokens.count_tokens(text) == len(ids)
    pieces = tokens.text_pieces(text, 2048)
    assert [(a, b) for a, b, _, _ in pieces] == [(0 if k == 0 else pieces[k - 1][1], p[1]) for k, p in enumerate(pieces)]
    assert sum(b - a for a, b, _, _ in pieces) == len(ids) and all(0 < b - a <= 2048 for a, b, _, _ in pieces)
    assert "".join(text[c:d] for _, _, c, d in pieces) == text
    assert all(encoding.decode(ids[a:b]) == text[c:d] for a, b, c, d in pieces)


def test_counts(spark):
    df = spark.createDataFrame([(1, "hello world", "s"), (2, None, None), (3, "", "s"), (None, "hello", "s")], "d bigint, text string, source string").selectExpr("*", "7 AS id", "8 AS n_tokens")
    assert sorted(((r.id or 0), r.n_tokens) for r in tokens.with_token_counts(df, "d", "text", ["source"], "/opt/tokenizers/byte_bpe_50k.tiktoken").collect()) == [(0, 1), (1, 2), (2, 0), (3, 0)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_first_fit_by_hand(sizes):
    room, want = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        b = next((k for k, r in enumerate(room) if r >= sizes[i]), len(room))
        if b == len(room):
            room.append(20)
        room[b] -= sizes[i]
        want[i] = b
    assert first_fit_decreasing(sizes, 20) == want


def test_packing(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([0, None, 3, 100, 5000, rng.randint(1, 2048)])) for i in range(300)] + [(None, 10), (None, 10), (7, 10)]
    packed = pack(pieces_of_sizes(spark.createDataFrame(rows, "id bigint, n_tokens int")), group_rows=100)
    got = packed.collect()
    bins, sums = {}, {}
    for r in got:
        bins[r.bin_id] = bins.get(r.bin_id, 0) + r.n_tokens
        assert r.n_tokens <= 2048 and (r.n_pieces == 1 or r.n_tokens == 2048 or r.piece_no == r.n_pieces - 1)
        sums[r.id] = sums.get(r.id, 0) + r.n_tokens
    assert max(bins.values()) <= 2048 and sum(bins.values()) == sum(n or 0 for _, n in rows)
    assert all(sums[i] == n for i, n in rows if i is not None and n and i != 7)
    report = fill_report(packed).first()
    assert report.bins == len(bins) and report.bins <= report.least_bins * 1.1 + 4
    empty = spark.createDataFrame([], "id bigint, n_tokens int")
    assert pack(pieces_of_sizes(empty)).collect() == [] and fill_report(pack(pieces_of_sizes(empty))).first().bins == 0
    with pytest.raises(ValueError):
        first_fit_decreasing([5], 4)


def test_contexts_hold_the_texts(spark):
    rng = random.Random(12)
    rows = [(i, " ".join(rng.choice(["queue", "检索", "Zähler", "shard", "\U0001f600"]) for _ in range(rng.choice([0, 5, 40, 400])))) for i in range(60)] + [(60, None)]
    df = spark.createDataFrame(rows, "doc bigint, text string").selectExpr("*", "1 AS id", "2 AS pieces")
    packed = pack(tokens.with_token_pieces(df, "doc", "text", 64), 64)
    got = contexts(packed, df, "doc", "text").collect()
    texts = {}
    for r in got:
        assert r.n_tokens <= 64
        for item in r["items"]:
            texts.setdefault(item.id, {})[item.piece_no] = item.text
    assert {i: "".join(p[k] for k in sorted(p)) for i, p in texts.items()} == {i: t for i, t in rows if t}


def documents(rng):
    rows = [(i, rng.choice([" Wiki", "wiki", "WIKI "]) if i < 900 else "rare" if i < 940 else None if i < 960 else "other", rng.randint(1, 400)) for i in range(1000)]
    return rows + [(2000, "wiki", None), (2001, "wiki", -4)]


def test_mix(spark):
    rows = documents(random.Random(6))
    targets = [("Wiki", 0.4, 2), ("Rare", 0.5, 3), ("absent", 0.1, 2), (None, 0.2, 1)]
    sized = spark.createDataFrame(rows, "id bigint, source string, n_tokens int")
    drawn, report = mix(sized, spark.createDataFrame(targets, "source string, target_share double, max_repeats int"))
    total = sum(max(n or 0, 0) for _, _, n in rows)
    rep = {r.source: r for r in report.collect()}
    assert set(rep) == {"Wiki", "Rare", "absent"}
    assert abs(rep["Wiki"].drawn_tokens - 0.4 * total) <= 400 and rep["Wiki"].reachable
    rare = sum(n for _, s, n in rows if s == "rare")
    assert rep["Rare"].drawn_tokens == 3 * rare and rep["Rare"].reachable == (3 * rare >= 0.5 * total)
    assert rep["absent"].drawn_tokens == 0 and not rep["absent"].reachable
    assert math.isclose(sum(r.actual_share for r in rep.values()), 1)
    got = drawn.collect()
    assert {r.source: max(x.repeats for x in got if x.source == r.source) for r in got} == {"Wiki": 1, "Rare": 3}


def test_larger_budgets_draw_more(spark):
    sized = spark.createDataFrame(documents(random.Random(7)), "id bigint, source string, n_tokens int")
    targets = spark.createDataFrame([("wiki", 1.0, 3)], "source string, target_share double, max_repeats int")
    of = lambda n: {r.id: r.repeats for r in mix(sized, targets, n)[0].collect()}
    small, large = of(20_000), of(250_000)
    assert set(small) <= set(large) and all(large[i] >= k for i, k in small.items())


def test_empty_mix(spark):
    sized = spark.createDataFrame([], "id bigint, source string, n_tokens int")
    drawn, report = mix(sized, spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeats int"))
    assert drawn.collect() == [] and report.first().drawn_tokens == 0

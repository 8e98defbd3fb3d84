import json
import random

import pyarrow as pa
import pytest

from sparquill.llm import markup as mk


@pytest.mark.parametrize("text, kinds", [
    ("<h2>Title</h2> a &mdash; b<br/>", ["html"]), ("<!-- note -->x", ["html"]), ("<TABLE BORDER=1><TR><TD>x</TD></TR></TABLE>", ["html"]), ("<div class='note'\n  id=\"x\">y", ["html"]),
    ("# Head\ntext", ["markdown"]), ("Head\n=====\ntext", ["markdown"]), ("so **strong** it is", ["markdown"]), ("an *emphasis* here", ["markdown"]), ("__Nested index__ x", ["markdown"]), ("~~gone~~", ["markdown"]),
    ("see [label](http://x.y)", ["markdown"]), ("see [label][r3]", ["markdown"]), ("[r3]: http://x.y/z", ["markdown"]), ("![alt](img.png)", ["markdown"]), ("call `f()` now", ["markdown"]), ("> quoted", ["markdown"]),
    ("| a | b |\n|---|:--:|\n| 1 | 2 |", ["markdown"]), ("```xml\n<div>**x**</div>\n```", ["markdown"]), ("```\nopen fence $a_1$", ["markdown"]),
    ("== Head ==\nx", ["wiki"]), ("see [[Page|label]]", ["wiki"]), ("{{cite|a|2004}}", ["wiki"]), ("{{Infobox shard\n|owner=a\n|state=b}}", ["wiki"]), ("'''bold''' and ''it''", ["wiki"]), ("{| class=wikitable\n|-\n| a || 25\n|}", ["wiki"]),
    ("\\section{Intro} x", ["latex"]), ("\\begin{itemize}\n\\item a\n\\end{itemize}", ["latex"]), ("here $x_{c}^{4} = 1$ holds", ["latex"]), ("\\[ t \\leq 12\\,q \\]", ["latex"]), ("$$ w(a) = \\sqrt{n} $$", ["latex"]), ("weight \\(a \\cdot x\\) is", ["latex"]), ("\\cite{x2016}", ["latex"]),
    ("<pre><code>a = **b**</code></pre>", ["html"]), ("<b>**x**</b> and $a^2$", ["html", "latex", "markdown"]),
    # look-alikes
    ("Set the field to <api-key> and keep <token> out", []), ("returns a Map<String, Long> keyed", []), ("at <86 ms and >568 tokens", []), ("C:\\new\\cursor\\role on the host", []), ("pays $43 per blob and $14 per span", []),
    ("Ticket #7723 asks for 6 * 4 * 8 entries [22].", []), ("The Q&A desk; then wait ~294 ms.", []), ("Choose read | write | none for {clause} here", []), ("It holds that a_b == c_d whenever a[6] < b[0] and c > 49.", []), ("- item\n- item", []), ("snake_case_name and __init__", []),
    ("", []), ("   \n ", []),
])
def test_kinds(text, kinds):
    assert mk.parse(text).kinds() == kinds


def test_clean_text_keeps_structure():
    text = "# Top\nSee [the **guide**](http://x) &amp; more.\n\n<ul><li>one</li><li>two</li></ul>\n```py\na = '**b**'\n```\nWhere $x^2$ is.\n== Wiki ==\n{{note|kept}}"
    p = mk.parse(text)
    out = mk.render(p.pieces)
    assert out.startswith("# Top") and "See the guide & more." in out and "- one" in out and "    a = '**b**'" in out and "x^2" in out and "# Wiki" in out and "kept" in out
    assert ("code", 0, "a = '**b**'") in [x[:3] for x in p.pieces] and ("formula", 0, "x^2") in [x[:3] for x in p.pieces]


def test_hard_inputs_end_soon():
    for text in ("[" * 5000, "*a " * 5000, "<" * 5000, "{{" * 3000, "`" * 4001, "$" * 4001, "\\" * 4001, "'" * 4001, "|" * 4001, "=" * 4001, "x" * 300_000, "<a " * 3000, "**a" * 30_000, "[a](" * 2000, "# " * 50_000, "<!-- a " * 20_000, "f(" * 50_000):
        mk.render(mk.parse(text).pieces)


def test_a_host_has_one_wrapper_of_all_its_streams(spark):
    rng = random.Random(11)
    kinds = ["<b>x</b>", "**y**", "$a^2$", "[[p]]", "`c`", "text"]
    rows = [(i, " ".join(rng.choice(kinds) for _ in range(rng.randint(1, 12))), "big") for i in range(300)] + [(300, "**a** " * 3000, "big"), (301, "plain", None)]
    df = spark.createDataFrame(rows, "id bigint, text string, host string")
    streams = mk.tokenised(df, "id", "text", "host").cache()
    one = {r.key: r.wrapper for r in mk.Wrappers(streams, part_streams=2).of_hosts.collect()}  # some 100 parts, merged in rounds
    assert set(one) == {"hbig", "n"}
    wrapper = [(tuple(g), o, r) for g, o, r in json.loads(one["hbig"])]
    assert all(mk.covered(wrapper, r.stream.split()) == r.stream.split() for r in streams.collect() if r.host)


def test_the_wrapper_decides(spark, monkeypatch):
    df = spark.createDataFrame([(1, "# a\n**b**", "h"), (2, "<b>c</b>", "h"), (3, "d", "g")], "id bigint, text string, host string")
    full = {tuple(r) for r in mk.markup_kinds(df, "id", "text", "host").collect()}
    assert full == {(1, "markdown"), (2, "html")}
    wrappers = mk.Wrappers(mk.tokenised(df, "id", "text", "host"))
    other = json.dumps([[["md_heading"], False, False], [["slot"], True, True], [["md_strong"], False, False], [["slot"], False, False]])
    wrappers.of_hosts = spark.createDataFrame([("hh", other), ("hg", json.dumps([[["slot"], False, False]]))], "key string, wrapper string")
    got = wrappers.take(lambda columns, taken: pa.RecordBatch.from_arrays([columns[0], pa.array([mk.kinds_of(t) for t in taken], pa.list_(pa.string()))], names=["id", "kinds"]), "id bigint, kinds array<string>", ["id"])
    assert {(r.id, tuple(r.kinds)) for r in got.collect()} == {(1, ("markdown",)), (2, ()), (3, ())}


def test_repeats_of_any_length_fold():
    group = [f"t{i}" for i in range(90)]
    assert mk.fold_repeats(group * 3 + ["end"]) == [(tuple(group), False, True), (("end",), False, False)]
    assert mk.covered(mk.fold_repeats(group * 3), group * 7) == group * 7


def test_ends_that_are_far_away():
    far = "word " * 2000
    assert mk.parse(f"**{far}x** b").kinds() == ["markdown"] and mk.parse(f"''{far}x'' b").kinds() == ["wiki"]
    assert mk.parse(f"\\[ {far} \\]").kinds() == ["latex"] and mk.parse(f"\\( {far} \\)").kinds() == ["latex"] and mk.parse(f"$a^2 {far}x$ b").kinds() == ["latex"]


def test_wrappers_cover_what_they_are_made_of():
    rng = random.Random(8)
    for _ in range(40):
        streams = [[rng.choice("abcd") for _ in range(rng.randint(0, 9))] for _ in range(8)]
        wrapper = []
        for k, s in enumerate(sorted(streams, key=len)):
            wrapper = mk.align(wrapper, mk.fold_repeats(s)) if k else mk.fold_repeats(s)
        assert all(mk.covered(wrapper, s) == s for s in streams)
    rows = mk.fold_repeats("h li slot li slot li slot f".split())
    assert mk.expression(rows) == "h (li slot)+ f"
    assert mk.expression(mk.align(rows, mk.fold_repeats("h li slot".split()))).count("?") >= 1
    assert mk.covered(rows, ["h", "f"]) is None


def test_rows(spark):
    rows = [(1, "# a\ntext", "h"), (1, "# a\ntext", "h"), (2, "plain", "h"), (3, None, "h"), (4, "", None), (5, "<b>x</b> **y**", None), (None, "`c`", "h")]
    df = spark.createDataFrame(rows, "chunk_id bigint, content_text string, source string").selectExpr("*", "9 AS id", "'q' AS stream", "'q' AS host")
    got = {tuple(r) for r in mk.markup_kinds(df, "chunk_id", "content_text", "source").collect()}
    assert got == {(1, "markdown"), (5, "html"), (5, "markdown"), (None, "markdown")}
    clean = mk.clean_texts(df, "chunk_id", "content_text", keep=["source"]).collect()
    assert len(clean) == 7 and {(r.id, r.clean_text) for r in clean} == {(1, "# a\n\ntext"), (2, "plain"), (3, None), (4, ""), (5, "x y"), (None, "c")}
    assert mk.markup_kinds(df.limit(0), "chunk_id", "content_text", "source").collect() == []
    with pytest.raises(ValueError):
        mk.clean_texts(df, "chunk_id", "content_text", keep=["text"])

import random

from sparquill.llm import stuffing as sf

PROSE = "The storage team asks the retry queue to lock the upstream runbook. After 369 tokens a dense shard path expands the trigger of the worker. We read the local manifest because the global heading publishes the branch. A cold parser keeps seven pages for the index and copies them at night."
GERMAN = "Nach 884 Minuten wiederholt der Mandant den Entwurf. Wenn der Verweis fehlt, verwirft das Team die Fehler. Der doppelte Abschnitt bleibt gesperrt, solange der Rückstand den Schwellwert meldet."
CHINESE = "如果锁定的图谱不可用，则比较稠密的标题，随后过滤副本。清单每221分钟释放一次自动的规划器。不要让租户复制共享的归档，否则稀疏的索引变得稀疏。"
LINK = "https://hub.example/path-{}"
WORDS = "retry queue shard heading parser".split()


def stuffed(rng):
    n = range(40)
    return [
        " ".join(rng.choice(WORDS) for _ in range(120)),
        ", ".join(f"{rng.choice(['buy', 'cheap', 'best', 'top'])} {rng.choice(WORDS)} {rng.choice(WORDS)}" for _ in n),
        " ".join(f"#{rng.choice(WORDS)}{rng.choice(['buy', 'now', ''])}" for _ in n),
        "\n".join(LINK.format(i) for i in n),
        "".join(f'<a href="{LINK.format(i)}">{rng.choice(WORDS)}</a>' for i in n),
        "\n".join(f"[{rng.choice(WORDS)}]({LINK.format(i)})" for i in n),
        " » ".join(f"Some title {i} - www.hub.example/p-{i}" for i in n),
        "\n".join(f"Name{i} C-{1000 + i}, {i}.99, buy" for i in n),
        "\n".join(f"silent audit in Place{i}x" for i in n),
        " ".join(f"{rng.choice(['Buy', 'Top'])} {rng.choice(WORDS)} now." for _ in n),
        PROSE[:80] + "\n" + " / ".join(f"{rng.choice(['BUY', 'NOW'])} {rng.choice(WORDS).upper()}" for _ in n),
    ]


def sound():
    return [
        PROSE, GERMAN, CHINESE, "Title line\n\n" + PROSE + "\n\nTags: a, b, c, d", "  if (a.b() < 4 && c > 3) {\n  Map<String, X> m = new HashMap<>();\n" * 12,
        "\n".join(f"retry_queue_{i} = {i}\n{s}" for i, s in enumerate(PROSE.split(". "))), "\n".join(f"2026-01-{i:02d}T19:04:53 ERROR repo.resolve took={i}ms" for i in range(1, 29)),
        "\n".join(f"{i}. Handling the stale parser of case {i}" for i in range(1, 9)) + "\n\n" + PROSE, "\n".join("- " + s + "." for s in PROSE.split(". ")), "\n".join(f"Term{i}: {s}." for i, s in enumerate(PROSE.split(". "))),
        PROSE + " See https://a.example/x and https://b.example/y.", "n/a", "", "  \n", None,
    ]


def test_pages(spark):
    bad, good = stuffed(random.Random(9)), sound()
    rows = [(i, t, f"https://h{i}.example/p") for i, t in enumerate(bad)] + [(100 + i, t, None) for i, t in enumerate(good)]
    rows += [rows[0], (None, bad[0], "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, url string").selectExpr("*", "1 AS id", "2 AS chars", "3 AS range")
    got = {r.doc_id: r for r in sf.stuffing_evidence(df).withColumnRenamed("id", "doc_id").collect()}
    assert set(got) == set(range(len(bad))) | {100 + i for i in range(len(good))}
    assert {i for i, r in got.items() if r.stuffed_share > 0.5} == set(range(len(bad)))
    assert got[100 + len(good) - 1].chars == 0
    assert sf.stuffed_pages(df.limit(0)).collect() == []


def test_fragments_count_where_their_phrases_stand_on_other_hosts(spark):
    rng = random.Random(10)
    letters = "bcdfghklmnprstvz"
    word = lambda: "".join(rng.choice(letters) + rng.choice("aeiou") for _ in range(4))
    stitched = "\n".join(" ".join(word() for _ in range(7)) for _ in range(12))  # no word twice: no density, no sentence
    alone = "\n".join(" ".join(word() for _ in range(7)) for _ in range(12))
    rows = [(1, stitched, "https://a.example/1"), (2, stitched, "https://b.example/2"), (3, alone, "https://c.example/3"), (4, alone, "https://c.example/4")]
    got = {r.id: r for r in sf.stuffing_evidence(spark.createDataFrame(rows, "doc_id bigint, text string, url string")).collect()}
    assert got[1].stuffed_share > 0.5 and got[2].stuffed_share > 0.5
    assert got[3].stuffed_share == got[4].stuffed_share == 0  # one host twice is no replication


def repeating(rng, topics):
    """Twelve-word lists that repeat themselves a little: too little to be keywords by themselves."""
    items = [f"{m} {t}" for t in topics for m in ("buy", "cheap", "best", "free")]
    return "\n".join(", ".join(rng.choice(items) for _ in range(5)) for _ in range(9))


def test_replication_decides_between_repeating_pages(spark):
    rng = random.Random(12)
    letters = "bcdfghklmnprstvz"
    word = lambda: "".join(rng.choice(letters) + rng.choice("aeiou") for _ in range(3))
    topics = [f"{word()} {word()} {word()}" for _ in range(30)]
    pages = [(i, repeating(rng, topics), f"https://h{i}.example/x") for i in range(8)]
    evidence = lambda rows: {r.id: r for r in sf.stuffing_evidence(spark.createDataFrame(rows, "doc_id bigint, text string, url string").repartition(3), pages_per_range=2).collect()}
    many, one = evidence(pages), evidence([(i, t, "https://h.example/x") for i, t, _ in pages])
    assert all(r.asked_chars > 0 and r.keyword_chars == one[i].keyword_chars and one[i].replicated_chars == 0 for i, r in many.items())
    assert any(r.stuffed_share > 0.5 >= one[i].stuffed_share for i, r in many.items())
    # the same by hand: an item of fewer than five words is a phrase
    hosts = {}
    for i, t, _ in pages:
        for item in {x.strip() for x in t.replace("\n", ",").split(",")}:
            hosts.setdefault(item, set()).add(i)
    for i, t, _ in pages:
        page, replicated = sf.page_evidence(t), 0
        for w in page.windows:
            size = lambda words: sum(map(len, words))
            share = sum(size(p) for p in w.phrases if len(hosts[" ".join(p)]) >= 2) / sum(map(size, w.phrases))
            replicated += w.chars if share >= w.need else 0
        assert many[i].replicated_chars == replicated


def test_long_labels_and_far_prices():
    label = "word " * 200
    for text in (f'<a href="https://a.example/x">{label}</a>', f"[{label}](https://a.example/x)", f"Item C-1200 {'longname' * 9}, 12.99, buy\n" * 9):
        page = sf.page_evidence(text)
        assert page.links + page.tags > 0.9 * page.chars

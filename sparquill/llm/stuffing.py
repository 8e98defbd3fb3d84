"""Pages of stuffed keywords, link lists and tags instead of sentences.

Two kinds of evidence are joined, window by window of a page's text. List
density: links with their labels and tags count as they stand, and the words
of a window tell how much it repeats itself and how short its sentences are.
Replication: the five-word phrases of all pages are counted by the hosts they
stand on. A window that repeats itself a lot is stuffing; one that repeats
itself less is stuffing if its phrases stand on other hosts too, the more of
them the less it repeats itself.

The phrases are not shuffled as rows. Each Arrow batch drops what repeats
within it and sends, per hash range, one packed array; a range is counted in
one numpy pass, and its size is set by the number of pages.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PHRASE_WORDS = 5
MIN_HOSTS = 2  # a phrase on this many hosts is replicated
WINDOW = 50  # words in which distinct words are counted; a Chinese character is half a word
LEAST_WORDS = 20  # a list of fewer words in all shows no repetition
SHORT, LONG = 5.0, 7.0  # mean words of a window's sentences that make them short, and such as people write
PAGES_PER_RANGE = 16_000  # of about 1 KB each a range is 14 MB to read for its task; with 1e10 pages and more, a multiple keeps the tasks few

#: Per kind of window (low, span, most): with fewer than ``low`` distinct words a word it is keywords, whatever its phrases;
#: above, the share of it that must stand in replicated phrases rises to 1 over ``span``, where it stays below ``most``.
#: Sentences as people write them are often copied whole, so their replication tells nothing. Numbered lines are mostly
#: tables of contents, so they count only where replicated; code, settings and logs repeat themselves and count as nothing.
LIMITS = {"long sentences": (0.46, 0.0, 1.0), "short sentences": (0.75, 0.1, 1.0), "fragments": (0.6, 0.25, 0.9), "numbered lines": (0.0, 0.35, 1.0)}

_ANCHOR = re.compile(r"<a\b[^<>]*>|</a\s*>", re.I)
_LINK = re.compile(r"!?\[[^\[\]\n]*\]\([^()\s]*\)|\[\[[^\[\]\n]*\]\]")
_URL = re.compile(r"(?:https?://|www\.)\S+", re.I)
_HASHTAG = re.compile(r"(?<![\w#&])#[^\W\d_][\w-]*")
_CODE = re.compile(r"\b[A-Z]{1,4}-?\d{2,}\b")
_PRICE = re.compile(r"\d[.,]\d\d\b")
_ITEM = re.compile(r"[\n|»•·]")
_END = re.compile(r"[.!?](?=\s|$)|[。！？]")
_SIGN = re.compile(r"([㐀-鿿])")
_PHRASE_ENDS = ",;|»•·，；、：:"
_PUNCTUATION = str.maketrans({c: " " for c in "!\"#$%&'()*+-./<=>?@[\\]^_`{}~" + "。？！“”‘’（）《》«…—–"} | {c: "\n" for c in _PHRASE_ENDS})
_PLAIN = re.compile(r"\s{2,}\S|\t|\d{4}-\d\d-\d\d[T ]|\s*[\w.\-\[\]\"']+\s*[=:]\s*\S+\s*$|\s*\d+(?:\.\d+)*[.)]?\s+\S|\s*\d+(?:\.\d+)+\s*$|\s*(?:```|\$ |//|--|<!)")
_NUMBERED = re.compile(r"\s?\d+[.)]\s+[^\W\d_]")
_CALL = re.compile(r"\w\([^()]*\)")

@dataclass(slots=True)
class Unit:
    chars: int
    phrases: list[list[str]]
    """The words of each phrase between separators."""
    words: list[str]
    weight: float
    """Words, a Chinese character counting half."""


@dataclass
class Window:
    """A stretch of about ``WINDOW`` words of one kind that replication decides: keywords if ``need`` of it is replicated."""

    chars: int
    need: float
    phrases: list[list[str]]


@dataclass
class Page:
    chars: int = 0
    links: int = 0
    tags: int = 0
    keywords: int = 0
    windows: list[Window] = field(default_factory=list)
    phrases: list[list[str]] = field(default_factory=list)
    """The words of every phrase of the page, links left out."""


def _is_plain(line: str) -> bool:
    """Neither a sentence nor a list on the face of it: code, logs, settings, numbered headings, versions."""
    return bool(_PLAIN.match(line)) or line.rstrip().endswith((";", "{", "}")) or bool(_CALL.search(line))


def _unit(chars: int, text: str) -> Unit | None:
    """The lower-case words; a Chinese character is a word. None without any."""
    low, signs = text.lower().translate(_PUNCTUATION), 0
    if not low.isascii():
        low, signs = _SIGN.subn(r" \1 ", low)
    words = low.split()
    if not words:
        return None
    phrases = [w for w in map(str.split, low.split("\n")) if w] if "\n" in low else [words]
    return Unit(chars, phrases, words, len(words) - 0.5 * signs)


def _windows(units: list[Unit]) -> list[tuple[list[Unit], list[str], float]]:
    """(units, words, weight) of each window; a rest shorter than half a window goes with the window before it."""
    out: list[tuple[list[Unit], list[str], float]] = []
    held: list[Unit] = []
    words: list[str] = []
    weight = 0.0
    for unit in units:
        held.append(unit)
        words += unit.words
        weight += unit.weight
        if weight >= WINDOW:
            out.append((held, words, weight))
            held, words, weight = [], [], 0.0
    if out and 0 < weight < WINDOW / 2:
        before = out.pop()
        out.append((before[0] + held, before[1] + words, before[2] + weight))
    elif weight >= LEAST_WORDS:
        out.append((held, words, weight))
    return out


def _judge(page: Page, units: list[Unit], kind: str) -> None:
    """Adds the units' windows of few distinct words to the page's keywords, and those that replication decides to its windows."""
    judged: list[tuple[list[Unit], float, float]] = []
    long = [u for u in units if len(u.words) > 4 * WINDOW]
    for unit in long:  # a long run is judged by the mean of its parts
        parts = [unit.words[i : i + WINDOW] for i in range(0, len(unit.words) - WINDOW + 1, WINDOW)]
        judged.append(([unit], sum(len(set(p)) for p in parts) / (WINDOW * len(parts)), LONG))
    usual = [u for u in units if len(u.words) <= 4 * WINDOW] if long else units
    judged += [(own, len(set(words)) / len(words), weight / len(own)) for own, words, weight in _windows(usual)]
    for own, distinct, mean in judged:
        if kind == "sentences":
            (low, _, _), (high, span, most) = LIMITS["long sentences"], LIMITS["short sentences"]
            shortness = min(max((LONG - mean) / (LONG - SHORT), 0.0), 1.0)
            low, span = low + (high - low) * shortness, span * shortness
        else:
            low, span, most = LIMITS[kind]
        chars = sum(u.chars for u in own)
        if distinct < low:
            page.keywords += chars
        elif (need := min((distinct - low) / span, most) if span else 1.0) < 1:
            page.windows.append(Window(chars, need, [p for u in own for p in u.phrases]))


def _without_anchors(text: str) -> tuple[str, int]:
    """The text without its HTML links, and their length; a link goes from its start tag to the next end tag."""
    kept, links, at, start = [], 0, 0, -1
    for m in _ANCHOR.finditer(text):
        if m.group()[1] != "/":
            start = m.start()
        elif start >= 0:
            kept += [text[at:start], "\n" if "\n" in text[start : m.end()] else " "]
            links += m.end() - start
            at, start = m.end(), -1
    return "".join(kept) + text[at:], links


def page_evidence(text: str) -> Page:
    """What the page tells by itself: characters of links, tags and keywords, and the windows that its phrases' hosts decide."""
    page = Page(chars=len(text.strip()))
    body = text
    if "<a" in body or "<A" in body:
        body, page.links = _without_anchors(body)

    def cut(m: re.Match) -> str:
        page.links += m.end() - m.start()
        return " "

    body = _LINK.sub(cut, body) if "](" in body or "[[" in body else body
    kinds: dict[str, list[Unit]] = {"sentences": [], "fragments": [], "numbered lines": [], "plain lines": []}

    def say(kind: str, chars: int, text: str) -> None:
        unit = _unit(chars, text)
        if unit:
            page.phrases.extend(unit.phrases)
            kinds[kind].append(unit)

    for line in body.split("\n"):
        if not line or line.isspace():
            continue
        if "://" in line or "www." in line or "WWW." in line:
            rest = []
            for item in _ITEM.split(line):
                label, n = _URL.subn("", item)
                if n and len(label.split()) <= 12 * n and not label.rstrip(" -:").endswith((".", "!", "?", "。")):
                    page.links += len(item) + 1
                elif n:
                    page.links += len(item) - len(label)
                    rest.append(label)
                else:
                    rest.append(item)
            line = " ".join(rest)
        if "#" in line:
            kept, n = _HASHTAG.subn("", line)
            if n >= 2:
                page.tags += len(line) - len("".join(kept.split()))
                line = kept
        if not line or line.isspace():
            continue
        if _PRICE.search(line) and _CODE.search(line):
            left = []
            for item in _ITEM.split(line):
                n = len(_CODE.findall(item))
                if n and _PRICE.search(item) and len(item.split()) <= 12 * n and not item.rstrip().endswith((".", "!", "?", "。")):
                    page.tags += len(item) + 1
                else:
                    left.append(item)
            line = " ".join(left)
            if not line or line.isspace():
                continue
        at = 0
        written = kinds["sentences"]
        kinds["sentences"] = []
        for end in (m.end() for m in _END.finditer(line)):
            say("sentences", end - at, line[at:end])
            at = end
        if sum(u.weight for u in kinds["sentences"]) >= WINDOW:  # a long line by itself, apart from its introduction
            _judge(page, kinds["sentences"], "sentences")
            kinds["sentences"] = written
        else:
            kinds["sentences"] = written + kinds["sentences"]
        unit = line[at:]
        if unit and not unit.isspace():
            kind = "fragments" if at or not _is_plain(line) else "numbered lines" if _NUMBERED.match(line) else "plain lines"
            say(kind, len(unit) + 1, unit)
    for kind in ("sentences", "fragments", "numbered lines"):
        _judge(page, kinds[kind], kind)
    return page


def _phrases(units: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each five-word phrase, its unit); a unit of fewer words is one phrase."""
    lengths = np.fromiter(map(len, units), np.int64, len(units))
    codes, distinct = pd.factorize(np.array([w for u in units for w in u], dtype=object))
    word = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in distinct), np.uint64, len(distinct))[codes]
    unit = np.repeat(np.arange(len(units)), lengths)
    first = np.repeat(np.cumsum(lengths) - lengths, lengths)
    left = np.minimum(first + np.repeat(lengths, lengths) - np.arange(len(word)), PHRASE_WORDS)  # words from here to the unit's end
    mixed = np.zeros(len(word), np.uint64)
    padded = np.concatenate([word, np.zeros(PHRASE_WORDS, np.uint64)])
    for k in range(PHRASE_WORDS):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + np.where(left > k, padded[k : k + len(word)], np.uint64(0))
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    whole = (left == PHRASE_WORDS) | (np.arange(len(word)) == first)
    return mixed[whole], unit[whole]


def _host(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-z][a-z0-9+.-]*://)?([^/:?#\s]+)", url or "", re.I)
    return m.group(1).lower() if m else ""


_MESSAGE = pa.schema([
    ("range", pa.int32()), ("hosts", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32())), ("phrases", pa.binary()),
    ("ids", pa.list_(pa.int64())), ("windows", pa.list_(pa.int64())), ("sums", pa.list_(pa.int32())), ("needs", pa.list_(pa.float32())),
    ("asked", pa.list_(pa.int64())), ("asked_windows", pa.list_(pa.int64())), ("asked_phrases", pa.binary()), ("weights", pa.list_(pa.float32())),
])
_MESSAGE_SQL = (
    "range int, hosts array<int>, counts array<int>, phrases binary, ids array<bigint>, windows array<bigint>, sums array<int>, needs array<float>, "
    "asked array<bigint>, asked_windows array<bigint>, asked_phrases binary, weights array<float>"
)
_SUMS = ("chars", "link_chars", "tag_chars", "keyword_chars", "asked_chars")
_PAGE = -1  # as the window of the row that has a page's own sums


def _pack(hashes: np.ndarray) -> bytes:
    """The low six bytes of each hash; the range it is sent to holds some of the others."""
    return hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack(parts: list[bytes]) -> np.ndarray:
    packed = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, 6)
    wide = np.zeros((len(packed), 8), np.uint8)
    wide[:, :6] = packed
    return wide.view("<u8").ravel().astype(np.uint64)


def _range_of(phrase: np.ndarray, ranges: int) -> np.ndarray:
    return ((phrase >> np.uint64(40)) % np.uint64(ranges)).astype(np.int64)


def _messages(ids: list[int], texts: list[str | None], urls: list[str | None], ranges: int) -> pa.RecordBatch:
    """What a batch sends to each hash range: its phrases by host, and the phrases that its windows ask for.

    The pages' own sums ride along to a range that differs from batch to batch, so no range gathers them.
    """
    blank = lambda r: [r, [], [], b"", [], [], [], [], [], [], b"", []]
    hosts: dict[str, int] = {}
    units, unit_host, page_ids, windows, sums, needs = [], [], [], [], [], []
    asked, asked_id, asked_window, asked_chars = [], [], [], []
    for key, text, url in zip(ids, texts, urls):
        page = page_evidence(text) if text else Page()
        page_ids.append(key)
        windows.append(_PAGE)
        sums += [page.chars, page.links, page.tags, page.keywords, sum(w.chars for w in page.windows)]
        needs.append(0.0)
        units += page.phrases
        unit_host += [hosts.setdefault(_host(url), len(hosts))] * len(page.phrases)
        first = xxhash.xxh3_64_intdigest(text) >> 2 if page.windows else 0
        for number, window in enumerate(page.windows, first):
            page_ids.append(key)
            windows.append(number)
            sums += [window.chars, 0, 0, 0, 0]
            needs.append(window.need)
            lengths = [sum(map(len, p)) for p in window.phrases]
            scale = window.chars / sum(lengths)
            asked += window.phrases
            asked_id += [key] * len(lengths)
            asked_window += [number] * len(lengths)
            asked_chars += [n * scale for n in lengths]
    home = xxhash.xxh32_intdigest(",".join(map(str, ids[:100]))) % ranges
    out: dict[int, list] = {home: blank(home)}
    out[home][4:8] = [page_ids, windows, sums, needs]
    names = np.fromiter((xxhash.xxh32_intdigest(h) for h in hosts), np.uint32, len(hosts)).view(np.int32)
    if units:
        phrase, unit = _phrases(units)
        host = np.asarray(unit_host, np.int64)[unit]
        order = np.lexsort((host, phrase))
        phrase, host = phrase[order], host[order]
        new_phrase = np.append(True, phrase[1:] != phrase[:-1])
        new = new_phrase | np.append(True, host[1:] != host[:-1])
        phrase, host, new_phrase = phrase[new], host[new], new_phrase[new]
        at = np.arange(len(phrase))
        keep = at - np.maximum.accumulate(np.where(new_phrase, at, 0)) < MIN_HOSTS  # more hosts of a phrase tell nothing new
        phrase, host = phrase[keep], host[keep]
        to = _range_of(phrase, ranges)
        order = np.lexsort((host, to))
        phrase, host, to = phrase[order], host[order], to[order]
        ends = np.flatnonzero(np.append(to[1:] != to[:-1], True)) + 1
        for a, b in zip(np.append(0, ends[:-1]), ends):
            own = host[a:b]
            runs = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            message = out.setdefault(int(to[a]), blank(int(to[a])))
            message[1:4] = [names[own[runs]], np.diff(np.append(runs, b - a)), _pack(phrase[a:b])]
    if asked:
        phrase, unit = _phrases(asked)
        weight = (np.asarray(asked_chars) / np.bincount(unit, minlength=len(asked)))[unit]
        key, window, to = np.asarray(asked_id, np.int64)[unit], np.asarray(asked_window, np.int64)[unit], _range_of(phrase, ranges)
        for r in np.unique(to):
            here = to == r
            out.setdefault(int(r), blank(int(r)))[8:12] = [key[here], window[here], _pack(phrase[here]), weight[here].astype(np.float32)]
    columns = list(zip(*out.values()))
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, _MESSAGE)], schema=_MESSAGE)


def _flat(table: pa.Table, name: str) -> np.ndarray:
    return table[name].combine_chunks().flatten().to_numpy(zero_copy_only=False)


def _count_range(table: pa.Table) -> pa.Table:
    """Rows of pages and windows as sent, and the characters of windows whose phrases, of this range, stand on other hosts too."""
    asked = _flat(table, "asked")
    hit = np.zeros(len(asked))
    if len(asked):
        phrase, host = _unpack(table["phrases"].to_pylist()), np.repeat(_flat(table, "hosts"), _flat(table, "counts"))
        order = np.lexsort((host, phrase))
        phrase, host = phrase[order], host[order]
        new = np.append(True, (phrase[1:] != phrase[:-1]) | (host[1:] != host[:-1]))
        found, hosts = np.unique(phrase[new], return_counts=True)
        wanted = _unpack(table["asked_phrases"].to_pylist())
        at = np.minimum(np.searchsorted(found, wanted), len(found) - 1)
        hit = np.where((found[at] == wanted) & (hosts[at] >= MIN_HOSTS), _flat(table, "weights"), 0.0)
    ids, none = _flat(table, "ids"), np.zeros(len(asked))
    sums = np.concatenate([_flat(table, "sums").reshape(-1, len(_SUMS)), np.zeros((len(asked), len(_SUMS)), np.int32)])
    columns = [
        np.concatenate([ids, asked]), np.concatenate([_flat(table, "windows"), _flat(table, "asked_windows")]), *(sums[:, k] for k in range(len(_SUMS))),
        np.concatenate([_flat(table, "needs"), none]).astype(np.float64), np.concatenate([np.zeros(len(ids)), hit]),
    ]
    return pa.Table.from_arrays([pa.array(c) for c in columns], names=["id", "window", *_SUMS, "need", "hit"])


def stuffing_evidence(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", url_col: str = "url", pages_per_range: int = PAGES_PER_RANGE) -> DataFrame:
    """One row per id: id, chars, link_chars, tag_chars, keyword_chars, asked_chars, replicated_chars, stuffed_share.

    asked_chars are those of the windows of words that repeat too little to be
    keywords by themselves; replicated_chars are those of them of which a large
    enough share stands in five-word phrases (or whole items of fewer words)
    that are on at least two hosts. The less a window repeats, the more of it
    must be replicated. stuffed_share is (links + tags + keywords + replicated)
    / chars, 0 for null, empty and blank texts.

    Ids are whole numbers; rows without id are left out. Repeated rows of one id
    add up, which leaves the share as it is. Pages without url are of one
    unknown host. Other columns, whatever their names, are not read. Each range
    of phrase hashes is one task, so that a task reads as much at every size.
    """
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), F.col(url_col).cast("string").alias("url")).filter("id IS NOT NULL")
    ranges = max(1, -(-df.count() // pages_per_range))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _messages(b.column("id").to_pylist(), b.column("text").to_pylist(), b.column("url").to_pylist(), ranges)

    counted = rows.mapInArrow(send, _MESSAGE_SQL).repartitionById(ranges, "range").groupBy("range").applyInArrow(
        _count_range, "id bigint, window bigint, " + ", ".join(f"{c} int" for c in _SUMS) + ", need double, hit double",
    )
    # laid out by id once, for the windows and for the pages
    windows = counted.repartition("id").groupBy("id", "window").agg(*(F.sum(c).alias(c) for c in _SUMS), F.max("need").alias("need"), F.sum("hit").alias("hit"))
    page = F.col("window") == _PAGE
    replicated = ~page & (F.col("hit") >= F.col("need") * F.col("chars") * (1 - 1e-6))
    pages = windows.groupBy("id").agg(*(F.sum(F.when(page, F.col(c))).alias(c) for c in _SUMS), F.coalesce(F.sum(F.when(replicated, F.col("chars"))), F.lit(0)).alias("replicated_chars"))
    stuffed = F.col("link_chars") + F.col("tag_chars") + F.col("keyword_chars") + F.col("replicated_chars")
    return pages.withColumn("stuffed_share", F.coalesce(F.try_divide(stuffed, F.col("chars")), F.lit(0.0)))


def stuffed_pages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", url_col: str = "url", share: float = 0.5) -> DataFrame:
    """The rows of ``stuffing_evidence`` of whose characters more than ``share`` are stuffing."""
    return stuffing_evidence(df, id_col, text_col, url_col).filter(F.col("stuffed_share") > share)

"""Markup residue in texts: wrappers of each host's texts, and what they hold as clean text.

A text is read once by a tokeniser whose alternatives are the delimiters of the
four languages; code, whatever it contains, is one token, and look-alikes
(placeholders, type names, prices, paths, comparisons) match no alternative.
The token streams of one host's texts are aligned, a mismatch becoming an
optional group and what follows itself a repeated one, into a wrapper: a
union-free expression with text slots between the delimiters. The groups of
that wrapper then take the tokens of each text of the host; what they take
gives the kinds of markup, and their slots the clean text.
"""

from __future__ import annotations

import html
import json
import re
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache
from html.entities import html5

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparquill.scratch import Scratch

KINDS = ("html", "latex", "markdown", "wiki")

# fixed values: element names of HTML
_ELEMENTS = (
    "a abbr acronym address area article aside audio b base basefont bdi bdo big blockquote body br button canvas caption center cite code col colgroup "
    "data datalist dd del details dfn dialog dir div dl dt em embed fieldset figcaption figure font footer form frame frameset h1 h2 h3 h4 h5 h6 head "
    "header hgroup hr html i iframe img input ins kbd label legend li link main map mark menu meta meter nav noframes noscript object ol optgroup option "
    "output p param picture pre progress q rp rt ruby s samp script section select small source span strike strong style sub summary sup svg table tbody "
    "td template textarea tfoot th thead time title tr track tt u ul var video wbr"
)
# fixed values: LaTeX commands that stand without an argument
_BARE = (
    "item maketitle par noindent newpage clearpage tableofcontents centering small large Large textit newline hline quad qquad ldots cdots dots alpha beta "
    "gamma delta epsilon varepsilon theta lambda mu nu pi rho sigma tau phi varphi chi psi omega Gamma Delta Theta Lambda Pi Sigma Phi Psi Omega leq geq "
    "neq le ge ne approx equiv sim propto cdot times div pm mp infty partial nabla in notin subset subseteq cup cap forall exists to rightarrow leftarrow "
    "Rightarrow Leftrightarrow mapsto sum prod int oint lim log ln exp sin cos tan min max sup inf left right"
)
_BOL = r"(?:(?<![^\n])|(?<=\n )|(?<=\n  )|(?<=\n   ))"  # where a line begins, up to three blanks in
_EOL = r"[ \t]*(?![^\n])"

# one alternative per construct; the first that matches at a position takes the whole of it. No alternative reads past
# the next delimiter of its own kind, so the time is in proportion to the text; strong text and wiki quotes, whose
# inside may hold what looks like their delimiter, only match where they open, and _PAIRS finds the end in a table.
# Blocks of code and comments run to their end or to the text's
_RULES: tuple[tuple[str, str, str], ...] = (
    ("md_fence", "`~", rf"{_BOL}(?P<fence>`{{3,}}|~{{3,}})[^\n`]*(?:\n(?P<fenced>[\s\S]*?))?(?:(?<=\n)[ ]{{0,3}}(?P=fence)[`~]*{_EOL}|\Z)"),
    ("md_code", "`", r"(?P<ticks>`+)(?!`)(?P<ticked>[^`\n]+)(?P=ticks)(?!`)"),
    ("path", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz\\", r"(?:\b[A-Za-z]:\\|(?<![\\\w])\\\\(?=\w+\\))[^\s\"'<>|]*"),
    ("html_comment", "<", r"<!--[\s\S]*?(?:-->|\Z)|<!DOCTYPE\b[^<>]*>|<!\[CDATA\[|\]\]>"),
    ("html_pre", "<", r"<(?P<raw>pre|script|style|textarea)\b[^<>]*>(?P<preformatted>[\s\S]*?)(?:</(?P=raw)\s*>|\Z)"),
    ("html_tag", "<", rf"(?:(?<![A-Za-z0-9_])(?=</?(?:[a-z0-9]+|[A-Z0-9]+)\b)|(?=</?[a-z0-9]+\b))<(?P<close>/?)(?P<tag>(?i:{'|'.join(sorted(_ELEMENTS.split(), key=len, reverse=True))}))(?![\w-])(?P<attrs>(?:\s+[\w:@.-]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'<>=]+))?)*)\s*/?>"),
    ("md_autolink", "<", r"<(?P<auto>(?:https?|ftp|mailto):[^\s<>]+)>"),
    ("html_entity", "&", r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"),
    ("tex_display", "$\\", r"\$\$(?P<display>[^$]+)\$\$|\\\[(?P<bracket>(?:[^\\]|\\[^\[\]])+)\\\]"),
    ("tex_inline", "$\\", r"\\\((?P<paren>(?:[^\\]|\\[^()])+)\\\)|(?<![\w$\\])\$(?=[^\s$])(?P<dollar>[^$\n]*[^\s$\\])\$(?![\w$])"),
    ("tex_math_env", "\\", r"\\begin\{(?P<env>equation|align|gather|multline|eqnarray|math|displaymath|verbatim|lstlisting)(?P<star>\*?)\}(?P<inside>[\s\S]*?)(?:\\end\{(?P=env)(?P=star)\}|\Z)"),
    ("tex_heading", "\\", r"\\(?P<level>part|chapter|section|subsection|subsubsection|paragraph)\*?\{(?P<heading>[^{}]*)\}"),
    ("tex_env", "\\", r"\\(?:begin|end)\{[A-Za-z]+\*?\}(?:\[[^\]\n]*\]|\{[^{}\n]*\})*"),
    ("tex_item", "\\", r"\\item\b(?:\[[^\]\n]*\])?[ \t]*"),
    ("tex_silent", "\\", r"(?<![\\\w:])\\(?:cite[pt]?|ref|eqref|label|pageref|includegraphics|input|usepackage|documentclass|bibliography|bibliographystyle|vspace|hspace)\*?(?:\[[^\]\n]*\])*\{[^{}]*\}"),
    ("tex_command", "\\", rf"(?<![\\\w:])\\(?:(?:[A-Za-z]+)\*?(?:\[[^\]\n]*\])?\{{(?P<argument>[^{{}}]*)\}}|(?:{'|'.join(sorted(_BARE.split(), key=len, reverse=True))})(?![A-Za-z\\]))"),
    ("wiki_table", "{|!", rf"{_BOL}(?:\{{\|[^\n]*|\|\}}{_EOL}|\|-[-]*(?:[ \t]*[a-z]+=[^|\n]*)?{_EOL}|\|\+[^\n]*)"),
    ("wiki_template", "{", r"\{\{(?!\{)(?P<template>(?:[^{}]|\{[^{}]*\})*)\}\}"),
    ("wiki_link", "[", r"\[\[(?P<target>[^\[\]|\n]+)(?P<parts>(?:\|[^\[\]|\n]*)*)\]\]|(?<![\]\w])\[(?:https?|ftp)://[^\s\[\]]+[ \t]+(?P<external>[^\[\]\n]+)\](?!\()"),
    ("wiki_heading", "=", rf"(?<![^\n])(?P<bar>={{2,6}})(?!=)[ \t]*(?P<wikihead>[^=\n](?:[^\n]*?[^=\s])?)[ \t]*(?P=bar){_EOL}"),
    ("wiki_quote", "'", r"(?<!')(?P<quotes>'{5}|'{3}|'{2})(?=[^'\n])"),
    ("md_setext", "=-", rf"(?<=[^\n]\n)(?:={{2,}}|-{{3,}}){_EOL}"),
    ("md_heading", "#", rf"{_BOL}(?P<marks>#{{1,6}})[ \t]+(?:#{{1,6}}[ \t]+)*(?P<mdhead>[^\n]*?\S)[ \t]*(?:[ \t]#+)?{_EOL}"),
    ("md_quote", ">", rf"{_BOL}>(?:[ \t]?>)*(?=[ \t\n]|\Z)[ \t]?"),
    ("md_table", "|:-", rf"{_BOL}(?=[^\n]*\|)\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?{_EOL}"),
    ("md_image", "!", r"!\[(?P<alt>[^\[\]\n]*)\](?:\([^()\n]*\)|\[[^\[\]\n]*\])"),
    ("md_definition", "[", rf"{_BOL}\[(?!\^)[^\[\]\n]+\]:[ \t]+\S+(?:[ \t]+(?:\"[^\"\n]*\"|'[^'\n]*'|\([^()\n]*\)))?{_EOL}"),
    ("md_link", "[", r"(?<![\w\]])\[(?P<label>(?:[^\[\]\n]|!\[[^\[\]\n]*\]\([^()\n]*\))+)\](?:\([^()\s]*(?:[ \t]+(?:\"[^\"\n]*\"|'[^'\n]*'))?\)|\[(?=[^\[\]\n]*[A-Za-z])[^\[\]\n]*\])"),
    ("md_named", "_", r"(?<![\w_])__(?P<onebar>[A-Z]\w*?|[㐀-鿿]+)__(?![\w_])"),
    ("md_strong", "*_", r"(?<![\w*])(?P<stars>\*\*)(?=[^\s*])|(?<![\w_])(?P<bars>__)(?=[^\s_])(?!\w+__)"),
    ("md_strong_cjk", "*", r"\*\*(?=[^\s*])(?P<cjkstars>[^\n*]*?[^\s*])\*\*(?!\*)"),
    ("md_emphasis", "*_", r"(?<![\w*\\])\*(?=[^\s*])(?P<star1>[^*\n]*?[^\s*])\*(?![\w*])|(?<![\w_\\])_(?=[^\s_])(?P<bar1>[^_\n]*[ \t][^_\n]*?[^\s_]|[^\W_]+)_(?![\w_])"),
    ("md_strike", "~", r"~~(?=\S)(?P<struck>[^~\n]*?\S)~~"),
)
_FIRST = "".join(sorted(set("".join(c for n, c, _ in _RULES if n != "path"))))


def _any_of(rules) -> re.Pattern:
    return re.compile(rf"(?=[{re.escape(_FIRST)}]|[A-Za-z]:\\)(?:" + "|".join(f"(?P<{name}>{body})" for name, _, body in rules) + ")")


_PAIRS = {"**": re.compile(r"(?<=[^\s*])\*\*(?![\w*])"), "__": re.compile(r"(?<=[^\s_])__(?![\w_])")} | {"'" * n: re.compile(rf"(?<=[^'\n])'{{{n}}}(?!')") for n in (2, 3, 5)}
_PAIRED = frozenset(("md_strong", "wiki_quote"))


@lru_cache(maxsize=None)
def _tokens(without: frozenset[str]) -> re.Pattern:
    return _any_of([r for r in _RULES if r[0] not in without])


_MATH = re.compile(r"[\\^_={}+<>]|^[A-Za-z]$|[A-Za-z]\([A-Za-z]\)")
_KIND = {"md": "markdown", "html": "html", "wiki": "wiki", "tex": "latex"}
_PLAIN_TEXT = re.compile(r"[<>&`*_~\[\]{}'$\\|#=-]")

TEXT, HEADING, ITEM, CODE, FORMULA, ROW, QUOTE = "text", "heading", "list", "code", "formula", "table", "quote"


@dataclass
class Parsed:
    """tokens: the names of the delimiters and 'slot' for text, in order; pieces: (structure, level, text, place of its token)."""

    tokens: list[str] = field(default_factory=list)
    pieces: list[tuple[str, int, str, int]] = field(default_factory=list)

    def kinds(self) -> list[str]:
        return kinds_of(self.tokens)

    def put(self, kind: str, level: int, text: str) -> None:
        self.pieces.append((kind, level, text, max(0, len(self.tokens) - 1)))

    def say(self, kind: str, text: str, level: int = 0) -> None:
        if not text:
            return
        if kind == TEXT:
            if text.strip() and self.tokens[-1:] != ["slot"]:
                self.tokens.append("slot")
            if self.pieces and self.pieces[-1][0] == TEXT:
                _, _, before, at = self.pieces.pop()
                self.pieces.append((TEXT, 0, before + text, at))
                return
        self.put(kind, level, text)


def kinds_of(tokens: Sequence[str]) -> list[str]:
    return sorted({_KIND[t.split("_", 1)[0]] for t in tokens if t != "slot"})


class _Ends:
    """Where each paired delimiter of a text may end, listed once per text."""

    def __init__(self, text: str):
        self.text = text
        self.of: dict[str, list[int]] = {}
        self.breaks: list[int] | None = None

    def after(self, mark: str, at: int) -> int | None:
        """The place of the first end of ``mark`` on this line that leaves at least a character from ``at`` on."""
        if mark not in self.of:
            self.of[mark] = [m.start() for m in _PAIRS[mark].finditer(self.text)]
        if self.breaks is None:
            self.breaks = [m.start() for m in re.finditer("\n", self.text)]
        ends = self.of[mark]
        i, line = bisect_left(ends, at + 1), bisect_left(self.breaks, at)
        if i == len(ends) or (line < len(self.breaks) and self.breaks[line] < ends[i]):
            return None
        return ends[i]


def parse(text: str, into: Parsed | None = None, without: frozenset[str] = frozenset()) -> Parsed:
    """Tokens and structure of a text.

    Nested markup is parsed too, headings in a heading ``without`` its own kind; as nothing holds its own kind, it is at
    most as deep as there are kinds.
    """
    out = into or Parsed()
    if not _PLAIN_TEXT.search(text):
        out.say(TEXT, text)
        return out
    ends, any_token = _Ends(text), _tokens(without)
    at = begin = 0
    while m := any_token.search(text, begin):
        name, end, inner = m.lastgroup, m.end(), None
        if name in _PAIRED:
            mark = m.group()
            close = ends.after(mark, end)
            if close is not None:
                inner, end = text[m.end() : close], close + len(mark)
            elif m := _tokens(without | _PAIRED).match(text, begin := m.start()):
                name, end = m.lastgroup, m.end()
            else:
                begin += 1
                continue
        begin = end if end > m.start() else end + 1
        if name == "path" or name == "html_entity" and not _is_entity(m.group()) or name == "tex_inline" and m.group("dollar") and not _MATH.search(m.group("dollar")):
            continue  # stays in the text
        out.say(TEXT, text[at : m.start()])
        at = end
        _take(name, m, out, inner, without)
    out.say(TEXT, text[at:])
    return out


_LEVELS = {"part": 1, "chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4}


def _is_entity(text: str) -> bool:
    return text[1] == "#" or text[1:] in html5


def _take(name: str, m: re.Match, out: Parsed, inside: str | None, without: frozenset[str]) -> None:
    g = m.groupdict()
    first = lambda *names: next((g[n] for n in names if g[n] is not None), "")
    out.tokens.append(name + (f":{g['close']}{g['tag'].lower()}" if name == "html_tag" else ""))
    if name in ("md_fence", "html_pre"):
        body = first("fenced", "preformatted")
        out.say(CODE, re.sub(r"</?code\b[^<>]*>", "", html.unescape(body) if name == "html_pre" else body).strip("\n"))
    elif name == "md_code":
        out.say(TEXT, g["ticked"])
    elif name == "html_entity":
        out.say(TEXT, html.unescape(m.group()).replace("\xa0", " "))
    elif name == "md_autolink":
        out.say(TEXT, g["auto"])
    elif name in ("tex_display", "tex_inline"):
        out.say(FORMULA, first("display", "bracket", "paren", "dollar").strip())
    elif name == "tex_math_env":
        out.say(CODE if g["env"] in ("verbatim", "lstlisting") else FORMULA, g["inside"].strip("\n"))
    elif name in ("md_heading", "wiki_heading", "tex_heading"):
        inner = parse(first("mdhead", "wikihead", "heading"), None, without | {name})
        out.tokens += inner.tokens
        level = len(g["marks"]) if g["marks"] else len(g["bar"]) - 1 if g["bar"] else _LEVELS[g["level"]]
        out.say(HEADING, "".join(t for _, _, t, _ in inner.pieces), level)
    elif name == "md_setext":
        if out.pieces and out.pieces[-1][0] == TEXT:  # the line above is the heading
            _, _, above, place = out.pieces.pop()
            before, _, title = above.rstrip("\n").rpartition("\n")
            if before:
                out.pieces.append((TEXT, 0, before + "\n", place))
            out.say(HEADING, title, 1 if m.group().startswith("=") else 2)
    elif name == "tex_item":
        out.say(ITEM, "")
        out.put(ITEM, 1, "")
    elif name == "md_quote":
        out.put(QUOTE, 1, "")
    elif name == "html_tag":
        _html_tag(g, out)
    elif name == "wiki_link":
        parts = (g["parts"] or "").split("|")
        shown = g["external"] or (parts[-1] if len(parts) > 1 else g["target"])
        if not re.match(r"(?i)\s*(?:category|kategorie|分类)\s*:", g["target"] or ""):
            parse(shown, out, without)
    elif name == "wiki_template":
        fields = [f.partition("=")[2] or f for f in g["template"].split("|")[1:]]
        parse(" ".join(f.strip() for f in fields), out, without)
    elif inner := first("argument", "alt", "label", "onebar", "cjkstars", "star1", "bar1", "struck") if inside is None else inside:
        parse(inner, out, without)


def _html_tag(g: dict, out: Parsed) -> None:
    tag, closing = g["tag"].lower(), bool(g["close"])
    if tag in ("h1", "h2", "h3", "h4", "h5", "h6") and not closing:
        out.put(HEADING, int(tag[1]), "")
    elif tag == "li" and not closing:
        out.put(ITEM, 1, "")
    elif tag in ("tr",) and not closing:
        out.put(ROW, 0, "")
    elif tag in ("td", "th") and closing:
        out.say(TEXT, " | ")
    elif tag in ("p", "div", "br", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "table", "tr", "blockquote"):
        out.say(TEXT, "\n")


def render(pieces: Sequence[tuple]) -> str:
    """Clean text of (structure, level, text, ...): headings as '# ', list items as '- ', quotes as '> ' lines, code indented by four, formulas alone."""
    lines: list[str] = []
    pending = ""
    for kind, level, text, *_ in pieces:
        if kind in (HEADING, ITEM, QUOTE, ROW) and not text:
            pending = {HEADING: "#" * max(1, level) + " ", ITEM: "- ", QUOTE: "> ", ROW: ""}[kind]
            lines.append("\n" + pending)
        elif kind == HEADING:
            lines.append("\n" + "#" * max(1, level) + " " + text.strip() + "\n")
        elif kind == CODE:
            lines.append("\n" + "\n".join("    " + x for x in text.split("\n")) + "\n")
        elif kind == FORMULA and "\n" in text:
            lines.append("\n" + text + "\n")
        else:
            lines.append(text)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", "".join(lines))).strip()


# wrappers: a sequence of (tokens of a group, optional, repeated)

Wrapper = list[tuple[tuple[str, ...], bool, bool]]
LONGEST_GROUP = 256  # tokens; what repeats in still longer groups stands in the wrapper as often as it does in the text
PART_STREAMS = 2_000  # distinct streams that one task makes a wrapper of
MERGED = 32  # wrappers of a host's parts that are aligned at a time


def fold_repeats(tokens: Sequence[str]) -> Wrapper:
    """A stream as a wrapper of itself: a group that follows itself becomes a repeated group."""
    out: Wrapper = []
    at, n = 0, len(tokens)
    while at < n:
        first = tokens[at]
        for size in range(1, min(LONGEST_GROUP, (n - at) // 2) + 1):
            if tokens[at + size] == first and tokens[at : at + size] == tokens[at + size : at + 2 * size]:
                group = tuple(tokens[at : at + size])
                at += 2 * size
                while tuple(tokens[at : at + size]) == group:
                    at += size
                out.append((group, False, True))
                break
        else:
            out.append(((first,), False, False))
            at += 1
    return out


def align(a: Wrapper, b: Wrapper) -> Wrapper:
    """The wrapper of everything that either covers: equal groups meet, a mismatch makes both sides optional.

    As many groups as can meet do (a longest common subsequence, a row of its
    table being the bits of one integer, so that long wrappers cost little).
    """
    if len(a) > len(b):
        a, b = b, a
    n, m = len(a), len(b)
    where: dict[tuple[str, ...], int] = {}
    for j, (group, _, _) in enumerate(b):
        where[group] = where.get(group, 0) | 1 << j
    rows, row, full = [], (1 << m) - 1, (1 << m) - 1
    for group, _, _ in a:
        hit = row & where.get(group, 0)
        row = ((row + hit) | (row - hit)) & full
        rows.append(row)
    out, i, j = [], n, m
    while i or j:
        if i and j and not rows[i - 1] >> (j - 1) & 1:
            if i > 1 and not rows[i - 2] >> (j - 1) & 1:
                i -= 1
                out.append((a[i][0], True, a[i][2]))
            else:
                i, j = i - 1, j - 1
                out.append((a[i][0], a[i][1] or b[j][1], a[i][2] or b[j][2]))
        elif j:
            j -= 1
            out.append((b[j][0], True, b[j][2]))
        else:
            i -= 1
            out.append((a[i][0], True, a[i][2]))
    return out[::-1]


def merge(wrappers: Sequence[Wrapper]) -> Wrapper:
    """One wrapper of all, aligned from the shortest on."""
    out: Wrapper = []
    for k, wrapper in enumerate(sorted(wrappers, key=lambda w: (len(w), w))):
        out = align(out, wrapper) if k else wrapper
    return out


def expression(wrapper: Wrapper) -> str:
    """As text: groups of tokens with ? (optional), + (repeated) or * (both)."""
    return " ".join(("(" + " ".join(g) + ")" if len(g) > 1 else g[0]) + {(False, False): "", (True, False): "?", (False, True): "+", (True, True): "*"}[o, r] for g, o, r in wrapper)


def taken_by(wrapper: Wrapper, tokens: Sequence[str]) -> list[int] | None:
    """The place in the wrapper of the group that takes each token; None where the wrapper does not cover the stream.

    The prefixes of the stream that the wrapper's groups reach are the bits of
    one integer per group; the way back from the end tells the groups.
    """
    where: dict[str, int] = {}
    for p, t in enumerate(tokens):
        where[t] = where.get(t, 0) | 1 << p

    def step(reach: int, group: tuple[str, ...]) -> int:
        for t in group:
            reach = (reach & where.get(t, 0)) << 1
        return reach

    reach, before = 1, []
    for group, optional, repeated in wrapper:
        before.append(reach)
        new = step(reach, group)
        reach = (reach if optional else 0) | new
        while repeated and (new := step(new, group)) & ~reach:
            reach |= new
        if not reach:
            return None
    at = len(tokens)
    if not reach >> at & 1:
        return None
    out = [0] * at
    for k in range(len(wrapper) - 1, -1, -1):
        group, optional, _ = wrapper[k]
        if optional and before[k] >> at & 1:
            continue
        while True:  # at least once; the tokens before were matched on the way here
            for p in range(at - len(group), at):
                out[p] = k
            at -= len(group)
            if before[k] >> at & 1:
                break
    return out


def covered(wrapper: Wrapper, tokens: Sequence[str]) -> list[str] | None:
    """The tokens that the wrapper's groups take, group by group, or None where it does not cover the stream."""
    places = taken_by(wrapper, tokens)
    if places is None:
        return None
    out: list[str] = []
    at = 0
    while at < len(places):
        group = wrapper[places[at]][0]
        out += group
        at += len(group)
    return out


_PIECES = "array<struct<kind: string, level: int, text: string, place: int>>"


def tokenised(df: DataFrame, id_col: str, text_col: str, host_col: str | None, keep: Sequence[str] = (), pieces: bool = False) -> DataFrame:
    """(id, the ``keep`` columns, host, stream[, pieces]): the names of each text's tokens, joined by blanks; null texts are left out."""
    host = F.col(host_col).cast("string") if host_col else F.lit(None).cast("string")
    rows = df.select(F.col(id_col).alias("id"), *keep, host.alias("host"), F.col(text_col).alias("text")).filter("text IS NOT NULL")
    heads = ["id", *keep, "host"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("text").schema) + ", stream string" + (f", pieces {_PIECES}" if pieces else "")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parsed = [parse(t) for t in b.column(len(heads)).to_pylist()]
            columns = [b.column(i) for i in range(len(heads))] + [pa.array([" ".join(p.tokens) for p in parsed], pa.string())]
            if pieces:
                columns.append(pa.array([[{"kind": k, "level": n, "text": t, "place": at} for k, n, t, at in p.pieces] for p in parsed], _PIECES_ARROW))
            yield pa.RecordBatch.from_arrays(columns, names=[*heads, "stream", *(["pieces"] if pieces else [])])

    return rows.mapInArrow(read, schema)


_PIECES_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("level", pa.int32()), ("text", pa.string()), ("place", pa.int32())]))


def _infer(joined: bool):
    """Makes a wrapper of each run of equal (key, part): of its streams, or of the wrappers of its parts."""

    def infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, last, done = None, [], None, []

        def close() -> None:
            if now is not None:
                done.append((*now, json.dumps(merge(held))))

        for b in batches:
            for key, part, said in zip(*(b.column(i).to_pylist() for i in range(3))):
                if (key, part) != now:
                    close()
                    now, held, last = (key, part), [], None
                if said != last or joined:
                    held.append([(tuple(g), o, r) for g, o, r in json.loads(said)] if joined else fold_repeats(said.split()))
                    last = said
            yield _wrapper_rows(done)
            done = []
        close()
        yield _wrapper_rows(done)

    return infer


def _wrapper_rows(rows: list[tuple[str, int, str]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string()))], names=["key", "part", "wrapper"])


def _host_key():
    return F.coalesce(F.concat(F.lit("h"), "host"), F.lit("n"))


class Wrappers:
    """The wrappers of the hosts of tokenised rows (``host``, ``stream``, ...).

    A host's rows are dealt into parts of about ``PART_STREAMS`` distinct
    streams; each part's streams are aligned into a wrapper, then ``MERGED``
    wrappers of a host at a time, until it has one that covers every stream.
    """

    def __init__(self, streams: DataFrame, part_streams: int = PART_STREAMS):
        spark = streams.sparkSession
        self.tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        keyed = streams.withColumn("key", _host_key())
        scratch = Scratch(spark)
        parts = F.ceil(F.approx_count_distinct("stream") / F.lit(part_streams)).cast("int")
        # a row per host of more than one part: at most rows / part_streams
        self.split = scratch.keep(keyed.groupBy("key").agg(parts.alias("parts")).filter("parts > 1"))
        most = self.split.agg(F.max("parts")).first()[0] or 1
        self.rows = self._dealt(keyed).withColumn("part", F.pmod(F.xxhash64("stream"), F.col("parts")).cast("int")).drop("parts")
        wrappers = self._runs(self.rows.select("key", "part", "stream"), "stream").mapInArrow(_infer(False), "key string, part int, wrapper string")
        while most > 1:
            most = -(-most // MERGED)
            joined = wrappers.select("key", F.floor(F.col("part") / MERGED).cast("int").alias("part"), "wrapper")
            wrappers = self._runs(joined, "wrapper").mapInArrow(_infer(True), "key string, part int, wrapper string")
        self.of_hosts = scratch.keep(wrappers.select("key", "wrapper"))

    def _dealt(self, df: DataFrame) -> DataFrame:
        return df.join(self.split, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))

    def _runs(self, df: DataFrame, *order: str) -> DataFrame:
        """Rows laid out so that those of one (key, part) follow each other."""
        return df.repartition(self.tasks, "key", "part").sortWithinPartitions("key", "part", *order)

    def take(self, finish, schema: str, columns: Sequence[str]) -> DataFrame:
        """``finish(columns of a batch, tokens its hosts' wrappers take from each row)`` for all rows.

        A part's rows follow their host's wrapper, which is sent once per part.
        A row that its host's wrapper does not cover gives no tokens.
        """
        heads = self._dealt(self.of_hosts).select("key", "wrapper", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        both = self.rows.select("key", "part", F.lit(1).alias("last"), F.lit(None).cast("string").alias("wrapper"), "stream", *columns).unionByName(
            heads.withColumn("last", F.lit(0)), allowMissingColumns=True,
        )

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            wrapper: Wrapper = []
            last, tokens = None, []
            for b in batches:
                rows, taken = [], []
                for at, (said, stream) in enumerate(zip(b.column(3).to_pylist(), b.column(4).to_pylist())):
                    if said is not None:
                        wrapper, last = [(tuple(g), o, r) for g, o, r in json.loads(said)], None
                        continue
                    if stream != last:
                        last, tokens = stream, covered(wrapper, stream.split()) or []
                    rows.append(at)
                    taken.append(tokens)
                mine = b.take(pa.array(rows, pa.int32()))
                yield finish([mine.column(5 + i) for i in range(len(columns))], taken)

        return self._runs(both, "last", "stream").mapInArrow(read, schema)


def markup_kinds(df: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """(id, markup): one row per id and kind of markup among the delimiters that its host's wrapper takes from the text.

    markup is html, latex, markdown or wiki. Code, fenced or preformatted, only
    counts with its own marks. Null and empty texts and texts without markup
    have no row; repeated rows give one. Rows with a null id come out as one id,
    rows with a null host are one host. Other columns are not read.
    """
    streams = Scratch(df.sparkSession).keep(tokenised(df.withColumn(id_col, F.col(id_col).cast("bigint")), id_col, text_col, host_col).select("id", "host", "stream"))

    def finish(columns: list[pa.Array], taken: list[list[str]]) -> pa.RecordBatch:
        kinds = [kinds_of(t) for t in taken]
        at = pa.array([i for i, k in enumerate(kinds) for _ in k], pa.int32())
        return pa.RecordBatch.from_arrays([columns[0].take(at), pa.array([x for k in kinds for x in k], pa.string())], names=["id", "markup"])

    return Wrappers(streams).take(finish, "id bigint, markup string", ["id"]).distinct()


def host_wrappers(df: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """(host, wrapper, rows): the wrapper of each host's texts, as an expression, and how many texts it covers.

    Rows with a null host are one host; null texts count as none.
    """
    streams = Scratch(df.sparkSession).keep(tokenised(df, id_col, text_col, host_col).select("host", "stream"))
    said = Wrappers(streams.withColumn("own", F.col("stream")))

    def speak(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([expression(json.loads(w)) for w in b.column(1).to_pylist()], pa.string())], names=["key", "wrapper"])

    def finish(columns: list[pa.Array], taken: list[list[str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[0], pa.array([bool(t) or not s for t, s in zip(taken, columns[1].to_pylist())])], names=["host", "taken"])

    counts = said.take(finish, "host string, taken boolean", ["host", "own"]).groupBy("host").agg(F.count_if("taken").alias("rows")).withColumn("key", _host_key())
    return counts.join(said.of_hosts.mapInArrow(speak, "key string, wrapper string"), "key").select("host", "wrapper", "rows")


def clean_texts(df: DataFrame, id_col: str, text_col: str, keep: Sequence[str] = (), host_col: str | None = None) -> DataFrame:
    """id, the ``keep`` columns, clean_text, structure (array of kind, level, text) and markup (the kinds found).

    The text is what the slots and groups of the host's wrapper hold; without
    ``host_col`` all rows are of one host. Null texts stay null with null
    structure; empty texts stay empty. Repeated rows stay repeated. ``keep``
    must not name the result's own columns.
    """
    clash = {"id", "text", "clean_text", "structure", "markup", "host", "stream", "pieces", "key", "part", "last", "wrapper"} & set(keep)
    if clash:
        raise ValueError(f"keep names columns of the result: {sorted(clash)}")
    heads = ["id", *keep]
    streams = Scratch(df.sparkSession).keep(tokenised(df, id_col, text_col, host_col, keep, pieces=True))
    schema = ", ".join(f"`{n}` {streams.schema[n].dataType.simpleString()}" for n in heads)
    schema += ", clean_text string, structure array<struct<kind: string, level: int, text: string>>, markup array<string>"
    structure = pa.list_(pa.struct([("kind", pa.string()), ("level", pa.int32()), ("text", pa.string())]))

    def finish(columns: list[pa.Array], taken: list[list[str]]) -> pa.RecordBatch:
        pieces = [[(p["kind"], p["level"], p["text"]) for p in row if p["place"] < len(t) or not p["text"].strip()] for row, t in zip(columns[-1].to_pylist(), taken)]
        own = [
            pa.array([render(p) for p in pieces], pa.string()), pa.array([[dict(zip(("kind", "level", "text"), x)) for x in p] for p in pieces], structure),
            pa.array([kinds_of(t) for t in taken], pa.list_(pa.string())),
        ]
        return pa.RecordBatch.from_arrays([*columns[:-1], *own], names=[*heads, "clean_text", "structure", "markup"])

    none = df.filter(F.col(text_col).isNull()).select(F.col(id_col).alias("id"), *keep)
    cleaned = Wrappers(streams).take(finish, schema, [*heads, "pieces"])
    return cleaned.unionByName(none, allowMissingColumns=True)

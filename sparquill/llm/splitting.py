"""Cutting oversized texts into overlapping pieces at natural boundaries, by recursive bisection."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVELS = ("paragraph", "line", "sentence", "word", "none")  # from the strongest

_BREAK = r"(?>\r\n|\r|\n)"
_CUTS = (
    re.compile(rf"{_BREAK}(?:[^\S\r\n]*{_BREAK})+"),
    re.compile(_BREAK),
    re.compile(rf"{_BREAK}|(?<=[.!?])\s+|(?<=[。！？])"),
    re.compile(r"\s+"),
)


class _Marks:
    """The boundaries of a text, per level: where they end, in order, and where each begins."""

    def __init__(self, text: str):
        self.spans = [{m.end(): m.start() for m in cut.finditer(text)} for cut in _CUTS]
        self.ends = [sorted(s) for s in self.spans]

    def cut(self, a: int, b: int, levels: int, least: int) -> tuple[int, str] | None:
        """The place, not before ``least``, of the strongest boundary of the first ``levels`` in the middle half of a..b, nearest to the midpoint; without any there, elsewhere."""
        mid, quarter = (a + b) // 2, (b - a) // 4
        for low, high in ((mid - quarter, mid + quarter), (a + 1, b - 1)):
            for level, at in zip(LEVELS[:levels], self.ends):
                i = bisect_left(at, mid)
                near = [x for x in at[max(0, i - 1) : i + 1] if max(low, a + 1, least) <= x <= min(high, b - 1)]
                if near:
                    return min(near, key=lambda x: (abs(x - mid), x)), level
        return None

    def bisect(self, length: int, fits, levels: int, force: bool, least: int = 0) -> list[tuple[int, int, str]] | None:
        """(start, end, level of the cut before it) of ranges that fit, in order; without a boundary the midpoint if ``force``, else None."""
        out, todo = [], [(0, length, "")]
        while todo:
            a, b, level = todo.pop()
            if fits(a, b):
                out.append((a, b, level))
                continue
            cut = self.cut(a, b, levels, least) or (((a + b) // 2, LEVELS[-1]) if force else None)
            if cut is None:
                return None
            todo += [(cut[0], b, cut[1]), (a, cut[0], level)]
        return out

    def needed(self, length: int, limit: int) -> str:
        """The coarsest level whose boundaries alone bisect the text until no unit, its trailing boundary left out, exceeds the limit."""
        for k, level in enumerate(LEVELS[:-1]):
            # a boundary of a coarser level is one of each finer level too
            fits = lambda a, b: self.spans[k].get(b, b) - a <= limit  # noqa: E731, B023
            if self.bisect(length, fits, k + 1, False) is not None:
                return level
        return LEVELS[-1]


def needed_boundary(text: str, limit: int) -> str:
    """The coarsest level at which cutting everywhere leaves no unit above ``limit`` characters."""
    return _Marks(text).needed(len(text), limit)


def bisect_text(text: str, limit: int, overlap: int, marks: _Marks | None = None) -> list[tuple[int, int, str]]:
    """(start, end, level) of each piece, overlap included; level is that of the cut before the piece.

    The bodies without their overlaps are the text, in order. Each range longer
    than ``limit - overlap`` is cut at the strongest boundary in its middle
    half, at the one nearest to the midpoint; without any there, at the
    strongest nearest one elsewhere; without any, at the midpoint.
    """
    if len(text) <= limit:
        return [(0, len(text), "")] if text else []
    ranges = (marks or _Marks(text)).bisect(len(text), lambda a, b: b - a <= limit - overlap, len(_CUTS), True, overlap)  # the first piece is no shorter than the overlap
    return [(max(0, a - overlap), b, level) for a, b, level in ranges]


def split_oversized(df: DataFrame, id_col: str, text_col: str, keep: Sequence[str] = (), limit: int = 4096, overlap: int = 200) -> DataFrame:
    """Pieces of at most ``limit`` characters (code points) of every text.

    Result: id, the ``keep`` columns, piece_no from 0, n_pieces, start, text,
    cut (the level of the cut before the piece, null for a first piece) and
    boundary (the text's coarsest sufficient level, null for a text within the
    limit). Consecutive pieces of a text share exactly ``overlap`` characters.

    A text within the limit is its own piece and stays on the JVM. Null and
    empty texts have no piece. Repeated rows give repeated pieces. A null id is
    kept. ``keep`` must not name the result's own columns; other columns of
    ``df`` are not read, whatever their names.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be less than half the limit")
    clash = {"id", "piece_no", "n_pieces", "start", "text", "cut", "boundary"} & set(keep)
    if clash:
        raise ValueError(f"keep names columns of the result: {sorted(clash)}")
    rows = df.select(F.col(id_col).alias("id"), *keep, F.col(text_col).alias("text")).filter(F.length("text") > 0)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select("id", *keep).schema)
    schema += ", piece_no int, n_pieces int, start int, text string, cut string, boundary string"

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            heads = pdf[["id", *keep]].itertuples(index=False, name=None)
            for head, text in zip(heads, pdf["text"]):
                marks = _Marks(text)
                pieces, level = bisect_text(text, limit, overlap, marks), marks.needed(len(text), limit)
                out += [(*head, k, len(pieces), a, text[a:b], of or None, level) for k, (a, b, of) in enumerate(pieces)]
            yield pd.DataFrame(out, columns=["id", *keep, "piece_no", "n_pieces", "start", "text", "cut", "boundary"])

    long = rows.filter(F.length("text") > limit).mapInPandas(cut, schema)
    short = rows.filter(F.length("text") <= limit).select(
        "id", *keep, F.lit(0).alias("piece_no"), F.lit(1).alias("n_pieces"), F.lit(0).alias("start"), "text",
        F.lit(None).cast("string").alias("cut"), F.lit(None).cast("string").alias("boundary"),
    )
    return long.unionByName(short)

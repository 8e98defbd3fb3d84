"""Markdown, and the marked-up text that Word and PDF extraction yields."""

from __future__ import annotations

import re

from sparquill.sources.parsers import MAX_TOKENS, Piece, estimate, pack

MIN_TOKENS = 64
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")
_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_SENTENCES = re.compile(r"(?<=[.!?])\s+")


def _words(text: str) -> int:
    return len(text.split())


def _headings(lines: list[str]) -> list[tuple[int, int, str, int]]:
    """(line, level, title, lines of the heading) outside of code fences."""
    out, fence = [], ""
    for i, line in enumerate(lines):
        if m := _FENCE.match(line):
            if not fence:
                fence = m.group(1)
            elif m.group(1)[0] == fence[0] and len(m.group(1)) >= len(fence) and not line.strip().strip(fence[0]):
                fence = ""
        elif fence:
            continue
        elif m := _ATX.match(line):
            out.append((i, len(m.group(1)), (m.group(2) or "").strip(), 1))
        elif i and re.fullmatch(r" {0,3}(=+|-+)[ \t]*", line) and lines[i - 1].strip() and not _ATX.match(lines[i - 1]) and not (out and out[-1][0] == i - 1):
            out.append((i - 1, 1 if "=" in line else 2, lines[i - 1].strip(), 2))
    return out


def markdown(text: str, filename: str = "") -> list[Piece]:
    """Sections with text of their own, or without sections below; small ones join their parent, large ones split at blank lines."""
    lines = text.split("\n")
    heads = _headings(lines)
    if not heads:
        body = text.strip()
        return [Piece(body, "", "", "section", 1, len(lines), _words(body))]
    sections: list[dict] = []
    stack: list[dict] = []
    for k, (at, level, title, size) in enumerate(heads):
        while stack and stack[-1]["level"] >= level:
            stack.pop()
        parent = stack[-1] if stack else None
        until = heads[k + 1][0] if k + 1 < len(heads) else len(lines)
        name = f"{'#' * level} {title}"
        section = {"level": level, "path": f"{parent['path']} > {name}" if parent else name, "parent": parent, "leaf": True, "start": at + 1, "end": until, "body": "\n".join(lines[at + size : until]).strip()}
        if parent:
            parent["leaf"] = False
        section["text"] = "\n".join(lines[at:until]).strip()
        sections.append(section)
        stack.append(section)
    kept: list[dict] = []
    for s in sections:
        if not (s["leaf"] or s["body"]):
            continue
        if _words(s["text"]) < MIN_TOKENS and any(s["parent"] is x for x in kept):
            s["parent"]["text"] += "\n\n" + s["text"]
            s["parent"]["end"] = max(s["parent"]["end"], s["end"])
        else:
            kept.append(s)
    out = []
    for s in kept:
        parts = [s["text"]]
        if _words(s["text"]) > MAX_TOKENS:
            parts = pack([p.strip() for p in re.split(r"\n\s*\n", s["text"]) if p.strip()], "\n\n", size=_words)
        above = s["parent"]["path"] if s["parent"] else ""
        out += [Piece(p, s["path"], above, "section", s["start"], s["end"], _words(p)) for p in parts]
    return out


def _resized(piece: Piece, joiner: str = "\n") -> list[Piece]:
    if piece.tokens <= MAX_TOKENS:
        return [piece]
    units = piece.content.split("\n") if "\n" in piece.content else _SENTENCES.split(piece.content)
    return [piece._replace(content=c, tokens=estimate(c)) for c in pack([u for u in units if u.strip()], joiner)]


_ITEM = re.compile(r"(?:[-*+•]|\d+[.)])\s+(.*)")


def word(text: str, filename: str = "") -> list[Piece]:
    """A piece per heading, paragraph line, run of list items and run of table rows."""
    lines = [line.strip() for line in text.splitlines()]
    headed = any(re.match(r"#{1,6}\s+\S", line) for line in lines)
    stack: list[tuple[int, str]] = []
    path = lambda s: " > ".join(f"{'#' * n} {t}" for n, t in s)
    out: list[Piece] = []
    run: list[str] = []
    run_kind, run_at = "", 0

    def close(end: int) -> None:
        if run:
            add("\n".join(run), run_kind, run_at, end)
            run.clear()

    def add(content: str, kind: str, start: int, end: int) -> None:
        here, above = (path(stack), path(stack[:-1])) if headed else (f"# {filename.strip() or 'document'}", "")
        piece = Piece(content, here, above, kind, start + 1, end + 1, estimate(content))
        out.extend([piece] if kind == "heading" else _resized(piece))

    for i, line in enumerate(lines):
        heading = re.match(r"(#{1,6})\s+(.*\S)", line)
        item = _ITEM.match(line)
        kind = "" if not line else "heading" if heading else "table" if line.startswith("|") and line.endswith("|") and len(line) > 1 else "list" if item else "paragraph"
        if kind != run_kind or kind not in ("table", "list"):
            close(i - 1)
            run_kind, run_at = kind, i
        if heading:
            level = len(heading.group(1))
            while stack and stack[-1][0] >= level:
                stack.pop()
            stack.append((level, heading.group(2)))
            add(line, "heading", i, i)
        elif kind in ("table", "list"):
            run.append(item.group(1) if kind == "list" else line)
        elif kind == "paragraph":
            add(line, "paragraph", i, i)
    close(len(lines) - 1)
    return out


_PAGE = re.compile(r"=== PAGE (\d+)(?: \([^)]*\))? ===")
_NUMBERED = re.compile(r"(\d+(?:\.\d+)*)\s+(.+)")


def pdf(text: str, filename: str = "") -> list[Piece]:
    """Per page: numbered headings below 100 characters, and paragraphs between blank lines; line = page * 1000 + line on the page."""
    pages: list[tuple[int, list[str]]] = []
    for line in text.splitlines():
        if m := _PAGE.fullmatch(line.strip()):
            pages.append((int(m.group(1)), []))
        elif pages:
            pages[-1][1].append(line)
    out: list[Piece] = []
    for number, lines in pages or [(1, text.splitlines())]:
        trail: list[str] = []
        held: list[str] = []
        at, before = 0, len(out)
        place = lambda names: f"page:{number}" + (" §" + " ".join(names) if names else "")  # noqa: B023, E731

        def close(end: int) -> None:
            content = "\n".join(held).strip()  # noqa: B023
            held.clear()  # noqa: B023
            if content:
                piece = Piece(content, place(trail), place(trail[:-1]), "paragraph", number * 1000 + at, number * 1000 + end, estimate(content))  # noqa: B023
                parts = [content] if piece.tokens <= MAX_TOKENS else pack(_SENTENCES.split(content), " ")
                out.extend(piece._replace(content=c, tokens=estimate(c)) for c in parts)

        for i, raw in enumerate(lines):
            line = raw.strip()
            heading = _NUMBERED.fullmatch(line) if len(line) < 100 else None
            if line and not heading:
                held.append(line)
                continue
            close(i)
            at = i + 1
            if heading:
                del trail[heading.group(1).count(".") :]
                trail.append(f"{heading.group(1)} {heading.group(2).strip()}")
                out.append(Piece(line, place(trail), place(trail[:-1]), "heading", number * 1000 + i, number * 1000 + i, estimate(line)))
        close(len(lines))
        if len(out) == before and "".join(lines).strip():
            body = "\n".join(lines).strip()
            out.append(Piece(body, place([]), "", "paragraph", number * 1000, number * 1000 + len(lines), estimate(body)))
    return out

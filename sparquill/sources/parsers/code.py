"""Java, Go and Python symbols. Java and Go are read by matching brackets in a text whose strings and comments are blanked."""

from __future__ import annotations

import ast
import re
from typing import NamedTuple

from sparquill.sources.parsers import MAX_TOKENS, Piece, estimate, pack

_QUIET = re.compile(r'//[^\n]*|/\*[\s\S]*?\*/|"""[\s\S]*?"""|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|`[^`]*`')


def blanked(source: str) -> str:
    """The source, as long as it was, with blanks for strings and comments."""
    return _QUIET.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), source)


def _closing(quiet: str, at: int) -> int:
    """The bracket that closes the one at ``at``; -1 if there is none or one of another kind comes first."""
    pairs, stack = {"{": "}", "(": ")", "[": "]"}, []
    for i in range(at, len(quiet)):
        c = quiet[i]
        if c in pairs:
            stack.append(pairs[c])
        elif c in ")]}":
            if not stack or stack.pop() != c:
                return -1
            if not stack:
                return i
    return -1


def _line(source: str, at: int) -> int:
    return source.count("\n", 0, at) + 1


def _piece(source: str, start: int, end: int, path: str, parent: str, kind: str) -> Piece:
    content = source[start:end]
    return Piece(content, path, parent, kind, _line(source, start), _line(source, max(start, end - 1)), estimate(content))


class Member(NamedTuple):
    name: str
    kind: str
    start: int
    end: int
    body: tuple[int, int] | None


_TYPE = re.compile(r"\b(class|interface|enum|record|@interface)\s+([A-Za-z_$][\w$]*)")
_CALLED = re.compile(r"([A-Za-z_$][\w$]*)\s*\(")
_MODIFIERS = {"public", "protected", "private", "static", "final", "abstract", "synchronized", "native", "strictfp", "default"}  # fixed values: keywords
_NOT_CALLS = {"if", "for", "while", "switch", "catch", "synchronized", "try", "return", "new", "throw", "assert", "super", "this", "else", "do", "case"}  # fixed values: keywords


def java_members(quiet: str, start: int, end: int) -> list[Member]:
    """Declarations between two positions, nested ones left to the caller; a ValueError if brackets do not match."""
    out, at, first = [], start, start
    while at < end:
        c = quiet[at]
        if c in "([":
            at = _closing(quiet, at)
            if at < 0:
                raise ValueError("unmatched bracket")
            at += 1
        elif c in "{;":
            head = quiet[first:at]
            stop = at + 1
            body = None
            if c == "{":
                close = _closing(quiet, at)
                if close < 0:
                    raise ValueError("unmatched bracket")
                body, stop = (at + 1, close), close + 1
            lead = first + len(head) - len(head.lstrip())
            plain = re.sub(r"@[\w.]+(?:\([^()]*\))?", lambda m: " " * len(m.group()), head)
            kind, name = "", ""
            if m := _TYPE.search(plain):
                kind, name = ("interface" if "interface" in m.group(1) else m.group(1)), m.group(2)
            elif "=" in plain.split("(")[0]:
                kind, name = "field", re.split(r"[\s\[\]]+", plain.split("=")[0].strip())[-1]
                if body:  # an initialiser in braces: the field ends at the semicolon
                    stop = quiet.find(";", stop) + 1 or stop
                    body = None
            elif m := _CALLED.search(plain):
                kind, name = "method", m.group(1)
            elif c == ";" and plain.strip():
                kind, name = "field", re.split(r"[\s\[\]]+", plain.split(",")[0].strip())[-1]
            if kind == "method" and not set(plain[: m.start()].split()) - _MODIFIERS:
                kind = ""  # a constructor: there is no type before its name
            if name and kind:
                out.append(Member(name, kind, lead, stop, body))
            at = first = stop
        elif c == "}":
            raise ValueError("unmatched bracket")
        else:
            at += 1
    return out


def java(source: str, filename: str = "") -> list[Piece]:
    """Classes, interfaces, their methods and fields as pkg.Class#member; blocks of 50 lines where brackets do not match."""
    quiet = blanked(source)
    package = re.search(r"\bpackage\s+([\w.]+)\s*;", quiet)

    def of_type(m: Member, prefix: str, parent: str) -> list[Piece]:
        path = f"{prefix}.{m.name}" if prefix else m.name
        out = [_piece(source, m.start, m.end, path, parent, "symbol")]
        for x in java_members(quiet, *m.body) if m.body else []:
            if x.kind in ("class", "interface"):
                out += of_type(x, "", path)  # a nested type's path begins anew
            elif x.kind in ("method", "field"):
                out.append(_piece(source, x.start, x.end, f"{path}#{x.name}", path, "symbol"))
        return out

    try:
        return [p for m in java_members(quiet, 0, len(quiet)) if m.kind in ("class", "interface") for p in of_type(m, package.group(1) if package else "", "")]
    except ValueError:
        lines = source.splitlines()
        blocks = ((i, "\n".join(lines[i : i + 50])) for i in range(0, len(lines), 50))
        return [Piece(b, "", "", "symbol", i + 1, min(i + 50, len(lines)), estimate(b)) for i, b in blocks]


def java_calls(source: str) -> list[tuple[str, str, int]]:
    """(caller, callee, line): calls between methods declared in the file, by name; no calls of a method by itself, none if it does not parse."""
    quiet = blanked(source)
    methods: dict[str, Member] = {}

    def visit(start: int, end: int) -> None:
        for m in java_members(quiet, start, end):
            if m.kind == "method":
                methods.setdefault(m.name, m)
            elif m.body:
                visit(*m.body)

    try:
        visit(0, len(quiet))
    except ValueError:
        return []
    out: dict[tuple[str, str], int] = {}
    for m in methods.values():
        for call in _CALLED.finditer(quiet, *m.body) if m.body else []:
            if call.group(1) in methods and call.group(1) != m.name and call.group(1) not in _NOT_CALLS:
                out.setdefault((m.name, call.group(1)), _line(source, call.start()))
    return [(a, b, line) for (a, b), line in out.items()]


_GO = re.compile(r"^(?:func\s+(?:\((?P<receiver>[^)]*)\)\s*)?(?P<func>\w+)|type\s+(?P<group>\()|type\s+(?P<type>\w+))", re.M)


def go(source: str, filename: str = "") -> list[Piece]:
    """Functions, methods (pkg.Type#method) and types; one above 1,024 tokens is several pieces of whole lines. Raises where brackets do not match."""
    quiet = blanked(source)
    package = re.search(r"^package\s+(\w+)", quiet, re.M)
    named = lambda name: f"{package.group(1)}.{name}" if package else name
    depth = 0
    for c in quiet:
        depth += (c in "({[") - (c in ")}]")
        if depth < 0:
            break
    if depth:
        raise ValueError(f"{filename or 'Go source'}: brackets do not match")
    out: list[Piece] = []

    def end_of(at: int) -> int:
        """The end of a declaration: its line, with every bracket that opens on it."""
        while at < len(quiet) and quiet[at] != "\n":
            at = _closing(quiet, at) + 1 if quiet[at] in "({[" else at + 1
        return at

    def add(start: int, end: int, path: str, parent: str, kind: str) -> None:
        p = _piece(source, start, start + len(source[start:end].rstrip()), path, parent, kind)
        line = p.start_line
        for part in pack(p.content.split("\n"), "\n") if p.tokens > MAX_TOKENS else [p.content]:
            last = line + part.count("\n")
            out.append(p._replace(content=part, tokens=estimate(part), start_line=line, end_line=last))
            line = last + 1

    for m in _GO.finditer(quiet):
        if m.group("func"):
            end = end_of(m.end())
            if m.group("receiver") is not None:
                owner = re.sub(r"\[.*", "", m.group("receiver").split()[-1].lstrip("*").split(".")[-1]) if m.group("receiver").split() else "Unknown"
                add(m.start(), end, f"{named(owner)}#{m.group('func')}", named(owner), "method")
            else:
                add(m.start(), end, named(m.group("func")), "", "function")
        elif m.group("type"):
            end = end_of(m.end())
            start = m.start("type")
            add(start, end, named(m.group("type")), "", "interface" if re.match(r"\w+\s+interface\b", quiet[start:end]) else "type")
        else:
            close = _closing(quiet, m.start("group"))
            at = m.end("group")
            while at < close:
                if spec := re.compile(r"\s*(\w+)").match(quiet, at, close):
                    end = min(end_of(spec.end()), close)
                    add(spec.start(1), end, named(spec.group(1)), "", "interface" if re.match(r"\w+\s+interface\b", quiet[spec.start(1) : end]) else "type")
                    at = end
                else:
                    at = close
    return out


def python(source: str, filename: str = "") -> list[Piece]:
    """Functions, classes and methods at any depth, decorators included; large ones split between lines. Raises on a syntax error."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError) as e:
        raise ValueError(f"{filename or 'Python source'}: {e}") from e
    lines = source.splitlines(keepends=True)
    module = re.sub(r"\.py$", "", filename.rsplit("/", 1)[-1])
    out: list[Piece] = []

    def visit(node: ast.AST, scope: str, in_class: bool) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                is_class = isinstance(child, ast.ClassDef)
                path = f"{scope}.{child.name}" if scope else child.name
                first = min([child.lineno, *(d.lineno for d in child.decorator_list)])
                content = "".join(lines[first - 1 : child.end_lineno]).strip("\n")
                kind = "class" if is_class else "method" if in_class else "function"
                at = first
                parts = [content] if estimate(content) <= MAX_TOKENS else pack(content.split("\n"), "\n", 4 * MAX_TOKENS, lambda x: len(x) + 1)
                for part in parts:
                    n = part.count("\n") + 1
                    out.append(Piece(part, path, scope, kind, at, at + n - 1, estimate(part)))
                    at += n
                visit(child, path, is_class)
            elif isinstance(child, (ast.stmt, ast.ExceptHandler, ast.match_case)):
                visit(child, scope, in_class)

    visit(tree, module, False)
    return out

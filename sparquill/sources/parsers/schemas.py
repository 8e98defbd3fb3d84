"""OpenAPI / Swagger documents and SQL DDL."""

from __future__ import annotations

import json
import re

from sparquill.sources.parsers import Piece, estimate

_METHODS = {"get", "put", "post", "delete", "options", "head", "patch", "trace"}  # fixed values: HTTP methods


def load_spec(text: str) -> dict:
    """A JSON or YAML document with an openapi or swagger version. Raises ValueError otherwise."""
    try:
        spec = json.loads(text)
    except ValueError:
        try:
            import yaml
        except ImportError as e:
            raise ValueError("not JSON, and YAML cannot be read here") from e
        try:
            spec = yaml.safe_load(text)
        except yaml.YAMLError as e:
            raise ValueError(f"neither JSON nor YAML: {e}") from e
    if not isinstance(spec, dict) or not {"openapi", "swagger"} & set(spec):
        raise ValueError("no openapi or swagger version in the document")
    return spec


def _refs(node) -> list[str]:
    """Paths of the schemas that a node refers to, in order."""
    if isinstance(node, list):
        return [r for x in node for r in _refs(x)]
    if not isinstance(node, dict):
        return []
    out = []
    for key, value in node.items():
        if key == "$ref" and isinstance(value, str):
            if m := re.search(r"#/(components/schemas|definitions)/(.+)", value):
                out.append(f"schema:{m.group(1).replace('/', '.')}.{m.group(2)}")
        else:
            out += _refs(value)
    return out


def openapi(text: str, filename: str = "") -> list[Piece]:
    """A piece per schema and per operation; an operation's parent is the first schema of its request body, else of all it refers to."""
    spec = load_spec(text)
    place = "components.schemas" if "openapi" in spec else "definitions"
    schemas = (spec.get("components") or {}).get("schemas") if "openapi" in spec else spec.get("definitions")
    said = lambda x: json.dumps(x, indent=2, ensure_ascii=False, default=str)
    out = [Piece(c := said(body), f"schema:{place}.{name}", "", "schema", 0, 0, estimate(c)) for name, body in (schemas or {}).items()]
    for route, operations in (spec.get("paths") or {}).items():
        for method, operation in operations.items() if isinstance(operations, dict) else ():
            if str(method).lower() in _METHODS:
                body = operation.get("requestBody") if isinstance(operation, dict) else None
                refs = _refs(body) or _refs(operation)
                out.append(Piece(c := said(operation), f"{method.upper()} {route}", refs[0] if refs else "", "endpoint", 0, 0, estimate(c)))
    return out


_SILENT = re.compile(r"--[^\n]*|/\*[\s\S]*?\*/|'(?:''|[^'])*'|\$(\w*)\$[\s\S]*?\$\1\$")
_NAME = r"(?:[\"`\[]?[\w$]+[\"`\]]?\.)*[\"`\[]?[\w$]+[\"`\]]?"
_CREATE = re.compile(rf"create\s+(?:or\s+replace\s+)?(?:(?:global|local)\s+)?(?:temp(?:orary)?\s+)?(?P<kind>table|(?:unique\s+)?index|view|procedure)\s+(?:concurrently\s+)?(?:if\s+not\s+exists\s+)?(?P<name>{_NAME})", re.I)
_INDEX_ON = re.compile(rf"\bon\s+(?:only\s+)?(?P<table>{_NAME})", re.I)
_ALTER = re.compile(rf"alter\s+table\s+(?:if\s+exists\s+)?(?:only\s+)?(?P<table>{_NAME})\s+", re.I)
_CONSTRAINT = re.compile(rf"constraint\s+(?P<name>{_NAME})", re.I)
_UNNAMED = re.compile(r"(?:primary\s+key|foreign\s+key|unique|check|exclude|like)\b", re.I)
_KEY = re.compile(rf"foreign\s+key\s*\([^)]*\)\s*references\s+(?P<table>{_NAME})", re.I)


def _bare(name: str) -> str:
    return name.split(".")[-1].strip('"`[]')


def _quiet(sql: str) -> str:
    """The text, as long as it was, with blanks for comments and what strings hold."""
    return _SILENT.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), sql)


def _statements(quiet: str) -> list[tuple[int, int]]:
    """Spans of statements, split at semicolons outside of brackets and of BEGIN ... END."""
    out, start, depth, block = [], 0, 0, 0
    for m in re.finditer(r"[();]|\b(?:begin|case|end)\b", quiet, re.I):
        token = m.group().lower()
        if token == ";" and depth <= 0 and block <= 0:
            out.append((start, m.end()))
            start = m.end()
        depth += (token == "(") - (token == ")")
        block += (token in ("begin", "case")) - (token == "end")
    return [*out, (start, len(quiet))]


def _entries(quiet: str, start: int, end: int) -> list[tuple[int, int]]:
    """Spans between the commas of the outermost level, without the blanks around."""
    cuts, depth = [start - 1], 0
    for i in range(start, end):
        depth += (quiet[i] in "([") - (quiet[i] in ")]")
        if quiet[i] == "," and depth == 0:
            cuts.append(i)
    spans = []
    for a, b in zip(cuts, [*cuts[1:], end]):
        text = quiet[a + 1 : b]
        if text.strip():
            lead = a + 1 + len(text) - len(text.lstrip())
            spans.append((lead, lead + len(text.strip())))
    return spans


def _body(quiet: str, at: int, end: int) -> tuple[int, int] | None:
    open_ = quiet.find("(", at, end)
    if open_ < 0:
        return None
    depth = 0
    for i in range(open_, end):
        depth += (quiet[i] == "(") - (quiet[i] == ")")
        if not depth:
            return open_ + 1, i
    return open_ + 1, end


def ddl(text: str, filename: str = "") -> list[Piece]:
    """Tables with their columns and named constraints, indexes, views, procedures and what ALTER TABLE adds; other statements have no piece."""
    quiet = _quiet(text)
    out: list[Piece] = []

    def add(a: int, b: int, path: str, parent: str, kind: str) -> None:
        content = text[a:b].strip()
        lead = a + len(text[a:b]) - len(text[a:b].lstrip())
        out.append(Piece(content, path, parent, kind, text.count("\n", 0, lead) + 1, text.count("\n", 0, lead + len(content)) + 1, estimate(content)))

    def part(a: int, b: int, table: str) -> None:
        entry = quiet[a:b]
        if m := _CONSTRAINT.match(entry):
            add(a, b, f"constraint:{_bare(m.group('name'))}", table, "constraint")
        elif not _UNNAMED.match(entry) and (m := re.match(_NAME, entry)):
            add(a, b, f"{table}.column:{_bare(m.group())}", table, "column")

    for start, end in _statements(quiet):
        a = start + len(quiet[start:end]) - len(quiet[start:end].lstrip())
        if m := _CREATE.match(quiet, a, end):
            kind, name = m.group("kind").split()[-1].lower(), _bare(m.group("name"))
            parent = ""
            if kind == "index" and (on := _INDEX_ON.search(quiet, m.end(), end)):
                parent = f"table:{_bare(on.group('table'))}"
            add(a, end, f"{kind}:{name}", parent, kind)
            if kind == "table" and (span := _body(quiet, m.end(), end)):
                for entry in _entries(quiet, *span):
                    part(*entry, f"table:{name}")
        elif m := _ALTER.match(quiet, a, end):
            table = f"table:{_bare(m.group('table'))}"
            stop = end - 1 if text[a:end].rstrip().endswith(";") else end
            for x, y in _entries(quiet, m.end(), stop):
                if add_ := re.compile(r"add\s+(?:column\s+)?(?:if\s+not\s+exists\s+)?", re.I).match(quiet, x, y):
                    part(add_.end(), y, table)
    return out


def foreign_keys(text: str) -> list[tuple[str, str]]:
    """(table, referenced table) of the table-level foreign keys of CREATE TABLE bodies; references within a column do not count."""
    quiet = _quiet(text)
    out = []
    for start, end in _statements(quiet):
        a = start + len(quiet[start:end]) - len(quiet[start:end].lstrip())
        m = _CREATE.match(quiet, a, end)
        if m and m.group("kind").lower() == "table" and (span := _body(quiet, m.end(), end)):
            for x, y in _entries(quiet, *span):
                if key := _KEY.search(quiet, x, y):
                    out.append((_bare(m.group("name")), _bare(key.group("table"))))
    return list(dict.fromkeys(out))

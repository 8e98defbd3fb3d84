import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from sparquill.operators import extraction
from sparquill.sources import files, layout
from sparquill.sources.parsers import SCHEMA, parse, parse_sources, with_ids
from sparquill.sources.parsers.code import java_calls
from sparquill.sources.parsers.schemas import foreign_keys

JAVA = """package shop.core;
/** class Fake { } */
public class Cart extends Base {
    private final List<Item> items = new ArrayList<>();
    public Cart() { reset(); }
    public int total(int rate) { // calls price(
        return price(rate) + "x{".length();
    }
    int price(int rate) { return rate; }
    static class Line { void show() { } }
}
interface Shelf { void put(Item i); }
"""
DDL = """-- shop
CREATE TABLE shop.orders (id BIGINT PRIMARY KEY, note VARCHAR(9) DEFAULT 'a,b;', customer BIGINT,
  CONSTRAINT fk_c FOREIGN KEY (customer) REFERENCES customers(id), CHECK (id > 0));
CREATE TABLE customers (id BIGINT, boss BIGINT REFERENCES customers(id));
CREATE UNIQUE INDEX ix ON orders (id);
INSERT INTO orders VALUES (1);
CREATE VIEW v AS SELECT 1;
CREATE PROCEDURE p() BEGIN UPDATE orders SET id = 1; END;
ALTER TABLE orders ADD COLUMN extra INT, ADD CONSTRAINT u UNIQUE (note);
"""


def paths(text, fmt, name=""):
    return [(p.path, p.kind) for p in parse(text, fmt, name)]


def test_java():
    assert [p for p, _ in paths(JAVA, "java")] == ["shop.core.Cart", "shop.core.Cart#items", "shop.core.Cart#total", "shop.core.Cart#price", "Line", "Line#show", "shop.core.Shelf", "shop.core.Shelf#put"]
    total = parse(JAVA, "java")[2]
    assert (total.start_line, total.end_line, total.parent_path) == (6, 8, "shop.core.Cart")
    assert java_calls(JAVA) == [("total", "price", 7)]
    broken = parse("class A {\n" + "x;\n" * 120, "java")
    assert [(p.start_line, p.end_line) for p in broken] == [(1, 50), (51, 100), (101, 121)]


def test_go():
    text = 'package store\n\ntype Repo struct {\n\tx int\n}\n\ntype (\n\tA int\n\tReader interface {\n\t\tRead() error\n\t}\n)\n\nfunc (r *Repo) Get(id int) error {\n\treturn nil // }\n}\n\nfunc New() *Repo { return &Repo{} }\n'
    assert paths(text, "go") == [("store.Repo", "type"), ("store.A", "type"), ("store.Reader", "interface"), ("store.Repo#Get", "method"), ("store.New", "function")]
    with pytest.raises(ValueError):
        parse("package x\nfunc f() {", "go")


def test_python():
    text = "import os\n\n@wrap\ndef f(a):\n    def g():\n        pass\n    return g\n\nif os:\n    class C:\n        async def m(self):\n            pass\n"
    assert paths(text, "python", "a/tools.py") == [("tools.f", "function"), ("tools.f.g", "function"), ("tools.C", "class"), ("tools.C.m", "method")]
    assert parse(text, "python", "tools.py")[0].start_line == 3
    with pytest.raises(ValueError):
        parse("def f(:", "python")
    long = "def f():\n" + "    x = 1111111111\n" * 600
    parts = parse(long, "python", "m.py")
    assert len(parts) > 1 and "\n".join(p.content for p in parts) == long.strip("\n")
    assert all(b.start_line == a.end_line + 1 for a, b in zip(parts, parts[1:]))


def test_openapi():
    spec = {"openapi": "3.0.0", "components": {"schemas": {"Pet": {"type": "object"}}}, "paths": {"/pets": {"post": {"requestBody": {"$ref": "#/components/schemas/Pet"}, "responses": {"$ref": "#/components/schemas/Err"}}, "x-note": {}}}}
    got = parse(json.dumps(spec), "openapi")
    assert [(p.path, p.parent_path) for p in got] == [("schema:components.schemas.Pet", ""), ("POST /pets", "schema:components.schemas.Pet")]
    with pytest.raises(ValueError):
        parse("{}", "openapi")


def test_ddl():
    assert paths(DDL, "ddl") == [
        ("table:orders", "table"), ("table:orders.column:id", "column"), ("table:orders.column:note", "column"), ("table:orders.column:customer", "column"), ("constraint:fk_c", "constraint"),
        ("table:customers", "table"), ("table:customers.column:id", "column"), ("table:customers.column:boss", "column"), ("index:ix", "index"), ("view:v", "view"), ("procedure:p", "procedure"),
        ("table:orders.column:extra", "column"), ("constraint:u", "constraint"),
    ]
    assert foreign_keys(DDL) == [("orders", "customers")]


def test_markdown():
    body = "word " * 70
    text = f"# A\n{body}\n## B\nsmall\n```\n# not a heading\n```\nC\n==\n{body}"
    got = parse(text, "markdown")
    assert [(p.path, p.parent_path) for p in got] == [("# A", ""), ("# C", "")]
    assert "small" in got[0].content  # a small section joins its parent
    assert [p.path for p in parse("just text", "markdown")] == [""]
    assert len(parse("# A\n" + "\n\n".join([body] * 40), "markdown")) > 1


def test_word_and_pdf():
    got = parse("# T\nplain\n- a\n- b\n\n| x | y |\n| 1 | 2 |\n## U\nmore", "word")
    assert [(p.kind, p.content) for p in got] == [("heading", "# T"), ("paragraph", "plain"), ("list", "a\nb"), ("table", "| x | y |\n| 1 | 2 |"), ("heading", "## U"), ("paragraph", "more")]
    assert got[-1].path == "# T > ## U" and got[-1].parent_path == "# T"
    pdf = parse("=== PAGE 2 ===\n1 Intro\nline one\nline two\n\n1.1 Deep\ntext\n=== PAGE 3 (linear-fallback: x) ===\nalone", "pdf")
    assert [(p.path, p.kind) for p in pdf] == [("page:2 §1 Intro", "heading"), ("page:2 §1 Intro", "paragraph"), ("page:2 §1 Intro 1.1 Deep", "heading"), ("page:2 §1 Intro 1.1 Deep", "paragraph"), ("page:3", "paragraph")]
    assert pdf[0].start_line == 2000


def test_parse_sources_ids_and_edges(spark):
    rows = [(1, "java", "Cart.java", JAVA), (2, "ddl", "s.sql", DDL), (3, "go", "x.go", "func {"), (4, "pdf", "e.pdf", None), (5, "nope", "f", "text")]
    sources = spark.createDataFrame(rows, "source_id bigint, format string, filename string, text string")
    pieces = parse_sources(sources)
    assert {r.source_id for r in pieces.filter("error IS NOT NULL").collect()} == {3, 4, 5}
    ids = with_ids(pieces)
    chunk = {r.position_path: r for r in ids.collect()}
    assert chunk["shop.core.Cart#total"].parent_chunk_id == chunk["shop.core.Cart"].chunk_id
    assert chunk["shop.core.Cart"].parent_chunk_id is None
    calls = extraction.call_edges(sources, ids).collect()
    assert {(r.source, r.target, r.relation_type) for r in calls} == {
        (chunk["shop.core.Cart#total"].chunk_id, chunk["shop.core.Cart#price"].chunk_id, "calls"), (chunk["shop.core.Cart#price"].chunk_id, chunk["shop.core.Cart#total"].chunk_id, "called_by"),
    }
    assert extraction.foreign_key_edges(sources, ids).count() == 2
    assert parse_sources(sources.limit(0)).columns == [c.split()[0] for c in SCHEMA.split(", ")]


def test_detect_format(spark):
    rows = [("a.md", "x", "markdown"), ("a.json", '{\n "openapi": "3"}', "openapi"), ("a.json", '{"a": 1}', None), ("b.go", "// c\n\npackage x", "go"), ("b.go", "func", None), ("c.DOCX", "", "word"), ("d.bin", "", None)]
    df = spark.createDataFrame(rows, "f string, t string, want string").withColumn("got", files.detect_format(F.col("f"), F.col("t")))
    assert all(r.want == r.got for r in df.collect())


def test_files_and_docx(spark, tmp_path):
    folder = tmp_path / "s1" / "src1"
    folder.mkdir(parents=True)
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda text, style="": f'<w:p>{f"<w:pPr><w:pStyle w:val=\'{style}\'/></w:pPr>" if style else ""}<w:r><w:t>{text}</w:t></w:r></w:p>'
    body = f'<w:document {w}><w:body>{p("Top", "Title")}{p("Part", "Heading2")}{p("one", "ListBullet")}<w:tbl><w:tr><w:tc>{p("a")}</w:tc><w:tc>{p("b")}</w:tc></w:tr></w:tbl></w:body></w:document>'
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", body)
    (folder / "a.docx").write_bytes(buffer.getvalue())
    (folder / "bad.docx").write_bytes(b"PK no")
    (folder / "empty.docx").write_bytes(b"")
    read = files.read_files(spark, str(tmp_path), "*.docx")
    assert {r.filename: (r.scope, r.source) for r in read.collect()} == {"a.docx": ("s1", "src1"), "bad.docx": ("s1", "src1")}
    got = {r.path.rsplit("/", 1)[1]: r for r in files.extract_docx(read).collect()}
    assert got["a.docx"].text == "# Top\n\n## Part\n\n- one\n\n| a | b |"
    assert got["bad.docx"].error
    with pytest.raises(ValueError):
        files.safe_part("../x")


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k int, v string")
    files.insert_new(df, path, ["k"])
    files.insert_new(spark.createDataFrame([(2, "z"), (3, "c")], df.schema), path, ["k"])
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "a"), (2, "b"), (3, "c")]


def test_two_columns(spark):
    rows = [(1, 1, 600.0, f"l{i}{w}", 50.0 + 60 * w, 100.0 + 60 * w, 20.0 * i) for i in range(3) for w in range(2)]
    rows += [(1, 1, 600.0, f"r{i}{w}", 350.0 + 60 * w, 400.0 + 60 * w, 20.0 * i) for i in range(3) for w in range(2)]
    words = spark.createDataFrame(rows, "doc int, page int, page_width double, text string, x0 double, x1 double, top double")
    assert layout.page_texts(words).first().text == "l00 l01\nl10 l11\nl20 l21\nr00 r01\nr10 r11\nr20 r21"
    one = words.withColumn("x1", F.when(F.col("text") == "l01", 360.0).otherwise(F.col("x1")))
    assert layout.page_texts(one).first().text.startswith("l00 l01 r00 r01")
    assert layout.document_texts(words).first().text.startswith("=== PAGE 1 ===\n")


def test_a_long_go_declaration_loses_no_text():
    from sparquill.sources.parsers import MAX_TOKENS, parse

    body = "\n".join(f"\tstep{i}(ctx, value{i})" for i in range(600))
    source = f"package q\n\nfunc Run() {{\n{body}\n}}\n"
    pieces = parse(source, "go", "q.go")
    assert len(pieces) > 1 and "\n".join(p.content for p in pieces) == source[source.index("func") :].rstrip()
    assert all(p.tokens <= MAX_TOKENS * 1.1 for p in pieces)
    assert [p.start_line for p in pieces][1:] == [p.end_line + 1 for p in pieces][:-1] and pieces[-1].end_line == source.count("\n")

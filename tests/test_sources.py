"""Parsers, office formats, ingestion, export."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from corpusmill import manifest
from corpusmill.sources import files as fs
from corpusmill.sources import office, parsers


def kinds(blocks):
    return [(b.kind, b.name, b.start, b.end) for b in blocks]


def test_generic():
    out = parsers.generic("a\nb\n\n  \nc\n")
    assert [(b.content, b.start, b.end) for b in out] == [("a\nb\n", 1, 2), ("c\n", 4, 5)]  # the line after the one that closed a block


def test_python():
    t = "import os\nclass A:\n    def f(self):\n        import re\n        return 1\n\nx = 1\ndef g():\n    pass"
    assert kinds(parsers.python(t)) == [("import", "", 1, 1), ("class", "A", 2, 2), ("function", "f", 3, 6), ("function", "g", 8, 9)]
    assert "async" not in [b.name for b in parsers.python("async def f():\n    pass")]


def test_javascript():
    t = "import x from 'y'\nfunction f() {\n  if (a) { b }\n}\nconst g = (a) => {\n  return a\n}\nexport class C {\n  m() { }\n}"
    assert kinds(parsers.javascript(t)) == [("import", "", 1, 1), ("function", "f", 2, 4), ("function", "g", 5, 7), ("class", "C", 8, 10)]


def test_bash_sql_html_markdown_go():
    assert kinds(parsers.bash("#!/bin/sh\n# no\nf() {\n  x\n}\nfunction g {\n y\n}")) == [("shebang", "", 1, 1), ("function", "f", 3, 5), ("function", "g", 6, 8)]
    assert kinds(parsers.sql("-- c\nSELECT 1\nFROM x;\nnoise\ncreate table t (a int);")) == [("select", "", 2, 3), ("create", "", 5, 5)]
    assert kinds(parsers.html("<p>\n<script>\nx\n</script>\n<style>a</style>\n")) [0] == ("script", "", 2, 4)
    assert kinds(parsers.html("<p>one</p>"))[0][0] == "document"
    md = parsers.markdown("lost\n# A\ntext\n```py\ncode\n```\n## B\nend")
    assert kinds(md) == [("code_block", "py", 4, 6), ("section", "A", 2, 6), ("section", "B", 7, 8)]
    assert kinds(parsers.markdown("# A\n```\nx\n ```\ny")) == [("code_block", "", 2, 5), ("section", "A", 1, 5)]  # a fence ends at the margin alone
    go = parsers.golang('package p\nimport (\n\t"fmt"\n)\ntype T struct {\n\ta int\n}\nfunc (t *T) M() {\n}\nfunc F() int {\n\treturn 1\n}')
    assert {(b.kind, b.name) for b in go} == {("import", '"fmt"'), ("struct", "T"), ("function", "(*T).M"), ("function", "F")}


GO = """package main

import (
\t"fmt"
\tu "net/url" // with a name
)
import "os"

// func no() {
type (
\tA struct {
\t\tx int
\t}
\tB interface{ Do() }
\tC = map[string]int
\tG[T any] struct{ v T }
)

type D []int

func (a *A) Run(s string) string {
\tx := "{" /* } */
\ttype local struct{ y int }
\treturn s + x
}
func (A) Plain() {}
func main() { fmt.Println(`
func no() {`) }
"""


def test_go():
    assert kinds(parsers.golang(GO)) == [
        ("import", '"fmt"', 4, 4), ("import", '"net/url"', 5, 5), ("import", '"os"', 7, 7), ("struct", "A", 11, 13), ("interface", "B", 14, 14), ("type", "C", 15, 15), ("struct", "G", 16, 16),
        ("type", "D", 19, 19), ("function", "(*A).Run", 21, 25), ("struct", "local", 23, 23), ("function", "(A).Plain", 26, 26), ("function", "main", 27, 28),
    ]
    assert [b.content for b in parsers.golang(GO)][:2] == ['\t"fmt"', '\tu "net/url" // with a name']
    assert [x[2] for x in parsers.parse("func f() {", "go")] == ["func f() {\n"]  # no source of this language: by blank lines


def test_pdf_text():
    out = parsers.pdf_text("one\n two \n\nPage 2\nthree\nfour")
    assert [(b.content, b.page) for b in out] == [("one two", 1), ("three four", 2)]
    (first, *_), *_ = parsers.parse("one\n two ", "pdf")
    assert first == parsers.block_id("one two ")


def _zip(**files):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for k, v in files.items():
            z.writestr(k.replace("__", "/").replace("_xml", ".xml"), v)
    return b.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
DOCX = _zip(word__document_xml=f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>Some </w:t><w:t>text</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
XLSX = _zip(xl__sharedStrings_xml=f"<sst {S}><si><t>name</t></si></sst>", xl__worksheets__sheet1_xml=f'<worksheet {S}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="b"><v>1</v></c></row><row r="2"/><row r="3"><c r="A3"><v>4.5</v></c></row></sheetData></worksheet>')


def test_office():
    assert [(b.kind, b.content, b.level) for b in office.docx(DOCX)] == [("heading", "Head", 2), ("text", "Some text", 0), ("table", "a | b", 0)]
    assert [b.content for b in office.xlsx(XLSX)] == ["A1:name | B1:TRUE", "A3:4.5"]
    assert [b.content for b in office.pdf(b"%PDF (Hello) Tj (World) Tj")] == ["Hello World"]


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.py").write_text("def f():\n    return 1\n")
    (tmp_path / "sub" / "b.md").write_text("# T\n\nbody\n")
    (tmp_path / "sub" / "copy.md").write_text("# T\n\nbody\n")
    (tmp_path / "d.docx").write_bytes(DOCX)
    return str(tmp_path)


def test_ingest(spark, folder):
    found = fs.ingest(spark, folder)
    assert sorted(r["mime_type"] for r in found.collect()) == sorted(["text/x-python", "text/markdown", fs.tx.MIME[".docx"]])
    assert fs.ingest(spark, folder, found).count() == 0 and fs.ingest(spark, folder, recursive=False).count() == 2
    assert {r["workflow_id"] for r in fs.route(found).collect()} == {"python_chunking_v1", "markdown_chunking_v1", "docx_chunking_v1"}


def test_extract(spark):
    df = spark.createDataFrame([("f", bytearray(DOCX)), ("bad", bytearray(b"no zip"))], "id string, content binary")
    assert [r["content"] for r in fs.extract(df, "docx").orderBy("position").collect()] == ["Head", "Some text", "a | b"]
    assert fs.extract(df, "unknown").count() == 0
    text = spark.createDataFrame([("x", "a\nb\n\nc")], "id string, content string")
    native = [r["content"] for r in fs.generic_blocks(text).orderBy("position").collect()]
    assert native == [r["content"] for r in fs.extract(text, "text").orderBy("position").collect()] == ["a\nb\n", "c\n"]


def test_export(spark, tmp_path):
    chunks = spark.createDataFrame([("c2", "f", "x, y", 1, "semantic", 2), ("c1", "f", "z", 1, "semantic", 1)], "id string, file_id string, content string, token_count bigint, chunk_type string, position bigint")
    files = spark.createDataFrame([("f", "/a,b.txt")], "id string, source_path string")
    fs.write_json(fs.export(chunks, files), f"{tmp_path}/j")
    fs.write_csv(fs.export(chunks, files, content=False), f"{tmp_path}/c")
    assert [r["id"] for r in spark.read.json(f"{tmp_path}/j").collect()] == ["c1", "c2"]
    back = spark.read.csv(f"{tmp_path}/c", header=True).collect()
    assert back[0]["source_path"] == "/a,b.txt" and "content" not in back[0].asDict()


def test_manifest(spark, folder):
    m = manifest.scan(spark, folder, "p").cache()
    assert m.count() == 4 and manifest.verify(m, m).count() == 0 and len(manifest.total(m).first()["total"]) == 64
    changed = m.withColumn("sha256", F.when(F.col("path").endswith("a.py"), "0").otherwise(F.col("sha256"))).where("path not like '%copy.md'")
    assert sorted(r["fault"] for r in manifest.verify(m, changed).collect()) == ["changed", "missing"]

"""DOCX, XLSX and PDF files to segments. Standard library only; PDFs go through pdftotext where it is installed."""

from __future__ import annotations

import io
import re
import subprocess
import zipfile
from xml.etree import ElementTree

from corpusmill.sources import parsers

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def docx(raw: bytes) -> list[parsers.Block]:
    """Paragraphs, then tables. A style that names a heading makes a heading; a table is rows of cells joined by ` | `."""
    try:
        root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(raw)).read("word/document.xml"))
    except ElementTree.ParseError:
        text = " ".join(re.findall(r"<w:t[^>]*>([^<]*)</w:t>", zipfile.ZipFile(io.BytesIO(raw)).read("word/document.xml").decode("utf-8", "replace")))
        return [parsers.Block("text", "", p.strip(), i, i) for i, p in enumerate(text.split("  ")) if p.strip()]
    body = root.find(f"{W}body")
    out: list[parsers.Block] = []
    if body is None:
        return out
    for p in body.findall(f"{W}p"):
        text = "".join(t.text or "" for t in p.iter(f"{W}t")).strip()
        style = p.find(f"{W}pPr/{W}pStyle")
        name = style.get(f"{W}val", "") if style is not None else ""
        m = re.search(r"(?i)heading\s*(\d*)|title", name)
        if text:
            out.append(parsers.Block("heading" if m else "text", name, text, len(out), len(out), int(m[1]) if m and m[1] else int(bool(m))))
    for table in body.findall(f"{W}tbl"):
        rows = [" | ".join("".join(t.text or "" for t in c.iter(f"{W}t")).strip() for c in r.findall(f"{W}tc")) for r in table.findall(f"{W}tr")]
        text = "\n".join(rows).strip()
        if text:
            out.append(parsers.Block("table", "", text, len(out), len(out)))
    return out


def xlsx(raw: bytes) -> list[parsers.Block]:
    """One segment a row that isn't empty: REF:value joined by ` | `."""
    z = zipfile.ZipFile(io.BytesIO(raw))
    names = z.namelist()
    shared = []
    if "xl/sharedStrings.xml" in names:
        shared = ["".join(t.text or "" for t in si.iter(f"{S}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{S}si")]
    out: list[parsers.Block] = []
    for name in sorted(n for n in names if re.fullmatch(r"xl/worksheets/sheet[^/]*\.xml", n)):
        first = len(out)
        body = z.read(name)
        try:
            rows = ElementTree.fromstring(body).iter(f"{S}row")
        except ElementTree.ParseError:
            text = " ".join(re.findall(r"<v>([^<]*)</v>", body.decode("utf-8", "replace")))
            out += [parsers.Block("table", name, text, first, first)] if text else []
            continue
        for row in rows:
            cells = []
            for c in row.findall(f"{S}c"):
                v, kind = c.find(f"{S}v"), c.get("t")
                value = "".join(t.text or "" for t in c.iter(f"{S}t")) if kind == "inlineStr" else (v.text or "") if v is not None else ""
                if kind == "s" and value.isdigit() and int(value) < len(shared):
                    value = shared[int(value)]
                if kind == "b":
                    value = "TRUE" if value == "1" else "FALSE"
                if value:
                    cells.append(f"{c.get('r', '')}:{value}")
            if cells:
                at = first + int(row.get("r") or 0)
                out.append(parsers.Block("table", name, " | ".join(cells), at, at))
    return out


def pdf(raw: bytes) -> list[parsers.Block]:
    try:
        run = subprocess.run(["pdftotext", "-layout", "-enc", "UTF-8", "-", "-"], input=raw, capture_output=True, timeout=120, check=True)
        text = run.stdout.decode("utf-8", "replace")
    except (OSError, subprocess.SubprocessError):
        text = " ".join(m.decode("latin-1") for m in re.findall(rb"\(([^()]*)\)", raw))
    return parsers.pdf_text(text)


READERS = {"docx": docx, "xlsx": xlsx, "pdf": pdf}

"""Parsers from a text to blocks. Each is a line scanner of its own; files are small next to a task, so a file is one call."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass


@dataclass
class Block:
    kind: str
    name: str
    content: str
    start: int
    end: int
    level: int = 0
    page: int | None = None


def block_id(content: str) -> str:
    """The first 16 bytes of the SHA-256, in hex."""
    return hashlib.sha256(content.encode()).hexdigest()[:32]


def _cut(lines: list[str], start: int, end: int) -> str:
    return "\n".join(lines[start - 1 : end])


def generic(text: str) -> list[Block]:
    """Runs of lines that aren't blank; each line keeps its newline."""
    out, run, start = [], [], 1
    lines = text.split("\n")
    if lines and lines[-1] == "":
        lines.pop()
    for i, line in enumerate(lines, 1):
        line = line.removesuffix("\r")
        if line.strip():
            run.append(line)
            continue
        if run:
            out.append(Block("block", "", "\n".join(run) + "\n", start, i - 1))
            run = []
            start = i + 1
    if run:
        out.append(Block("block", "", "\n".join(run) + "\n", start, len(lines)))
    return out


#: The starts of blocks by language.
PY_DEF, PY_CLASS, PY_IMPORT = r"^(\s*)def\s+(\w+)\s*\(", r"^(\s*)class\s+(\w+)", r"^(from\s+\S+\s+)?import\s+"
JS_FUNCTION, JS_ARROW, JS_CLASS, JS_IMPORT = r"^(\s*)(async\s+)?function\s+(\w+)", r"^(\s*)(const|let|var)\s+(\w+)\s*=\s*(async\s+)?\(", r"^(\s*)(export\s+)?(default\s+)?class\s+(\w+)", r"^import\s+"
BASH_NAME, BASH_WORD = r"^(\w+)\s*\(\)\s*\{?", r"^function\s+(\w+)"
SQL_STARTS = (("create", r"(?i)^CREATE\s+(TABLE|VIEW|INDEX|FUNCTION|PROCEDURE|TRIGGER)"), ("select", r"(?i)^SELECT\s+"), ("insert", r"(?i)^INSERT\s+"), ("update", r"(?i)^UPDATE\s+"), ("delete", r"(?i)^DELETE\s+"))
MD_HEADING, MD_FENCE, MD_FENCE_END = r"^(#{1,6})\s+(.+)$", r"^```(\w*)", r"^```$"


def python(text: str) -> list[Block]:
    """A def or class opens a block, which the next one or a line indented no deeper closes; imports are blocks of one line and
    close nothing."""
    lines, out = text.split("\n"), []
    opened: Block | None = None

    def close(end: int) -> None:
        nonlocal opened
        if opened is not None:
            opened.end = end
            opened.content = _cut(lines, opened.start, end)
            out.append(opened)
            opened = None

    for i, line in enumerate(lines, 1):
        bare = line.rstrip()
        depth = len(line) - len(line.lstrip(" \t"))
        for kind, pattern in (("function", PY_DEF), ("class", PY_CLASS)):
            if m := re.match(pattern, line):
                close(i - 1)
                opened = Block(kind, m[2], "", i, i, depth)
                break
        else:
            if re.match(PY_IMPORT, bare):
                out.append(Block("import", "", bare, i, i))
            elif opened is not None and bare and depth <= opened.level:
                close(i - 1)
    close(len(lines))
    return out


def _braced(text: str, starts: Callable[[str], tuple[str, str] | None], single: Callable[[str], str | None], skip: Callable[[str], bool] = lambda s: False) -> list[Block]:
    """Blocks that end where their braces do. A block that is still open when another one starts is dropped."""
    lines, out = text.split("\n"), []
    opened, depth = None, 0
    for i, line in enumerate(lines, 1):
        kind = single(line)
        if kind:
            out.append(Block(kind, "", line.strip(), i, i))
            continue
        if skip(line):
            continue
        begun = starts(line)
        if begun:
            opened, depth = Block(*begun, "", i, i), 0
        if opened is not None:
            depth += line.count("{") - line.count("}")
            if depth <= 0 and "}" in line:
                opened.end, opened.content = i, _cut(lines, opened.start, i)
                out.append(opened)
                opened, depth = None, 0
    return out


def javascript(text: str) -> list[Block]:
    def starts(line: str) -> tuple[str, str] | None:
        for kind, pattern, group in (("function", JS_FUNCTION, 3), ("function", JS_ARROW, 3), ("class", JS_CLASS, 4)):
            if m := re.match(pattern, line):
                return kind, m[group]
        return None

    return _braced(text, starts, lambda line: "import" if re.match(JS_IMPORT, line) else None)


def bash(text: str) -> list[Block]:
    def starts(line: str) -> tuple[str, str] | None:
        m = re.match(BASH_NAME, line.strip()) or re.match(BASH_WORD, line.strip())
        return ("function", m[1]) if m else None

    return _braced(text, starts, lambda line: "shebang" if line.strip().startswith("#!/") else None, lambda line: line.strip().startswith("#"))


def _masked(text: str) -> str:
    """The text with comments, and what stands in literals, as blanks; line breaks and lengths stay."""
    blank = lambda m: re.sub(r"[^\n]", " ", m[0])
    return re.sub(r'//[^\n]*|/\*.*?\*/|`[^`]*`|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'', blank, text, flags=re.S)


def _ended(code: str, at: int) -> int:
    """Where the declaration that starts here ends: at the line end (or a semicolon or closing bracket) outside all brackets."""
    depth = 0
    while at < len(code):
        c = code[at]
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
            if depth < 0:
                return at
        elif c in "\n;" and not depth:
            return at
        at += 1
    return at


def golang(text: str) -> list[Block]:
    """Imports in order, then functions and types (grouped ones and those inside functions too) by where they start. Scanned by
    brackets over the text without comments and literals, as there is no syntax tree of this language here; a text without a
    package clause or with brackets that don't match goes by blank lines.

    Blocks are whole lines. Methods are called (T).name, or (*T).name for a pointer receiver; imports by their quoted path."""
    code, lines = _masked(text), text.split("\n")
    if not re.match(r"\s*package\s+\w", code) or any(code.count(a) != code.count(b) for a, b in ("()", "[]", "{}")):
        raise ValueError("no source of this language")

    def block(kind: str, name: str, start: int, end: int) -> Block:
        a, b = text.count("\n", 0, start) + 1, text.count("\n", 0, max(start, end - 1)) + 1
        return Block(kind, name, _cut(lines, a, b), a, b)

    imports, found = [], []
    for m in re.finditer(r"^import\b", code, re.M):
        end = _ended(code, m.end())
        imports += [block("import", p[0], m.end() + p.start(), m.end() + p.end()) for p in re.finditer(r'"[^"\n]*"|`[^`]*`', text[m.end() : end])]
    for m in re.finditer(r"^func[ \t]*(?:\(([^()]*)\)[ \t]*)?(\w+)", code, re.M):
        receiver = re.search(r"(\*?)\s*(\w+)\s*$", m[1]) if m[1] else None
        name = m[2] if m[1] is None else f"({receiver[1] + receiver[2] if receiver else ''}).{m[2]}"
        found.append((m.start(), block("function", name, m.start(), _ended(code, m.start()))))

    def spec(at: int, end: int) -> None:
        if m := re.compile(r"[ \t]*(\w+)(?:\[[^\]\n]*[ \t][^\]\n]*\])?[ \t]*=?[ \t]*(struct|interface)?\b").match(code, at):
            found.append((m.start(1), block(m[2] or "type", m[1], m.start(1), end)))

    for m in re.finditer(r"^[ \t]*type\b[ \t]*(\()?", code, re.M):
        if not m[1]:
            spec(m.end(), _ended(code, m.end()))
            continue
        depth_end = m.end()
        while True:
            n = re.compile(r"[\s;]*").match(code, depth_end)
            at = n.end()
            if at >= len(code) or code[at] == ")":
                break
            depth_end = _ended(code, at)
            spec(at, depth_end)
    return imports + [b for _, b in sorted(found, key=lambda x: x[0])]


def sql(text: str) -> list[Block]:
    """Statements from a keyword to a line that ends in a semicolon."""
    lines, out = text.split("\n"), []
    start, kind = 0, ""
    for i, line in enumerate(lines, 1):
        bare = line.strip()
        if bare.startswith(("--", "/*")):
            continue
        if not start:
            kind = next((k for k, p in SQL_STARTS if re.match(p, bare)), "")
            start = i if kind else 0
        if start and bare.endswith(";"):
            out.append(Block(kind, "", _cut(lines, start, i), start, i))
            start = 0
    if start:
        out.append(Block(kind, "", _cut(lines, start, len(lines)), start, len(lines)))
    return out


def html(text: str) -> list[Block]:
    """Script, style and template blocks by line; the opening line isn't looked at for its end. No block: the whole document."""
    lines, out = text.split("\n"), []
    start, kind = 0, ""
    for i, line in enumerate(lines, 1):
        if start:
            if f"</{kind}>" in line.lower():
                out.append(Block(kind, "", _cut(lines, start, i), start, i))
                start = 0
            continue
        for k in ("script", "style", "template"):
            if re.search(rf"(?i)<{k}[^>]*>", line):
                start, kind = i, k
                break
    return out or [Block("document", "", text, 1, len(lines))]


def markdown(text: str) -> list[Block]:
    """Sections by heading; fenced code also as blocks of its own; text before the first heading is left out."""
    lines, out = text.split("\n"), []
    section: Block | None = None
    fence, language = 0, ""
    for i, line in enumerate(lines, 1):
        if fence:
            if re.match(MD_FENCE_END, line):
                out.append(Block("code_block", language, _cut(lines, fence, i), fence, i))
                fence = 0
            continue
        if m := re.match(MD_FENCE, line):
            fence, language = i, m[1]
            continue
        if m := re.match(MD_HEADING, line):
            if section is not None:
                section.end, section.content = i - 1, _cut(lines, section.start, i - 1)
                out.append(section)
            section = Block("section", m[2], "", i, i, len(m[1]))
    if fence:
        out.append(Block("code_block", language, _cut(lines, fence, len(lines)), fence, len(lines)))
    if section is not None:
        section.end, section.content = len(lines), _cut(lines, section.start, len(lines))
        out.append(section)
    return out


def pdf_text(text: str) -> list[Block]:
    """Text of a PDF: trimmed lines joined by blanks; a blank line or a page marker ends a block, the marker's line is dropped."""
    out, run, page, start = [], [], 1, 0
    lines = text.split("\n")

    def close(end: int) -> None:
        if run:
            out.append(Block("text", "", " ".join(run), start, end, 0, page))
            run.clear()

    for i, line in enumerate(lines):
        bare = line.strip()
        if line == "\f" or re.match(r"(?i)^(page\s+\d+|\f)", bare):
            close(i)
            page, start = page + 1, i + 1
        elif not bare:
            if run:
                close(i)
                start = i + 1
        else:
            run.append(bare)
    close(len(lines))
    return out


PARSERS: dict[str, Callable[[str], list[Block]]] = {"go": golang, "python": python, "javascript": javascript, "typescript": javascript, "bash": bash, "sql": sql, "html": html, "markdown": markdown, "pdf": pdf_text, "generic": generic, "text": generic}


def parse(text: str, language: str | None) -> Iterator[tuple]:
    """(id, segment_type, content, page, position, name, kind, level, line_start, line_end) of a text; position is the number of
    the block. Unknown languages, and sources that their parser can't read, go by blank lines."""
    language = language or "generic"
    try:
        found = PARSERS.get(language, generic)(text)
    except ValueError:
        found = generic(text)
    for i, b in enumerate(found):
        kind = "text" if language in ("pdf", "text") else "code"
        hashed = b.content + " " if language == "pdf" else b.content
        yield block_id(hashed), kind, b.content, b.page, i, b.name, b.kind, b.level, b.start, b.end

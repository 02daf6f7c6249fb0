"""Features of chunks as SQL text, in Spark's dialect and in that of the oracle."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Dialect:
    newline: str
    div: str
    #: Backslashes in string literals have to be doubled.
    doubled: bool = False


SPARK = Dialect("char(10)", "div", True)
DUCKDB = Dialect("chr(10)", "//")


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def removed(s: str, of: str = "content") -> str:
    """Characters that go when s is removed; s is SQL text."""
    return f"(length({of}) - length(replace({of}, {s}, '')))"


def has(*any_of: str, of: str = "content") -> str:
    return "cast((" + " OR ".join(f"instr({of}, {lit(s)}) > 0" for s in any_of) + ") as bigint)"


def has_all(*all_of: str) -> str:
    return "cast((" + " AND ".join(f"instr(content, {lit(s)}) > 0" for s in all_of) + ") as bigint)"


def share(part: str, times: str = "", whole: str = "length(content)") -> str:
    return f"cast({part} as double) / nullif({whole}, 0){times}"


def starts(*prefixes: str) -> str:
    return "cast((" + " OR ".join(f"upper(content) LIKE {lit(p + '%')}" for p in prefixes) + ") as bigint)"


def _marks() -> str:
    inner = "content"
    for m in ("**", "__", "``"):
        inner = f"replace({inner}, '{m}', '')"
    return f"(length(content) - length({inner}))"


def features(kind: str, d: Dialect = SPARK) -> dict[str, str]:
    """Name to expression over content (docx also level, section_path); counts are bigint, shares double.

    Fixed values: the formulas, thresholds and marker strings are the contract of the workflows, traps included (a marker of
    several characters counts once for each character; digit_ratio is the share of what isn't a digit)."""
    tokens = f"length(content) {d.div} 4"
    lines = f"{removed(d.newline)} + 1"
    words = f"({removed(lit(' '))} + 1)"
    word_length = share("length(replace(content, ' ', ''))", whole=words)
    no_digits = "content"
    for digit in "0123456789":
        no_digits = f"replace({no_digits}, '{digit}', '')"
    upper = "upper(content)"
    levels = " ".join(f"WHEN content LIKE '{'#' * n} %' THEN {n}" for n in range(6, 0, -1))
    table = {
        "pdf": {"token_count": tokens, "char_count": "length(content)", "line_count": lines, "word_count": words, "avg_word_length": word_length, "uppercase_ratio": share("(length(content) - length(lower(content)))"), "digit_ratio": share(f"length({no_digits})")},
        "docx": {"token_count": tokens, "heading_depth": "level", "section_length": removed(lit("/"), "section_path"), "list_density": has("- ", "* "), "has_code": has("```"), "formatting_density": share(_marks())},
        "go": {"line_count": lines, "has_func": has("func "), "has_struct": has_all("type ", " struct"), "has_interface": has("interface {"), "has_error_handling": has("err != nil", "error"), "has_goroutine": has("go func", "go "), "has_channel": has("chan ", "<-"), "complexity": " + ".join(removed(lit(s)) for s in ("if ", "for ", "switch "))},
        "python": {"line_count": lines, "has_class": has("class "), "has_def": has("def "), "has_async": has("async ", "await "), "has_decorator": has("@"), "has_type_hints": has_all(": ", " ->"), "has_exception": has("try:", "except"), "indentation_level": f"(length(content) - length(ltrim(content))) {d.div} 4"},
        "javascript": {"line_count": lines, "has_function": has("function "), "has_arrow": has("=>"), "has_class": has("class "), "has_async": has("async ", "await "), "has_import": has("import "), "has_export": has("export "), "has_react": has("React", "useState", "<"), "has_promise": has("Promise", ".then(")},
        "typescript": {"line_count": lines, "has_interface": has("interface "), "has_type": has("type "), "has_generic": has("<T>", "<T,"), "has_decorator": has("@"), "has_enum": has("enum "), "has_namespace": has("namespace "), "type_annotation_density": share(removed(lit(": ")), " * 100")},
        "bash": {"line_count": lines, "has_function": has("() {", "function "), "has_pipe": has(" | "), "has_redirect": has(" > ", " >> ", " < "), "has_variable": has("$"), "has_loop": has("for ", "while "), "has_conditional": has("if ", "[[ "), "has_subshell": has("$(", "`")},
        "sql": {"line_count": lines, "is_select": starts("SELECT"), "is_insert": starts("INSERT"), "is_update": starts("UPDATE"), "is_create": starts("CREATE"), "has_join": has(" JOIN ", of=upper), "has_subquery": has("(SELECT "), "has_cte": has("WITH ", of=upper), "table_count": f"{removed(lit(' FROM '), upper)} + {removed(lit(' JOIN '), upper)}"},
        "html": {"line_count": lines, "has_script": has("<script", of="lower(content)"), "has_style": has("<style", of="lower(content)"), "has_form": has("<form", of="lower(content)"), "has_htmx": has("hx-"), "has_alpine": has("x-", "@click"), "has_template": has("<template", of="lower(content)"), "tag_density": share(removed(lit("<")), " * 100")},
        "markdown": {"line_count": lines, "heading_level": f"CASE {levels} ELSE 0 END", "has_code_block": has("```"), "has_link": has("]("), "has_image": has("!["), "has_list": f"cast((instr(content, {d.newline} || '- ') > 0 OR instr(content, {d.newline} || '* ') > 0) as bigint)", "has_table": has_all("|", "---"), "formatting_density": share(_marks(), " * 100")},
        "text": {"token_count": tokens, "line_count": lines, "word_count": words, "avg_word_length": word_length},
    }
    doubles = ("ratio", "density", "avg_")
    return {n: f"cast({e} as {'double' if any(x in n for x in doubles) and n != 'list_density' else 'bigint'})" for n, e in table[kind].items()}


KINDS = ("pdf", "docx", "go", "python", "javascript", "typescript", "bash", "sql", "html", "markdown", "text")
#: Blocks shorter than this, in characters, are dropped.
MIN_LENGTH = {"pdf": 10, "docx": 5, "go": 20, "python": 15, "javascript": 15, "typescript": 15, "bash": 10, "sql": 10, "html": 20, "markdown": 20, "text": 10}

#: Structure features and the scales they are divided by.
STRUCTURE = {"token_count": 1000.0, "char_count": 5000.0, "line_count": 100.0, "word_count": 500.0, "avg_word_length": 10.0, "uppercase_ratio": 1.0, "digit_ratio": 1.0, "punctuation_ratio": 1.0, "has_code": 1.0, "has_list": 1.0, "has_heading": 1.0}


def structure(d: Dialect = SPARK) -> dict[str, str]:
    """The structure features of a text (content), by Unicode classes."""
    slash = "\\\\" if d.doubled else "\\"

    def gone(pattern: str, of: str = "content") -> str:
        flag = "" if d.doubled else ", 'g'"
        return f"length(regexp_replace({of}, '{pattern}', ''{flag}))"

    def kind(c: str) -> str:
        if d.doubled:  # counted without making a text
            return f"cast(regexp_count(content, '{slash}p{{{c}}}') as double) / greatest(length(content), 1)"
        return f"cast(length(content) - {gone(slash + 'p{' + c + '}')} as double) / greatest(length(content), 1)"

    trimmed = f"regexp_replace(content, '^{slash}s+', '')"
    fields = f"length(regexp_replace(regexp_replace(content, '{slash}S+', 'x'{'' if d.doubled else ', ' + lit('g')}), '{slash}s+', ''{'' if d.doubled else ', ' + lit('g')}))"
    size = "octet_length" if d.doubled else "strlen"
    letters = f"{size}(regexp_replace(content, '{slash}s+', ''{'' if d.doubled else ', ' + lit('g')}))"
    if d.doubled:
        fields, letters = f"regexp_count(content, '{slash}S+')", f"(octet_length(content) - regexp_count(content, '{slash}s'))"
    out = {
        "token_count": f"length(content) {d.div} 4",
        "char_count": "length(content)",
        "line_count": f"{removed(d.newline)} + 1",
        "word_count": fields,
        "avg_word_length": f"coalesce(cast({letters} as double) / nullif({fields}, 0), 0)",
        "uppercase_ratio": kind("Lu"),
        "digit_ratio": kind("Nd"),
        "punctuation_ratio": kind("P"),
        "has_code": has("func ", "def ", "class ", "```"),
        "has_list": has("- ", "* "),
        "has_heading": f"cast(({trimmed} LIKE '#%') as bigint)",
    }
    return {n: f"cast({e} as {'double' if 'ratio' in n or 'avg' in n else 'bigint'})" for n, e in out.items()}

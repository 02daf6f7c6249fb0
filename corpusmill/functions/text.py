"""Tokens, n-grams, hashes, MIME types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions.vectors import bind

TOKEN = r"[\p{L}\p{N}]+"
FNV_BASIS, FNV_PRIME = 2166136261, 16777619
#: Common English words that carry no meaning in a query.
STOPWORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with")

#: Extensions and their MIME types.
MIME = {
    ".pdf": "application/pdf", ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", ".doc": "application/msword",
    ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", ".xls": "application/vnd.ms-excel", ".txt": "text/plain",
    ".html": "text/html", ".htm": "text/html", ".css": "text/css", ".csv": "text/csv", ".xml": "text/xml", ".png": "image/png", ".jpg": "image/jpeg",
    ".sh": "application/x-sh", ".md": "text/markdown", ".go": "text/x-go", ".py": "text/x-python", ".js": "text/javascript", ".ts": "text/typescript",
    ".rs": "text/x-rust", ".sql": "text/x-sql", ".yaml": "text/yaml", ".yml": "text/yaml", ".json": "application/json", ".toml": "text/toml",
}
#: Which workflow a MIME type goes to.
ROUTES = {
    MIME[".pdf"]: "pdf_chunking_v1", MIME[".docx"]: "docx_chunking_v1", MIME[".doc"]: "docx_chunking_v1", "text/plain": "text_chunking_v1", "text/markdown": "markdown_chunking_v1",
    MIME[".xlsx"]: "xlsx_chunking_v1", MIME[".xls"]: "xlsx_chunking_v1", "text/x-go": "go_chunking_v1", "text/x-python": "python_chunking_v1", "text/javascript": "javascript_chunking_v1",
    "application/javascript": "javascript_chunking_v1", "text/typescript": "typescript_chunking_v1", "text/x-sh": "bash_chunking_v1", "application/x-sh": "bash_chunking_v1",
    "text/x-sql": "sql_chunking_v1", "text/html": "html_chunking_v1",
}


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def ngrams(toks: Column, n: int, sep: str = "_") -> Column:
    """Runs of n tokens; none if there are fewer."""
    if n == 1:
        return toks
    return bind(toks, lambda t: F.when(F.size(t) < n, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(F.size(t) - n, F.lit(0))), lambda i: F.array_join(F.slice(t, i + 1, F.lit(n)), sep))))


def fnv(text: Column, first_xor: bool = True) -> Column:
    """FNV-1a (first_xor) or FNV-1, 32 bits, of the UTF-8 bytes, as bigint."""
    def octets(code: Column) -> Column:
        n = (F.length(code) / 2).cast("int")
        return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.conv(F.substring(code, i * 2 - 1, F.lit(2)), 16, 10).cast("bigint")))

    def step(h: Column, b: Column) -> Column:
        if first_xor:
            return (h.bitwiseXOR(b) * FNV_PRIME).bitwiseAND(F.lit(0xFFFFFFFF))
        return (h * FNV_PRIME).bitwiseAND(F.lit(0xFFFFFFFF)).bitwiseXOR(b)

    return F.aggregate(bind(F.hex(F.encode(text, "UTF-8")), octets), F.lit(FNV_BASIS).cast("bigint"), step)


def fnv_python(text: str, first_xor: bool = True) -> int:
    h = FNV_BASIS
    for b in text.encode():
        h = ((h ^ b) * FNV_PRIME) & 0xFFFFFFFF if first_xor else ((h * FNV_PRIME) & 0xFFFFFFFF) ^ b
    return h


def bucket(term: Column, dims: int) -> Column:
    return fnv(term) % dims


def sign(term: Column) -> Column:
    """1 if the FNV-1 hash is even, else -1."""
    return F.when(fnv(term, first_xor=False) % 2 == 0, 1.0).otherwise(-1.0)


def stem(word: Column) -> Column:
    """A small suffix stemmer for query expansion."""
    return F.when(F.length(word) > 5, F.regexp_replace(word, "(ing|edly|ed|ies|es|s|ly)$", "")).when(F.length(word) > 3, F.regexp_replace(word, "s$", "")).otherwise(word)


def _listed(words: tuple[str, ...]) -> str:
    return "array(" + ", ".join(f"'{w}'" for w in words) + ")"


#: SQL around the argument of tokenize(text): its words in lower case, each once, without stop words unless all are.
TOKENIZE_SQL = (
    "get(transform(array(array_distinct(regexp_extract_all(lower(",
    f"), '[\\\\p{{L}}\\\\p{{N}}]+', 0))), ws -> if(size(array_except(ws, {_listed(STOPWORDS)})) > 0, array_except(ws, {_listed(STOPWORDS)}), ws)), 0)",
)
#: SQL around the argument of expand_tokens(words): each word with its stem, as stem() has it.
EXPAND_SQL = ("transform(", ", w -> array_distinct(array(w, case when length(w) > 5 then regexp_replace(w, '(ing|edly|ed|ies|es|s|ly)$', '') when length(w) > 3 then regexp_replace(w, 's$', '') else w end)))")


def mime_type(path: Column, head: Column | None = None) -> Column:
    """By extension, else by the first bytes (a hex string, two characters a byte), else application/octet-stream."""
    ext = F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))
    known = F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv])
    out = F.try_element_at(known, ext)
    if head is not None:
        out = F.coalesce(out, F.when(F.upper(head).startswith("25504446"), MIME[".pdf"]).when(F.upper(head).startswith("504B"), "application/zip"))
    return F.coalesce(out, F.lit("application/octet-stream"))


def route(mime: Column, mapping: dict[str, str | None] | None = None) -> Column:
    known = {k: v for k, v in (ROUTES | (mapping or {})).items() if v is not None}
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), mime)

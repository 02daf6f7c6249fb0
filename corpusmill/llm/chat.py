"""Chat formatting by schema fingerprints (operator 7, native).

A record's nested field paths, those of all elements of its lists together, are taken row by row. Paths that some mapping knows
are hashed; the hash selects a declarative mapping, an SQL expression that turns this layout into canonical turns,
array<struct<role, text>>. A template then marks turns, with control strings inside roles and texts
escaped so that the text can be read back exactly.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain, combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.common import table

TURNS = "array<struct<role:string,text:string>>"
#: Control strings of the template and of its relatives; escaped in texts.
CONTROLS = ("<|", "<s>", "</s>", "[INST]", "[/INST]")
OPEN, MIDDLE, CLOSE = "<|turn|>", "<|text|>", "<|end|>"


def fingerprint(names: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(names)).encode()).hexdigest()[:16]


def _pair(user: str, assistant: str) -> str:
    first = "if(r.system is null, array(), array(named_struct('role', 'system', 'text', r.system)))"
    return f"concat({first}, array(named_struct('role', 'user', 'text', {user})), array(named_struct('role', 'assistant', 'text', {assistant})))"


def _listed(name: str, role: str, text: str, items: str = "") -> str:
    first = "if(r.system is null, array(), array(named_struct('role', 'system', 'text', r.system)))"
    return f"concat({first}, transform({items or 'r.' + name}, m -> named_struct('role', {role}, 'text', m.{text})))"


_FROM = "case m.from when 'human' then 'user' when 'gpt' then 'assistant' else m.from end"
#: Layouts: field paths that they need, those they may have, and the expression over record r that gives turns. [] stands for
#: the elements of a list, [0] for an empty list.
LAYOUTS: list[tuple[list[str], list[str], str]] = [
    (["messages[].role"], ["messages[].content", "system"], _listed("messages", "m.role", "content")),
    (["messages[].turn", "messages[].role", "messages[].text"], ["system"], _listed("messages", "m.role", "text", "array_sort(r.messages)")),
    (["messages[].role", "messages[].text"], ["system"], _listed("messages", "m.role", "text")),
    (["conversations[].from"], ["conversations[].value", "system"], _listed("conversations", _FROM, "value")),
    (["messages[0]"], ["system"], "if(r.system is null, array(), array(named_struct('role', 'system', 'text', r.system)))"),
    (["conversations[0]"], ["system"], "if(r.system is null, array(), array(named_struct('role', 'system', 'text', r.system)))"),
    (["prompt", "completion"], ["system"], _pair("r.prompt", "r.completion")),
    (["prompt", "response"], ["system"], _pair("r.prompt", "r.response")),
    (["instruction", "output"], ["input", "system"], _pair("if(coalesce(r.input, '') = '', r.instruction, concat_ws('\\n\\n', r.instruction, r.input))", "r.output")),
    (["question", "answer"], ["system"], _pair("r.question", "r.answer")),
]
#: Records may also lie whole in a field of this name.
WRAPPERS = ("", "data")
#: Fields of the records that expressions see; a record has null for what it lacks.
TEXTS = ("system", "prompt", "completion", "response", "instruction", "input", "output", "question", "answer")
LISTS = {"messages": ("turn", "role", "text", "content"), "conversations": ("from", "value")}
_KINDS = {x: "BIGINT" if x == "turn" else "STRING" for x in (*TEXTS, *LISTS["messages"], *LISTS["conversations"])}
SHAPE = ", ".join([*(f"`{x}`: STRING" for x in TEXTS), *(f"`{h}`: ARRAY<STRUCT<{', '.join(f'`{x}`: {_KINDS[x]}' for x in xs)}>>" for h, xs in LISTS.items())])


def _mappings() -> dict[str, tuple[str, str]]:
    """Fingerprint to expression and wrapper, for each layout with any of the fields that it may have."""
    out: dict[str, tuple[str, str]] = {}
    for w in WRAPPERS:
        for need, may, sql in LAYOUTS:
            for some in chain.from_iterable(combinations(may, n) for n in range(len(may) + 1)):
                out.setdefault(fingerprint([f"{w}.{p}".lstrip(".") for p in (*need, *some)]), (sql, w))
    return out


MAPPINGS = _mappings()
KNOWN = sorted({f"{w}.{p}".lstrip(".") for w in WRAPPERS for need, may, _ in LAYOUTS for p in (*need, *may)})


def chosen(found: Column) -> Column:
    """Fingerprint of an array of paths: the hash of those that some mapping knows."""
    known = F.array_sort(F.array_distinct(F.filter(found, lambda p: F.array_contains(F.array(*map(F.lit, KNOWN)), p))))
    return F.substring(F.sha2(F.array_join(known, "\n"), 256), 1, 16)


def struct_paths(kind: T.DataType, value: str, at: str = "", deep: int = 0) -> list[tuple[str, str]]:
    """Nested field paths of a type, and for each the SQL condition that a value has it: something under the path isn't null."""
    if isinstance(kind, T.StructType):
        return [x for f in kind.fields for x in struct_paths(f.dataType, f"{value}.`{f.name.replace('`', '``')}`", f"{at}.{f.name}" if at else f.name, deep)]
    if isinstance(kind, (T.ArrayType, T.MapType)):
        items, mark, inner = (value, "[]", kind.elementType) if isinstance(kind, T.ArrayType) else (f"map_values({value})", "{}", kind.valueType)
        own = [(at + mark.replace("[]", "[0]"), f"coalesce(size({items}) = 0, false)")]
        return own + [(p, f"coalesce(exists({items}, x{deep} -> {c}), false)") for p, c in struct_paths(inner, f"x{deep}", at + mark, deep + 1)]
    return [(at, f"{value} is not null")]


_TOKENS = r"(?:`(?:[^`]|``)*+`|[A-Za-z0-9_]+): |OBJECT<|ARRAY<|>|, |[A-Z_]+(?:\([0-9]+,[0-9]+\))?"
_POP = "slice({0}, 1, size({0}) - 1)"
_LAST = "element_at(s.open, -1)"
_UP = _POP.format("s.open")


def _after(stack: str) -> str:
    """What is open once a value has ended: a key ends with it."""
    return f"if(left(element_at({stack}, -1), 1) = 'k', {_POP.format(stack)}, {stack})"


#: Over the schema of _json, as text, from left to right: what is open (root, key, list or object, with its path), and paths.
_JSON_PATHS = f"""aggregate(regexp_extract_all(schema_of_variant(_json), '{_TOKENS.replace(chr(92), chr(92) * 2)}', 0), named_struct('open', array('r'), 'out', cast(array() as array<string>)), (s, t) -> case
    when endswith(t, ': ') then named_struct('open', concat(s.open, array('k' || concat_ws('.', nullif(substr({_LAST}, 2), ''), left(t, length(t) - 2)))), 'out', s.out)
    when t = 'OBJECT<' then named_struct('open', concat(s.open, array('o' || substr({_LAST}, 2))), 'out', s.out)
    when t = 'ARRAY<' then named_struct('open', concat(s.open, array('a' || substr({_LAST}, 2) || '[]')), 'out', s.out)
    when t = '>' then named_struct('open', {_after(_UP)}, 'out', s.out)
    when t = ', ' then s
    else named_struct('open', {_after("s.open")}, 'out', concat(s.out, array(if(t = 'VOID' and left({_LAST}, 1) = 'a', substr({_LAST}, 2, length({_LAST}) - 3) || '[0]', substr({_LAST}, 2)))))
    end, s -> s.out)"""


def json_paths(record: str) -> Column:
    """Nested field paths of a column of JSON texts, row by row, over all elements of every list; odd names in backticks.
    Null and malformed texts: null."""
    json = f"try_parse_json(`{record}`)"
    return F.expr(_JSON_PATHS.replace("_json", json))


def _record(kind: T.DataType, value: str) -> str:
    """SQL for the record of SHAPE that a struct holds; what the struct lacks, or has as something else, is null."""
    have = {f.name: f.dataType for f in kind.fields} if isinstance(kind, T.StructType) else {}

    def scalar(x: str, of: dict, at: str) -> str:
        plain = x in of and not isinstance(of[x], (T.StructType, T.ArrayType, T.MapType))
        return f"'{x}', " + (f"try_cast({at}.`{x}` as {_KINDS[x]})" if plain else f"cast(null as {_KINDS[x]})")

    parts = [scalar(x, have, value) for x in TEXTS]
    for h, xs in LISTS.items():
        item = have[h].elementType if h in have and isinstance(have[h], T.ArrayType) else None
        inner = {f.name: f.dataType for f in item.fields} if isinstance(item, T.StructType) else {}
        own = f"named_struct({', '.join(scalar(x, inner, 'e') for x in xs)})"
        shape = ", ".join(f"`{x}`: {_KINDS[x]}" for x in xs)
        parts.append(f"'{h}', " + (f"transform({value}.`{h}`, e -> {own})" if inner else f"cast(null as ARRAY<STRUCT<{shape}>>)"))
    return f"named_struct({', '.join(parts)})"


def _mapped(df: DataFrame, printed: str, records: dict[str, str], other: Column) -> Column:
    """Turns by fingerprint; records: SQL of the record of SHAPE of each wrapper."""
    turns = other
    for w in WRAPPERS:
        if w in records:
            for _, _, sql in LAYOUTS:
                prints = [k for k, m in MAPPINGS.items() if m == (sql, w)]
                if prints:
                    turns = F.when(F.col(printed).isin(prints), F.expr(re.sub(r"\br\.", lambda _: records[w] + ".", sql)).cast(TURNS)).otherwise(turns)
    return turns


def turns_of_struct(df: DataFrame, record: str) -> DataFrame:
    """Add turns for a struct column whose rows may follow different layouts, each leaving the fields of the others null.

    Fields that no mapping knows are ignored. Null records and unknown layouts: null turns. A type without any known field:
    ValueError. A column named turns is replaced."""
    kind = df.schema[record].dataType
    found = sorted((p, c) for p, c in struct_paths(kind, f"`{record}`") if p in KNOWN)
    if not found:
        raise ValueError(f"no mapping for the layout {sorted(p for p, _ in struct_paths(kind, record))}")
    present = F.array_compact(F.array(*[F.expr(f"if({c}, '{p}', null)") for p, c in found]))
    shapes = {"": (kind, f"`{record}`")} | {f.name: (f.dataType, f"`{record}`.`{f.name}`") for f in kind.fields if f.name in WRAPPERS}
    read = df.withColumn("_print", chosen(present)).select("*", *[F.expr(_record(k, v)).alias(f"_record_{w}") for w, (k, v) in shapes.items()])
    read = read.withColumn("turns", _mapped(read, "_print", {w: f"`_record_{w}`" for w in shapes}, F.lit(None).cast(TURNS)))
    return read.drop("_print", *[f"_record_{w}" for w in shapes])


def turns_of_json(df: DataFrame, record: str, unknown: str = "null") -> DataFrame:
    """Add turns for a column of JSON records of mixed layouts. Unknown layouts: null turns, or with unknown="error" an error
    that names their paths.

    Neither the order of fields nor fields that no mapping knows matter. An empty list: no turns. Null or malformed records:
    null turns. A text field that holds something else: its JSON. A column named turns is replaced."""
    keyed = df.withColumn("_paths", json_paths(record))
    keyed = keyed.withColumn("_print", F.when(F.col("_paths").isNotNull(), chosen(F.col("_paths"))))
    read = keyed.select("*", F.expr(f"from_json(cast(`{record}` as string), 'STRUCT<{SHAPE}, `data`: STRUCT<{SHAPE}>>')").alias("_record"))
    other = F.lit(None).cast(TURNS)
    if unknown == "error":
        other = F.when(F.col("_paths").isNotNull(), F.raise_error(F.concat(F.lit("no mapping for the layout "), F.array_join("_paths", ", "))).cast(TURNS))
    return read.withColumn("turns", _mapped(read, "_print", {"": "_record", "data": "_record.data"}, other)).drop("_paths", "_print", "_record")


def escape(c: Column) -> Column:
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for s in CONTROLS:
        c = F.replace(c, F.lit(s), F.lit(s[0] + "\\" + s[1:]))
    return c


def unescape(c: Column) -> Column:
    for s in CONTROLS:
        c = F.replace(c, F.lit(s[0] + "\\" + s[1:]), F.lit(s))
    return F.replace(c, F.lit("\\\\"), F.lit("\\"))


def render(turns: Column) -> Column:
    """Turns as one text. Null turns: null; null role or text: empty."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), escape(F.coalesce(t["role"], F.lit(""))), F.lit(MIDDLE), escape(F.coalesce(t["text"], F.lit(""))), F.lit(CLOSE))), "\n")


def read_back(formatted: Column) -> Column:
    """Turns from what render() made, exactly."""
    parts = F.filter(F.split(formatted, r"<\|end\|>\n?", -1), lambda p: p != "")

    def turn(p: Column) -> Column:
        return F.struct(unescape(F.substring_index(F.substring(p, len(OPEN) + 1, 2147483647), MIDDLE, 1)).alias("role"), unescape(F.substring_index(p, MIDDLE, -1)).alias("text"))

    return F.transform(parts, turn).cast(TURNS)


def format_chats(df: DataFrame, turns: str = "turns") -> DataFrame:
    """Add formatted (the text) and loss_spans (start, end of each assistant text as it stands escaped, code points)."""
    out = df.withColumn("formatted", render(F.col(turns)))
    lens = F.transform(F.col(turns), lambda t: F.struct(F.length(escape(F.coalesce(t["role"], F.lit("")))).alias("r"), F.length(escape(F.coalesce(t["text"], F.lit("")))).alias("t"), F.coalesce(t["role"] == "assistant", F.lit(False)).alias("loss")))
    marks = len(OPEN) + len(MIDDLE)
    zero = F.struct(F.lit(0).cast("long").alias("p"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("o"))

    def step(s: Column, x: Column) -> Column:
        at = s["p"] + x["r"] + marks
        own = F.when(x["loss"], F.array(F.struct(at.alias("start"), (at + x["t"]).alias("end")))).otherwise(F.array().cast("array<struct<start:bigint,end:bigint>>"))
        return F.struct((at + x["t"] + len(CLOSE) + 1).cast("long").alias("p"), F.concat(s["o"], own).alias("o"))

    return out.withColumn("loss_spans", F.aggregate(lens, zero, step, lambda s: s["o"]))


def gather(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows of turns as one record per conversation, layout messages[].{turn, role, text}.

    A conversation is one output row, so its turns have to meet; turns are ordered by turn, role, text, so ties and repeated
    rows keep a fixed order and all stay. Null conversation ids form one conversation; null role or text: empty."""
    row = F.struct(F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return df.groupBy(F.col(conv).alias("conv_id")).agg(F.collect_list(row).alias("messages")).select("conv_id", F.struct("messages").alias("record"))


def layouts_of(df: DataFrame) -> DataFrame:
    """Gathered conversations as records of several layouts in one struct column, as a file of mixed records is read: two turns
    as prompt and completion, three with a system turn as a system, prompt and response, up to eight of users and assistants
    alone as conversations in order, the rest as numbered messages in any order."""
    turns, roles = F.array_sort("record.messages"), "_roles"
    read = df.withColumn("_turns", turns).withColumn(roles, F.transform("_turns", lambda t: t["role"]))

    def are(*names: str) -> Column:
        return F.col(roles) == F.array(*map(F.lit, names))

    two, three = are("user", "assistant"), are("system", "user", "assistant")
    few = ~two & ~three & (F.size(roles) <= 8) & F.forall(roles, lambda r: r.isin("user", "assistant"))
    text = [F.get("_turns", F.lit(i))["text"] for i in range(3)]
    listed = F.transform("_turns", lambda t: F.struct(F.when(t["role"] == "user", "human").otherwise("gpt").alias("from"), t["text"].alias("value")))
    record = F.struct(
        F.when(three, text[0]).alias("system"),
        F.when(two, text[0]).when(three, text[1]).alias("prompt"),
        F.when(two, text[1]).alias("completion"),
        F.when(three, text[2]).alias("response"),
        F.when(few, listed).alias("conversations"),
        F.when(~two & ~three & ~few, F.col("record.messages")).alias("messages"),
    )
    return read.select("conv_id", record.alias("record"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    chats = format_chats(turns_of_struct(layouts_of(gather(rows.unionByName(own))), "record")).select("conv_id", "formatted", "loss_spans")
    back = chats.withColumn("turns", read_back(F.col("formatted")))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
    back = back.withColumn("_loss", loss)
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


QUERIES = {"op7_chat_format": op7}
def _oracle() -> str:
    escaped = "replace({0}, '\\', '\\\\')"
    for c in CONTROLS:
        escaped = f"replace({escaped}, '{c}', '{c[0]}\\{c[1:]}')"
    size = " + ".join([*(f"length({escaped.format(c)})" for c in ("role", "text")), str(len(OPEN + MIDDLE + CLOSE))])
    said = "</s>[INST] ok [/INST]"
    return f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL VALUES (-7, 0, 'user', '{said}'), (-7, 1, 'assistant', '{said}'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
(sum({size}) + count(*) - 1)::BIGINT AS formatted_chars FROM t GROUP BY conv_id"""


ORACLES = {"op7_chat_format": _oracle()}

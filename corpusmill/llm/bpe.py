"""BPE encoding and decoding by dynamic programming over prefixes (operator 5).

For each prefix of a piece of text there is exactly one last token of its encoding. An automaton that knows every vocabulary
entry gives, at each position, the entries that are suffixes of the prefix, longest first; an entry is the last token if it
is compatible with the last token of the prefix before it, that is, if byte pair merging would leave a boundary between the
two. Following the stored tokens back from the end gives the ids. Pieces repeat, so their encodings are remembered within
a bound.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm.common import small_batches, table

#: Fixed value: how byte-level vocabularies split text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts of Latin-1 alone, with the classes written out, for the faster engine.
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
LATIN = f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
#: Letters and numbers of newer Unicode versions than that of the tokenizers library, which takes them for neither.
NEWER_L = (
    "0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DF1 16EA0-16EB8 16EBB-16ED3 16FF2-16FF3 187F8-187FF "
    "18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF "
    "2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)
NEWER_N = "11DE0-11DE9 1246F 12475-1247F 12550-12686 16FF4-16FF6"
#: Remembered pieces (of which the later half outlives a renewal) and verdicts on pairs, and the longest piece that is
#: remembered. A task forgets them at its end, as the process that ran it may be kept for other work.
REMEMBER, REMEMBER_PAIRS, LONGEST = 400_000, 200_000, 64


def _chars(ranges: str) -> str:
    return "".join("-".join(f"\\U{int(x, 16):08x}" for x in r.split("-")) for r in ranges.split())


def pinned(pattern: str) -> str:
    """The pattern with classes of letters and numbers as the library's Unicode version has them."""
    for name, newer in (("L", NEWER_L), ("N", NEWER_N)):
        pattern = pattern.replace(rf"[^\s\p{{L}}\p{{N}}]", rf"[^\s[\p{{L}}--[{_chars(NEWER_L)}]][\p{{N}}--[{_chars(NEWER_N)}]]]").replace(rf" ?\p{{{name}}}+", rf" ?[\p{{{name}}}--[{_chars(newer)}]]+")
    return pattern


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the rest from 256 up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], spare = chr(spare), spare + 1
    return out


class Codec:
    """Encoder and decoder of one byte-level BPE vocabulary in the tokenizers library's JSON format."""

    def __init__(self, spec: str):
        data = json.loads(spec)
        model = data["model"]
        if model["type"] != "BPE" or data.get("normalizer") or (data.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or data["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("a byte-level BPE vocabulary without normalizer or prefix space is needed")
        letters = byte_letters()
        byte_of = {c: i for i, c in enumerate(letters)}
        vocab: dict[str, int] = model["vocab"]
        self.table = "".join(letters)
        self.bytes_of = {i: bytes(byte_of[c] for c in t) for t, i in vocab.items() if all(c in byte_of for c in t)}
        self.added = {a["content"]: a["id"] for a in data.get("added_tokens", [])}
        self.bytes_of |= {i: t.encode() for t, i in self.added.items()}
        self.size = {i: len(b) for i, b in self.bytes_of.items()}
        #: Order of merging; single letters merge from nothing. A pair's order and what it makes.
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for order, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.pairs.setdefault((vocab[a], vocab[b]), (order, vocab[a + b]))
        #: How an entry was made last: order, left, right. Entries that merging never leaves whole aren't in it.
        self.made: dict[int, tuple[int, int, int]] = {}
        self.agree: dict[int, bool] = {}
        own = {vocab[c]: c for c in letters if c in vocab}
        for (a, b), (order, t) in self.pairs.items():  # in merge order: both halves are known before
            if t not in self.made and (a in own or a in self.made) and (b in own or b in self.made) and self.compatible(a, b, order):
                self.made[t] = (order, a, b)
        self.automaton = ahocorasick.Automaton()
        for t, i in vocab.items():
            if i in own or i in self.made:
                self.automaton.add_word(t, (len(t), i))
        self.automaton.make_automaton()
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.split_any, self.split_latin = regex.compile(pinned(PATTERN), regex.V1).findall, re.compile(LATIN).findall
        self.known = _Known(self)

    def compatible(self, left: int, right: int, before: int | None = None) -> bool:
        """Whether merging leaves a boundary between these two tokens, at least among merges of an order below `before`.

        The two are taken apart in reverse order of merging; at each stage, the pieces that meet at the boundary must not
        be a pair that merges before the stage that is undone next."""
        limit, made, pairs = 1 << 60 if before is None else before, self.made, self.pairs
        while True:
            hit = pairs.get((left, right))
            if hit is not None and hit[0] < limit:
                return False
            a, b = made.get(left), made.get(right)
            if a is None and b is None:
                return True
            # Undo the later merge. At equal order the left one came first, so the right one is undone first; a pair of
            # that same order at the boundary then stands to the right of what is still whole.
            if b is None or (a is not None and a[0] > b[0]):
                limit, left = a[0], a[2]
            else:
                limit, right = b[0] + 1, b[1]

    def _last_tokens(self, letters: str) -> list[int]:
        ends: list[int] = [-1] * (len(letters) + 1)
        agree, done = self.agree, -1
        for at, (size, token) in self.automaton.iter(letters):
            if at == done:
                continue
            start = at + 1 - size
            if start:
                before = ends[start]
                if before < 0:
                    continue
                pair = before << 20 | token
                ok = agree.get(pair)
                if ok is None:
                    if len(agree) > REMEMBER_PAIRS:
                        agree.clear()
                    ok = agree[pair] = self.compatible(before, token)
                if not ok:
                    continue
            ends[at + 1], done = token, at
        return ends

    def piece(self, text: str) -> list[int]:
        """Ids of one piece."""
        letters = text.translate(self.table) if text.isascii() else text.encode().decode("latin-1").translate(self.table)
        ends, at, size, out = self._last_tokens(letters), len(letters), self.size, []
        while at:
            token = ends[at]
            if token < 0:
                raise ValueError("the vocabulary lacks a byte of the text")
            out.append(token)
            at -= size[token]
        out.reverse()
        return out

    def _parts(self, text: str) -> Iterator[tuple[str, int | None]]:
        at = 0
        for m in self.special.finditer(text) if self.special and any(map(text.__contains__, self.added)) else ():
            yield text[at : m.start()], None
            yield m.group(), self.added[m.group()]
            at = m.end()
        yield text[at:], None

    def _pieces(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.split_any(text)
        return self.split_latin(text)

    def written(self, text: str) -> tuple[list[str], str]:
        """Ids as decimal strings joined by commas, piece by piece, and the text that they decode to."""
        ids: list[str] = []
        out: list[str] = []
        get = self.known.__getitem__
        for part, token in self._parts(text):
            if token is not None:
                ids.append(str(token))
                out.append(self.bytes_of[token].decode())
            elif part:
                pieces = self._pieces(part)
                ids += map(get, pieces)
                out += pieces  # what their ids decode to, see _Known
        return ids, "".join(out)

    def encode(self, text: str) -> list[int]:
        ids, _ = self.written(text)
        return [int(x) for s in ids for x in s.split(",")]

    def decode(self, ids: list[int]) -> str:
        """Bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", errors="replace")


class _Known(dict):
    """Pieces to their ids, which were decoded once and gave the piece. When half of what may be remembered is new, only that
    half and what is asked for again stay."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec, self.old = codec, {}

    def __missing__(self, piece: str) -> str:
        out = self.old.get(piece)
        if out is None:
            ids = self.codec.piece(piece)
            if self.codec.decode(ids) != piece:
                raise ValueError(f"the ids of {piece!r} decode to something else")
            out = ",".join(map(str, ids))
        if len(piece) <= LONGEST:
            if len(self) >= REMEMBER // 2:
                self.old = dict(self)
                self.clear()
            self[piece] = out
        return out

    def forget(self) -> None:
        self.clear()
        self.old = {}


_CODECS: dict[str, Codec] = {}


def codec(spec: str) -> Codec:
    """One codec per process and vocabulary."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _CODECS:
        _CODECS[key] = Codec(spec)
    return _CODECS[key]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, with_ids: bool = True) -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256, and with with_ids also ids and decoded, for every row.

    Null text: empty text, no tokens. Equal keys and rows: each row for itself. Other columns are left out, so names can't
    clash. Empty table: empty result. Memory: one batch of texts and the remembered pieces.
    """
    spark = df.sparkSession
    small_batches(spark)
    with open(path or default_path(), encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())  # a vocabulary file has a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(spec.value)
        try:
            yield from encoded(own, batches)
        finally:
            own.known.forget()
            own.agree.clear()

    def encoded(own: Codec, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, ids_hash, text_hash, all_ids, all_texts = [], [], [], [], []
            for t in batch.column(1):
                ids, back = own.written(t.as_py() or "")
                line = ",".join(ids)
                n.append(line.count(",") + 1 if line else 0)
                ids_hash.append(hashlib.sha256(line.encode()).hexdigest())
                text_hash.append(hashlib.sha256(back.encode()).hexdigest())
                if with_ids:
                    all_ids.append([int(x) for x in line.split(",")] if line else [])
                    all_texts.append(back)
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())]
            names = [key, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols += [pa.array(all_ids, pa.list_(pa.int64())), pa.array(all_texts, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(cols, names)

    kind = df.schema[key].dataType.simpleString()
    shape = f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<bigint>, decoded string" * with_ids
    return df.select(key, text).mapInArrow(run, shape)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), with_ids=False)


QUERIES = {"op5_bpe_codec": op5}
ORACLES: dict[str, str] = {}

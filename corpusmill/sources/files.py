"""Files: ingestion, extraction, export."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import text as tx
from corpusmill.hooks import REGISTRY
from corpusmill.sources import office, parsers

SEGMENTS = "id string, file_id string, segment_type string, content string, page int, position bigint, name string, kind string, level bigint, line_start bigint, line_end bigint"
#: Which extractor and language a MIME type goes to.
EXTRACTORS = {tx.MIME[".pdf"]: ("pdf", None), tx.MIME[".docx"]: ("docx", None), tx.MIME[".doc"]: ("docx", None), tx.MIME[".xlsx"]: ("xlsx", None), "text/x-go": ("code", "go"), "text/x-python": ("code", "python"), "text/javascript": ("code", "javascript"), "text/typescript": ("code", "typescript"), "application/x-sh": ("code", "bash"), "text/x-sh": ("code", "bash"), "text/x-sql": ("code", "sql"), "text/html": ("code", "html"), "text/markdown": ("code", "markdown")}


def ingest(spark: SparkSession, path: str, known: DataFrame | None = None, recursive: bool = True) -> DataFrame:
    """Rows of raw_files for the files under a path whose content isn't known yet: id = checksum = SHA-256 of the bytes."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    out = found.select(F.sha2("content", 256).alias("id"), F.col("path").alias("source_path"), tx.mime_type(F.col("path"), F.hex(F.substring("content", 1, 4))).alias("mime_type"), F.col("length").alias("size"), F.col("path").alias("external_path"))
    out = out.groupBy("id").agg(*[F.min(c).alias(c) for c in ("source_path", "mime_type", "size", "external_path")])
    out = out.select("id", "source_path", "mime_type", "size", "external_path", F.col("id").alias("checksum"), F.lit("pending").alias("status"), F.current_timestamp().alias("created_at"))
    return out if known is None else out.join(known.select("id"), "id", "left_anti")


def copy_files(files: DataFrame, store: str) -> DataFrame:
    """Copy the files of rows of raw_files to store/<first two of the id>/<id>, where they are read, and point external_path there.

    A copy that is there already stays; a copy is written under another name first, so none is ever half."""
    read = files.sparkSession.read.format("binaryFile")
    paths = [r["external_path"] for r in files.select("external_path").collect()]  # the files of one ingestion
    if not paths:
        return files
    target = F.concat(F.lit(store.rstrip("/") + "/"), F.substring("id", 1, 2), F.lit("/"), F.col("id"))
    content = read.load(paths).select(F.sha2("content", 256).alias("id"), "content").dropDuplicates(["id"]).withColumn("_to", target)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as pfs

        for b in batches:
            done = []
            for k, c, to in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                where, at = pfs.FileSystem.from_uri(to if "://" in to else "file://" + to)
                if where.get_file_info(at).type == pfs.FileType.NotFound:
                    where.create_dir(at.rsplit("/", 1)[0], recursive=True)
                    with where.open_output_stream(f"{at}.{id(b)}.tmp") as out:
                        out.write(c)
                    where.move(f"{at}.{id(b)}.tmp", at)
                done.append((k, to))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], pa.string()) for i in range(2)], ["id", "_to"])

    made = content.mapInArrow(put, "id string, _to string")
    return files.join(made, "id", "left").withColumn("external_path", F.coalesce("_to", "external_path")).select(*files.columns)


def get_row(table: DataFrame, key: str, column: str = "id") -> DataFrame:
    """A chunk or a file by its id: none or one row."""
    return table.where(F.col(column) == key).limit(1)


def pending(files: DataFrame, limit: int = 100) -> DataFrame:
    return files.where("status = 'pending'").orderBy("id").limit(limit)


def route(files: DataFrame, mapping: dict[str, str | None] | None = None) -> DataFrame:
    """Add workflow_id by MIME type, null for types without a workflow; mapping: types that go elsewhere, or nowhere (None)."""
    return files.withColumn("workflow_id", tx.route(F.col("mime_type"), mapping))


def list_files(files: DataFrame, status: str | None = None, mime: str | None = None, limit: int | None = None) -> DataFrame:
    if status:
        files = files.where(F.col("status") == status)
    if mime:
        files = files.where(F.col("mime_type") == mime)
    files = files.orderBy(F.desc("created_at"), "id")
    return files.limit(limit) if limit else files


def extract(df: DataFrame, extractor: str = "code", options: dict | None = None, key: str = "id", content: str = "content") -> DataFrame:
    """Segments of each row's content (text, or bytes for office formats), file_id = key; a row that fails is left out.

    Position is the number of the segment in its file, from 0. Extractors that are registered go before those of the same name
    here. Unknown extractors give an empty table of segments."""
    language, own = (options or {}).get("language"), REGISTRY.extractors.get(extractor)
    if own is None and extractor not in ("code", "text", "pdftotext", "pdf", "docx", "pandoc", "xlsx"):
        return df.sparkSession.createDataFrame([], SEGMENTS)
    reader = {"pdftotext": "pdf", "pandoc": "docx"}.get(extractor, extractor)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    if own is not None:
                        found = [(parsers.block_id(x.content), "text", x.content, x.page, i, x.name, x.kind, x.level, x.start, x.end) for i, x in enumerate(own.read(c, options or {}))]
                    elif isinstance(c, bytes) and reader in office.READERS:
                        found = [(parsers.block_id(x.content), x.kind, x.content, x.page, x.start, x.name, x.kind, x.level, x.start, x.end) for x in office.READERS[reader](c)]
                    else:
                        text = c.decode("utf-8", "replace") if isinstance(c, bytes) else c or ""
                        found = list(parsers.parse(text, language or ("pdf" if reader == "pdf" else "text" if reader == "text" else None)))
                except Exception:  # noqa: BLE001  a file that can't be read yields no segments
                    continue
                rows += [(f[0], k, *f[1:4], i, *f[5:]) for i, f in enumerate(found)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_ARROW)], [x.split()[0] for x in SEGMENTS.split(", ")])

    return df.select(F.col(key).cast("string"), content).mapInArrow(run, SEGMENTS)


_ARROW = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]


def generic_blocks(df: DataFrame, key: str = "id", text: str = "content") -> DataFrame:
    """The generic parser as array expressions: runs of lines that aren't blank, each with its newline."""
    blocks = F.filter(F.split(F.regexp_replace(text, r"\r\n", "\n"), r"\n(?:[^\S\n]*\n)+|^(?:[^\S\n]*\n)+|\n[^\S\n]*$", -1), lambda b: F.regexp_replace(b, r"\s+", "") != "")
    return df.select(F.col(key).alias("file_id"), F.posexplode(blocks).alias("position", "b")).select("file_id", F.col("position").cast("bigint").alias("position"), F.concat("b", F.lit("\n")).alias("content"))


def export(chunks: DataFrame, files: DataFrame, content: bool = True) -> DataFrame:
    """Rows of the export, ordered by path and position; without content for the CSV form."""
    out = chunks.join(files.select(F.col("id").alias("file_id"), "source_path"), "file_id").orderBy("source_path", "position", "id")
    cols = ["id", "file_id", *(["content"] if content else []), "token_count", "chunk_type", "source_path"]
    return out.select(*cols)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)

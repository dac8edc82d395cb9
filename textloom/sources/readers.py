"""Files and pages as DataFrames of documents, and chunk and index files in and out."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.schema import CHUNK_FIELDS, RECORD
from textloom.sources.extract import epub_to_text, html_to_text, table_rows

DEFAULT_EXTENSIONS = (".txt", ".md")
SQLITE = (".db", ".sqlite", ".sqlite3")


def parse_extensions(names: str = "") -> tuple[str, ...]:
    """A list like "txt, .MD" as lower-case extensions with their dot."""
    out = [n.strip().lower() for n in names.split(",")]
    return tuple(n if n[0] == "." else f".{n}" for n in out if n) if names else DEFAULT_EXTENSIONS


def format_of(path: Column) -> Column:
    """csv, tsv, html, epub or text, by extension."""
    low = F.lower(path)
    ends = lambda *names: low.rlike("|".join(rf"\.{n}$" for n in names))
    return F.when(ends("csv"), "csv").when(ends("tsv"), "tsv").when(ends("html", "htm", "xhtml"), "html").when(ends("epub"), "epub").otherwise("text")


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """One row: path and text of a file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_directory(spark: SparkSession, path: str, extensions: Sequence[str] = DEFAULT_EXTENSIONS) -> DataFrame:
    """(path relative to the folder, format, content) of all files below it with one of the extensions, sorted by path. Names that begin with _ or . are skipped, as Spark does."""
    if not extensions:
        raise ValueError("no file extension is given")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    wanted = files.where(F.lower("path").rlike("|".join("\\" + e + "$" for e in extensions)))
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toString().rstrip("/") + "/"
    relative = F.regexp_replace(F.expr("url_decode(replace(path, '+', '%2B'))"), "^[a-z0-9]+:/+", "/")
    prefix = "/" + full.split(":", 1)[-1].lstrip("/")
    return wanted.select(F.when(relative.startswith(prefix), F.substring(relative, len(prefix) + 1, 1 << 20)).otherwise(relative).alias("path"), format_of(F.col("path")).alias("format"), "content").orderBy("path")


def extract(files: DataFrame) -> DataFrame:
    """(path, format, text) of (path, format, content): HTML and EPUB become text, the rest is decoded as UTF-8."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for kind, raw in zip(b.column("format").to_pylist(), b.column("content").to_pylist(), strict=True):
                raw = raw or b""
                out.append(html_to_text(raw) if kind == "html" else epub_to_text(raw) if kind == "epub" else raw.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([b.column("path"), b.column("format"), pa.array(out, pa.string())], names=["path", "format", "text"])

    return files.select("path", "format", "content").mapInArrow(run, "path string, format string, text string")


def html_text(df: DataFrame, html_col: str = "html", keep: Sequence[str] = (), bare: bool = True) -> DataFrame:
    """The columns `keep` and text, the visible text of a page; null as empty. bare: see html_to_text()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [html_to_text(x or "", bare) for x in b.column("__html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(texts, pa.string())], names=[*keep, "text"])

    schema = T.StructType([df.schema[c] for c in keep]).add("text", T.StringType())
    return df.select(*keep, F.col(html_col).alias("__html")).mapInArrow(run, schema)


def tabular_chunks(texts: DataFrame, separator: str = ",", *, text_col: str = "text", keep: Sequence[str] = ("path",)) -> DataFrame:
    """A chunk for each data row of a CSV text; the header is its context and offsets run over the decoded rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            index, out = [], []
            for i, text in enumerate(b.column("__text").to_pylist()):
                header, rows = table_rows(text or "", separator)
                at = 0
                for k, row in enumerate(rows):
                    index.append(i)
                    out.append((k, row, at, at + len(row), len(row), header))
                    at += len(row) + 1
            cols = list(zip(*out, strict=True)) or [()] * 6
            kinds = (pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string())
            taken = [b.column(c).take(pa.array(index, pa.int64())) for c in keep]
            yield pa.RecordBatch.from_arrays([*taken, *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[*keep, *(f.name for f in CHUNK_FIELDS)])

    schema = T.StructType([*(T.StructField(c, texts.schema[c].dataType, True) for c in keep), *CHUNK_FIELDS])
    return texts.select(*keep, F.col(text_col).alias("__text")).mapInArrow(run, schema)


_JSON_CHUNK = "text string, start int, end int, token_count int, context string"


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Records of a JSON Lines index; a missing file is empty, a broken line an error."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], RECORD)
    raw = spark.read.schema(f"chunk struct<{_JSON_CHUNK.replace(' string', ':string').replace(' int', ':int')}>, vector array<float>, source string").option("mode", "FAILFAST").json(path)
    return raw.select("chunk.text", "chunk.start", "chunk.end", "chunk.token_count", F.coalesce("chunk.context", F.lit("")).alias("context"), "vector", F.coalesce("source", F.lit("")).alias("source"))


def write_jsonl(records: DataFrame, path: str) -> None:
    """Records as JSON Lines; empty contexts and labels are left out. Never write where you read."""
    chunk = F.struct("text", "start", "end", "token_count", F.nullif("context", F.lit("")).alias("context"))
    records.select(chunk.alias("chunk"), "vector", F.nullif("source", F.lit("")).alias("source")).write.mode("overwrite").option("ignoreNullFields", True).json(path)


def write_chunks(chunks: DataFrame, path: str) -> None:
    chunks.write.mode("overwrite").option("ignoreNullFields", True).json(path)


class JsonlIndex:
    """An index kept as JSON Lines: each change writes all records anew beside the old ones and takes their place. For more than a few files use a Parquet index."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jpath = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._jpath(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def records(self) -> DataFrame:
        return read_jsonl(self.spark, self.path)

    def _commit(self, rows: DataFrame) -> None:
        import uuid

        new, old = (f"{self.path}.{uuid.uuid4().hex}.{kind}" for kind in ("new", "old"))
        write_jsonl(rows, new)
        if self._fs.exists(self._jpath(self.path)):
            self._fs.rename(self._jpath(self.path), self._jpath(old))
        self._fs.rename(self._jpath(new), self._jpath(self.path))
        self._fs.delete(self._jpath(old), True)

    def upsert(self, rows: DataFrame, mode: str = "append") -> None:
        from textloom.operators.index import upserted

        if mode not in ("keyed", "append"):
            raise ValueError(f"unknown mode {mode!r}: want keyed or append")
        names = RECORD.fieldNames()
        self._commit(upserted(self.records(), rows) if mode == "keyed" else self.records().select(names).unionByName(rows.select(names)))

    def index(self, chunks: DataFrame, *, source: Column | str = "", embedder="hashing", mode: str = "append", replace: bool = False) -> None:
        """Chunks become records, as in a Parquet index."""
        from textloom.operators.embed import embed, embed_text

        rows = chunks.withColumn("source", F.lit(source) if isinstance(source, str) else source)
        if "vector" not in chunks.columns:
            rows = embed(rows, embed_text(), embedder=embedder)
        if replace:
            named = [r[0] for r in rows.where("source <> ''").select("source").distinct().collect()]  # the sources of one write
            if named:
                self._commit(self.records().where(~F.col("source").isin(named)))
        self.upsert(rows, mode)

    def sources(self) -> DataFrame:
        from textloom.operators.index import list_sources

        return list_sources(self.records())

    def delete_source(self, source: str) -> int:
        n = self.records().where(F.col("source") == source).count()
        if n:
            self._commit(self.records().where(F.col("source") != source))
        return n

    def search(self, query: str, **options) -> DataFrame:
        from textloom.operators.index import search

        return search(self.records(), query, **options)


def read_sqlite(spark: SparkSession, path: str) -> DataFrame:
    """Records of SQLite indexes: tables `records` of text, start, end, context, token_count, vector (32-bit floats, low byte first) and perhaps source. A file is read in one task, within its memory."""
    import sqlite3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            for raw in b.column("content").to_pylist():
                con = sqlite3.connect(":memory:")
                con.deserialize(raw)
                names = {r[1] for r in con.execute("PRAGMA table_info(records)")}
                rows = con.execute(f"SELECT text, start, end, token_count, context, vector, {'source' if 'source' in names else repr('')} FROM records ORDER BY start")
                while some := rows.fetchmany(4096):
                    text, start, end, tokens, context, vector, source = zip(*some, strict=True)
                    floats = [np.frombuffer(v, "<f4") for v in vector]
                    yield pa.RecordBatch.from_arrays([pa.array(text), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(tokens, pa.int32()), pa.array(context), pa.array(floats, pa.list_(pa.float32())), pa.array(source)], names=RECORD.fieldNames())
                con.close()

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)


def open_index(spark: SparkSession, path: str):
    """By extension: JSON Lines, a SQLite file as a frame of its records (to be searched, or put into another index), or a Parquet index."""
    from textloom.operators.index import ParquetIndex

    low = path.lower()
    if low.endswith(SQLITE):
        return read_sqlite(spark, path)
    return JsonlIndex(spark, path) if low.endswith((".jsonl", ".json")) else ParquetIndex(spark, path)

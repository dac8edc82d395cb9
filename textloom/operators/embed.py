"""Vectors for texts: feature hashing of terms, as columns, and remote models."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions.rulers import index_terms as python_terms
from textloom.functions.terms import sliced

DIMENSIONS = 64
FNV_OFFSET, FNV_PRIME = 2166136261, 16777619
BATCH = 256


def slot(term: str, dimensions: int = DIMENSIONS) -> int:
    h = FNV_OFFSET
    for b in term.encode():
        h = (h ^ b) * FNV_PRIME & 0xFFFFFFFF
    return h % dimensions


class Slots(dict):
    """The slot of each term met, up to LIMIT terms; a worker keeps one for each width."""

    LIMIT = 500_000

    def __init__(self, dimensions: int):
        super().__init__()
        self.dimensions = dimensions

    def __missing__(self, term: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        self[term] = n = slot(term, self.dimensions)
        return n


_slots: dict[int, Slots] = {}


def slot_counts(texts: Sequence[str], dimensions: int = DIMENSIONS) -> np.ndarray:
    """Counts of hashed terms, a row for each text."""
    known = _slots.setdefault(dimensions, Slots(dimensions))
    terms = list(map(python_terms, texts))
    sizes = np.fromiter(map(len, terms), np.int64, len(terms))
    at = np.fromiter((known[t] for own in terms for t in own), np.int64, int(sizes.sum()))
    cells = np.repeat(np.arange(len(texts)) * dimensions, sizes) + at
    return np.bincount(cells, minlength=len(texts) * dimensions).reshape(-1, dimensions)


def hash_texts(texts: Sequence[str], dimensions: int = DIMENSIONS) -> np.ndarray:
    """The same as vectors; for kernels that already run in Python."""
    return slot_counts(texts, dimensions).astype(np.float32)


def slot_column(term: Column, dimensions: int = DIMENSIONS) -> Column:
    """FNV-1a over the UTF-8 bytes of a term, modulo the width."""
    digits = F.hex(F.encode(term, "utf-8"))
    byte = F.transform(F.sequence(F.lit(0), F.octet_length(term) - 1), lambda i: F.conv(F.substring(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("long"))
    return (F.aggregate(byte, F.lit(FNV_OFFSET).cast("long"), lambda h, b: h.bitwiseXOR(b) * F.lit(FNV_PRIME).cast("long") % F.lit(1 << 32)) % dimensions).cast("int")


def hashing_counts(df: DataFrame, id_col: str, text: Column, dimensions: int = DIMENSIONS) -> DataFrame:
    """(id, slot, n): the vectors' non-zero components. Terms are hashed and summed where they are found; only sums are moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in sliced(whole, "__text"):
                counts = slot_counts([x or "" for x in b.column("__text").to_pylist()], dimensions)
                row, at = np.nonzero(counts)
                yield pa.RecordBatch.from_arrays([b.column(id_col).take(pa.array(row)), pa.array(at, pa.int32()), pa.array(counts[row, at], pa.int64())], names=[id_col, "slot", "n"])

    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType, True), T.StructField("slot", T.IntegerType()), T.StructField("n", T.LongType())])
    parts = df.select(id_col, text.alias("__text")).mapInArrow(run, schema)
    return parts.groupBy(id_col, "slot").agg(F.sum("n").alias("n"))


def hashing_vector(text: Column) -> Column:
    """array<float> of 64 counts; all zeros for a text without a term."""

    @F.pandas_udf("array<float>")
    def counts(texts: pd.Series) -> pd.Series:
        return pd.Series(list(hash_texts([x or "" for x in texts])))

    return counts(text)


def embed_text(chunk_context: str = "context", chunk_text: str = "text") -> Column:
    """What of a chunk is embedded: its context and its text, with nothing between."""
    return F.concat(F.coalesce(F.col(chunk_context), F.lit("")), F.col(chunk_text))


class RemoteEmbedder:
    """An OpenAI-compatible endpoint: one request for each batch, vectors placed by their index."""

    def __init__(self, base_url: str | None = None, key: str | None = None, model: str | None = None, post: Callable | None = None):
        self.url = (base_url or os.environ.get("OPENAI_BASE_URL") or "https://api.openai.com/v1").rstrip("/")
        self.key = key if key is not None else os.environ.get("OPENAI_API_KEY", "")
        self.model = model or os.environ.get("OPENAI_EMBEDDING_MODEL") or "text-embedding-3-small"
        self.post = post or self._post

    def _post(self, url: str, body: bytes, headers: dict[str, str]) -> tuple[int, bytes]:
        from urllib.error import HTTPError
        from urllib.request import Request, urlopen

        try:
            with urlopen(Request(url, body, headers), timeout=60) as r:
                return r.status, r.read()
        except HTTPError as e:
            return e.code, e.read()

    def __call__(self, texts: Sequence[str]) -> list[list[float]]:
        if not texts:
            return []
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        status, raw = self.post(f"{self.url}/embeddings", json.dumps({"model": self.model, "input": list(texts)}).encode(), headers)
        try:
            answer = json.loads(raw)
        except ValueError:
            raise ValueError(f"embedding endpoint: status {status}, not JSON") from None
        if isinstance(answer, dict) and answer.get("error"):
            raise ValueError(f"embedding endpoint: {answer['error'].get('message', answer['error'])}")
        if not 200 <= status < 300:
            raise ValueError(f"embedding endpoint: status {status}")
        rows = answer.get("data") or []
        if len(rows) != len(texts):
            raise ValueError(f"embedding endpoint: {len(rows)} vectors for {len(texts)} texts")
        out: list[list[float] | None] = [None] * len(texts)
        for row in rows:
            i = row.get("index", -1)
            if not 0 <= i < len(texts):
                raise ValueError(f"embedding endpoint: index {i} is out of range")
            if out[i] is not None:
                raise ValueError(f"embedding endpoint: index {i} comes twice")
            if not row.get("embedding"):
                raise ValueError(f"embedding endpoint: index {i} has no vector")
            out[i] = row["embedding"]
        return out


def make_embedder(name: str = "hashing") -> Callable[[Sequence[str]], Sequence[Sequence[float]]]:
    if name in ("", "hashing"):
        return hash_texts
    if name == "openai":
        return RemoteEmbedder()
    raise ValueError(f"unknown embedder {name!r}: want hashing or openai")


def embed(df: DataFrame, text: Column, *, embedder: str | Callable = "hashing", to: str = "vector", batch: int = BATCH) -> DataFrame:
    """df with a vector column. Anything but hashing is called with at most `batch` texts at a time."""
    if embedder in ("", "hashing"):
        return df.withColumn(to, hashing_vector(text))
    call = make_embedder(embedder) if isinstance(embedder, str) else embedder

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                b = whole.slice(at, batch)
                vectors = call([x or "" for x in b.column("__text").to_pylist()])
                if len(vectors) != b.num_rows:
                    raise ValueError(f"embedder returned {len(vectors)} vectors for {b.num_rows} texts")
                rest = [c for c in b.schema.names if c != "__text"]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array([list(map(float, v)) for v in vectors], pa.list_(pa.float32()))], names=[*rest, to])

    schema = T.StructType([*df.schema.fields]).add(to, T.ArrayType(T.FloatType(), False))
    return df.withColumn("__text", text).mapInArrow(run, schema)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for empty, unequally wide or zero vectors."""
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm > 0), dot(a, b) / norm).otherwise(F.lit(0.0))


def cosine_to(vector: Column, query: Sequence[float]) -> Column:
    """Cosine to one fixed vector, a matrix product for each Arrow batch."""
    q = np.asarray(query, np.float64)

    @F.pandas_udf("double")
    def score(v: pd.Series) -> pd.Series:
        out = np.zeros(len(v))
        ok = np.array([x is not None and len(x) == len(q) for x in v], bool)
        if ok.any() and len(q):
            m = np.stack([np.asarray(x, np.float64) for x in v[ok]])
            norms = np.sqrt((m * m).sum(1) * (q @ q))
            out[ok] = np.divide(m @ q, norms, out=np.zeros(len(m)), where=norms > 0)
        return pd.Series(out)

    return score(vector)


def mean_vector(df: DataFrame, keys: Sequence[str], vector: str = "vector") -> DataFrame:
    """The component-wise mean of each group's vectors."""
    parts = df.select(*keys, F.posexplode(vector).alias("at", "x")).groupBy(*keys, "at").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return parts.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda p: p["x"].cast("float")).alias("mean"))

"""Chunking of a DataFrame: a row for each chunk of each document.

The chunkers run as one Arrow pass over the documents, which gives the exploded rows
at once: kept columns are repeated by index, and no array of chunks ever crosses to
the JVM. A window cut by a column expression would look for its start from the text's
beginning, which takes the square of a document's length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions import code, spans
from textloom.functions.rulers import Ruler, make_ruler
from textloom.functions.rules import rules_from_json
from textloom.functions.terms import sliced
from textloom.schema import CHUNK_FIELDS

CHUNKERS = ("token", "sentence", "recursive", "fast", "table", "code", "markdown", "semantic")


def make_kernel(name: str = "recursive", *, tokenizer: str | Ruler = "character", size: int = 512, overlap: int = 0, rules: str | Sequence[spans.Level] = "", lang: str = "", delimiters: Sequence[str] = (), min_runes: int = 0, min_sim: float | None = None, window: int = 1, embed: Callable | None = None) -> spans.Kernel:
    """The kernel of a chunker by name; options it does not take are errors."""
    if name not in CHUNKERS:
        raise ValueError(f"unknown chunker {name!r}: want one of {', '.join(CHUNKERS)}")
    if overlap and name not in ("token", "recursive"):
        raise ValueError(f"overlap is not supported by the {name} chunker, only by token and recursive")
    if rules and name != "recursive":
        raise ValueError(f"rules are not supported by the {name} chunker, only by recursive")
    if lang and name == "markdown":
        raise ValueError("lang is not supported by the markdown chunker: each fence names its own")
    if name == "fast":
        return spans.fast_chunks(size, delimiters)
    ruler = make_ruler(tokenizer)
    if name == "token":
        return spans.token_chunks(ruler, size, overlap)
    if name == "sentence":
        return spans.sentence_chunks(ruler, size, delimiters, min_runes)
    if name == "recursive":
        return spans.recursive_chunks(ruler, size, rules_from_json(rules) if isinstance(rules, str) else rules, overlap)
    if name == "table":
        return spans.table_chunks(ruler, size)
    if name == "code":
        return code.code_chunks(ruler, size, lang)
    if name == "markdown":
        return spans.markdown_chunks(ruler, size)
    from textloom.operators.embed import hash_texts

    return spans.semantic_chunks(ruler, size, embed or hash_texts, min_sim, window, min_runes)


def chunk(df: DataFrame, name: str = "recursive", *, text_col: str = "text", keep: Sequence[str] | None = None, **options: Any) -> DataFrame:
    """The columns `keep` (all but the text, if not given), chunk_index, text, start, end, token_count, context. Null and empty texts have no chunks."""
    make_kernel(name, **options)  # wrong options are errors now
    keep = [c for c in df.columns if c != text_col] if keep is None else list(keep)
    clash = set(keep) & {f.name for f in CHUNK_FIELDS}
    if clash:
        raise ValueError(f"columns to keep clash with chunk columns: {sorted(clash)}")
    fields = [df.schema[c] for c in keep]
    made_kernel: dict[str, spans.Kernel] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if "k" not in made_kernel:
            made_kernel["k"] = make_kernel(name, **options)
        kernel = made_kernel["k"]
        for whole in batches:
            for b in sliced(whole, "__text"):
                rows: list[int] = []
                out: list[tuple] = []
                for i, text in enumerate(b.column("__text").to_pylist()):
                    for k, s in enumerate(kernel(text) if text else ()):
                        rows.append(i)
                        out.append((k, text[s.start : s.end], s.start, s.end, s.tokens, s.context))
                index = pa.array(rows, pa.int64())
                cols = list(zip(*out, strict=True)) or [()] * 6
                kinds = (pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([*(b.column(f"__{j}").take(index) for j in range(len(keep))), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[*(f"__{j}" for j in range(len(keep))), *(f.name for f in CHUNK_FIELDS)])

    schema = T.StructType([*(T.StructField(f"__{j}", f.dataType, True) for j, f in enumerate(fields)), *CHUNK_FIELDS])
    made = df.select(*(F.col(c).alias(f"__{j}") for j, c in enumerate(keep)), F.col(text_col).alias("__text")).mapInArrow(run, schema)
    return made.select(*(F.col(f"__{j}").alias(c) for j, c in enumerate(keep)), *(f.name for f in CHUNK_FIELDS))


def documents(chunks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A row for each document with its chunks nested in order."""
    fields = F.struct("chunk_index", "text", "start", "end", "token_count", "context")
    return chunks.groupBy(*keys).agg(F.array_sort(F.collect_list(fields)).alias("chunks"))


def register(spark: SparkSession) -> None:
    """chunk_text(text, chunker, tokenizer, size, overlap) as a table function, and term and piece functions, for SQL."""
    from pyspark.sql.functions import udtf

    class ChunkText:
        def __init__(self) -> None:
            self.made: dict[tuple, spans.Kernel] = {}

        def eval(self, text: str, chunker: str, tokenizer: str, size: int, overlap: int):
            if text:
                key = (chunker, tokenizer, size, overlap)
                if key not in self.made:
                    self.made[key] = make_kernel(chunker, tokenizer=tokenizer, size=size, overlap=overlap)
                for k, s in enumerate(self.made[key](text)):
                    yield k, text[s.start : s.end], s.start, s.end, s.tokens, s.context

    spark.udtf.register("chunk_text", udtf(ChunkText, returnType="chunk_index int, text string, start int, end int, token_count int, context string"))

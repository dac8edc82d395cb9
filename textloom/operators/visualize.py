"""The layout of chunks over their source, and a page that shows it."""

from __future__ import annotations

import html
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from textloom.functions.terms import sliced

SLOTS = 12
SEGMENT = T.StructType([T.StructField(n, t) for n, t in (("start", T.IntegerType()), ("end", T.IntegerType()), ("text", T.StringType()), ("is_chunk", T.BooleanType()), ("chunk_index", T.IntegerType()), ("slot", T.IntegerType()), ("tokens", T.IntegerType()), ("context", T.StringType()), ("overlap", T.BooleanType()), ("mismatch", T.BooleanType()), ("covered", T.BooleanType()))])


def layout(chunks: DataFrame, docs: DataFrame, *, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, start, end, text, is_chunk, chunk_index, slot, tokens, context, overlap, mismatch, covered): chunks and the gaps between them, in order of start; of an overlapping chunk what lies beyond those before."""
    fields = ("start", "chunk_index", "end", "text", "token_count", "context")
    own = chunks.groupBy(key).agg(F.collect_list(F.struct(*fields)).alias("__own"))  # of one document
    rows = docs.select(key, F.coalesce(F.col(text_col), F.lit("")).alias("__doc")).join(own, key, "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in sliced(whole, "__doc"):
                index: list[int] = []
                out: list[tuple] = []
                for i, (doc, found) in enumerate(zip(b.column("__doc").to_pylist(), b.column("__own").to_pylist(), strict=True)):
                    made = _segments(doc, sorted(((c["start"], c["chunk_index"], c["end"], c["text"], c["token_count"], c["context"]) for c in found or ()), key=lambda c: c[:2]))
                    index += [i] * len(made)
                    out += made
                columns = list(zip(*out, strict=True)) or [()] * len(SEGMENT)
                yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array(index, pa.int64())), *(pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(columns, SEGMENT, strict=True))], names=[key, *SEGMENT.names])

    return rows.mapInArrow(run, T.StructType([T.StructField(key, docs.schema[key].dataType), *SEGMENT.fields]))


def _segments(doc: str, chunks: Sequence[tuple]) -> list[tuple]:
    """The segments of one document; chunks (start, chunk_index, end, text, token_count, context) in order."""
    out, at = [], 0
    for start, k, end, text, tokens, context in chunks:
        if start > at:
            out.append((at, start, doc[at:start], False, None, None, None, "", False, False, False))
        a, b = max(start, at), max(end, at)
        out.append((a, b, doc[a:b], True, k, k % SLOTS, tokens, context, start < at, doc[start:end] != text, end <= at))
        at = b
    if len(doc) > at:
        out.append((at, len(doc), doc[at:], False, None, None, None, "", False, False, False))
    return out


def render(segments: Sequence[dict], title: str = "chunks") -> str:
    """A self-contained page of one document's segments, given in order."""
    colors = "".join(f".c{i}{{background:hsl({i * 360 // SLOTS},70%,85%)}}" for i in range(SLOTS))
    parts = []
    for s in segments:
        text = html.escape(s["text"])
        if not s["is_chunk"]:
            parts.append(f'<span class="gap">{text}</span>')
            continue
        notes = [f"chunk {s['chunk_index']}", f"[{s['start']}, {s['end']})", f"{s['tokens']} tokens"] + [n for n in ("overlap", "mismatch", "covered") if s[n]]
        if s["context"]:
            notes.append(f"context: {s['context']}")
        parts.append(f'<span class="c{s["slot"]}{" bad" if s["mismatch"] else ""}" title="{html.escape(", ".join(notes))}">{text}</span>')
    n = sum(1 for s in segments if s["is_chunk"])
    return f'<!doctype html><html><head><meta charset="utf-8"><title>{html.escape(title)}</title><style>body{{font-family:sans-serif}}pre{{white-space:pre-wrap}}.gap{{color:#999}}.bad{{outline:2px solid #c00}}{colors}</style></head><body><h1>{html.escape(title)}</h1><p>{n} chunks</p><pre>{"".join(parts)}</pre></body></html>\n'

"""python -m textloom: chunk files, index them, search the index. Exit code 2 for wrong use, 1 for a failure.

The chunks are printed; with -quiet they are only indexed, and stay on the executors.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import chunkers, refine, visualize
from textloom.operators.embed import embed, embed_text
from textloom.sources import readers


class UsageError(Exception):
    pass


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="textloom", exit_on_error=False)
    p.add_argument("file", nargs="*")
    for name, kind, default in (("chunker", str, "recursive"), ("tokenizer", str, "character"), ("lang", str, ""), ("rules", str, ""), ("size", int, 512), ("overlap", int, 0), ("index", str, ""), ("embedder", str, "hashing"), ("context", int, 0), ("context-mode", str, "prefix"), ("dir", str, ""), ("ext", str, ""), ("html", str, ""), ("query", str, ""), ("k", int, None), ("scoring", str, "dense"), ("hybrid-weight", float, 0.5), ("source", str, ""), ("delete-source", str, "")):
        p.add_argument(f"-{name}", f"--{name}", type=kind, default=default)
    for name in ("embed", "append", "list-sources", "quiet"):
        p.add_argument(f"-{name}", f"--{name}", action="store_true")
    return p


def _check(a: argparse.Namespace) -> None:
    if len(a.file) > 1:
        raise UsageError("at most one file is read")
    if a.dir and a.file:
        raise UsageError("give a file or -dir, not both")
    if a.query and (a.file or a.dir):
        raise UsageError("-query reads the index, not files")
    if a.k is not None and not a.query:
        raise UsageError("-k goes with -query")
    if a.k is not None and a.k <= 0:
        raise UsageError("-k must be > 0")
    if a.list_sources and a.delete_source:
        raise UsageError("give -list-sources or -delete-source, not both")
    if (a.query or a.list_sources or a.delete_source) and not a.index:
        raise UsageError("-index is missing")
    if a.index.lower().endswith(readers.SQLITE):
        raise UsageError("a SQLite index is only read, by readers.read_sqlite, to be put into a Parquet or JSON Lines index")
    if a.context_mode not in ("prefix", "suffix"):
        raise UsageError(f"unknown context mode {a.context_mode!r}: want prefix or suffix")
    if a.context < 0:
        raise UsageError("-context must be >= 0")


def _documents(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    if a.dir:
        return readers.extract(readers.read_directory(spark, a.dir, readers.parse_extensions(a.ext)))
    if a.file:
        files = spark.read.format("binaryFile").load(a.file[0]).select("path", readers.format_of(F.col("path")).alias("format"), "content")
        return readers.extract(files)
    return spark.createDataFrame([("", "text", sys.stdin.read())], "path string, format string, text string")


def _chunks(docs: DataFrame, a: argparse.Namespace, options: dict) -> DataFrame:
    made = chunkers.chunk(docs.where("format NOT IN ('csv', 'tsv')"), a.chunker, keep=["path"], **options)
    for kind, separator in (("csv", ","), ("tsv", "\t")):
        made = made.unionByName(readers.tabular_chunks(docs.where(F.col("format") == kind), separator))
    if a.context:
        made = (refine.context_prefix if a.context_mode == "prefix" else refine.context_suffix)(made, a.context, keys=["path"], ruler=a.tokenizer)
    return made


def _plain(row: dict) -> dict:
    return {k: v for k, v in row.items() if k not in ("path", "chunk_index") and not (k == "context" and not v)}


def run(argv: Sequence[str], spark: SparkSession | None = None) -> int:
    try:
        a = parser().parse_args(list(argv))
        _check(a)
        options = {} if a.chunker == "fast" else {"tokenizer": a.tokenizer}
        options |= {"size": a.size, "overlap": a.overlap, "rules": a.rules, "lang": a.lang}
        chunkers.make_kernel(a.chunker, **options)
    except (UsageError, argparse.ArgumentError, ValueError) as e:
        print(f"textloom: {e}", file=sys.stderr)
        return 2
    try:
        spark = spark or SparkSession.builder.appName("textloom").getOrCreate()
        index = readers.open_index(spark, a.index) if a.index else None
        if a.query:
            source = a.source or None
            hits = index.search(a.query, k=a.k or 5, mode=a.scoring, weight=a.hybrid_weight, source=source, embedder=a.embedder).orderBy("rank").collect()
            out = [{"record": {"chunk": _plain({c: r[c] for c in ("text", "start", "end", "token_count", "context")})} | ({"source": r["source"]} if r["source"] else {}), "score": r["score"]} for r in hits]
        elif a.list_sources:
            out = [r.asDict() for r in index.sources().collect()]
        elif a.delete_source:
            out = {"deleted": index.delete_source(a.delete_source)}
        else:
            docs = _documents(spark, a)
            chunks = _chunks(docs, a, options)
            if a.embed or index:
                chunks = embed(chunks, embed_text(), embedder=a.embedder)
            if index and not a.quiet:
                chunks = chunks.persist()  # computed once for the index and for what is printed
            if index:
                label = F.lit(a.source) if a.source else F.col("path") if a.dir else F.lit("")
                index.index(chunks, source=label, replace=not a.append and bool(a.source or a.dir))
            if a.quiet:  # nothing comes to the driver
                return 0
            shown = chunks if a.embed else chunks.drop("vector")
            rows: dict[str, list[dict]] = {}
            for r in shown.orderBy("path", "chunk_index").collect():  # what is printed
                d = r.asDict()
                rows.setdefault(d["path"], []).append(_plain({"embedding" if k == "vector" else k: v for k, v in d.items()}))
            if a.html:
                texts = docs.select("path", "text")
                segments = [r.asDict() for r in visualize.layout(_chunks(docs, a, options), texts, key="path").orderBy("path", "start").collect()]
                with open(a.html, "w", encoding="utf-8") as f:
                    f.write(visualize.render(segments))
            if a.dir:
                out = [{"path": r["path"], "content": r["text"], "chunks": rows.get(r["path"], [])} for r in docs.orderBy("path").collect()]
            else:
                out = next(iter(rows.values()), [])
        print(json.dumps(out, ensure_ascii=False, indent=2))
        return 0
    except Exception as e:
        print(f"textloom: {e}", file=sys.stderr)
        return 1


def main() -> None:
    sys.exit(run(sys.argv[1:]))

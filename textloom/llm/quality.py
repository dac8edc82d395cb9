"""Operator 5, quality rules: per-text base rules and cross-document line frequency.

Lines are normalised (a-z for A-Z, runs of digits as 0, single spaces) and hashed.
For each host the number of distinct documents that hold a line is counted, exact
copies of a text as one document. A line is over the host's limit if more than
`min_docs` documents have it and these are more than `max_share` of the host's or
more than `max_docs`, so that a hot host's size doesn't raise its limit without end.
It is removed; a document that keeps too little is depleted and rejected.

Lines of every length are counted and removed: of a line only its hash and its
number of words are moved.

Edge cases: null text is empty (no words, base_failed); null host is a host of
its own; very long texts and lines are read whole; a line in exactly as many documents
as a limit stays; repeated rows each get a row and count as one document; null ids stay
null; an empty table gives an empty result; other columns of the input never clash, as
only the three named ones are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import common
from textloom.llm.common import Workspace

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
DIGITS = re.compile(rb"[0-9]+")

BASE = "rid long, doc_id long, th long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<long>, line_words array<int>"


def line_key(line: bytes) -> int:
    """64-bit signed hash of the normalised line: a-z for A-Z, 0 for a run of digits, single spaces."""
    return xxhash.xxh3_64_intdigest(b" ".join(DIGITS.sub(b"0", line.lower()).split())) - (1 << 63)


def repeat_words(words: list[bytes], n: int = 8) -> int:
    """Words that lie in an n-word window whose sequence is found twice or more in the text."""
    k = len(words) - n + 1
    if k < 2:
        return 0
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, len(words))
    if len(ids) == len(words):
        return 0
    step = 1
    while step < n:  # ranks of windows of 2, 4, 8 words; n is a power of two
        pair = w[: len(w) - step] * np.int64(len(words) + 1) + w[step:]
        _, w = np.unique(pair, return_inverse=True)
        step *= 2
    twice = np.bincount(w)[w] > 1
    if not twice.any():
        return 0
    cover = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + n, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    context, at = TaskContext.get(), 0
    first = (context.partitionId() if context else 0) << 36
    for b in common.slices(batches):
        out, flat, flat_words, counts = [], [], [], []
        for text in common.binaries(b.column("text")):
            words = text.split()
            spaces = len(text) - len(text.translate(None, SPACES))
            chars = len(text.decode()) if not text.isascii() else len(text)
            seen: set[bytes] = set()
            dup, own = 0, {}
            for line in text.split(b"\n"):
                n = len(line.split())
                if n:
                    if line in seen:
                        dup += 1
                    seen.add(line)
                    key = line_key(line)
                    own[key] = own.get(key, 0) + n
            out.append((len(words), chars - spaces, len(text) - len(text.translate(None, SYMBOLS)), dup, repeat_words(words)))
            flat += own
            flat_words += own.values()
            counts.append(len(own))
        cols = np.array(out, dtype=np.int64).reshape(-1, 5)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(first + at, first + at + b.num_rows)), b.column("doc_id"), b.column("th"), b.column("host"), *(pa.array(cols[:, i]) for i in range(5)), common.lists(np.array(flat, np.int64), counts, pa.int64()), common.lists(np.array(flat_words, np.int32), counts, pa.int32())],
            names=["rid", "doc_id", "th", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines", "line_words"],
        )
        at += b.num_rows


def frequent_lines(base: DataFrame, min_docs: int, max_share: float, max_docs: int) -> DataFrame:
    """(host, line) of the lines over their host's limit; exact copies count once."""
    once = base.groupBy("host", "th").agg(F.first("lines").alias("lines"))
    hosts = once.groupBy("host").agg(F.count(F.lit(1)).alias("docs"))
    counts = once.select("host", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > min_docs)
    return counts.join(hosts, "host").where((F.col("n") > F.col("docs") * F.lit(max_share)) | (F.col("n") > max_docs)).select("host", "line")


def assess(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_words: int = 20, max_repeat_pct: int = 30, min_docs: int = 10, max_share: float = 0.01, max_docs: int = 1000, min_kept_share: float = 0.3) -> DataFrame:
    """A row for each input row: the base measures, the words that frequent lines take, the verdict, and the keys of the lines to remove (drop).

    th is xxhash64 of the text (null as empty), host the host with null as "\\0".
    """
    ws = Workspace(docs.sparkSession, "quality")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), host_of(host_col).alias("host"), text.alias("text"))
    base = ws.write(rows.mapInArrow(measure, BASE), "base")
    frequent = ws.write(frequent_lines(base, min_docs, max_share, max_docs), "frequent")
    lines = base.select("rid", "host", F.explode(F.arrays_zip("lines", "line_words")).alias("x")).select("rid", "host", F.col("x.lines").alias("line"), F.col("x.line_words").alias("w"))
    # frequent is read from a table, so each side has an exchange of its own and Spark can split a line that fills a host
    lost = lines.join(frequent, ["host", "line"]).groupBy("rid").agg(F.sum("w").alias("lost"), F.collect_set("line").alias("drop"))
    out = base.drop("lines", "line_words").join(lost, "rid", "left")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))
    lost_words = F.coalesce("lost", F.lit(0)).cast("long")
    left = F.col("n_words") - lost_words
    good = (left >= min_words) & (left >= F.col("n_words") * F.lit(min_kept_share))
    return out.select("doc_id", "th", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & good).alias("kept"), lost_words.alias("n_line_words"), F.coalesce("drop", F.array().cast("array<long>")).alias("drop"))


def host_of(host_col: str):
    return F.coalesce(F.col(host_col).cast("string"), F.lit("\0"))


def cut_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts without the lines whose keys are in __drop."""
    for b in common.slices(batches):
        texts = []
        for text, drop in zip(common.binaries(b.column("text")), b.column("__drop").to_pylist(), strict=True):
            if drop:
                gone = set(drop)
                text = b"\n".join(x for x in text.split(b"\n") if not x.split() or line_key(x) not in gone)
            texts.append(text.decode())
        i = b.schema.get_field_index("text")
        n = b.schema.get_field_index("n_chars")
        b = b.set_column(i, b.schema.field(i), pa.array(texts, b.schema.field(i).type))
        if n >= 0:
            b = b.set_column(n, b.schema.field(n), pa.array([len(x) for x in texts], b.schema.field(n).type))
        yield b.select([x for x in b.schema.names if x != "__drop"])


def clean(docs: DataFrame, **rules) -> DataFrame:
    """The documents that the rules keep, without their frequent lines; the columns of docs (doc_id, text, source and, if there, n_chars are used)."""
    verdict = assess(docs, **rules).where("kept").select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), F.col("host").alias("__host"), F.col("drop").alias("__drop")).dropDuplicates(["__id", "__th", "__host"])
    # ids may be null: the hash of the text and the host stand beside them
    mine = docs.withColumns({"__i": F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), "__t": F.xxhash64(F.coalesce("text", F.lit("")))})
    verdict = verdict.withColumn("__i2", F.coalesce("__id", F.lit(-1)))
    kept = mine.join(verdict, (F.col("__i") == F.col("__i2")) & (F.col("__t") == F.col("__th")) & (host_of("source") == F.col("__host")) & F.col("doc_id").cast("long").eqNullSafe(F.col("__id")))
    return kept.select(*docs.columns, "__drop").mapInArrow(cut_lines, docs.schema)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess(common.table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_line_words")


QUERIES = {"op5_quality_rules": op5_quality_rules}

ORACLE_SQL = {
    "op5_quality_rules": r"""
WITH d AS (
  SELECT doc_id, coalesce(source, chr(0)) AS host, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS ls
  FROM documents),
win AS (
  SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i+7], ' '))) AS g FROM d WHERE len(w) >= 8),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY doc_id),
lines AS (
  SELECT doc_id, host, text, len(regexp_extract_all(l, '[^ 	-
]+')) AS nw,
         array_to_string(regexp_extract_all(regexp_replace(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]+', '0', 'g'), '[^ 	-
]+'), ' ') AS norm
  FROM (SELECT doc_id, host, text, unnest(ls) AS l FROM d)),
hosts AS (SELECT host, count(DISTINCT text) AS docs FROM d GROUP BY host),
freq AS (
  SELECT c.host, norm FROM (SELECT host, norm, count(DISTINCT text) AS n FROM lines GROUP BY host, norm) c JOIN hosts USING (host)
  WHERE n > 10 AND (n > docs * 0.01 OR n > 1000)),
lost AS (SELECT doc_id, sum(nw) AS lost FROM lines JOIN freq USING (host, norm) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0)::BIGINT AS n_line_words
  FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN lost USING (doc_id)),
f AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND n_words - n_line_words >= 20 AND n_words - n_line_words >= n_words * 0.3) AS kept, n_line_words
FROM f
"""
}

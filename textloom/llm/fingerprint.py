"""Operator 4, document fingerprints: threshold-scaled sketches.

A text's shingles are its windows of `WIDTH` code points (the whole text, if it is
shorter). A sketch retains every shingle hash below one fixed fraction of the hash
range, 2^-4 for all texts, so sketches merge by union and any two, of however
unequal texts, are compared as they are. Of n shingles about n / 16 hashes remain; a
share p of them is estimated with a standard error of about 4 * sqrt(p * (1 - p) / n):
0.04 for a half of 2,400 shingles, 0.2 for a half of 100.

A fingerprint is written as 8 hexadecimal digits of a digest of the text, a colon,
and the retained 48-bit hashes in ascending order, 12 digits each.

Edge cases: null text is empty; very short texts often retain no hash: where nothing
remains to compare, sketches with one digest are alike by 1 and others by 0, and so
two empty texts are alike by 1; very long texts are read whole; documents with equal
ids follow one another by text, and repeated rows follow themselves; null ids come
first; of one document alone the next is itself; only the id and the text are read,
so no other column can clash; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import common

WIDTH, LEVEL, BITS = 16, 4, 48
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(codes: np.ndarray, width: int) -> np.ndarray:
    """A hash for each window of `width` code points, by doubling; width is a power of two."""
    h = (codes.astype(np.uint64) + np.uint64(1)) * MULTIPLIER
    h ^= h >> np.uint64(29)
    step, power = 1, MULTIPLIER
    while step < width:
        with np.errstate(over="ignore"):
            h = h[: len(h) - step] * power + h[step:]
            power = power * power
        step *= 2
    return mix(h)


class Sketch(NamedTuple):
    digest: int
    #: ascending, distinct, below the fraction
    hashes: np.ndarray


def digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=4).digest(), "big")


def sketches(texts: list[str], width: int = WIDTH) -> list[Sketch]:
    """The sketch of each text."""
    sizes = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    begins = np.cumsum(sizes) - sizes
    counts = np.maximum(sizes - width + 1, 0)
    limit = np.uint64(1 << (BITS - LEVEL))
    value, doc = np.empty(0, np.uint64), np.empty(0, np.int64)
    if len(codes) >= width:
        h = window_hashes(codes, width) >> np.uint64(64 - BITS)
        pos = np.flatnonzero(h < limit)
        doc = np.searchsorted(begins, pos, side="right") - 1
        inside = pos - begins[doc] < counts[doc]
        value, doc = h[pos[inside]], doc[inside]
    short = np.flatnonzero((counts == 0) & (sizes > 0))
    if len(short):
        whole = np.array([int.from_bytes(hashlib.blake2b(texts[i].encode(), digest_size=8).digest(), "little") >> 64 - BITS for i in short.tolist()], np.uint64)
        value, doc = np.concatenate((value, whole[whole < limit])), np.concatenate((doc, short[whole < limit]))
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    fresh = np.concatenate(([True], (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])))[: len(value)]
    value, doc = value[fresh], doc[fresh]
    ends = np.searchsorted(doc, np.arange(len(texts) + 1))
    return [Sketch(digest(t), value[ends[i] : ends[i + 1]]) for i, t in enumerate(texts)]


def write(sketch: Sketch) -> str:
    digits = sketch.hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes().hex()
    return f"{sketch.digest:08x}:{digits}"


def read(fingerprint: str) -> Sketch:
    own, digits = fingerprint.split(":")
    raw = np.frombuffer(bytes.fromhex(digits), np.uint8).reshape(-1, 6)
    return Sketch(int(own, 16), np.pad(raw, ((0, 0), (2, 0))).copy().view(">u8").reshape(-1).astype(np.uint64))


def likeness(a: Sketch, b: Sketch) -> float:
    """Estimated intersection over union of the shingle sets."""
    if not len(a.hashes) and not len(b.hashes):
        return float(a.digest == b.digest)
    both = len(np.intersect1d(a.hashes, b.hashes, assume_unique=True))
    return both / (len(a.hashes) + len(b.hashes) - both)


def containment(a: Sketch, b: Sketch) -> float:
    """Estimated share of a's shingles that b has; b may be far longer or shorter."""
    if not len(a.hashes):
        return float(a.digest == b.digest)
    return len(np.intersect1d(a.hashes, b.hashes, assume_unique=True)) / len(a.hashes)


def merge(a: Sketch, b: Sketch) -> Sketch:
    """The sketch of both texts' shingles together; its digest tells the pair apart."""
    return Sketch(a.digest ^ b.digest, np.union1d(a.hashes, b.hashes))


def fingerprint(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of each row."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(map(write, sketches([x or "" for x in b.column("text").to_pylist()])), pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(kernel, f"doc_id {docs.schema[id_col].dataType.simpleString()}, fingerprint string")


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows dealt out by ranges of ids and sorted in each; the first rows of a range also end the range before (tail), the first of all the last."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("place"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # ids alone are read here; what comes to the driver is two numbers for each range
    quantiles = rows.approxQuantile("place", [i / ranges for i in range(1, ranges)], 1 / (8 * ranges)) if ranges > 1 else []
    cuts = np.array(sorted({int(x) for x in quantiles}), np.int64)

    @F.pandas_udf("int")
    def range_of(place: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, place.to_numpy(), side="right").astype(np.int32))

    firsts = dict(rows.select(range_of("place").alias("r"), "place").groupBy("r").agg(F.min("place")).collect())
    order = sorted(firsts)
    before = {firsts[r]: order[i - 1] for i, r in enumerate(order)}
    starts, ends = np.array(sorted(before), np.int64), np.array([before[x] for x in sorted(before)], np.int32)

    @F.pandas_udf("array<int>")
    def targets(place: pd.Series) -> pd.Series:
        own = place.to_numpy()
        at = np.minimum(np.searchsorted(starts, own), max(len(starts) - 1, 0))
        return pd.Series([[r, int(ends[i])] if starts[i] == p else [r] for r, i, p in zip(np.searchsorted(cuts, own, side="right").tolist(), at.tolist(), own.tolist(), strict=True)])

    dealt = rows.select("doc_id", "place", "text", F.posexplode(targets("place")).alias("tail", "target"))
    return dealt.repartitionById(ranges, "target").sortWithinPartitions("tail", "place", "text").select("doc_id", "tail", "text")


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_edited(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each document its fingerprint, that of its edited text (the last quarter replaced by the start of the next document), and the likeness to both."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the last row so far waits for the one after it
        ended = False
        for b in common.slices(batches):
            if ended:
                continue  # further rows of the next range's first id
            ids, tails, texts = b.column("doc_id").to_pylist(), b.column("tail").to_pylist(), [x or "" for x in b.column("text").to_pylist()]
            if 1 in tails:
                n = tails.index(1) + 1
                ids, texts, ended = ids[:n], texts[:n], True
            found = sketches(texts)
            if held:
                ids, texts, found = [held[0], *ids], [held[1], *texts], [held[2], *found]
            held = ids[-1], texts[-1], found[-1]
            edited = [t[: len(t) - len(t) // 4] + after[: len(t) // 4] for t, after in zip(texts[:-1], texts[1:], strict=True)]
            other = sketches(edited)
            n = len(edited)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[:n], pa.int64()), pa.array([len(t) for t in texts[:n]], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
                    pa.array(map(write, found[:n]), pa.string()), pa.array(map(write, other), pa.string()),
                    pa.array([likeness(x, y) for x, y in zip(found[:n], other, strict=True)], pa.float64()), pa.array([likeness(x, y) for x, y in zip(found[:n], found[1:], strict=True)], pa.float64()),
                ],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    return with_next(docs, id_col, text_col).mapInArrow(kernel, EDITED)


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edited(common.table(spark, sf_dir, "documents"))


QUERIES = {"op4_fingerprints": op4_fingerprints}

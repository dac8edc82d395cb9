"""Operator 7, language identification by language-bitmask n-gram filters.

The filters of all languages are one bit-sliced Bloom filter: a slot has a bit for
each language, and the slots of an n-gram, and-ed, give all languages that contain
it. Per language the popcount over a text's n-grams, corrected for the false
positives its fill makes likely, decides.

It learns from about `per_language` labelled documents of each language, chosen by a
hash of the id; every n-gram of theirs is in the language's filter. Each task fills a
filter of its own, and filters are or-ed, so what moves and what is sent are `slots`
bytes for each eight languages, whatever the corpus and however many languages.

Edge cases: null text, or one without a letter, is `und` with score 0; a text with
letters but no known n-gram gets the first language with score 0, one too short for
an n-gram of 5 is judged by those of 3 and 4; rows without a
label teach nothing; without any label all texts are `und`; very long texts are read
whole; of languages with equal counts the first by name is given; repeated rows each
get a row; null ids are neither held out nor learned from; columns of the input that
have the names of the result's are replaced by those; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import common
from textloom.llm.fingerprint import mix

SIZES = (5, 6)
#: Of texts that are too short for those.
SHORT = (3, 4)
PROBES = 2
#: Slots of a filter that move together.
CHUNK = 1 << 15


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point its lower-case letter, or a space."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def grams_of(texts: list[str], sizes: tuple[int, ...] = SIZES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text) of each n-gram with a letter, in runs of non-letters as one space; and whether each text has a letter."""
    table = letters()
    codes = np.frombuffer("".join(f" {t} " for t in texts).encode("utf-32-le"), np.uint32)
    low = table[codes]
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) + 2 for t in texts])
    blank = low == 32
    has = np.bincount(doc[~blank], minlength=len(texts)) > 0
    keep = ~blank | np.concatenate(([True], ~blank[:-1] | (doc[1:] != doc[:-1])))
    low, doc, blank = low[keep].astype(np.uint64), doc[keep], blank[keep]
    hashes, owners = [], []
    h = low
    for n in range(2, max(sizes) + 1):
        h = h[:-1] * np.uint64(0x100000001B3) + low[n - 1 :] + np.uint64(n)
        if n in sizes and len(h):
            ok = (doc[n - 1 :] == doc[: len(h)]) & ~(blank[: len(h)] & blank[1 : len(h) + 1])
            hashes.append(mix(h[ok]))
            owners.append(doc[: len(h)][ok])
    return np.concatenate(hashes) if hashes else np.empty(0, np.uint64), np.concatenate(owners) if owners else np.empty(0, np.int32), has


class Filters:
    """The bit-sliced filter with the languages' names: for each eight languages a byte a slot."""

    def __init__(self, languages: list[str], slots: np.ndarray):
        self.languages, self.slots = languages, slots
        fill = np.array([self.holds(slots, i).mean() for i in range(len(languages))])
        self.false = fill**PROBES

    @classmethod
    def empty(cls, languages: list[str], slots: int) -> np.ndarray:
        return np.zeros((-(-len(languages) // 8), slots), np.uint8)

    @classmethod
    def add(cls, table: np.ndarray, grams: np.ndarray, language: int) -> None:
        """Puts n-grams into a language's filter."""
        for at in cls.places(grams, table.shape[1]):
            table[language // 8, at] |= np.uint8(1 << language % 8)

    @staticmethod
    def holds(masks: np.ndarray, language: int) -> np.ndarray:
        return masks[language // 8] & np.uint8(1 << language % 8) != 0

    @staticmethod
    def places(h: np.ndarray, slots: int) -> list[np.ndarray]:
        return [((h >> np.uint64(32 * p)) & np.uint64(slots - 1)).astype(np.int64) for p in range(PROBES)]

    def _counts(self, texts: list[str], sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: its n-grams, those of them in each language's filter, and whether it has a letter."""
        n = len(texts)
        h, doc, has = grams_of(texts, sizes)
        first, *others = self.places(h, self.slots.shape[1])
        mask = self.slots[:, first]
        for at in others:
            mask &= self.slots[:, at]
        return np.bincount(doc, minlength=n), np.stack([np.bincount(doc[self.holds(mask, i)], minlength=n) for i in range(len(self.languages))]), has

    def judge(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and coverage of each text. Score: the winner's corrected count over its sum with the runner-up's. Coverage: over all n-grams."""
        n = len(texts)
        total, counts, has = self._counts(texts, SIZES)
        short = np.flatnonzero((total == 0) & has)
        if len(short):
            total[short], counts[:, short], _ = self._counts([texts[i] for i in short.tolist()], SHORT)
        fixed = np.maximum(0.0, (counts - self.false[:, None] * total) / (1 - np.minimum(self.false, 0.99))[:, None])
        best = fixed.argmax(axis=0)
        top = fixed[best, np.arange(n)]
        rest = fixed.copy()
        rest[best, np.arange(n)] = 0
        second = rest.max(axis=0)
        score = np.where(top > 0, top / np.maximum(top + second, 1e-9), 0.0)
        cover = np.minimum(1.0, top / np.maximum(total, 1))
        return [self.languages[i] if ok else "und" for i, ok in zip(best.tolist(), has.tolist(), strict=True)], np.where(has, score, 0.0), np.where(has, cover, 0.0)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_language: int = 2000, slots: int = 1 << 22) -> Filters | None:
    """The filters, from the labelled rows of docs; None without any."""
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL")
    counts = dict(rows.groupBy("lang").count().collect())  # a row for each language
    languages = sorted(counts)
    if not languages:
        return None
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    limit = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(int(min(1.0, per_language / counts[k]) * (1 << 30))))])
    sample = rows.where(place < limit[F.col("lang")])
    number = {k: i for i, k in enumerate(languages)}
    chunk = min(CHUNK, slots)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Filters.empty(languages, slots)
        for b in common.slices(batches):
            h, doc, _ = grams_of(b.column("text").to_pylist(), (*SHORT, *SIZES))
            lang = np.array([number[x] for x in b.column("lang").to_pylist()], np.int32)[doc]
            for i in np.unique(lang).tolist():
                Filters.add(table, h[lang == i], i)
        for row, part in enumerate(table.reshape(-1, chunk)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([row], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["part", "bits"])

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for i, raw in zip(b.column("part").to_pylist(), b.column("bits").to_pylist(), strict=True):
                held[i] = held.get(i, np.uint8(0)) | np.frombuffer(raw, np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["part", "bits"])

    schema = "part int, bits binary"
    table = Filters.empty(languages, slots)
    parts = table.reshape(-1, chunk)
    united = sample.select("lang", "text").mapInArrow(fill, schema).repartition(min(len(parts), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "part").mapInArrow(unite, schema)
    for r in united.collect():  # `slots` bytes for each eight languages
        parts[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    return Filters(languages, table)


def predict(docs: DataFrame, filters: Filters | None, *, text_col: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "coverage")) -> DataFrame:
    """docs with three columns more: the language, its score and its coverage; columns of docs with these names are replaced."""
    if text_col in names:
        raise ValueError(f"the text itself has one of the names {names}")
    docs = docs.drop(*names)
    sent = docs.sparkSession.sparkContext.broadcast((filters.languages, filters.slots) if filters else None)
    made: dict[str, Filters] = {}

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if sent.value and "f" not in made:
            made["f"] = Filters(*sent.value)
        for b in common.slices(batches, text_col):
            if sent.value:
                lang, score, cover = made["f"].judge([x or "" for x in b.column(text_col).to_pylist()])
            else:
                lang, score, cover = ["und"] * b.num_rows, np.zeros(b.num_rows), np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(cover, pa.float64())], names=[*b.schema.names, *names])

    from pyspark.sql.types import DoubleType, StringType, StructType

    schema = StructType([*docs.schema.fields]).add(names[0], StringType()).add(names[1], DoubleType()).add(names[2], DoubleType())
    return docs.mapInArrow(kernel, schema)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    filters = learn(docs.where(~held_out() & F.col("lang").isNotNull()))
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), filters).select("doc_id", "held_out", "lang_pred", "score", "coverage")


QUERIES = {"op7_language_id": op7_language_id}

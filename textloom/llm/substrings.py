"""Operator 10, substring removal by suffix automata of reference shards.

A word is removed if a window of `window` words that covers it also starts in a
document with a smaller id. The reference of that question is the corpus itself. As one
broadcast automaton a shard of a million words takes 300 MB and each word streamed
through it a microsecond, and every document must pass every shard, so time would grow
with the square of the corpus (the README has the figures). So the shards are keyed by
anchors instead, and a shard holds all text that could match there.

An anchor of a window is the least hash of its `gram`-word grams; equal windows
have equal anchors. Anchors found in one document only are dropped (a join on
anchors alone). Around the others, runs of windows with one anchor are cut out as
segments; equal segments become one, with their least id. For each anchor the
segments go, in ascending order of that id, through a suffix automaton of those
before: matching statistics of at least `window` words name the least id of each
window. Anchors in more than `hot` documents are too much for one task; there the
key is the whole window, so that only equal windows meet and are summed to one
before they are moved.

`remove_known` is the broadcast form for a reference of a checked size.

Edge cases: null text has no words; null ids count as one document before all
others; rows with equal ids are one document, so they lose nothing to each other;
repeated rows lose the same words; of equal windows the one in the least id stays, and
within one document all do; very long texts are cut into segments like others; texts of
fewer words than the window lose nothing; an empty table gives an empty result; other
columns stay untouched, whatever their names (but those that begin with "__").
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import common
from textloom.llm.common import Workspace
from textloom.llm.fingerprint import mix

FIRST = -(1 << 63)


class SuffixAutomaton:
    """Of sequences added one after another; each state knows the label of the sequence that first made its words."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.label = [-1], [0], [0]

    def _state(self, length: int, link: int, label: int, steps: dict) -> int:
        self.next.append(steps)
        self.link.append(link)
        self.length.append(length)
        self.label.append(label)
        return len(self.link) - 1

    def _split(self, p: int, symbol, q: int) -> int:
        """The part of q that ends p's words with symbol, as a state of its own."""
        clone = self._state(self.length[p] + 1, self.link[q], self.label[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = clone
            p = self.link[p]
        return clone

    def add(self, symbols: Iterable, label: int) -> None:
        last = 0
        for s in symbols:
            q = self.next[last].get(s)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, s, q)
                continue
            new, p = self._state(self.length[last] + 1, 0, label, {}), last
            while p >= 0 and s not in self.next[p]:
                self.next[p][s] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][s]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, s, q)
            last = new

    def matches(self, symbols: Iterable, least: int) -> Iterator[tuple[int, int]]:
        """(end, label) of each run of `least` symbols that the automaton has; end is exclusive."""
        state = size = 0
        for end, s in enumerate(symbols, 1):
            while state and s not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if s in self.next[state]:
                state = self.next[state][s]
                size += 1
            while state and self.length[self.link[state]] >= least:
                state = self.link[state]
                size = self.length[state]
            if size >= least:
                yield end, self.label[state]


def anchors(words: list[list[bytes]], window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, text, window start in the text) of every window, and the window's own hash as a fourth is made by window_keys."""
    sizes = np.array([len(w) for w in words], np.int64)
    flat = np.fromiter((xxhash.xxh3_64_intdigest(x) for own in words for x in own), np.uint64, int(sizes.sum()))
    begins = np.cumsum(sizes) - sizes
    counts = np.maximum(sizes - window + 1, 0)
    if not counts.sum():
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), flat
    h = flat[: len(flat) - gram + 1] * np.uint64(1)
    for j in range(1, gram):
        h = h * np.uint64(0x9E3779B97F4A7C15) + flat[j : len(flat) - gram + 1 + j]
    h = mix(h)
    wide = window - gram + 1
    step = 1
    while 2 * step <= wide:
        h = np.minimum(h[: len(h) - step], h[step:])
        step *= 2
    if step < wide:
        h = np.minimum(h[: len(h) - (wide - step)], h[wide - step :])
    text = np.repeat(np.arange(len(words)), counts)
    start = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    return h[begins[text] + start], text, start, flat


def split(column: pa.Array) -> list[list[bytes]]:
    return [x.split() for x in common.binaries(column)]


def place(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(FIRST))


def find_anchors(window: int, gram: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        rid = (context.partitionId() if context else 0) << 36
        for b in common.slices(batches):
            a, text, _, _ = anchors(split(b.column("text")), window, gram)
            order = np.lexsort((a, text))
            a, text = a[order], text[order]
            fresh = np.ones(len(a), bool)
            fresh[1:] = (a[1:] != a[:-1]) | (text[1:] != text[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(rid, rid + b.num_rows)), b.column("place"), b.column("th"), common.lists(a[fresh].view(np.int64), np.bincount(text[fresh], minlength=b.num_rows), pa.int64())], names=["rid", "place", "th", "anchors"])
            rid += b.num_rows

    return kernel


SEGMENTS = "key long, same long, place long, th long, at int, words string"


def cut_segments(window: int, gram: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            words = split(b.column("text"))
            a, text, start, _ = anchors(words, window, gram)
            bounds = np.searchsorted(text, np.arange(len(words) + 1))
            places, hashes, cold, hot = (b.column(c).to_pylist() for c in ("place", "th", "cold", "hot"))
            out: list[tuple] = []
            for i, own in enumerate(words):
                mine = a[bounds[i] : bounds[i + 1]]
                signed = mine.view(np.int64)
                for at in np.flatnonzero(np.isin(signed, hot[i])).tolist() if hot[i] else ():
                    joined = b" ".join(own[at : at + window])
                    same = xxhash.xxh3_64_intdigest(joined) - (1 << 63)
                    out.append((same, same, places[i], hashes[i], at, joined))
                if cold[i]:
                    shared = np.isin(signed, cold[i])
                    edge = np.flatnonzero(np.concatenate(([True], (mine[1:] != mine[:-1]) | (shared[1:] != shared[:-1]))))
                    for s, e in zip(edge.tolist(), [*edge[1:].tolist(), len(mine)], strict=True):
                        if shared[s]:
                            joined = b" ".join(own[s : e + window - 1])
                            out.append((int(signed[s]), xxhash.xxh3_64_intdigest(joined, 1) - (1 << 63), places[i], hashes[i], s, joined))
            cols = list(zip(*out, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            arrays = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*arrays[:5], arrays[5].cast(pa.string())], names=["key", "same", "place", "th", "at", "words"])

    return kernel


def match_segments(window: int):
    """Rows sorted by (key, first): for each segment the least id of each of its windows, if a document has reason to lose one."""

    def group(key: int, segments: list[tuple[int, int, int, bytes]]) -> Iterator[tuple]:
        automaton = SuffixAutomaton()
        for n, (same, first, last, joined) in enumerate(segments):
            words = joined.split()
            least = [first] * (len(words) - window + 1)
            found = 0
            if n:
                for end, label in automaton.matches(words, window):
                    least[end - window] = label
                    found += 1
            if len(segments) > 1 and found < len(least) and n + 1 < len(segments):
                automaton.add(words, first)
            if min(least) < last:
                yield key, same, least

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = None, []

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) or [()] * 3
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.list_(pa.int64()))], names=["key", "same", "least"])

        for b in common.slices(batches, "words"):
            out: list[tuple] = []
            for k, same, first, last, joined in zip(*(b.column(c).to_pylist() for c in ("key", "same", "first", "last")), common.binaries(b.column("words")), strict=True):
                if k != key:
                    if own:
                        out += group(key, own)
                    key, own = k, []
                own.append((same, first, last, joined))
            yield batch(out)
        if own:
            yield batch(list(group(key, own)))

    return kernel


def find_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 13, gram: int = 5, hot: int = 1000) -> DataFrame:
    """(place, th, found): for documents that may lose words, runs of windows as (at, least id of each window). place is the id, null as the least long; th is xxhash64 of the text."""
    if not 0 < gram <= window:
        raise ValueError("gram must be between 1 and window")
    spark = docs.sparkSession
    ws = Workspace(spark, "substrings")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(place(id_col).alias("place"), F.xxhash64(text).alias("th"), text.alias("text"))
    found = ws.write(rows.mapInArrow(find_anchors(window, gram), "rid long, place long, th long, anchors array<long>"), "anchors")
    each = found.select("rid", F.explode("anchors").alias("anchor"))
    placed = found.select("place", F.explode("anchors").alias("anchor"))
    shared = ws.write(placed.groupBy("anchor").agg(F.min("place").alias("first"), F.max("place").alias("last"), F.count(F.lit(1)).alias("n")).where("first < last").select("anchor", (F.col("n") > hot).alias("hot")), "shared")
    # both sides come from tables, so each has an exchange of its own that Spark can split where an anchor is hot
    mine = each.join(shared, "anchor").groupBy("rid").agg(F.collect_set(F.when(~F.col("hot"), F.col("anchor"))).alias("cold"), F.collect_set(F.when(F.col("hot"), F.col("anchor"))).alias("hot"))
    # of rows with one id and one text the first stands for all
    once = found.groupBy("place", "th").agg(F.min("rid").alias("rid"))
    mine = ws.write(once.join(mine, "rid").drop("rid"), "mine")
    ws.drop("anchors", "shared")
    segments = ws.write(rows.join(mine, ["place", "th"]).mapInArrow(cut_segments(window, gram), SEGMENTS), "segments")
    ws.drop("mine")
    distinct = segments.groupBy("key", "same").agg(F.min("place").alias("first"), F.max("place").alias("last"), F.first("words").alias("words"))
    least = distinct.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "key").sortWithinPartitions("key", "first", "same").mapInArrow(match_segments(window), "key long, same long, least array<long>")
    least = ws.write(least, "least")
    lost = segments.select("key", "same", "place", "th", "at").join(least, ["key", "same"]).where(F.array_min("least") < F.col("place"))
    found = ws.write(lost.groupBy("place", "th").agg(F.collect_set(F.struct("at", "least")).alias("found")), "found")
    ws.drop("segments", "least")
    return found


def removed_words(n: int, place: int, found: list[dict] | None, window: int) -> np.ndarray:
    """Which of n words a window with a smaller id covers."""
    cover = np.zeros(n + 1, np.int64)
    for run in found or ():
        least = np.array(run["least"], np.int64)
        at = run["at"] + np.flatnonzero(least < place)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + window, -1)
    return np.cumsum(cover)[:n] > 0


def _joined(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.withColumns({"__place": place(id_col), "__th": F.xxhash64(text)})
    return keyed.join(found.select(F.col("place").alias("__place"), F.col("th").alias("__th"), F.col("found").alias("__found")), ["__place", "__th"], "left")


def measure_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 13, **options) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of each row."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            out = []
            for words, at, found in zip(split(b.column("text")), b.column("place").to_pylist(), b.column("found").to_pylist(), strict=True):
                gone = removed_words(len(words), at, found, window)
                if found:
                    kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                else:
                    kept = words
                out.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            n, m, s = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(m, pa.int64()), pa.array(s)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    found = find_repeats(docs, id_col=id_col, text_col=text_col, window=window, **options)
    rows = _joined(docs.select(id_col, text_col), found, id_col, text_col).select(F.col(id_col).cast("long").alias("doc_id"), F.col("__place").alias("place"), F.col(text_col).alias("text"), F.col("__found").alias("found"))
    return rows.mapInArrow(kernel, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def cut_words(text: str, gone: np.ndarray) -> str:
    """The text without the words that are gone and the space after each; line ends stay."""
    import re

    out, at = [], 0
    for m, g in zip(re.finditer(r"[^\x20\x09-\x0D]+", text), gone.tolist(), strict=True):
        if g:
            out.append(text[at : m.start()])
            at = m.end() + (text[m.end() : m.end() + 1] == " ")
    return "".join((*out, text[at:]))


def clean(docs: DataFrame, *, window: int = 13, **options) -> DataFrame:
    """docs (doc_id, text and, if there, n_chars) with the repeated words cut; documents left without a word go."""
    found = find_repeats(docs, window=window, **options)
    rows = _joined(docs, found, "doc_id", "text").select(*docs.columns, "__place", "__found")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            texts, keep = [], []
            for text, at, found in zip(b.column("text").to_pylist(), b.column("__place").to_pylist(), b.column("__found").to_pylist(), strict=True):
                if found:
                    text = cut_words(text, removed_words(len(text.encode().split()), at, found, window))
                texts.append(text)
                keep.append(not found or bool(text.encode().split()))
            b = b.drop_columns(["__place", "__found"])
            i, n = b.schema.get_field_index("text"), b.schema.get_field_index("n_chars")
            b = b.set_column(i, b.schema.field(i), pa.array(texts, b.schema.field(i).type))
            if n >= 0:
                b = b.set_column(n, b.schema.field(n), pa.array([len(x or "") for x in texts], b.schema.field(n).type))
            yield b.filter(pa.array(keep))

    return rows.mapInArrow(kernel, docs.schema)


def remove_known(docs: DataFrame, reference: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", reference_col: str = "text", window: int = 13, max_bytes: int = 64 << 20) -> DataFrame:
    """(doc_id, n_words, n_removed): words of windows that also lie in the reference. Its shards are broadcast, so its size is checked: over max_bytes is a ValueError, and find_repeats is the way."""
    size = reference.agg(F.sum(F.octet_length(reference_col))).first()[0] or 0
    if size > max_bytes:
        raise ValueError(f"the reference has {size} bytes; at most {max_bytes} are broadcast")
    shards = docs.sparkSession.sparkContext.broadcast([r[0] for r in reference.select(reference_col).where(F.col(reference_col).isNotNull()).collect()])
    made: list[SuffixAutomaton] = []

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            automaton = SuffixAutomaton()
            for text in shards.value:
                automaton.add(text.encode().split(), 0)
            made.append(automaton)
        for b in common.slices(batches):
            n, m = [], []
            for words in split(b.column("text")):
                cover = np.zeros(len(words) + 1, np.int64)
                for end, _ in made[0].matches(words, window):
                    cover[end - window] += 1
                    cover[end] -= 1
                n.append(len(words))
                m.append(int((np.cumsum(cover)[:-1] > 0).sum()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(m, pa.int64())], names=["doc_id", "n_words", "n_removed"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(kernel, "doc_id long, n_words long, n_removed long")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure_repeats(common.table(spark, sf_dir, "documents"))


QUERIES = {"op10_substring_dedup": op10_substring_dedup}

ORACLE_SQL = {
    "op10_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i+12], ' '))) AS g FROM d WHERE len(w) >= 13),
least AS (SELECT g, min(doc_id) AS first FROM win GROUP BY g HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN least USING (g) WHERE first < doc_id)),
lost AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN ps IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(ps, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN lost USING (doc_id)
"""
}

"""Operator 6, mixture-controlled packing by deficit round-robin over source queues.

Each source is a queue: its documents' tokens in one stream. The corpus is cut
into lanes of some thousand windows. A lane's share of each queue follows from
the queue totals and the target proportions alone, so a lane starts where the
one before stopped, with the fractions of a token it left over as deficits, and
lanes are filled side by side. Within a lane every window adds each queue's
quantum to its deficit, takes as many whole tokens, and gives the last places to
the largest deficits; what is owed goes on to the next window.

The tokens are made once, written to the shared folder with each row's place in
its queue within the writing task: the queues' totals for each task give the rest.
These are broadcast up to `common.SENT_ROWS` rows (tasks times queues), so tokens are
not shuffled; beyond that the join moves them once. A lane's last window is not
full; it becomes sequences of powers of two, so nothing is padded.

Sources with less than a 1 / `max_queues` share of the text, which is under a token in
two windows, share `TAIL` queues by hash; with weights, those without one do.

Edge cases: a null or empty text is its end id alone; a very long text is pieces over
many windows; a null source is a queue of its own; repeated rows are packed each;
ties between equally owed queues go to the first by name; null ids stay null; only the
id, text and source are read, so no other column can clash; an empty table gives no
pieces.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm import common
from textloom.llm.common import Workspace

#: Words and parts of words whose ids a worker keeps; about 30 bytes each, and as much again while some are added.
STORE_WORDS = 800_000
#: Queues of the sources that are too small for one of their own.
TAIL = 64
#: Windows times queues of one lane's plan.
PLAN_CELLS = 1 << 20
#: Marks a word that is to be encoded as it is; line ends never occur in words.
SEVERAL = "\n"


def hashes_of(words: list[str]) -> np.ndarray:
    """128 bits for each, as two numbers."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), np.uint64).reshape(-1, 2)


class IdStore:
    """The ids of words, known by their hashes, in flat arrays."""

    def __init__(self, kind: np.dtype):
        self.low, self.high, self.begin, self.size, self.ids = np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0, kind)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The places of words, -1 for unknown ones."""
        if not len(self.low):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.low, hashes[:, 0]), len(self.low) - 1)
        return np.where((self.low[at] == hashes[:, 0]) & (self.high[at] == hashes[:, 1]), at, -1)

    def add(self, hashes: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        low = np.concatenate((self.low, hashes[:, 0]))
        order = np.argsort(low, kind="stable")
        self.low, self.high = low[order], np.concatenate((self.high, hashes[:, 1]))[order]
        self.begin = np.concatenate((self.begin, (len(self.ids) + np.cumsum(sizes) - sizes).astype(np.int32)))[order]
        self.size = np.concatenate((self.size, sizes.astype(np.int32)))[order]
        self.ids = np.concatenate((self.ids, ids))

    def gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of the words at these places one after another, how many of each)."""
        sizes = self.size[at].astype(np.int64)
        ends = np.cumsum(sizes)
        return self.ids[np.repeat(self.begin[at] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)], sizes


class WordTokenizer:
    """Ids by a tokenizer whose tokens never reach across a space or a line end.

    The words of many texts are cut and numbered by Arrow, and ids are looked up once for
    each different word. Where the tokenizer's own description says that a word falls into
    parts by one pattern, each ending in a token with an end-of-word mark, the parts of
    many new words are encoded as one text and told apart by that mark.
    """

    def __init__(self, data: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(data)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.store = IdStore(self.kind)
        self.pattern = self._pattern(json.loads(data))
        if self.pattern:
            self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True

    @staticmethod
    def _pattern(own: dict):
        steps = (own.get("normalizer") or {}).get("normalizers", [])
        cuts = (own.get("pre_tokenizer") or {}).get("pretokenizers", [])
        known = [x["type"] for x in steps] == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in cuts] == ["Split", "ByteLevel"]
        if not known or own["model"].get("end_of_word_suffix") != "</w>" or not (cuts[0]["invert"] and cuts[0]["behavior"] == "Removed") or cuts[1]["add_prefix_space"] or cuts[1]["use_regex"]:
            return None
        return regex.compile(cuts[0]["pattern"]["Regex"])

    def _split(self, word: str) -> tuple[str, ...] | list[str]:
        """The parts of a word in lower case."""
        if word.isalpha():
            return (word,)
        if word[-1] in ".,!?;:" and word[:-1].isalpha():
            return word[:-1], word[-1]
        return self.pattern.findall(word)

    def _learn(self, words: list[str], hashes: np.ndarray) -> None:
        """Puts the ids of new words into the store."""
        plain = np.array([bool(self.pattern) and w != "" and w[0] != SEVERAL for w in words], bool)
        own = [words[i] for i in np.flatnonzero(plain).tolist()]
        if own:
            split = list(map(self._split, own))
            parts = {p: i for i, p in enumerate(dict.fromkeys(p for x in split for p in x))}
            names, keys = list(parts), hashes_of(list(parts))
            new = np.flatnonzero(self.store.find(keys) < 0)
            if len(new):
                ids = np.array(self.tokenizer.encode_batch_fast([" ".join(names[i] for i in new.tolist())], add_special_tokens=False)[0].ids, self.kind)
                stops = np.flatnonzero(self.ends[ids]) + 1
                if len(stops) != len(new):
                    raise ValueError("the tokenizer does not end each part with an end-of-word token")
                self.store.add(keys[new], ids, np.diff(stops, prepend=0))
            counts = np.array(list(map(len, split)), np.int64)
            several = np.array([len(x) != 1 or x[0] != w for x, w in zip(split, own, strict=True)], bool)  # others are their one part
            at = self.store.find(keys)[np.fromiter((parts[p] for x, s in zip(split, several.tolist(), strict=True) if s for p in x), np.int64, int(counts[several].sum()))]
            ids, sizes = self.store.gather(at)
            before = np.concatenate(([0], np.cumsum(sizes)))
            bounds = np.concatenate(([0], np.cumsum(counts[several])))
            self.store.add(hashes[plain][several], ids, np.diff(before[bounds]))
        rest = np.flatnonzero(~plain)
        if len(rest):
            found = [e.ids for e in self.tokenizer.encode_batch_fast([words[i].removeprefix(SEVERAL) for i in rest.tolist()], add_special_tokens=False)]
            self.store.add(hashes[rest], np.array([x for own in found for x in own], self.kind), np.array(list(map(len, found)), np.int64))

    def _places(self, words: list[str]) -> np.ndarray:
        """Where the store has these different words."""
        hashes = hashes_of(words)
        at = self.store.find(hashes)
        new = at < 0
        if new.any():
            if len(self.store.low) + int(new.sum()) > STORE_WORDS:
                self.store = IdStore(self.kind)
                new[:] = True
            self._learn([words[i] for i in np.flatnonzero(new).tolist()], hashes[new])
            at = self.store.find(hashes)
            if (at < 0).any():
                raise ValueError("two words have one hash")
        return at

    def _plain(self, text: str) -> bool:
        """Below U+0130 lower case is letter for letter and nothing is composed anew, and "<|" may begin a special token."""
        if "<|" in text:
            return False
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return True

    def _words(self, text: str) -> list[str]:
        """The words of any text; those that lower case or special tokens make unsure are marked, to be encoded as they are."""
        words = text.replace("\n", " ").split(" ")
        if not self.pattern:
            return [SEVERAL + w for w in words]
        return [w.lower() if w and max(w) < "\u0130" and "<|" not in w else SEVERAL + w for w in words]

    def _cut(self, column: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """(the words of all texts, bounds of each text's)."""
        texts = column.to_pylist()
        plain = np.array([bool(self.pattern) and self._plain(t) for t in texts], bool)
        pieces = []
        if plain.any():
            low = pa.compute.replace_substring(pa.compute.utf8_lower(column.filter(pa.array(plain))), "\n", " ")
            pieces.append(pa.compute.split_pattern(low, " ").cast(pa.list_(pa.string())))
        if not plain.all():
            pieces.append(pa.array([self._words(texts[i]) for i in np.flatnonzero(~plain).tolist()], pa.list_(pa.string())))
        lists = pieces[0] if len(pieces) == 1 else pa.concat_arrays(pieces).take(pa.array(np.argsort(np.argsort(~plain, kind="stable"))))
        return lists.flatten(), np.concatenate(([0], np.cumsum(np.asarray(pa.compute.list_value_length(lists), np.int64))))

    def encode(self, column: pa.Array, end: int) -> tuple[pa.Array, np.ndarray]:
        """(the ids of each text with the end id, how many) of texts without nulls."""
        if not len(column):
            return pa.array([], pa.binary()), np.empty(0, np.int64)
        words, bounds = self._cut(column)
        coded = words.dictionary_encode()
        at = self._places(coded.dictionary.to_pylist())[np.asarray(coded.indices)]
        ids, sizes = self.store.gather(at)
        totals = np.diff(np.concatenate(([0], np.cumsum(sizes)))[bounds])
        ids = np.insert(ids, np.cumsum(totals), end)
        totals = totals + 1
        offsets = np.concatenate(([0], np.cumsum(totals))).astype(np.int32) * self.kind.itemsize
        return pa.Array.from_buffers(pa.binary(), len(column), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(ids.tobytes())]), totals


_tokenizers: dict[int, WordTokenizer] = {}


def tokenizer(data: str) -> WordTokenizer:
    key = hash(data)
    if key not in _tokenizers:
        _tokenizers[key] = WordTokenizer(data)
    return _tokenizers[key]


class Lanes:
    """The plan: which tokens of each queue go where. It follows from totals, weights and sizes alone, so every task finds the same."""

    def __init__(self, totals: dict[str, int], weights: dict[str, float] | None, length: int, lane_windows: int):
        self.queues = sorted(totals)
        self.totals = np.array([totals[q] for q in self.queues], np.int64)
        self.rates = np.array([weights.get(q, 0.0) if weights else totals[q] for q in self.queues], float)
        if (self.rates < 0).any():
            raise ValueError("weights must not be negative")
        self.rates = np.where(self.rates == 0, self.rates[self.rates > 0].min() * 1e-3 if (self.rates > 0).any() else 1.0, self.rates)
        lane_windows = max(16, min(lane_windows, PLAN_CELLS // max(1, len(self.queues))))
        self.length, self.stride = length, 2 * lane_windows + 64
        self.total = int(self.totals.sum())
        self.count = max(1, self.total // (length * lane_windows))
        # all queues run at their rates until they are empty; total(u) is linear between the times that happens
        self.times = np.unique(self.totals / self.rates)
        self.spent = np.array([np.minimum(self.totals, self.rates * u).sum() for u in self.times])
        # 8 bytes for each window and queue: 128 MB of plans at most
        self.plan = lru_cache(maxsize=min(64, max(4, 16 * PLAN_CELLS // (lane_windows * max(1, len(self.queues))))))(self._plan)
        self.last: dict[int, int] = {}  # the lane each queue was last asked for

    def bounds(self, lane: int) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each queue before the lane, and the fractions owed to it there."""
        if lane >= self.count:
            return self.totals, np.zeros(len(self.totals))
        u = float(np.interp(self.total * (lane / self.count), np.concatenate(([0.0], self.spent)), np.concatenate(([0.0], self.times))))
        exact = np.minimum(self.totals, self.rates * u)
        whole = np.floor(exact).astype(np.int64)
        return whole, exact - whole

    def lane_of(self, queue: int, at: int) -> int:
        """The lane that holds token `at` of the queue."""
        low, high = 0, self.count - 1
        while low < high:
            mid = (low + high + 1) // 2
            if self.bounds(mid)[0][queue] <= at:
                low = mid
            else:
                high = mid - 1
        return low

    def _plan(self, lane: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Tokens before the lane; cumulative grants, (windows + 1, queues); where each queue starts in each window; ends of the sequences of the last window."""
        first, deficit = self.bounds(lane)
        left = self.bounds(lane + 1)[0] - first
        size = int(left.sum())
        windows, rest = divmod(size, self.length)
        quantum = left * (self.length / max(size, 1))
        grants = np.zeros((windows + (rest > 0), len(left)), np.int64)
        for w in range(windows):
            deficit = deficit + quantum
            grant = np.clip(np.floor(deficit).astype(np.int64), 0, left)
            over = int(grant.sum()) - self.length
            while over > 0:  # only by rounding: the least owed give back
                for k in np.argsort(deficit - grant)[:over]:
                    if grant[k] and over > 0:
                        grant[k] -= 1
                        over -= 1
            while over < 0:
                open_ = np.flatnonzero(grant < left)
                best = open_[np.argsort(grant[open_] - deficit[open_], kind="stable")][:-over]
                grant[best] += 1
                over += len(best)
            deficit, left = deficit - grant, left - grant
            grants[w] = grant
        if rest:
            grants[windows] = left
        done = np.zeros((len(grants) + 1, grants.shape[1]), np.int32)
        np.cumsum(grants, axis=0, out=done[1:])
        starts = (np.cumsum(grants, axis=1) - grants).astype(np.int32)
        ends = np.cumsum([1 << i for i in range(rest.bit_length() - 1, -1, -1) if rest >> i & 1]).astype(np.int64)
        return first, done, starts, ends

    def pieces(self, queue: int, begin: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start in the document, length, sequence, offset there) of the pieces of tokens begin to begin + n of the queue."""
        at, lane, out = begin, self.last.get(queue, 0), []
        first, done, starts, ends = self.plan(lane)
        if not first[queue] <= at < first[queue] + done[-1, queue]:
            lane = self.lane_of(queue, begin)
        while at < begin + n:
            first, done, starts, ends = self.plan(lane)
            own, base = done[:, queue], int(first[queue])
            low, high = at - base, min(begin + n - base, int(own[-1]))
            if high > low:
                a, b = int(own.searchsorted(low, side="right")) - 1, int(own.searchsorted(high, side="left"))
                edges = own[a : b + 1].astype(np.int64)
                edges[0], edges[-1] = low, high
                w = np.arange(a, b)
                offset = starts[a:b, queue] + edges[:-1] - own[a:b]
                if len(ends) and b == len(starts):  # the last window: cut at the powers of two too
                    more = ends[(ends > offset[-1]) & (ends < offset[-1] + edges[-1] - edges[-2])]
                    if len(more):
                        edges = np.concatenate((edges[:-1], edges[-2] + more - offset[-1], edges[-1:]))
                        offset = np.concatenate((offset, more))
                    k = ends.searchsorted(offset[b - a - 1 :], side="right")
                    w = np.concatenate((w[:-1], b - 1 + k))
                    offset[b - a - 1 :] -= np.concatenate(([0], ends))[k]
                size = np.diff(edges)
                keep = size > 0  # a window may have no place for the queue
                out.append((edges[:-1][keep] + (base - begin), size[keep], w[keep] + lane * self.stride, offset[keep]))
            self.last[queue] = lane
            at = base + max(high, low)
            lane += 1
        return out[0] if len(out) == 1 else tuple(np.concatenate(x) for x in zip(*out, strict=True))


TOKENS = "doc_id long, queue string, block long, begin long, n long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def queue_of(ws: Workspace, docs: DataFrame, source_col: str, text_col: str, weights: dict[str, float] | None, most: int) -> Column:
    """A queue for each source that has a weight or at least a share of 1 / most of the text; the others, of which no window of `most` tokens holds one, are dealt to TAIL queues by a hash."""
    source = F.coalesce(F.col(source_col).cast("string"), F.lit("\0"))
    if weights is None:
        sizes = ws.write(docs.groupBy(source.alias("source")).agg(F.sum(F.octet_length(F.coalesce(F.col(text_col), F.lit(""))) + 1).alias("bytes")), "sources")
        total = sizes.agg(F.sum("bytes")).first()[0] or 0
        own = [r["source"] for r in sizes.where(F.col("bytes") >= total / most).select("source").collect()]  # `most` at most
    else:
        own = list(weights)
    tail = F.concat(F.lit("\1"), F.pmod(F.xxhash64(source), F.lit(TAIL)).cast("string"))
    return F.when(source.isin(own), source).otherwise(tail) if own else tail


def pack(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", end_id: int = 1, length: int = 2048, weights: dict[str, float] | None = None, lane_windows: int = 1024, max_queues: int = 4096) -> DataFrame:
    """Pieces of all documents; each id lies in exactly one. weights: target token proportions by source, that of the corpus if none."""
    spark = docs.sparkSession
    ws = Workspace(spark, "packing")
    with open(tokenizer_path, encoding="utf-8") as f:
        data = spark.sparkContext.broadcast(f.read())
    queue = queue_of(ws, docs, source_col, text_col, weights, max_queues)

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(data.value)
        block = TaskContext.get().partitionId()
        at: dict[str, int] = {}
        for b in common.slices(batches, limit=4 * common.SLICE_BYTES):  # more text at once holds fewer different words
            ids, sizes = t.encode(pa.compute.fill_null(b.column("text"), "").cast(pa.string()), end_id)
            begins = []
            for q, n in zip(b.column("queue").to_pylist(), sizes.tolist(), strict=True):
                begins.append(at.get(q, 0))
                at[q] = begins[-1] + n
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("queue"), pa.array([block] * len(ids), pa.int64()), pa.array(begins, pa.int64()), pa.array(sizes), ids], names=["doc_id", "queue", "block", "begin", "n", "ids"])

    rows = ws.write(docs.select(F.col(id_col).cast("long").alias("doc_id"), queue.alias("queue"), F.col(text_col).alias("text")).mapInArrow(tokens, TOKENS), "tokens")
    parts = ws.write(rows.groupBy("queue", "block").agg(F.sum("n").alias("n")), "parts")
    totals = {r["queue"]: r["n"] for r in parts.groupBy("queue").agg(F.sum("n").alias("n")).collect()}  # a row for each queue, max_queues or the weights, and TAIL, at most
    bases = ws.write(parts.select("queue", "block", (F.sum("n").over(Window.partitionBy("queue").orderBy("block")) - F.col("n")).alias("base")), "bases")
    lanes = spark.sparkContext.broadcast((totals, weights, length, lane_windows))
    made: dict[str, Lanes] = {}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = made.setdefault("plan", None) or Lanes(*lanes.value)
        made["plan"] = plan
        index = {q: i for i, q in enumerate(plan.queues)}
        kind = tokenizer(data.value).kind
        for b in common.slices(batches, "ids"):
            columns: list[tuple[np.ndarray, ...]] = []
            sums: list[int] = []
            rows_of = zip(*(b.column(c).to_pylist() for c in ("queue", "begin", "n", "ids")), strict=True)
            for queue, begin, n, ids in rows_of:
                made_here = plan.pieces(index[queue], begin, n)
                columns.append(made_here)
                wide = memoryview(np.frombuffer(ids, kind).astype("<u4").tobytes())
                sums += [zlib.crc32(wide[4 * s : 4 * (s + m)]) for s, m in zip(made_here[0].tolist(), made_here[1].tolist(), strict=True)]
            counts = [len(x[0]) for x in columns]
            row = pa.array(np.repeat(np.arange(b.num_rows), counts))
            start, size, sequence, offset = (pa.array(np.concatenate(x)) for x in zip(*columns, strict=True))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(row), start, size, pa.array(sums, pa.int64()), b.column("n").take(row), sequence, offset], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    placed = rows.join(common.sized(bases), ["queue", "block"]).select("doc_id", "queue", (F.col("begin") + F.col("base")).alias("begin"), "n", "ids")
    return placed.mapInArrow(cut, PIECES)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op6_packing": op6_packing}

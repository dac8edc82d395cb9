"""Operator 3, SentencePiece encoding and decoding by vectorised merge rounds.

A text is cut where no piece of the vocabulary can reach across, into words of
a run of spaces and what follows it. The words of many documents that are not in
the worker's bounded cache lie in one flat symbol array. A round finds the least
pair rank of each word (a segmented minimum), merges all its leftmost
non-overlapping occurrences at once, and compacts the array; a word without a
pair is done and leaves. Several merges of a word in one round are the same as
the library's one-by-one order unless one of them makes a pair that ranks as
well or better; such a word gets its leftmost merge alone in that round.

Only what the library does for byte-pair models with the identity normaliser,
a dummy prefix and byte fallback is covered; other models raise ValueError.

Edge cases: null text is empty; an empty text is the begin and end ids alone;
unknown characters fall back to bytes; a very long word takes as many rounds as
it has different ranks, a very long text is many words; equal pairs merge from the left;
null or repeated ids and repeated rows stay as they are; only the named columns are
read, so no other can clash; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import common

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
NO_PAIR = np.int32(2**31 - 1)
CACHE_WORDS = 250_000
SEGMENT = re.compile(f"{SPACE}+[^{SPACE}]*")


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol-buffer message."""
    at, end = 0, len(data)

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < end:
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = varint() if kind == 2 else 4 if kind == 5 else 8
            yield tag >> 3, data[at : at + n]
            at += n


class PieceCodec:
    def __init__(self, model: bytes):
        self.pieces, scores, self.types = [], [], []
        spec: dict[int, int | bytes] = {}
        trainer: dict[int, int | bytes] = {}
        for number, value in fields(model):
            if number == 1:
                own = dict(fields(value))
                self.pieces.append(own.get(1, b"").decode())
                scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                self.types.append(own.get(3, NORMAL))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                spec = dict(fields(value))
        if trainer.get(3, 1) != 2 or not trainer.get(35, 0):
            raise ValueError("only byte-pair models with byte fallback are covered")
        if spec.get(2) or not spec.get(3, 1) or spec.get(4, 1) or not spec.get(5, 1):
            raise ValueError("only the identity normaliser with a dummy prefix and kept spaces is covered")
        if {USER, UNUSED} & set(self.types):
            raise ValueError("user-defined and unused pieces are not covered")
        normal = {p: i for i, p in enumerate(self.pieces) if self.types[i] == NORMAL}
        if any(SPACE in p.lstrip(SPACE) for p in normal):
            raise ValueError("a piece reaches across words")
        self.bos = self.types.index(CONTROL) if CONTROL in self.types else -1
        self.eos = self.pieces.index("</s>")
        self.bytes_of = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.types[i] == BYTE}
        # symbols: ids of normal pieces, then characters that only occur inside pieces
        symbol = dict(normal)
        for p in normal:
            for c in p:
                symbol.setdefault(c, len(self.pieces) + len(symbol))
        self.width = max(symbol.values()) + 1
        order = {s: r for r, s in enumerate(sorted({scores[i] for i in normal.values()}, reverse=True))}
        rows = [(symbol[p[:k]] * self.width + symbol[p[k:]], order[scores[i]], i) for p, i in normal.items() for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol]
        rows.sort()
        self.keys, self.ranks, self.merged = (np.array(x, d) for x, d in zip(zip(*rows, strict=True), (np.int64, np.int32, np.int32), strict=True))
        chars = sorted((ord(c), i) for c, i in symbol.items() if len(c) == 1)
        self.char_codes, self.char_ids = np.array([x[0] for x in chars], np.uint32), np.array([x[1] for x in chars], np.int32)
        self.cache: dict[str, bytes] = {}
        surface = [self.surface(i) for i in range(len(self.pieces))]
        self.surface_at = np.cumsum([0, *map(len, surface)])
        self.surface_bytes = np.frombuffer(b"".join(surface), np.uint8)
        self.kinds = np.array(self.types)
        self.starts_space = np.array([p.startswith(SPACE) and t == NORMAL for p, t in zip(self.pieces, self.types, strict=True)])

    def surface(self, i: int) -> bytes:
        kind = self.types[i]
        if kind == BYTE:
            return bytes([int(self.pieces[i][3:5], 16)])
        return b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else self.pieces[i].replace(SPACE, " ").encode()

    # encoding

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged id of each pair; NO_PAIR where no piece is made. Negative symbols never pair."""
        key = left.astype(np.int64) * self.width + right
        key[(left < 0) | (right < 0)] = -1
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], NO_PAIR), self.merged[at]

    def merge(self, words: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each word."""
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        at = np.minimum(np.searchsorted(self.char_codes, codes), len(self.char_codes) - 1)
        sym = np.where(self.char_codes[at] == codes, self.char_ids[at], -1 - codes.astype(np.int64)).astype(np.int32)
        word = np.repeat(np.arange(len(words), dtype=np.int32), [len(w) for w in words])
        rank = np.full(len(sym), NO_PAIR, np.int32)
        made = np.zeros(len(sym), np.int32)
        if len(sym) > 1:
            inside = np.flatnonzero(word[1:] == word[:-1])
            rank[inside], made[inside] = self.pair(sym[inside], sym[inside + 1])
        done_word, done_sym = [], []
        while len(sym):
            starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            least = np.minimum.reduceat(rank, starts)
            lengths = np.diff(np.append(starts, len(sym)))
            of_symbol = np.repeat(least, lengths)
            over = of_symbol == NO_PAIR
            if over.any():
                done_word.append(word[over])
                done_sym.append(sym[over])
                keep = ~over
                sym, word, rank, made, of_symbol = sym[keep], word[keep], rank[keep], made[keep], of_symbol[keep]
                if not len(sym):
                    break
            pos = np.flatnonzero(rank == of_symbol)
            # of a run of overlapping pairs every second one, from its left end
            new_run = np.concatenate(([True], pos[1:] != pos[:-1] + 1))
            first = np.maximum.accumulate(np.where(new_run, np.arange(len(pos)), 0))
            pos = pos[(np.arange(len(pos)) - first) % 2 == 0]
            pos = self.safe(pos, sym, word, rank, made)
            sym[pos] = made[pos]
            keep = np.ones(len(sym), bool)
            keep[pos + 1] = False
            at = np.cumsum(keep)[pos] - 1
            sym, word, rank, made = sym[keep], word[keep], rank[keep], made[keep]
            touched = np.zeros(len(sym), bool)
            touched[at] = touched[at[at > 0] - 1] = True
            dirty = np.flatnonzero(touched)
            rank[dirty] = NO_PAIR
            dirty = dirty[dirty < len(sym) - 1]
            dirty = dirty[word[dirty] == word[dirty + 1]]
            rank[dirty], made[dirty] = self.pair(sym[dirty], sym[dirty + 1])
        word, sym = (np.concatenate(x) if x else np.empty(0, np.int32) for x in (done_word, done_sym))
        order = np.argsort(word, kind="stable")
        return self.spell(word[order], sym[order], len(words))

    def safe(self, pos: np.ndarray, sym: np.ndarray, word: np.ndarray, rank: np.ndarray, made: np.ndarray) -> np.ndarray:
        """The merges that may happen at once: of a word where one would make a pair of as good a rank, the leftmost alone."""
        own = word[pos]
        first = np.concatenate(([True], own[1:] != own[:-1]))
        several = ~first | np.concatenate((~first[1:], [False]))
        if not several.any():
            return pos
        where = np.flatnonzero(several)
        p = pos[where]
        best = np.full(len(p), NO_PAIR, np.int32)
        left = np.maximum(p - 1, 0)
        has = (p > 0) & (word[left] == word[p])
        before = np.concatenate(([-9], pos))[where]  # the merge to the left, in order
        symbol = np.where(before == p - 2, made[np.maximum(p - 2, 0)], sym[left])
        best[has] = self.pair(symbol[has], made[p[has]])[0]
        right = np.minimum(p + 2, len(sym) - 1)
        has = (p + 2 < len(sym)) & (word[right] == word[p])
        best[has] = np.minimum(best[has], self.pair(made[p[has]], sym[right[has]])[0])
        bad = np.unique(word[p[best <= rank[p]]])
        return pos[first | ~np.isin(own, bad)]

    def spell(self, word: np.ndarray, sym: np.ndarray, n: int) -> list[bytes]:
        """Ids of each word: unknown characters, and those only known inside pieces, as bytes."""
        ends = np.searchsorted(word, np.arange(n + 1))
        plain = (sym >= 0) & (sym < len(self.pieces))
        ids = sym.astype("<u4").tobytes()
        out = [ids[4 * a : 4 * b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        inner = dict(zip(self.char_ids.tolist(), self.char_codes.tolist(), strict=True)) if not plain.all() else {}
        for w in np.unique(word[~plain]).tolist():
            own: list[int] = []
            for s in sym[ends[w] : ends[w + 1]].tolist():
                own += [s] if 0 <= s < len(self.pieces) else [self.bytes_of[b] for b in chr(inner[s] if s >= 0 else -1 - s).encode()]
            out[w] = np.array(own, "<u4").tobytes()
        return out

    def words(self, text: str) -> list[str]:
        """Cache keys: with a space mark in front, the segment as it is; else the segment follows a space, or starts with its newline."""
        if SPACE in text or "  " in text or " \n" in text or text[0] in " \n":
            return SEGMENT.findall(SPACE + text.replace(" ", SPACE))
        return text.replace("\n", " \n").split(" ")

    def encode(self, texts: list[str], marks: bool = True) -> list[bytes]:
        """Ids of each text, with begin and end ids if marks, as little-endian unsigned 32-bit integers."""
        keys = [self.words(t) if t else [] for t in texts]
        wanted: set[str] = set().union(*keys)
        missing = list(wanted.difference(self.cache))
        if len(self.cache) + len(missing) > CACHE_WORDS:
            self.cache.clear()
            missing = list(wanted)
        self.cache.update(zip(missing, self.merge([k if k[:1] in (SPACE, "\n") else SPACE + k for k in missing]), strict=True))
        head, tail = (struct.pack("<I", i) if marks else b"" for i in (self.bos, self.eos))
        get = self.cache.__getitem__
        return [b"".join((head, *map(get, own), tail)) for own in keys]

    # decoding

    def decode(self, ids: Iterable[bytes]) -> list[str]:
        arrays = [np.frombuffer(x, "<u4") for x in ids]
        flat = np.concatenate(arrays).astype(np.int64) if arrays else np.empty(0, np.int64)
        if len(flat) and flat.max() >= len(self.pieces):
            raise IndexError("piece id is out of range")
        sizes = np.diff(self.surface_at)[flat]
        ends = np.cumsum(sizes)
        source = np.repeat(self.surface_at[flat] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)
        data = self.surface_bytes[source].tobytes()
        out, at = [], 0
        kinds = self.kinds[flat]
        for own in arrays:
            n = len(own)
            kind = kinds[at : at + n]
            inner = (kind == CONTROL) & (np.arange(n) > 0) & (np.arange(n) < n - 1)
            begin, end = (int(ends[i - 1]) if i else 0 for i in (at, at + n))
            text = None
            if not inner.any():
                try:
                    text = data[begin:end].decode()
                except UnicodeDecodeError:
                    pass
            if text is None:
                text = self.decode_slowly(own.tolist())
            else:
                real = np.flatnonzero(kind != CONTROL)[:1]
                if len(real) and self.starts_space[own[real[0]]]:
                    text = text[1:]
            out.append(text)
            at += n
        return out

    def decode_slowly(self, ids: list[int]) -> str:
        """One id after another, for ids no encoder makes: broken byte runs, or marks inside."""
        out: list[str] = []
        run = bytearray()
        seen = False

        def flush() -> None:
            at = 0
            while at < len(run):
                for n in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[at : at + n]).decode())
                        break
                    except UnicodeDecodeError:
                        pass
                else:
                    n = 1
                    out.append("�")
                at += n
            run.clear()

        for i in ids:
            if self.types[i] == BYTE:
                run += self.surface(i)
                continue
            flush()
            text = self.surface(i).decode()
            if not seen and not any(out) and self.starts_space[i]:
                text, seen = text[1:], True
            out.append(text)
        flush()
        return "".join(out)


_codecs: dict[int, PieceCodec] = {}


def codec(model: bytes) -> PieceCodec:
    """One for each model and Python worker."""
    key = hash(model)
    if key not in _codecs:
        _codecs[key] = PieceCodec(model)
    return _codecs[key]


def encode(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", marks: bool = True, decoded: bool = False) -> DataFrame:
    """(doc_id, ids binary): ids as little-endian unsigned 32-bit integers; with `decoded` also what decode(ids) gives."""
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model.value)
        for b in common.slices(batches):
            ids = c.encode([x or "" for x in b.column("text").to_pylist()], marks)
            cols = [b.column("doc_id"), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(c.decode(ids), pa.string())] * decoded, names=["doc_id", "ids", "decoded"][: 2 + decoded])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(kernel, f"doc_id {docs.schema[id_col].dataType.simpleString()}, ids binary" + ", decoded string" * decoded)


def decode(encoded: DataFrame, model_path: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, decoded): the text of each row's ids; null ids give an empty text."""
    with open(model_path, "rb") as f:
        model = encoded.sparkSession.sparkContext.broadcast(f.read())

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model.value)
        for b in common.slices(batches, "ids"):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(c.decode([x or b"" for x in b.column("ids").to_pylist()]), pa.string())], names=["doc_id", "decoded"])

    return encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(kernel, f"doc_id {encoded.schema[id_col].dataType.simpleString()}, decoded string")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    rows = encode(common.table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), decoded=True)
    return rows.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


QUERIES = {"op3_sentencepiece": op3_sentencepiece}

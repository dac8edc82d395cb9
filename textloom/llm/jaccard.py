"""Operator 8, n-gram Jaccard join with set-relation skipping.

A document's set is its distinct `shingle`-word shingles in lower case (A-Z). Equal
sets are one from the start. Tokens have one order for all: first those of a single
set, then by the number of documents they are in, counted exactly. Two sets alike
enough share a token among the first n - ceil(threshold * n) + 1 of both; as rare
tokens come first, few sets have any token there that another set has too, and only
these tokens are the index.

Counting moves each token once, as 48 bits in a blob for each pair of a task and a
bucket; what comes back is only the tokens of several documents, which are all that
overlaps can consist of. Tokens so frequent that they would swell a bucket (found in
a sample of bounded size) are not moved at all and come last in the order.

Index-level skipping: a list is sorted by size and position and compared block by
block; blocks whose sizes, or what their positions leave, are too little for an
overlap are skipped whole. What remains is held against each other by parity bitmaps
of two bits for each token: the bits in which two differ are at most the tokens in
which the sets differ, so what this drops can't be linked. Sets that may be linked,
over all lists, form families; a set moves once, to its family. Answer-level
skipping: in a family, a set's overlaps are computed against the others still
undecided; for a set that differs from it in d tokens the answers follow within d of
those, and sets already in one component are not compared.

Lists and families over `limit` members are cut into blocks, each with the member
that has most in common with others. Members of one block that find no link to the
largest component of their list are compared with its other blocks; the rest needs
no comparison, so a group of copies costs its size, not its square.

Links leave a task as stars, so a group of copies makes as many rows as it has
members. Larger components are joined over tables; nothing but the frequent tokens
(`HOT_TOKENS` at most) and row counts comes to the driver.

Edge cases: null or blank text has the empty set, which is linked with nothing;
fewer words than a shingle are one shingle of their own; rows with equal ids each
get a row; a component of null ids alone has the component id null; very long texts
are whole sets like any other; ties in size or frequency go by token; other columns
of the input are not read, so none can clash; an empty table gives an empty result.
Sets are told apart by 64-bit hashes, tokens by 48 bits and their bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import common
from textloom.llm.common import Workspace
from textloom.llm.components import components
from textloom.llm.fingerprint import mix

FIRST = -(1 << 63)
#: Documents looked at for frequent tokens; a token in HOT_LEAST of them is one, the HOT_TOKENS most frequent at most.
HOT_SAMPLE, HOT_LEAST, HOT_TOKENS = 8192, 16, 1 << 16
#: Text whose tokens are counted in one task, and tokens of one blob unit.
BUCKET_BYTES, UNIT_TOKENS, UNIT_DOCS = 12 << 20, 1 << 20, 1 << 16
#: Document counts are kept to 16 bits; frequent tokens come after all others.
MANY = 60_000
#: Rows of a list that are skipped or compared together.
RUN = 32
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ascending distinct 64-bit tokens of all texts, bounds of each text)."""
    words = [t.lower().split() for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    flat = np.fromiter((xxhash.xxh3_64_intdigest(x) for own in words for x in own), np.uint64, int(sizes.sum()))
    counts = np.maximum(sizes - k + 1, 0)
    begins = np.cumsum(sizes) - sizes
    text = np.repeat(np.arange(len(texts)), counts)
    at = begins[text] + np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    h = np.zeros(len(at), np.uint64)
    for j in range(k):
        h = h * MULTIPLIER + flat[at + j]
    h = mix(h)
    short = np.flatnonzero((sizes > 0) & (sizes < k))
    if len(short):
        text = np.concatenate((text, short))
        h = np.concatenate((h, np.array([xxhash.xxh3_64_intdigest(b" ".join(words[i]), 7) for i in short.tolist()], np.uint64)))
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    h, text = h[fresh], text[fresh]
    return h, np.searchsorted(text, np.arange(len(texts) + 1))


def set_key(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


def prefix_length(n, num: int, den: int):
    """Works on numbers and on arrays."""
    return n - -(-num * n // den) + 1


def overlap_needed(a, b, num: int, den: int):
    """The least intersection with which sizes a and b reach num/den; numbers or arrays."""
    return -(-num * (a + b) // (num + den))


# exact document counts


def pack_owners(owners: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.diff(owners, prepend=0).astype("<u2").tobytes())


def unpack_owners(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), "<u2").astype(np.int64))


def pack_tokens(tokens: np.ndarray) -> bytes:
    """The low 48 bits of each."""
    return tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack_tokens(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8").astype(np.uint64)


#: bucket is null in the row of a document, -1 in a blob of frequent tokens; idx is the document's place in its unit.
ROWS = "target int, bucket int, unit long, idx int, place long, doc_id long, key long, n long, tokens binary, owners binary, counts binary"
NAMES = [x.split()[0] for x in ROWS.split(", ")]
KINDS = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]


def row_batch(rows: int, /, **columns) -> pa.RecordBatch:
    arrays = [columns[c] if isinstance(columns.get(c), pa.Array) else pa.nulls(rows, t) if c not in columns else pa.array(columns[c], t) for c, t in zip(NAMES, KINDS, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=NAMES)


def deal_tokens(k: int, buckets: int, hot):
    """A row for each document; for each unit of documents a blob of tokens for each bucket, and one of frequent tokens with their ranks."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        task, serial = (context.partitionId() if context else 0), 0
        frequent, places = hot.value
        held: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        docs = size = 0

        def unit() -> int:
            return (task << 24) + serial

        def target() -> int:
            return (task * 7919 + serial) % buckets

        def blobs() -> Iterator[pa.RecordBatch]:
            tokens, own = np.concatenate(held), np.concatenate(owners)
            if len(frequent) and len(tokens):
                at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
                is_hot = frequent[at] == tokens
                if is_hot.any():
                    yield row_batch(1, target=[target()], bucket=[-1], unit=[unit()], tokens=[tokens[is_hot].tobytes()], owners=[pack_owners(own[is_hot])], counts=[places[at[is_hot]].astype("<u2").tobytes()])
                    tokens, own = tokens[~is_hot], own[~is_hot]
            bucket = (((tokens >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int32 if buckets > 1 << 16 else np.uint16)
            order = np.argsort(bucket, kind="stable")
            tokens, own = tokens[order], own[order]
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            used = np.flatnonzero(np.diff(edges)).tolist()
            for some in (used[i : i + 256] for i in range(0, len(used), 256)):
                yield row_batch(len(some), target=some, bucket=some, unit=[unit()] * len(some), tokens=[pack_tokens(tokens[edges[i] : edges[i + 1]]) for i in some], owners=[pack_owners(own[edges[i] : edges[i + 1]]) for i in some])

        for b in common.slices(batches):
            tokens, bounds = shingle_sets(common.binaries(b.column("text")), k)
            if held and (size + len(tokens) > UNIT_TOKENS or docs + b.num_rows > UNIT_DOCS):
                yield from blobs()
                held, owners, docs, size, serial = [], [], 0, 0, serial + 1
            keys = [set_key(tokens[s:e]) if e > s else None for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            sizes = np.diff(bounds)
            n = b.num_rows
            yield row_batch(n, target=(target() + np.arange(n, dtype=np.int32)) % buckets, unit=[unit()] * n, idx=np.arange(docs, docs + n, dtype=np.int32), place=b.column("place"), doc_id=b.column("doc_id"), key=keys, n=sizes.astype(np.int64))
            held.append(tokens)
            owners.append(np.repeat(np.arange(docs, docs + n), sizes))
            docs, size = docs + n, size + len(tokens)
        if held:
            yield from blobs()

    return kernel


def count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In the task of a bucket: its blobs come back with the document count of each token, without those in one document; other rows pass."""
    blobs: dict[int, list[tuple[int, bytes, bytes]]] = {}
    for b in batches:
        bucket = np.asarray(pa.compute.fill_null(b.column("bucket"), -1))
        passing = bucket < 0
        if passing.any():
            yield b.filter(pa.array(passing))
        own = b.filter(pa.array(~passing))
        for i, *blob in zip(*(own.column(c).to_pylist() for c in ("bucket", "unit", "tokens", "owners")), strict=True):
            blobs.setdefault(i, []).append(tuple(blob))
    for i in list(blobs):
        units = blobs.pop(i)
        tokens = np.concatenate([unpack_tokens(t) for _, t, _ in units])
        sizes = [len(t) // 6 for _, t, _ in units]
        order = np.argsort(tokens)
        ranked = tokens[order]
        edges = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1], [True])))
        counts = np.empty(len(tokens), np.int64)
        counts[order] = np.repeat(np.diff(edges), np.diff(edges))
        del order, ranked
        ids = np.uint64(i * int(MULTIPLIER) % (1 << 64)) ^ tokens
        at = 0
        for (unit, _, owners), n in zip(units, sizes, strict=True):
            several = counts[at : at + n] > 1
            if several.any():
                c = np.minimum(counts[at : at + n][several], MANY).astype("<u2")
                yield row_batch(1, bucket=[i], unit=[unit], tokens=[ids[at : at + n][several].tobytes()], owners=[pack_owners(unpack_owners(owners)[several])], counts=[c.tobytes()])
            at += n


def parity(tokens: np.ndarray) -> bytes:
    """Two bits or more for each token, flipped by each token that has it; a power of two, 64 at least."""
    width = max(64, 2 << (len(tokens) - 1).bit_length())
    odd = np.bincount((tokens & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(bits: bytes, size: int) -> np.ndarray:
    """The parities of fewer residues; size in bytes, a power of two."""
    out = np.frombuffer(bits, np.uint8)
    while len(out) > size:
        out = out[: len(out) // 2] ^ out[len(out) // 2 :]
    return out


SETS = "key long, n long, m long, prefix array<long>, shared binary, bits binary"


def index_sets(num: int, den: int):
    """In the order of units: for each first document of a set that has a shared token in its prefix, those tokens, all its shared tokens, and their bitmap.

    A token is shared if more documents have it than there are copies of the set. m is the number of shared tokens.
    """

    def made(rows: list[tuple[int, int, int, int]], blobs: list[tuple[bytes, bytes, bytes]]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary()]
        names = ["key", "n", "m", "prefix", "shared", "bits"]
        out: list[tuple] = []
        if rows and blobs:
            place = np.full(UNIT_DOCS, -1, np.int64)
            idx, keys, n, copies = (np.array(x) for x in zip(*rows, strict=True))
            place[idx] = np.arange(len(rows))
            token = np.concatenate([np.frombuffer(t, np.uint64) for t, _, _ in blobs])
            own = place[np.concatenate([unpack_owners(o) for _, o, _ in blobs])]
            count = np.concatenate([np.frombuffer(c, "<u2") for _, _, c in blobs]).astype(np.int64)
            keep = own >= 0
            token, own, count = token[keep], own[keep], count[keep]
            keep = (count > copies[own]) | (count >= MANY)
            token, own, count = token[keep], own[keep], count[keep]
            shared = np.bincount(own, minlength=len(rows))
            left = prefix_length(n, num, den) - (n - shared)  # prefix tokens that are shared
            keep = left[own] > 0
            token, own, count = token[keep], own[keep], count[keep]
            order = np.lexsort((token, count, own))
            token, own = token[order], own[order]
            edges = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1], [True]))) if len(own) else np.zeros(1, np.int64)
            for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                i = int(own[s])
                mine = np.sort(token[s:e])
                out.append((int(keys[i]), int(n[i]), e - s, token[s : s + int(left[i])].view(np.int64), mine.tobytes(), parity(mine)))
        columns = list(zip(*out, strict=True)) or [()] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows, blobs = None, [], []
        for b in batches:
            for unit, idx, key, n, copies, *blob in zip(*(b.column(c).to_pylist() for c in ("unit", "idx", "key", "n", "copies", "tokens", "owners", "counts")), strict=True):
                if unit != at:
                    yield made(rows, blobs)
                    at, rows, blobs = unit, [], []
                if key is None:
                    blobs.append(tuple(blob))
                else:
                    rows.append((idx, key, n, copies))
        yield made(rows, blobs)

    return kernel


# lists and families: what may be linked, and what is


def groups_of(ok: np.ndarray) -> list[np.ndarray]:
    """Components of two or more of a symmetric matrix of pairs."""
    out, left = [], ok.any(axis=1)
    while left.any():
        own = np.zeros(len(ok), bool)
        new = own.copy()
        new[int(left.argmax())] = True
        while new.any():
            own |= new
            new = ok[new].any(axis=0) & ~own
        out.append(np.flatnonzero(own))
        left &= ~own
    return out


def told_apart(labels: list[int | None]) -> np.ndarray:
    """Numbers for labels; each None is one of its own."""
    seen: dict[int, int] = {}
    return np.array([-1 - i if x is None else seen.setdefault(x, len(seen)) for i, x in enumerate(labels)], np.int64)


def possible_groups(sizes: list[int], shared: list[int], positions: list[int], bits: list[bytes], labels: list[int | None], num: int, den: int) -> list[np.ndarray]:
    """Positions of the members of a list that may be linked, by component of the pairs that sizes, positions and bitmaps leave.

    Members with one label are known to be in one component, and are not compared.
    A pair is met at its first common token too, where no overlap lies before it.
    """
    if len(sizes) == 2:
        need = overlap_needed(*sizes, num, den)
        if min(m - p for m, p in zip(shared, positions, strict=True)) < need or labels[0] is not None and labels[0] == labels[1]:
            return []
        x, y = (int.from_bytes(folded(b, min(map(len, bits))).tobytes(), "little") for b in bits)
        return [np.arange(2)] if (sum(shared) - (x ^ y).bit_count()) // 2 >= need else []
    n, m = np.array(sizes, np.int64), np.array(shared, np.int64)
    left = m - np.array(positions, np.int64)
    order = np.lexsort((-left, n))  # by size, then by position
    n, m, left = n[order], m[order], left[order]
    label = told_apart(labels)[order]
    width = min(map(len, bits))
    table = np.stack([folded(bits[i], width) for i in order.tolist()])
    if width % 8 == 0:
        table = table.view(np.uint64)
    ok = np.zeros((len(n), len(n)), bool)
    starts = range(0, len(n), RUN)
    most = [int(left[i : i + RUN].max()) for i in starts]
    for a, i in enumerate(starts):
        x = slice(i, i + RUN)
        for b in range(a, len(most)):
            y = slice(b * RUN, b * RUN + RUN)
            if num * n[y][0] > den * n[x][-1]:
                break  # the sizes grow on
            if min(most[a], most[b]) < overlap_needed(int(n[x][0]), int(n[y][0]), num, den):
                continue
            both = m[x][:, None] + m[y][None, :]
            need = overlap_needed(n[x][:, None], n[y][None, :], num, den)
            fits = np.minimum(left[x][:, None], left[y][None, :]) >= need
            if not fits.any():
                continue
            differ = np.bitwise_count(table[x][:, None, :] ^ table[y][None, :, :]).sum(axis=2, dtype=np.int64)
            fits &= (both - differ) // 2 >= need
            fits &= label[x][:, None] != label[y][None, :]
            ok[x, y] = fits
            ok[y, x] = fits.T
    np.fill_diagonal(ok, False)
    return [order[g] for g in groups_of(ok)]


class Overlaps:
    """Intersection sizes of one set with all in a list, by a matrix of the tokens that at least two have."""

    def __init__(self, sets: list[np.ndarray]):
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        self.sets, self.bounds = sets, np.cumsum([0, *map(len, sets)])
        values, token, count = np.unique(flat, return_inverse=True, return_counts=True)
        shared = count > 1
        columns = int(shared.sum())
        self.matrix = None
        if columns * len(sets) <= 16 << 20:
            place = np.cumsum(shared) - 1
            keep = shared[token]
            self.matrix = np.zeros((len(sets), columns), np.float32)
            self.matrix[owner[keep], place[token[keep]]] = 1
        else:
            self.flat = flat

    def of(self, i: int) -> np.ndarray:
        if self.matrix is not None:
            return (self.matrix @ self.matrix[i]).astype(np.int64)
        hit = np.concatenate((np.isin(self.flat, self.sets[i]), [False]))
        out = np.add.reduceat(hit, self.bounds[:-1], dtype=np.int64)
        return np.where(np.diff(self.bounds) > 0, out, 0)


def links_of(keys: list[int], size: list[int], sets: list[np.ndarray], labels: list[int | None], num: int, den: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among sets of the given sizes, of which the shared tokens are given. Sets with one label are in one component already."""
    n = len(keys)
    size = np.array(size, np.int64)
    label = told_apart(labels)
    links = []
    if n == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        return [(keys[0], keys[1])] if label[0] != label[1] and den * both >= num * (int(size.sum()) - both) else []
    overlaps = Overlaps(sets)
    undecided = label[:, None] != label[None, :]
    undecided &= (den * size[:, None] >= num * size[None, :]) & (den * size[None, :] >= num * size[:, None])
    need = overlap_needed(size[:, None], size[None, :], num, den)
    for i in np.argsort(-undecided.sum(axis=1), kind="stable").tolist():
        if not (undecided[i] & (label != label[i])).any():
            continue
        inter = overlaps.of(i)
        asked = undecided[i] & (inter >= need[i])
        for j in np.flatnonzero(asked).tolist():
            if label[j] != label[i]:
                links.append((keys[i], keys[j]))
                label[label == label[j]] = label[i]
        undecided[i] = undecided[:, i] = False
        # sets like this one: their answers lie within what they have beside it
        for j in np.flatnonzero(inter >= need[i]).tolist():
            if undecided[j].any():
                no = inter + (size[j] - inter[j]) < need[j]
                yes = undecided[j] & (inter - (size[i] - inter[j]) >= need[j])
                for z in np.flatnonzero(yes).tolist():
                    if label[z] != label[j]:
                        links.append((keys[j], keys[z]))
                        label[label == label[z]] = label[j]
                undecided[j] &= ~(no | yes)
                undecided[:, j] &= ~(no | yes)
    return links


def stars(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(key, least key of its component) for each key of the pairs."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        root.setdefault(a, a)
        root.setdefault(b, b)
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [(x, find(x)) for x in root]


def over_blocks(columns: list[str], by: str, pairs_of: Callable[..., list[tuple[int, int]]]):
    """For rows sorted by (list, block): (a, b) of each member of a group and its least. pairs_of: key and the given columns as lists -> pairs of keys."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, {}

        def ended() -> list[tuple[int, int]]:
            return stars(pairs_of(list(own), *map(list, zip(*own.values(), strict=True)))) if len(own) > 1 else []

        def batch(rows: list[tuple[int, int]]) -> pa.RecordBatch:
            a, b = zip(*rows, strict=True) if rows else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for b in common.slices(batches, by):
            out: list[tuple[int, int]] = []
            for i, block, key, *values in zip(*(b.column(c).to_pylist() for c in ("list", "block", "key", *columns)), strict=True):
                if (i, block) != at:
                    out += ended()
                    at, own = (i, block), {}
                own[key] = values
            yield batch(out)
        yield batch(ended())

    return kernel


def closure(ws: Workspace, name: str, members: DataFrame, columns: list[str], by: str, pairs_of: Callable[..., list[tuple[int, int]]], limit: int, parts: int) -> DataFrame:
    """(node, root): components of the pairs that pairs_of finds in the lists of members (list, key, extra, and the columns).

    Lists over `limit` are cut into blocks by a hash of the key, each with the list's
    hub, the member with the least `extra` (tokens that no other set has). Where a
    list is then not in one component, members outside its largest one meet all
    blocks of it.
    """
    spark = ws.spark
    long_ = ws.write(members.groupBy("list").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > limit).select("list", F.ceil(F.col("size") / limit).alias("blocks")), f"{name}-long")
    kernel = over_blocks([*columns, "label"], by, pairs_of)

    def run(rows: DataFrame) -> DataFrame:
        own = rows.select("list", "block", "key", *columns, "label")
        return own.repartition(parts, "list", "block").sortWithinPartitions("list", "block").mapInArrow(kernel, "a long, b long").distinct()

    block = F.pmod(F.xxhash64("key", "list"), F.col("blocks"))
    unlabelled = F.lit(None).cast("long")
    if not long_.head(1):
        return components(ws, ws.write(run(members.withColumns({"block": F.lit(0).cast("long"), "label": unlabelled})), f"{name}-pairs"), f"{name}-parts")
    short = members.join(long_, "list", "left_anti").select("list", F.lit(0).cast("long").alias("block"), "key", *columns)
    cut = members.join(long_, "list").withColumn("block", block)
    hubs = members.select("list", "key", "extra").join(long_, "list").groupBy("list", "blocks").agg(F.min(F.struct("extra", "key")).alias("hub")).select("list", "blocks", F.col("hub.key").alias("key"))
    hubs = ws.write(hubs, f"{name}-hubs")
    seeds = members.join(hubs, ["list", "key"]).select("list", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "key", *columns)
    rows = short.union(cut.select("list", "block", "key", *columns)).union(seeds)
    pairs = ws.write(run(rows.withColumn("label", unlabelled)), f"{name}-pairs")
    found = ws.write(components(ws, pairs, f"{name}-within"), f"{name}-found")

    # where members of a long list lie outside its largest component
    placed = ws.write(members.select("list", "key").join(long_, "list").join(found.withColumnRenamed("node", "key"), "key", "left").select("list", "key", "blocks", F.coalesce("root", "key").alias("label")), f"{name}-placed")
    parted = placed.groupBy("list", "label").agg(F.count(F.lit(1)).alias("size"))
    largest = parted.groupBy("list").agg(F.max(F.struct("size", "label")).alias("x"), F.sum("size").alias("all")).where(F.col("all") > F.col("x.size"))
    largest = ws.write(largest.select("list", F.col("x.label").alias("main"), F.ceil((F.col("all") - F.col("x.size")) / limit).alias("others")), f"{name}-largest")
    if not largest.head(1):
        return found
    marked = placed.join(largest, "list").withColumns({"own": block, "other": F.when(F.col("label") != F.col("main"), F.pmod(F.xxhash64("list", "key"), F.col("others")))})
    # a block here: a part of those outside, with a block of the list
    everywhere = marked.select("list", "key", "label", "others", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("others") - 1)).alias("with")).select("list", "key", "label", (F.col("own") * F.col("others") + F.col("with")).alias("block"))
    outside = marked.where("other IS NOT NULL").select("list", "key", "label", "others", "other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("with")).select("list", "key", "label", (F.col("with") * F.col("others") + F.col("other")).alias("block"))
    again = everywhere.union(outside).distinct().join(members.select("list", "key", *columns), ["list", "key"])
    more = ws.write(run(again), f"{name}-more")
    return components(ws, ws.write(found.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more), f"{name}-all"), f"{name}-whole")


def frequent_tokens(rows: DataFrame, docs: int, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(ascending tokens, their places in the order): those frequent in a sample of HOT_SAMPLE documents."""
    share = int(min(1.0, HOT_SAMPLE / max(docs, 1)) * (1 << 30))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            value, n = np.unique(shingle_sets(common.binaries(b.column("text")), shingle)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(n, pa.int64())], names=["token", "n"])

    sample = rows.where(F.pmod(F.xxhash64("place", "text"), F.lit(1 << 30)) < share).select("text")
    counts = sample.mapInArrow(kernel, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT_LEAST)
    found = counts.orderBy(F.desc("n"), "token").limit(HOT_TOKENS).toPandas()  # HOT_TOKENS at most
    tokens, n = found["token"].to_numpy(np.int64).view(np.uint64), found["n"].to_numpy(np.float64)
    order = np.argsort(tokens)
    return tokens[order], (MANY + 1 + np.floor(16 * np.log2(np.maximum(n[order], 1)))).astype(np.int64)


def join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, num: int = 90, den: int = 100, limit: int = 512) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row: two documents are linked when den * intersection >= num * union."""
    if not 0 < num <= den:
        raise ValueError("the threshold must be above 0 and at most 1")
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ws = Workspace(spark, "jaccard")
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(FIRST)).alias("place"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    buckets = max(parts, (total["bytes"] or 0) // BUCKET_BYTES + 1)
    hot = spark.sparkContext.broadcast(frequent_tokens(rows, total["n"], shingle))  # HOT_TOKENS at most

    dealt = rows.mapInArrow(deal_tokens(shingle, buckets, hot), ROWS).repartitionById(buckets, "target")
    counted = ws.write(dealt.mapInArrow(count_tokens, ROWS).drop("target"), "counted")
    documents = ws.write(counted.where("bucket IS NULL").select("doc_id", "key", "n", "unit", "idx"), "documents")
    once = documents.where("key IS NOT NULL").groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("unit", "idx")).alias("x"), F.first("n").alias("n"))
    once = once.select(F.col("x.unit").alias("unit"), F.col("x.idx").alias("idx"), "key", "n", "copies", *(F.lit(None).cast("binary").alias(c) for c in ("tokens", "owners", "counts")))
    blobs = counted.where("bucket IS NOT NULL").select("unit", F.lit(None).cast("int").alias("idx"), F.lit(None).cast("long").alias("key"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("long").alias("copies"), "tokens", "owners", "counts")
    sets = ws.write(once.union(blobs).repartition(buckets, "unit").sortWithinPartitions("unit").mapInArrow(index_sets(num, den), SETS), "sets")
    ws.drop("counted")

    def may_link(keys: list[int], n: list[int], m: list[int], pos: list[int], bits: list[bytes], labels: list[int | None]) -> list[tuple[int, int]]:
        return [(keys[g[0]], keys[i]) for g in possible_groups(n, m, pos, bits, labels, num, den) for i in g[1:].tolist()]

    def link(keys: list[int], n: list[int], shared: list[bytes], labels: list[int | None]) -> list[tuple[int, int]]:
        return links_of(keys, n, [np.frombuffer(x, np.uint64) for x in shared], labels, num, den)

    entries = sets.select("key", "n", "m", "bits", (F.col("n") - F.col("m")).alias("extra"), F.posexplode("prefix").alias("pos", "list"))
    families = ws.write(closure(ws, "lists", entries, ["n", "m", "pos", "bits"], "bits", may_link, limit, parts), "families")
    joined = sets.select("key", "n", (F.col("n") - F.col("m")).alias("extra"), "shared").join(families.select(F.col("node").alias("key"), F.col("root").alias("list")), "key")
    members = ws.write(joined, "members")
    ws.drop("sets", "families")
    roots = closure(ws, "families", members, ["n", "shared"], "shared", link, limit, parts)
    ids = documents.where("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("least"))
    named = ws.write(ids.join(roots, ids["key"] == roots["node"], "left").select("key", F.coalesce("root", "key").alias("root"), "least"), "named")
    of_root = ws.write(named.groupBy("root").agg(F.min("least").alias("component_id")), "roots")
    by_key = ws.write(named.join(of_root, "root").select("key", "component_id"), "keys")
    return documents.join(by_key, "key", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """docs without the documents of a component but that with its least id; documents without words stay, and so do all rows of an id of which one row stays."""
    verdict = join(docs, **options).where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("stays"))
    ws = Workspace(docs.sparkSession, "keep-one")
    gone = ws.write(verdict.where("NOT stays").select("doc_id"), "gone")
    return docs.join(common.sized(gone), "doc_id", "left_anti").select(docs.columns)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(common.table(spark, sf_dir, "documents"))


QUERIES = {"op8_jaccard_join": op8_jaccard_join}

"""Operator 2, token counts as delta-maintained rollups.

A store holds additive totals (documents, tokens) by source, language and tokenizer
version. A batch of changes becomes signed sums: an insert adds a document and its
tokens, a delete takes them away, a revision adds the difference of its counts; a
document that moves to another key is a delete and an insert. A batch's sums are
written beside the store and moved to their place by one rename that fails if the
place is taken, so a batch that is sent again, or by two writers, counts once.
Totals are the sum of a base and the batches it does not hold. compact() lists the
batches once, folds just those into a new base together with that list, and deletes
what the base before held, one generation late, so that readers who planned before
find their files; an empty marker keeps the id of a deleted batch taken. Renames must
be atomic, as on HDFS or a local disk; an object store without that needs one writer.

Edge cases: null source, language or counts of a change: a null key is a key of its
own, a null count is 0; keys whose totals are all 0 are not returned; repeated
changes within a batch count each, and there are no ties to decide; an empty batch or
table commits and changes nothing; very long texts are counted whole; only the named
columns are read, so others can't clash; a kind other than insert, delete or revise
stops the batch before it commits.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import common
from textloom.llm.common import Workspace

KEYS = ("source", "lang", "tokenizer")
SUMS = "source string, lang string, tokenizer string, docs long, tokens long"
CACHE_WORDS = 300_000
RUN_OF_SPACES = re.compile(r"\s\s")


class TokenRollup:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, common.qualified(spark, path)
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _names(self, kind: str) -> list[str]:
        p = self._path(f"{self.path}/{kind}")
        return sorted(x.getPath().getName() for x in self._fs.listStatus(p)) if self._fs.exists(p) else []

    def _publish(self, staged: str, kind: str, name: str) -> bool:
        """Moves a staged folder to its place; False if another is there."""
        jvm = self.spark._jvm
        self._fs.mkdirs(self._path(f"{self.path}/{kind}"))
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.path).toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            files.rename(self._path(staged), self._path(f"{self.path}/{kind}/{name}"), options)
            return True
        except Py4JJavaError:
            if not self._fs.exists(self._path(f"{self.path}/{kind}/{name}")):
                raise
            self._fs.delete(self._path(staged), True)
            return False

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Commits a batch of (kind, source, lang, tokenizer, tokens, old_tokens); False if it was committed before."""
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", batch):
            raise ValueError("a batch id has letters, digits, '.', '_' and '-'")
        if self._committed(batch):
            return False
        sign = F.when(F.col("kind") == "insert", 1).when(F.col("kind") == "delete", -1).when(F.col("kind") == "revise", 0).otherwise(F.raise_error(F.concat(F.lit("unknown kind of change: "), F.coalesce("kind", F.lit("null")))).cast("int"))
        new, old = (F.coalesce(F.col(c).cast("long"), F.lit(0)) for c in ("tokens", "old_tokens"))
        signed = changes.select(*KEYS, sign.cast("long").alias("docs"), F.when(F.col("kind") == "revise", new - old).when(F.col("kind") == "delete", -new).otherwise(new).alias("tokens"))
        staged = f"{self.path}/staged/{uuid.uuid4().hex}"
        signed.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).write.parquet(staged)
        return self._publish(staged, "batches", batch)

    def _committed(self, batch: str) -> bool:
        return any(self._fs.exists(self._path(f"{self.path}/{kind}/{batch}")) for kind in ("batches", "done"))

    def _base(self) -> tuple[str | None, set[str]]:
        """The newest base and the batches in it of which the folders may still be there."""
        names = self._names("bases")
        if not names:
            return None, set()
        base = f"{self.path}/bases/{names[-1]}"
        return base, {r[0] for r in self.spark.read.schema("batch string").parquet(f"{base}/batches").collect()}

    def _sums(self, base: str | None, batches: list[str]) -> DataFrame:
        paths = [f"{self.path}/batches/{x}" for x in batches] + [f"{base}/sums"] * bool(base)
        rows = self.spark.read.schema(SUMS).parquet(*paths) if paths else self.spark.createDataFrame([], SUMS)
        return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 OR tokens <> 0")

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, docs, tokens) over all committed batches."""
        base, folded = self._base()
        return self._sums(base, [x for x in self._names("batches") if x not in folded])

    def compact(self) -> bool:
        """Folds all batches committed so far into a new base; False if another writer made it first."""
        base, folded = self._base()
        present = self._names("batches")
        new = [x for x in present if x not in folded]
        staged = f"{self.path}/staged/{uuid.uuid4().hex}"
        self._sums(base, new).write.parquet(f"{staged}/sums")
        self.spark.createDataFrame([(x,) for x in present], "batch string").write.parquet(f"{staged}/batches")
        number = int(base.rpartition("/")[2]) + 1 if base else 0
        done = self._publish(staged, "bases", f"{number:08d}")
        if done:
            for x in sorted(folded):  # in the base before this one too
                self._fs.mkdirs(self._path(f"{self.path}/done/{x}"))
                self._fs.delete(self._path(f"{self.path}/batches/{x}"), True)
            for x in self._names("bases")[:-2]:
                self._fs.delete(self._path(f"{self.path}/bases/{x}"), True)
        return done


class WordCounter:
    """Token counts by a byte-level tokenizer. Where no two spaces meet, a text falls into words whose counts are kept."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import tiktoken

        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.cache: dict[str, int] = {}

    def count(self, text: str) -> int:
        if RUN_OF_SPACES.search(text):
            return len(self.encoding.encode_ordinary(text))
        first, *others = text.split(" ")
        total = self.of(first)
        cache = self.cache
        for w in others:
            n = cache.get(w)
            if n is None:
                n = cache[w] = len(self.encoding.encode_ordinary(" " + w))
            total += n
        if len(cache) > CACHE_WORDS:
            cache.clear()
        return total

    def of(self, word: str) -> int:
        return len(self.encoding.encode_ordinary(word))


def load_ranks(path: str) -> dict[bytes, int]:
    import base64

    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def without_repeats(text: str) -> str:
    """The text with each line that is not blank once."""
    seen: set[str] = set()
    out = []
    for line in text.split("\n"):
        if line.strip():
            if line in seen:
                continue
            seen.add(line)
        out.append(line)
    return "\n".join(out)


def count_tokens(docs: DataFrame, tokenizers: dict[str, tuple[dict[bytes, int], str]], texts: dict[str, tuple[str, bool]], *, keep: tuple[str, ...] = ("doc_id", "source", "lang"), text_col: str = "text") -> DataFrame:
    """The columns `keep`, th (xxhash64 of the text), and a long column for each of texts: name -> (tokenizer, of the text without repeated lines)."""
    sent = docs.sparkSession.sparkContext.broadcast((tokenizers, texts))  # vocabulary files, of fixed size
    made: dict[str, WordCounter] = {}

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabularies, wanted = sent.value
        for name, (ranks, pattern) in vocabularies.items():
            if name not in made:
                made[name] = WordCounter(ranks, pattern)
        for b in common.slices(batches):
            out = []
            for text in b.column("text").to_pylist():
                whole = text or ""
                cut = without_repeats(whole)
                own = {}
                for tokenizer, short in wanted.values():
                    t = cut if short else whole
                    if (tokenizer, t) not in own:
                        own[tokenizer, t] = made[tokenizer].count(t)
                out.append([own[tokenizer, cut if short else whole] for tokenizer, short in wanted.values()])
            cols = np.array(out, np.int64).reshape(-1, len(wanted))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in (*keep, "th")), *(pa.array(cols[:, i]) for i in range(len(wanted)))], names=[*keep, "th", *wanted])

    rows = docs.select(*keep, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th"), F.col(text_col).alias("text"))
    schema = ", ".join([*(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep), "th long", *(f"{c} long" for c in texts)])
    return rows.mapInArrow(kernel, schema)


def op2_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents are inserted, exact copies of earlier ones deleted, what is left revised to the text without repeated lines and counted by a second tokenizer, and the first two batches sent again."""
    import public_tokenizers as P

    ws = Workspace(spark, "rollup")
    first, second = "byte_bpe_50k@1", "byte_bpe_multi_50k@1"
    vocabularies = {first: (load_ranks(P.path("byte_bpe_50k.tiktoken")), P.PATTERN), second: (load_ranks(P.path("byte_bpe_multi_50k.tiktoken")), P.PATTERN)}
    counted = ws.write(count_tokens(common.table(spark, sf_dir, "documents"), vocabularies, {"whole": (first, False), "cut": (first, True), "other": (second, True)}), "counts")
    # read from a table, so that Spark can split the copies of a text with very many
    kept = ws.write(counted.groupBy("th").agg(F.min("doc_id").alias("kept")), "kept")
    counted = ws.write(counted.join(kept, "th").select("source", "lang", "whole", "cut", "other", (F.col("doc_id") == F.col("kept")).alias("original")), "marked")
    store = TokenRollup(spark, f"{ws.path}/store")

    def changes(rows: DataFrame, kind: str, tokenizer: str, tokens: str, old: str | None = None) -> DataFrame:
        return rows.select(F.lit(kind).alias("kind"), "source", "lang", F.lit(tokenizer).alias("tokenizer"), F.col(tokens).alias("tokens"), (F.col(old) if old else F.lit(None).cast("long")).alias("old_tokens"))

    original = counted.where("original")
    load, copies = changes(counted, "insert", first, "whole"), changes(counted.where("NOT original"), "delete", first, "whole")
    for batch, rows in (("load", load), ("copies", copies), ("lines", changes(original, "revise", first, "cut", "whole").union(changes(original, "insert", second, "other"))), ("load", load), ("copies", copies)):
        store.apply(batch, rows)
    store.compact()
    return store.totals()


QUERIES = {"op2_token_rollups": op2_token_rollups}

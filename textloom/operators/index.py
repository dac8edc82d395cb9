"""The index: immutable segments of records and a manifest that names them.

A change writes one new segment and a manifest of the next number; readers see the
manifest before or after it. Deleting a source marks it in the manifest, so nothing
is rewritten; a keyed write rewrites only the segments that hold one of its chunks.
Each segment keeps, beside its records, what a sparse search needs: postings sorted
by term and the sizes of its sources, so that a search reads the query's terms alone.
When there are many, the newest are merged until the next older one is larger than
all of them, so a record is rewritten a number of times that grows with the logarithm
of the index; `compact()` merges all. What the last `KEPT` manifests don't name is
deleted.

With `keyed` writes a chunk is known by (text, start, end): the last one given stays,
with its source. The order of given rows is that of their column `ord`, or else that
in which Spark reads them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.operators import scoring
from textloom.operators.embed import cosine_to, embed, embed_text, make_embedder
from textloom.schema import RECORD

KEY = ("text", "start", "end")
COLUMNS = RECORD.fieldNames()
#: Manifests whose segments stay; segments at which a write merges them; rows of ids that are broadcast at most.
KEPT, MERGE_AT, SENT_ROWS = 2, 24, 1 << 20
#: Scores that are equal to so many digits are ties; rows beyond k that a search takes to the driver to settle them.
DIGITS, SPARE = 9, 1000
STORED = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in RECORD.fields), "rid long, chunk_key binary"])
POSTED = ("rid", "source", "dl", "term", "tf")
POSTINGS, SIZES = "rid long, source string, dl int, term string, tf long", "source string, n long, dl long"


def _sized(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= SENT_ROWS else df


def _chunk_key() -> Column:
    return F.unhex(F.md5(F.concat_ws("\0", F.col("start"), F.col("end"), F.col("text")).cast("binary")))


class ParquetIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._jpath = jvm.org.apache.hadoop.fs.Path
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._jpath(self.path).getFileSystem(self._conf)
        self.path = self._fs.makeQualified(self._jpath(self.path)).toString()

    # manifests

    def _numbers(self) -> list[int]:
        p = self._jpath(self.path)
        names = [x.getPath().getName() for x in self._fs.listStatus(p)] if self._fs.exists(p) else []
        return sorted(int(n[1:-5]) for n in names if n[:1] == "v" and n.endswith(".json") and n[1:-5].isdigit())

    def _segments(self, number: int | None = None) -> list[dict]:
        """[{name, gone, rows}]: segments, the oldest first, the sources that are deleted from each, and the rows it was written with."""
        if number is None:
            numbers = self._numbers()
            if not numbers:
                return []
            number = numbers[-1]
        stream = self._fs.open(self._jpath(f"{self.path}/v{number}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["segments"]
        finally:
            stream.close()

    def _commit(self, before: int, segments: list[dict]) -> None:
        """A manifest is written aside and renamed; of two writers the second one fails."""
        staged, target = self._jpath(f"{self.path}/_staged-{uuid.uuid4().hex}"), self._jpath(f"{self.path}/v{before + 1}.json")
        out = self._fs.create(staged)
        out.write(json.dumps({"segments": segments}).encode())
        out.close()
        jvm = self.spark._jvm
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self._conf).rename(staged, target, options)
        except Py4JJavaError:
            self._fs.delete(staged, True)
            raise RuntimeError("the index was changed by another writer") from None
        self._clean()

    def _clean(self) -> None:
        """Deletes manifests but the last KEPT, and segments that only those named."""
        numbers = self._numbers()
        old, kept = numbers[:-KEPT], numbers[-KEPT:]
        if old:
            named = {s["name"] for n in kept for s in self._segments(n)}
            for s in {s["name"] for n in old for s in self._segments(n)} - named:
                self._fs.delete(self._jpath(f"{self.path}/{s}"), True)
            for n in old:
                self._fs.delete(self._jpath(f"{self.path}/v{n}.json"), True)

    # segments

    def _stored(self, segment: dict, table: str = "records", schema: str = STORED) -> DataFrame:
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/{segment['name']}/{table}")
        return rows.where(~F.col("source").isin(segment["gone"])) if segment["gone"] else rows

    def _union(self, segments: list[dict], table: str, schema: str) -> DataFrame:
        """A table of all segments, with the segment's number."""
        parts = [self._stored(s, table, schema).withColumn("segment", F.lit(i)) for i, s in enumerate(segments)]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], f"{schema}, segment int")

    def _write(self, rows: DataFrame) -> str:
        """Records as a segment; rows are computed once. Their order is kept in rid."""
        name = f"s-{uuid.uuid4().hex}"
        numbered = rows.select(*COLUMNS, F.monotonically_increasing_id().alias("rid"), _chunk_key().alias("chunk_key"))
        numbered.write.parquet(f"{self.path}/{name}/records", compression="zstd")
        return name

    def _index_terms(self, name: str) -> None:
        """The postings and sizes of a written segment."""
        records = self._stored({"name": name, "gone": []})
        scoring.record_postings(records, "rid", ["source"]).select(*POSTED).write.parquet(f"{self.path}/{name}/postings", compression="zstd")
        held = self.spark.read.schema(POSTINGS).parquet(f"{self.path}/{name}/postings")
        both = records.select("source", F.lit(1).cast("long").alias("n"), F.lit(0).cast("long").alias("dl")).unionByName(held.select("source", F.lit(0).cast("long").alias("n"), F.lit(1).cast("long").alias("dl")))
        both.groupBy("source").agg(F.sum("n").alias("n"), F.sum("dl").alias("dl")).coalesce(1).write.parquet(f"{self.path}/{name}/sizes")

    def _checked(self, name: str) -> int:
        """The number of records of a written segment; one with a vector that can't be is deleted."""
        rows = self._stored({"name": name, "gone": []})
        bad = rows.agg(F.count(F.lit(1)).alias("n"), F.max((F.size("vector") < 1).cast("int")).alias("empty"), F.max(F.exists("vector", lambda x: F.isnan(x) | (F.abs(x) == float("inf"))).cast("int")).alias("odd")).first()
        if bad["empty"] or bad["odd"]:
            self._fs.delete(self._jpath(f"{self.path}/{name}"), True)
            raise ValueError("every record needs a vector" if bad["empty"] else "a vector holds NaN or an infinity")
        return bad["n"]

    def _put(self, rows: DataFrame, mode: str, replace: bool) -> None:
        if mode not in ("keyed", "append"):
            raise ValueError(f"unknown mode {mode!r}: want keyed or append")
        numbers = self._numbers()
        segments = self._segments(numbers[-1]) if numbers else []
        if mode == "keyed" and "ord" in rows.columns:
            rows = rows.orderBy(F.col("ord").cast("long"))  # so that rid is in this order
        name = self._write(rows)
        new = {"name": name, "gone": [], "rows": self._checked(name)}
        if replace:
            named = [r[0] for r in self._stored(new).where("source <> ''").select("source").distinct().collect()]  # the sources of one write
            segments = [{**s, "gone": sorted({*s["gone"], *named})} for s in segments]
        if mode == "keyed":
            segments, new = self._keyed(segments, new)
        self._index_terms(new["name"])
        self._commit(numbers[-1] if numbers else 0, [*segments, new])
        if len(segments) >= MERGE_AT:
            self._merge(newest([*segments, new]))

    def _keyed(self, segments: list[dict], new: dict) -> tuple[list[dict], dict]:
        """(the segments that hold no chunk of the new one, the new one with the rest of the others, each chunk once)."""
        rows, count = self._stored(new), new["rows"]
        keys = rows.select("chunk_key").distinct()
        old = self._union(segments, "records", STORED)
        met = {r[0] for r in old.select("segment", "chunk_key").join(_sized(keys, count), "chunk_key", "left_semi").select("segment").distinct().collect()}
        latest = F.max("rid").over(Window.partitionBy("chunk_key"))
        earlier = rows.select("chunk_key", "rid").withColumn("__m", latest).where(F.col("rid") < F.col("__m")).select("rid")
        again = earlier.count()  # rows whose chunk comes once more in the write
        if not met and not again:
            return segments, new
        kept = self._union([s for i, s in enumerate(segments) if i in met], "records", STORED).join(_sized(keys, count), "chunk_key", "left_anti")
        last = rows.join(_sized(earlier, again), "rid", "left_anti") if again else rows
        name = self._write(kept.select(*COLUMNS).unionByName(last.select(*COLUMNS)))
        self._fs.delete(self._jpath(f"{self.path}/{new['name']}"), True)
        return [s for i, s in enumerate(segments) if i not in met], {"name": name, "gone": [], "rows": count + sum(s["rows"] for i, s in enumerate(segments) if i in met)}

    # what users call

    def version(self) -> int:
        """The number of the newest manifest; 0 for a missing index."""
        return (self._numbers() or [0])[-1]

    def records(self) -> DataFrame:
        """All rows; a missing index is empty."""
        return self._union(self._segments(), "records", STORED).select(*COLUMNS)

    def upsert(self, rows: DataFrame, mode: str = "keyed") -> None:
        self._put(rows, mode, replace=False)

    def index(self, chunks: DataFrame, *, source: Column | str = "", embedder: str | Callable = "hashing", mode: str = "keyed", replace: bool = False) -> None:
        """Chunks become records: embedded unless they bring a vector. replace: the sources they name are emptied first, unless that is ''."""
        labelled = chunks.withColumn("source", F.lit(source) if isinstance(source, str) else source)
        if "vector" not in chunks.columns:
            labelled = embed(labelled, embed_text(), embedder=embedder)
        self._put(labelled.select(*COLUMNS, *(c for c in ("ord",) if c in chunks.columns)), mode, replace)

    def compact(self) -> None:
        """All segments as one."""
        segments = self._segments()
        if len(segments) > 1 or any(s["gone"] for s in segments):
            self._merge(len(segments))

    def _merge(self, count: int) -> None:
        """The newest `count` segments as one."""
        numbers = self._numbers()
        segments = self._segments(numbers[-1])
        merged = segments[len(segments) - count :]
        name = self._write(self._union(merged, "records", STORED).select(*COLUMNS))
        self._index_terms(name)
        self._commit(numbers[-1], [*segments[: len(segments) - count], {"name": name, "gone": [], "rows": sum(s["rows"] for s in merged)}])

    def sources(self) -> DataFrame:
        sizes = self._union(self._segments(), "sizes", SIZES)
        return sizes.groupBy(F.col("source").alias("name")).agg(F.sum("n").alias("count")).orderBy(F.desc("count"), "name")

    def delete_source(self, source: str) -> int:
        numbers = self._numbers()
        segments = self._segments(numbers[-1]) if numbers else []
        n = self._union(segments, "sizes", SIZES).where(F.col("source") == source).agg(F.sum("n")).first()[0] or 0
        if n:
            self._commit(numbers[-1], [{**s, "gone": sorted({*s["gone"], source})} for s in segments])
        return n

    def sparse_scores(self, query: str, *, source: str | None = None, stats_scope: str = "filtered") -> tuple[DataFrame, int]:
        """(segment, rid, s) of the records that hold a term of the query, from the stored postings, and how many they are at most; s is not normalised."""
        segments = self._segments()
        terms = list(scoring.distinct_terms(query))
        of = (lambda df: df) if source is None else (lambda df: df.where(F.col("source") == source))
        scope = of if stats_scope == "filtered" else (lambda df: df)
        hit = self._union(segments, "postings", POSTINGS).where(F.col("term").isin(terms) if terms else F.lit(False))
        sizes = scope(self._union(segments, "sizes", SIZES)).agg(F.sum("n").alias("n"), F.sum("dl").alias("dl")).first()
        n = sizes["n"] or 0
        df = {r["term"]: r["count"] for r in scope(hit).groupBy("term").count().collect()}  # a row for each term of the query
        weight = F.lit(0.0)
        for t in terms:
            part = scoring.idf(F.lit(n), F.lit(df.get(t, 0))) * scoring.term_weight(F.col("tf"), F.col("dl"), F.lit((sizes["dl"] or 0) / max(n, 1)))
            weight = F.when(F.col("term") == t, part).otherwise(weight)
        return of(hit).groupBy("segment", "rid").agg(F.sum(weight).alias("s")), sum(df.values())

    def search(self, query: str, *, k: int = 5, mode: str = "dense", weight: float = 0.5, source: str | None = None, stats_scope: str = "filtered", embedder: str | Callable = "hashing", vector: Sequence[float] | None = None) -> DataFrame:
        """The k best records; see search(). Sparse scores come from the stored postings."""
        _checked_search(k, mode, stats_scope)
        stored = self._union(self._segments(), "records", STORED)
        rows = stored if source is None else stored.where(F.col("source") == source)
        ids = ["segment", "rid"]
        if mode == "dense":
            return self._fetched(rows, rows.select(*ids, _dense(query, embedder, vector).alias("score")), k)
        sparse, most = self.sparse_scores(query, source=source, stats_scope=stats_scope)
        top = [r["s"] for r in sparse.select("s").orderBy(F.desc("s")).limit(k).collect()]
        share = F.coalesce(F.col("s"), F.lit(0.0)) / F.lit(top[0] if top else 1.0)
        if mode == "bm25" and len(top) == k:
            return self._fetched(rows, sparse.select(*ids, share.alias("score")), k)  # nothing else can be among them
        own = rows.select(*ids) if mode == "bm25" else rows.select(*ids, _dense(query, embedder, vector).alias("dense"))
        score = share if mode == "bm25" else scoring.blend(F.col("dense"), share, weight)
        return self._fetched(rows, own.join(_sized(sparse, most), ids, "left").select(*ids, score.alias("score")), k)

    def _fetched(self, rows: DataFrame, scored: DataFrame, k: int) -> DataFrame:
        """The k best rows by their scores (segment, rid, score); no text is read or moved but theirs."""
        first = scored.orderBy(F.desc("score")).limit(k + SPARE).collect()
        if len(first) < k + SPARE or first[-1]["score"] < first[k - 1]["score"] - 10**-DIGITS:
            found = F.broadcast(self.spark.createDataFrame([tuple(r) for r in first], scored.schema))
        else:  # more ties than that
            tied = scored.where(F.col("score") >= first[k - 1]["score"] - 10**-DIGITS)
            found = _sized(tied, tied.count())
        return best(rows.join(found, ["segment", "rid"]), k)


def newest(segments: list[dict]) -> int:
    """How many of the newest segments to merge: until the next older one is larger than all of them."""
    count = total = 0
    for s in reversed(segments):
        if count >= 2 and s["rows"] > total:
            break
        count, total = count + 1, total + s["rows"]
    return count


def upserted(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both, with the last row of each (text, start, end); the new rows' order is that of their column `ord`, or else that in which Spark reads them."""
    order = F.col("ord").cast("long") if "ord" in new.columns else F.monotonically_increasing_id()
    both = old.select(*COLUMNS, F.lit(0).alias("__b"), F.lit(0).cast("long").alias("__o")).unionByName(new.select(*COLUMNS, F.lit(1).alias("__b"), order.alias("__o")))
    last = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("__b"), F.desc("__o")))
    return both.withColumn("__r", last).where("__r = 1").drop("__b", "__o", "__r")


def list_sources(records: DataFrame, source: str = "source") -> DataFrame:
    """(name, count), the largest first."""
    return records.groupBy(F.col(source).alias("name")).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "name")


def _checked_search(k: int, mode: str, stats_scope: str) -> None:
    scoring.check_mode(mode)
    if k <= 0:
        raise ValueError(f"k must be > 0, got {k}")
    if stats_scope not in ("filtered", "corpus"):
        raise ValueError(f"unknown stats_scope {stats_scope!r}: want filtered or corpus")


def _dense(query: str, embedder: str | Callable, vector: Sequence[float] | None) -> Column:
    """The cosine of column vector to the query's; another width is an error."""
    call = make_embedder(embedder) if isinstance(embedder, str) else embedder
    q = list(map(float, vector if vector is not None else call([query])[0]))
    wrong = F.raise_error(F.concat(F.lit(f"the query has {len(q)} dimensions, a record "), F.size("vector").cast("string"))).cast("double")
    return F.when(F.size("vector") == len(q), cosine_to(F.col("vector"), q)).otherwise(wrong)


def best(scored: DataFrame, k: int) -> DataFrame:
    """The k rows of the highest score with their rank; ties go by start, text and source."""
    order = [F.desc(F.round("score", DIGITS)), "start", "text", "source"]
    top = scored.select(*COLUMNS, "score").orderBy(*order).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # k rows


def search(records: DataFrame, query: str, *, k: int = 5, mode: str = "dense", weight: float = 0.5, source: str | None = None, stats_scope: str = "filtered", embedder: str | Callable = "hashing", vector: Sequence[float] | None = None) -> DataFrame:
    """The k best of any records with score and rank. source None is no filter, '' the records without a label.

    Ties go by start, text and source. stats_scope: whether BM25's counts come from the
    filtered records or the whole corpus. Nothing is stored: a sparse search reads the
    records once for the totals, which are a few numbers, and once for the scores.
    """
    _checked_search(k, mode, stats_scope)
    kept = records if source is None else records.where(F.col("source") == source)
    if mode == "dense":
        return best(kept.withColumn("score", _dense(query, embedder, vector)), k)
    terms = scoring.distinct_terms(query)

    def measured(frame: DataFrame) -> DataFrame:
        own = F.col("__found")
        counts = [own[i + 1].alias(f"__tf{i}") for i in range(len(terms))]
        return frame.withColumn("__found", scoring.term_counts(scoring.retrieval_text(), terms)).select(*frame.columns, own[0].alias("__dl"), *counts)

    rows = measured(kept)
    base = rows if stats_scope == "filtered" else measured(records)
    totals = base.agg(F.count(F.lit(1)).alias("n"), F.avg("__dl").alias("average"), *(F.sum((F.col(f"__tf{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(terms)))).first()
    s = F.lit(0.0)
    for i in range(len(terms)):
        tf = F.col(f"__tf{i}")
        s = s + F.when(tf > 0, scoring.idf(F.lit(totals["n"]), F.lit(totals[f"df{i}"] or 0)) * scoring.term_weight(tf, F.col("__dl"), F.lit(totals["average"] or 1.0))).otherwise(0.0)
    if mode == "bm25":
        top = best(rows.withColumn("score", s), k)
        most = F.max("score").over(Window.partitionBy())  # of k rows
        return top.withColumn("score", F.when(most > 0, F.col("score") / most).otherwise(F.col("score")))
    most = rows.agg(F.max(s)).first()[0] or 1.0
    return best(rows.withColumn("score", scoring.blend(_dense(query, embedder, vector), s / F.lit(most if most > 0 else 1.0), weight)), k)

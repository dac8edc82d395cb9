"""BM25 over an inverted index, and blends with dense scores. Documents of length dl hold dl different terms."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from textloom.functions.columns import index_terms
from textloom.functions.rulers import index_terms as python_terms
from textloom.functions.terms import counted, sliced

K1, B = 1.5, 0.75
MODES = ("dense", "bm25", "hybrid")
#: Queries times terms whose weights are sent to the tasks at most.
QUERY_CELLS = 1 << 22


def retrieval_text(context: str = "context", text: str = "text") -> Column:
    """Context and text with a space between, or the text alone."""
    return F.concat_ws(" ", F.nullif(F.col(context), F.lit("")), F.col(text))


def postings(records: DataFrame, id_col: str, text: Column) -> DataFrame:
    """(id, term, tf)"""
    return records.select(id_col, F.explode(index_terms(text)).alias("term")).groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf"))


def lengths(records: DataFrame, id_col: str, text: Column) -> DataFrame:
    """(id, dl) of every record, 0 for one without a term."""
    return records.select(id_col, F.size(F.array_distinct(index_terms(text))).alias("dl"))


def occurrences(terms: Column, term: str) -> Column:
    return F.size(F.filter(terms, lambda t: t == F.lit(term)))


def term_counts(text: Column, terms: Sequence[str]) -> Column:
    """array<int>: how many different terms a text has, and how often it holds each of the given ones."""
    wanted = list(terms)

    @F.pandas_udf("array<int>")
    def counts(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            found = python_terms(t) if t else []
            different = set(found)
            out.append([len(different), *(found.count(q) if q in different else 0 for q in wanted)])
        return pd.Series(out)

    return counts(text)


def record_postings(records: DataFrame, id_col: str, keep: Sequence[str] = (), text: Column | None = None) -> DataFrame:
    """(id, the columns `keep`, dl, term, tf) of records whose id is their own, in one pass; sorted by term within each SLICE_BYTES of text."""
    names = [id_col, *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in sliced(whole, "__text"):
                terms, term, row, tf = counted(b.column("__text").to_pylist())
                dl = np.bincount(row, minlength=b.num_rows)
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in names), pa.array(dl[row], pa.int32()), terms.take(pa.array(term)), pa.array(tf, pa.int64())], names=[*names, "dl", "term", "tf"])

    schema = T.StructType([*(T.StructField(c, records.schema[c].dataType, True) for c in names)]).add("dl", T.IntegerType()).add("term", T.StringType()).add("tf", T.LongType())
    return records.select(*names, (retrieval_text() if text is None else text).alias("__text")).mapInArrow(run, schema)


def term_totals(records: DataFrame, text: Column, terms: Sequence[str]) -> tuple[int, float, dict[str, int]]:
    """(records, their mean length, for each given term the records that hold it), in one pass; what is moved is a few numbers for each task and term."""
    wanted = pa.array(list(terms), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(wanted) + 2, np.int64)
        for whole in batches:
            for b in sliced(whole, "t"):
                names, term, _, _ = counted(b.column("t").to_pylist())
                at = np.asarray(pa.compute.fill_null(pa.compute.index_in(names, value_set=wanted), -1), np.int64)
                held = np.bincount(term, minlength=len(names))
                sums[2 + at[at >= 0]] += held[at >= 0]
                sums[:2] += b.num_rows, len(term)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(sums), pa.int32()), pa.array(sums[sums != 0])], names=["at", "n"])

    got = {r["at"]: r["n"] for r in records.select(text.alias("t")).mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()}  # a number for each term
    n = got.get(0, 0)
    return n, got.get(1, 0) / n if n else 0.0, {t: got.get(i + 2, 0) for i, t in enumerate(terms)}


class Weights:
    """The weights of many queries' terms, by which a task scores its own records against all of them."""

    #: Cells of a matrix of records and terms that is held at once.
    CELLS = 1 << 21

    def __init__(self, asked: Sequence[Sequence[str]], n: int, average: float, df: dict[str, int]):
        terms = sorted({t for own in asked for t in own})
        place = {t: i for i, t in enumerate(terms)}
        self.terms, self.average, self.wants = pa.array(terms, pa.string()), average or 1.0, np.zeros((len(terms), len(asked)))
        for q, own in enumerate(asked):
            for t in set(own):
                self.wants[place[t], q] = math.log(1 + (n - df.get(t, 0) + 0.5) / (df.get(t, 0) + 0.5))

    def scores(self, texts: Sequence[str | None]) -> np.ndarray:
        """A row for each text, a column for each query; 0 where they share no term."""
        out = np.zeros((len(texts), self.wants.shape[1]))
        names, term, row, tf = counted(texts)
        if not len(names) or not len(self.terms):
            return out
        dl = np.bincount(row, minlength=len(texts))
        at = np.asarray(pa.compute.fill_null(pa.compute.index_in(names, value_set=self.terms), -1), np.int64)[term]
        held = np.flatnonzero(at >= 0)
        held = held[np.argsort(row[held], kind="stable")]
        at, row, tf = at[held], row[held], tf[held]
        weight = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[row] / self.average))
        step = max(1, self.CELLS // len(self.terms))
        for a in range(0, len(texts), step):
            i, j = np.searchsorted(row, (a, a + step))
            shares = np.zeros((min(step, len(texts) - a), len(self.terms)))
            shares[row[i:j] - a, at[i:j]] = weight[i:j]
            out[a : a + step] = shares @ self.wants
        return out


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def term_weight(tf: Column, dl: Column, average: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / average))


def bm25(records: DataFrame, query: str, *, id_col: str = "record_id", text: Column | None = None, stats: DataFrame | None = None, normalize: bool = True) -> DataFrame:
    """(id, score) of every record; 0 without a query term. stats: the records whose counts apply, records themselves if not given.

    Only the query's terms are exploded, so postings that cannot score are never made.
    """
    text = retrieval_text() if text is None else text
    terms = sorted(set(python_terms(query)))
    corpus = records if stats is None else stats
    wanted = F.array(*map(F.lit, terms)) if terms else F.array().cast("array<string>")

    def measured(frame: DataFrame) -> DataFrame:
        own = F.col("terms")
        counts = F.transform(wanted, lambda q: F.size(F.filter(own, lambda t: t == q)))
        return frame.select(id_col, index_terms(text).alias("terms")).select(id_col, F.size(F.array_distinct(own)).alias("dl"), counts.alias("tf"))

    whole = measured(corpus)
    holds = [F.sum((F.col("tf")[i] > 0).cast("long")).alias(f"df{i}") for i in range(len(terms))]
    totals = whole.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("average"), *holds)  # one row
    scored = (measured(records) if stats is not None else whole).crossJoin(F.broadcast(totals))
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf = F.col("tf")[i]
        score = score + F.when(tf > 0, idf(F.col("n"), F.col(f"df{i}")) * term_weight(tf, F.col("dl"), F.col("average"))).otherwise(0.0)
    out = scored.select(id_col, score.alias("score"))
    if not normalize:
        return out
    top = out.agg(F.max("score").alias("top"))  # one row
    return out.crossJoin(F.broadcast(top)).select(id_col, F.when(F.col("top") > 0, F.col("score") / F.col("top")).otherwise(F.col("score")).alias("score"))


def blend(dense: Column, sparse: Column, weight: float) -> Column:
    if not 0 <= weight <= 1:
        raise ValueError(f"weight must be in [0, 1], got {weight}")
    return F.lit(float(weight)) * dense + F.lit(1.0 - weight) * sparse


def bm25_many(records: DataFrame, queries: DataFrame, *, id_col: str = "record_id", query_col: str = "query_id", query_text: str = "query", text: Column | None = None, k: int | None = None) -> DataFrame:
    """(query, id, score), not normalised, of all records that hold a query term, or the k best of each query, ties by id.

    Where the queries' weights fit in QUERY_CELLS, each task scores its records against all
    of them, and of k keeps but those; beyond that postings meet the queries' terms in an
    equi-join. A record is one row, a query too.
    """
    text = retrieval_text() if text is None else text
    words = queries.select(query_col, F.array_distinct(index_terms(F.col(query_text))).alias("terms"))
    size = words.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("terms")).alias("terms")).first()
    if size["n"] * (size["terms"] or 0) > QUERY_CELLS:
        scores = _joined(records, queries, id_col, query_col, query_text, text)
        if k is None:
            return scores
        order = Window.partitionBy(query_col).orderBy(F.desc(F.round("score", 9)), id_col)
        return scores.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= k).drop("__r")
    asked = words.collect()  # of the size checked
    terms = sorted({t for r in asked for t in r["terms"] or ()})
    sent = records.sparkSession.sparkContext.broadcast(Weights([r["terms"] or () for r in asked], *term_totals(records, text, terms)))
    names = pa.array([r[query_col] for r in asked])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in asked]
        for whole in batches:
            for b in sliced(whole, "__text"):
                scores = sent.value.scores(b.column("__text").to_pylist())
                if k is None:
                    row, q = np.nonzero(scores)
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(q)), b.column(id_col).take(pa.array(row)), pa.array(scores[row, q])], names=[query_col, id_col, "score"])
                    continue
                ids = b.column(id_col).to_pylist()
                rounded = scores.round(9)
                least = np.partition(rounded, -k, axis=0)[-k] if len(ids) > k else np.zeros(len(asked))
                for q in range(len(asked)):
                    best[q] += [(-rounded[i, q], ids[i], scores[i, q]) for i in np.flatnonzero((rounded[:, q] >= least[q]) & (scores[:, q] > 0)).tolist()]
                    best[q] = sorted(best[q])[:k]
        if k is not None:
            rows = [(q, x[1], x[2]) for q, own in enumerate(best) for x in own]
            q, ids, scores = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([names.take(pa.array(q, pa.int64())), pa.array(ids, kind), pa.array(scores, pa.float64())], names=[query_col, id_col, "score"])

    kind = to_arrow_type(records.schema[id_col].dataType)
    names = names.cast(to_arrow_type(queries.schema[query_col].dataType))
    schema = T.StructType([T.StructField(query_col, queries.schema[query_col].dataType), T.StructField(id_col, records.schema[id_col].dataType), T.StructField("score", T.DoubleType())])
    scored = records.select(id_col, text.alias("__text")).mapInArrow(run, schema)
    if k is None:
        return scored
    order = Window.partitionBy(query_col).orderBy(F.desc(F.round("score", 9)), id_col)  # k rows for each query and task
    return scored.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= k).drop("__r")


def _joined(records: DataFrame, queries: DataFrame, id_col: str, query_col: str, query_text: str, text: Column) -> DataFrame:
    """bm25_many by joins, for any number of queries."""
    index = postings(records, id_col, text)
    sizes = lengths(records, id_col, text)
    totals = sizes.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("average"))  # one row
    asked = queries.select(query_col, F.explode(F.array_distinct(index_terms(F.col(query_text)))).alias("term"))
    hit = index.join(asked.select("term").distinct(), "term")
    weights = hit.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(totals)).select("term", "average", idf(F.col("n"), F.col("df")).alias("idf"))
    parts = hit.join(weights, "term").join(sizes, id_col).select(id_col, "term", (F.col("idf") * term_weight(F.col("tf"), F.col("dl"), F.col("average"))).alias("w"))
    return parts.join(asked, "term").groupBy(query_col, id_col).agg(F.sum("w").alias("score"))


def check_mode(mode: str) -> None:
    if mode not in MODES:
        raise ValueError(f"unknown scoring {mode!r}: want {', '.join(MODES)}")


def distinct_terms(query: str) -> Sequence[str]:
    return sorted(set(python_terms(query)))

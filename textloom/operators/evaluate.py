"""Retrieval quality: recall@k and mean reciprocal rank over cases."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.terms import sliced
from textloom.operators.embed import make_embedder
from textloom.operators.scoring import Weights, blend, check_mode, distinct_terms, retrieval_text, term_totals


def normalized(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    from textloom.functions.classes import WHITE_SPACE

    return F.trim(F.regexp_replace(text, f"[{WHITE_SPACE}]+", " "))


def top_k(scores: DataFrame, k: int, *, case: str = "case_id") -> DataFrame:
    """The k best rows of each case with their rank; ties by start, source, text."""
    if k <= 0:
        raise ValueError(f"k must be > 0, got {k}")
    order = Window.partitionBy(case).orderBy(F.desc("score"), "start", "source", "text")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def judge(cases: DataFrame, hits: DataFrame, *, case: str = "case_id") -> DataFrame:
    """(case, hit, rank, top_hit): the first hit of the relevant source that holds an answer, white space aside."""
    both = cases.join(hits, case, "left")
    right = (F.col("source") == F.col("relevant")) & F.exists("answers", lambda a: F.contains(normalized(F.col("text")), normalized(a)))
    out = both.groupBy(case).agg(F.min(F.when(right, F.col("rank"))).alias("rank"), F.max(F.when(F.col("rank") == 1, F.col("text"))).alias("top_hit"))
    return out.select(case, F.col("rank").isNotNull().alias("hit"), "rank", "top_hit")


def recall_mrr(judged: DataFrame) -> DataFrame:
    """One row: recall and mrr; 0 without a case."""
    return judged.agg(F.coalesce(F.avg(F.col("hit").cast("double")), F.lit(0.0)).alias("recall"), F.coalesce(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), F.lit(0.0)).alias("mrr"))


def rank_cases(records: DataFrame, queries: Sequence[str], *, k: int = 3, mode: str = "dense", weight: float = 0.5, embedder: str | Callable = "hashing") -> DataFrame:
    """(case_id, text, start, source, score, rank): the k best records of each query, its number being case_id.

    All queries go over the records at once: each task scores its records against all
    of them and keeps k for each, so what is shuffled is k rows for each query and task.
    Term counts of the queries' terms, and for a blend each query's largest sparse
    score, are summed first; both are a few numbers for each query.
    """
    check_mode(mode)
    if k <= 0:
        raise ValueError(f"k must be > 0, got {k}")
    blend(F.lit(0.0), F.lit(0.0), weight)  # a wrong weight is an error
    spark = records.sparkSession
    call = make_embedder(embedder) if isinstance(embedder, str) else embedder
    vectors = np.asarray(call(list(queries)), np.float64) if mode != "bm25" else np.zeros((len(queries), 0))
    asked = [distinct_terms(q) for q in queries]
    terms = sorted({t for own in asked for t in own})
    text = retrieval_text()
    totals = term_totals(records, text, terms) if mode != "dense" else (0, 1.0, {})
    sent = spark.sparkContext.broadcast((vectors, Weights(asked, *totals)))

    def sparse(texts: list[str]) -> np.ndarray:
        return sent.value[1].scores(texts)

    def dense(rows: list) -> np.ndarray:
        query = sent.value[0]
        if any(len(v) != query.shape[1] for v in rows):
            raise ValueError(f"the query has {query.shape[1]} dimensions, a record another number")
        m = np.asarray(rows, np.float64).reshape(len(rows), query.shape[1])
        norms = np.sqrt((m * m).sum(1)[:, None] * (query * query).sum(1)[None, :])
        return np.divide(m @ query.T, norms, out=np.zeros(norms.shape), where=norms > 0)

    largest = np.ones(len(queries))
    if mode == "hybrid":

        def most(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            top = np.zeros(len(queries))
            for whole in batches:
                for b in sliced(whole, "t"):
                    top = np.maximum(top, sparse(b.column("t").to_pylist()).max(axis=0))
            yield pa.RecordBatch.from_arrays([pa.array(range(len(queries)), pa.int32()), pa.array(top)], names=["case_id", "top"])

        for r in records.select(text.alias("t")).mapInArrow(most, "case_id int, top double").groupBy("case_id").agg(F.max("top").alias("top")).collect():  # a number for each query
            largest[r["case_id"]] = r["top"] or 1.0

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[list[tuple]] = [[] for _ in queries]
        for b in (own for whole in batches for own in sliced(whole, "t")):
            score = np.zeros((b.num_rows, len(queries)))
            if mode != "dense":
                score = sparse(b.column("t").to_pylist()) / largest
            if mode != "bm25":
                score = dense(b.column("vector").to_pylist()) if mode == "dense" else weight * dense(b.column("vector").to_pylist()) + (1 - weight) * score
            text_, start, source = (b.column(c).to_pylist() for c in ("text", "start", "source"))
            for q in range(len(queries)):
                own = score[:, q]
                least = np.partition(own, -k)[-k] if len(own) > k else own.min()
                found[q] += [(-own[i], start[i], source[i], text_[i]) for i in np.flatnonzero(own >= least).tolist()]
                found[q] = sorted(found[q])[:k]
        rows = [(q, x[3], x[1], x[2], -x[0]) for q, own in enumerate(found) for x in own]
        columns = list(zip(*rows, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.int32(), pa.string(), pa.float64()), strict=True)], names=["case_id", "text", "start", "source", "score"])

    best = records.select("text", F.col("start").cast("int").alias("start"), "source", "vector", text.alias("t")).mapInArrow(kept, "case_id int, text string, start int, source string, score double")
    ranked = top_k(best, k)
    if mode == "bm25":
        most_ = F.max("score").over(Window.partitionBy("case_id"))  # of k rows
        ranked = ranked.withColumn("score", F.when(most_ > 0, F.col("score") / most_).otherwise(F.col("score")))
    return ranked


def evaluate(records: DataFrame, cases: list[dict], *, k: int = 3, **options) -> tuple[float, float]:
    """(recall@k, mrr) over cases {query, relevant, answers}; one plan for all."""
    if not cases:
        return 0.0, 0.0
    table = records.sparkSession.createDataFrame([(i, c["relevant"], list(c["answers"])) for i, c in enumerate(cases)], "case_id int, relevant string, answers array<string>")
    row = recall_mrr(judge(table, rank_cases(records, [c["query"] for c in cases], k=k, **options))).first()
    return row["recall"], row["mrr"]

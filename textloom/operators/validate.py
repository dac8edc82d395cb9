"""Do chunks tile their documents?"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def validate_chunks(chunks: DataFrame, docs: DataFrame, *, key: str = "doc_id", text_col: str = "text", overlap: bool = False) -> DataFrame:
    """(key, chunks, tiles): whether the chunks of a document start at 0, follow one another, end with it, and are its slices. Documents without text tile by no chunks.

    overlap: chunks may reach back into the one before, but leave no gap.
    """
    w = Window.partitionBy(key).orderBy("chunk_index")
    before = F.coalesce(F.lag("end").over(w), F.lit(0))
    met = F.col("start") == before if not overlap else F.col("start") <= before
    one = chunks.select(key, "start", "end", "text", "token_count", met.alias("met"))
    sound = (F.col("start") >= 0) & (F.col("end") > F.col("start")) & (F.col("token_count") >= 0) & (F.length("text") == F.col("end") - F.col("start"))
    joined = docs.select(key, F.coalesce(F.col(text_col), F.lit("")).alias("__doc")).join(one, key, "left")
    good = sound & F.col("met") & (F.substring("__doc", F.col("start") + 1, F.col("end") - F.col("start")) == F.col("text"))
    out = joined.groupBy(key).agg(F.count("start").alias("chunks"), F.min(F.coalesce(good, F.lit(True)).cast("int")).alias("ok"), F.max("end").alias("last"), F.max(F.length("__doc")).alias("n"))
    return out.select(key, "chunks", ((F.col("ok") == 1) & (F.coalesce("last", F.lit(0)) == F.col("n"))).alias("tiles"))


def check_chunks(chunks: DataFrame) -> DataFrame:
    """The rows that no chunk may be: negative or crossed offsets, negative counts, a text of another length."""
    return chunks.where("start < 0 OR end < start OR token_count < 0 OR length(text) <> end - start")

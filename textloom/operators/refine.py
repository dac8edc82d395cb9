"""Neighbouring context: what a chunk repeats of the one before or after it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.columns import join_pieces, ruler_count, ruler_pieces


def _check(n: int) -> None:
    if n < 0:
        raise ValueError(f"context must be >= 0, got {n}")


def _tail(text: Column, n: int, ruler: str) -> Column:
    """Its last n tokens."""
    if ruler in ("", "character"):
        return F.substring(text, F.greatest(F.length(text) - n, F.lit(0)) + 1, F.lit(n))
    p = ruler_pieces(text, ruler)
    return join_pieces(F.slice(p, F.greatest(F.size(p) - n, F.lit(0)) + 1, F.lit(n)))


def _head(text: Column, n: int, ruler: str) -> Column:
    if ruler in ("", "character"):
        return F.substring(text, F.lit(1), F.lit(n))
    return join_pieces(F.slice(ruler_pieces(text, ruler), F.lit(1), F.lit(n)))


def _order(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy("chunk_index")


def _around(keys: Sequence[str], n: int, ruler: str) -> tuple[Column, Column]:
    w = _order(keys)
    before = F.coalesce(_tail(F.lag("text").over(w), n, ruler), F.lit(""))
    after = F.coalesce(_head(F.lead("text").over(w), n, ruler), F.lit(""))
    return before, after


def context_prefix(chunks: DataFrame, n: int, *, keys: Sequence[str] = ("doc_id",), ruler: str = "character") -> DataFrame:
    """context takes the last n tokens of the chunk before, behind what it holds."""
    _check(n)
    return chunks.withColumn("context", F.concat("context", _around(keys, n, ruler)[0])) if n else chunks


def context_suffix(chunks: DataFrame, n: int, *, keys: Sequence[str] = ("doc_id",), ruler: str = "character") -> DataFrame:
    """context takes the first n tokens of the chunk after, behind what it holds."""
    _check(n)
    return chunks.withColumn("context", F.concat("context", _around(keys, n, ruler)[1])) if n else chunks


def merge(chunks: DataFrame, n: int, mode: str = "prefix", *, keys: Sequence[str] = ("doc_id",), ruler: str = "character") -> DataFrame:
    """The text itself takes its neighbours' tokens (mode prefix, suffix or justified); offsets stay, tokens are added."""
    _check(n)
    if mode not in ("prefix", "suffix", "justified"):
        raise ValueError(f"unknown mode {mode!r}: want prefix, suffix or justified")
    if not n:
        return chunks
    before, after = _around(keys, n, ruler)
    taken = chunks.withColumns({"__b": before if mode != "suffix" else F.lit(""), "__a": after if mode != "prefix" else F.lit("")})
    added = F.concat("__b", "__a")
    return taken.withColumns({"text": F.concat("__b", "text", "__a"), "context": F.concat("context", added), "token_count": (F.col("token_count") + ruler_count(added, ruler)).cast("int")}).drop("__b", "__a")

"""Column forms of the rulers, the splitters and the token windows: all of it stays in Catalyst."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.classes import CJK_JAVA, WHITE_SPACE

WORD = f"[{WHITE_SPACE}]+|[^{WHITE_SPACE}]+"
BIGRAM = f"[{CJK_JAVA}]{{1,2}}|[{WHITE_SPACE}]+|[^{CJK_JAVA}{WHITE_SPACE}]+"


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def ruler_pieces(text: Column, ruler: str = "character") -> Column:
    """The pieces of a text, array<string>."""
    patterns = {"": "(?s).", "character": "(?s).", "word": WORD, "bigram": BIGRAM}
    if ruler not in patterns:
        raise ValueError(f"{ruler!r} has no column form: want character, word or bigram")
    return matches(text, patterns[ruler])


def ruler_count(text: Column, ruler: str = "character") -> Column:
    return F.length(text) if ruler in ("", "character") else F.size(ruler_pieces(text, ruler))


def join_pieces(pieces: Column) -> Column:
    return F.array_join(pieces, "")


def character_codes(text: Column) -> Column:
    return F.transform(matches(text, "(?s)."), lambda c: F.ascii(c))


def is_cjk(text: Column) -> Column:
    return text.rlike(f"[{CJK_JAVA}]")


def lowered(text: Column) -> Column:
    """Lower case letter by letter: the two letters whose lower case depends on context or grows are put first."""
    return F.lower(F.translate(text, "İΣ", "iσ"))


def index_terms(text: Column) -> Column:
    """Lower-case terms: letters and digits whole, CJK runs as sliding pairs. Texts without CJK take the cheaper pattern."""
    low = lowered(text)
    mixed = matches(low, f"[{CJK_JAVA}]+|[\\p{{L}}\\p{{Nd}}&&[^{CJK_JAVA}]]+")
    pairs = F.flatten(F.transform(mixed, lambda w: F.when(is_cjk(w) & (F.length(w) > 1), F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: F.substring(w, i, F.lit(2)))).otherwise(F.array(w))))
    return F.when(is_cjk(low), pairs).otherwise(matches(low, "[\\p{L}\\p{Nd}]+"))


def delimiter_class(delimiters: Sequence[str]) -> str:
    return "|".join(re.sub(r"([^\w\s])", r"\\\1", d) for d in sorted(delimiters, key=lambda d: -len(d.encode())))


def split_pieces(text: Column, delimiters: Sequence[str], attach: str = "prev") -> Column:
    """Pieces at delimiters, longest first; a delimiter goes to the piece before, to the one after, or stands alone."""
    if any(not d for d in delimiters):
        raise ValueError("delimiters must not be empty strings")
    if not delimiters:
        return F.when(text != "", F.array(text)).otherwise(F.array().cast("array<string>"))
    d = delimiter_class(delimiters)
    forms = {"prev": f"(?s).*?(?:{d})|(?s).+\\z", "next": f"(?s)(?:{d})(?:(?!{d}).)*+|(?s)(?:(?!{d}).)++", "own": f"(?s)(?:{d})|(?s)(?:(?!{d}).)++"}
    if attach not in forms:
        raise ValueError(f"unknown attach {attach!r}: want prev, next or own")
    return matches(text, forms[attach])


def line_pieces(text: Column) -> Column:
    return matches(text, "[^\\n]*\\n|[^\\n]+\\z")


def with_offsets(pieces: Column) -> Column:
    """array<struct<text, start, end>> of pieces that tile their text."""
    ends = F.transform(F.sequence(F.lit(1), F.greatest(F.size(pieces), F.lit(1))), lambda i: F.aggregate(F.slice(pieces, F.lit(1), i), F.lit(0), lambda n, p: n + F.length(p)))
    return F.when(F.size(pieces) > 0, F.zip_with(pieces, ends, lambda p, e: F.struct(p.alias("text"), (e - F.length(p)).alias("start"), e.alias("end")))).otherwise(F.array().cast("array<struct<text:string,start:int,end:int>>"))


def token_windows(text: Column, size: int, overlap: int = 0, ruler: str = "character") -> Column:
    """array<struct<text, start, end, token_count>>: windows of `size` tokens, as columns. Rulers other than character take their pieces' lengths."""
    if size <= 0:
        raise ValueError(f"size must be > 0, got {size}")
    if not 0 <= overlap < size:
        raise ValueError(f"overlap must be >= 0 and < size, got {overlap}")
    step = size - overlap
    none = F.array().cast("array<struct<text:string,start:int,end:int,token_count:int>>")
    if ruler in ("", "character"):
        n = F.length(text)
        last = F.greatest(F.lit(0), F.ceil((n - size) / step)).cast("int")
        made = F.transform(F.sequence(F.lit(0), last), lambda k: F.struct(F.substring(text, k * step + 1, F.lit(size)).alias("text"), (k * step).alias("start"), F.least(k * step + size, n).alias("end"), (F.least(k * step + size, n) - k * step).alias("token_count")))
        return F.when(n > 0, made).otherwise(none)
    pieces = ruler_pieces(text, ruler)
    last = F.greatest(F.lit(0), F.ceil((F.size(pieces) - size) / step)).cast("int")
    windows = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(pieces, k * step + 1, F.lit(size)))
    before = F.transform(F.sequence(F.lit(0), last), lambda k: F.length(F.array_join(F.slice(pieces, F.lit(1), k * step), "")))
    made = F.zip_with(windows, before, lambda w, s: F.struct(F.array_join(w, "").alias("text"), s.alias("start"), (s + F.length(F.array_join(w, ""))).alias("end"), F.size(w).alias("token_count")))
    return F.when(F.size(pieces) > 0, made).otherwise(none)

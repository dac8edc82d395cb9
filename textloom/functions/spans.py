"""Chunk kernels. A chunk is a span of its document, so its text is a slice and never carried along.

Every kernel is a function text -> spans, made once with its options checked; spans
are in order and tile the text (before overlap). Nothing here knows Spark.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterator, Sequence
from itertools import accumulate
from typing import NamedTuple

from textloom.functions.classes import CLAUSES, FAST_DELIMITERS, PARAGRAPHS, SENTENCE_DELIMITERS, STRIP
from textloom.functions.rulers import Ruler


class Span(NamedTuple):
    start: int
    end: int
    tokens: int
    context: str = ""

    def shifted(self, by: int) -> Span:
        return self._replace(start=self.start + by, end=self.end + by) if by else self


class Level(NamedTuple):
    """A rule of the recursive chunker: delimiters, or a cut by tokens."""

    delimiters: tuple[str, ...] = ()
    attach: str = "prev"
    token: bool = False


DEFAULT_RULES = (Level(PARAGRAPHS), Level(SENTENCE_DELIMITERS), Level(CLAUSES), Level((" ", "\t")), Level(token=True))
FALLBACK_RULES = (Level(CLAUSES), Level((" ", "\t", "\n", "\r")), Level(token=True))
Kernel = Callable[[str], list[Span]]


def _positive(size: int) -> None:
    if size <= 0:
        raise ValueError(f"size must be > 0, got {size}")


# splitting and packing


def delimiter_pattern(delimiters: Sequence[str]) -> str:
    """Longest first, in bytes; equal ones in the order given."""
    return "|".join(re.escape(d) for d in sorted(delimiters, key=lambda d: -len(d.encode())))


def split_at(delimiters: Sequence[str], attach: str = "prev", min_runes: int = 0) -> Callable[[str], list[tuple[int, int]]]:
    """text -> (start, end) of its pieces."""
    if any(not d for d in delimiters):
        raise ValueError("delimiters must not be empty strings")
    if min_runes < 0:
        raise ValueError(f"min runes must be >= 0, got {min_runes}")
    if attach not in ("prev", "next", "own"):
        raise ValueError(f"unknown attach {attach!r}: want prev, next or own")
    pattern = re.compile(delimiter_pattern(delimiters)) if delimiters else None

    def split(text: str) -> list[tuple[int, int]]:
        if pattern and attach == "prev":
            cuts = [0, *(m.end() for m in pattern.finditer(text))]
            if cuts[-1] < len(text):
                cuts.append(len(text))
        else:
            edges = {0, len(text)}
            for m in pattern.finditer(text) if pattern else ():
                edges.add(m.start())
                if attach == "own":
                    edges.add(m.end())
            cuts = sorted(edges)
        if min_runes > 1:
            merged = [0]
            for c in cuts[1:-1]:
                if c - merged[-1] >= min_runes:
                    merged.append(c)
            cuts = [*merged, len(text)]
        return [(a, b) for a, b in zip(cuts, cuts[1:]) if b > a]

    return split


def packed(counts: Sequence[int], size: int, breaks: Sequence[bool] | None = None) -> list[tuple[int, int]]:
    """Runs [a, b) of pieces: each takes as many as fit, at least one; a new one starts where breaks says so."""
    sums = [0, *accumulate(counts)]
    stops = [i for i, x in enumerate(breaks) if x] if breaks else []
    out, a, n = [], 0, len(counts)
    while a < n:
        b = max(a + 1, bisect.bisect_right(sums, sums[a] + size) - 1)
        k = bisect.bisect_right(stops, a)
        if k < len(stops):
            b = min(b, stops[k])
        out.append((a, b))
        a = b
    return out


def blanks_merged(text: str, spans: list[Span]) -> list[Span]:
    """White-space spans go to the one before; those in front to the first with content. All blank: unchanged."""
    blank = [not text[s.start : s.end].strip(STRIP) for s in spans]
    if all(blank):
        return spans
    first = blank.index(False)
    owner = list(accumulate(range(len(spans)), lambda at, i: at if blank[i] else i, initial=first))[1:]
    owner[: first + 1] = [first] * (first + 1)
    out: list[Span] = []
    last = -1
    for s, o in zip(spans, owner, strict=True):
        if o == last:
            out[-1] = Span(out[-1].start, s.end, out[-1].tokens + s.tokens)
        else:
            out.append(s)
        last = o
    return out


# chunkers


def token_chunks(ruler: Ruler, size: int, overlap: int = 0) -> Kernel:
    """Windows of `size` tokens, each `overlap` tokens into the one before."""
    _positive(size)
    if not 0 <= overlap < size:
        raise ValueError(f"overlap must be >= 0 and < size, got {overlap}")

    def chunk(text: str) -> list[Span]:
        ends = ruler.cuts(text)
        n = len(ends)
        if not n:
            return []
        last = max(0, -(-(n - size) // (size - overlap)))
        out = []
        for k in range(last + 1):
            a, b = k * (size - overlap), min(n, k * (size - overlap) + size)
            start = ends[a - 1] if a else 0
            if ends[b - 1] > start:
                out.append(Span(start, ends[b - 1], b - a))
        return out

    return chunk


def recursive_chunks(ruler: Ruler, size: int, rules: Sequence[Level] = (), overlap: int = 0) -> Kernel:
    """Split by the first level, pack, and split what is still too long by the next."""
    _positive(size)
    if overlap < 0 or overlap >= size:
        raise ValueError(f"overlap must be >= 0 and < size, got {overlap}")
    rules = tuple(rules) or DEFAULT_RULES
    for level in rules:
        if level.token and level.delimiters:
            raise ValueError("a token level has no delimiters")
    hard = token_chunks(ruler, size)
    splits = [None if level.token else split_at(level.delimiters, level.attach) for level in rules]

    def cut(text: str, a: int, b: int, level: int, count: Callable[[int, int], int]) -> Iterator[Span]:
        part = text[a:b]
        tokens = count(a, b)
        if tokens <= size:
            yield Span(a, b, tokens)
        elif level >= len(rules) or splits[level] is None:
            yield from (s.shifted(a) for s in hard(part))
        else:
            pieces = splits[level](part)
            counts = [count(a + x, a + y) for x, y in pieces]
            for i, j in packed(counts, size) if len(pieces) > 1 else [(0, 1)]:
                x, y, n = a + pieces[i][0], a + pieces[j - 1][1], sum(counts[i:j])
                if n <= size:
                    yield Span(x, y, n)
                else:
                    yield from cut(text, x, y, level + 1, count)

    def whole(text: str) -> list[Span]:
        spans = blanks_merged(text, list(cut(text, 0, len(text), 0, ruler.counter(text)))) if text else []
        return widened(text, spans, ruler, overlap) if overlap else spans

    return whole


def widened(text: str, spans: list[Span], ruler: Ruler, n: int) -> list[Span]:
    """Each span after the first also repeats the last n tokens of the one before, as that was widened."""
    out = spans[:1]
    for s in spans[1:]:
        before = text[out[-1].start : out[-1].end]
        ends = ruler.cuts(before)
        keep = len(ends) - n
        repeat = before[ends[keep - 1] if keep > 0 else 0 :]
        out.append(s._replace(start=s.start - len(repeat), tokens=s.tokens + ruler.count(repeat)))
    return out


def _packed_sentences(text: str, pieces: list[tuple[int, int]], counts: list[int], size: int, fallback: Kernel, breaks: Sequence[bool] | None = None) -> list[Span]:
    out: list[Span] = []
    for i, j in packed(counts, size, breaks):
        a, b = pieces[i][0], pieces[j - 1][1]
        tokens = sum(counts[i:j])
        out += [Span(a, b, tokens)] if tokens <= size else [s.shifted(a) for s in fallback(text[a:b])]
    return out


def sentence_chunks(ruler: Ruler, size: int, delimiters: Sequence[str] = (), min_runes: int = 0) -> Kernel:
    """Sentences packed to size; one that is too long goes through the fallback rules."""
    _positive(size)
    split = split_at(tuple(delimiters) or SENTENCE_DELIMITERS, "prev", min_runes)
    fallback = recursive_chunks(ruler, size, FALLBACK_RULES)

    def chunk(text: str) -> list[Span]:
        pieces, count = split(text), ruler.counter(text)
        return _packed_sentences(text, pieces, [count(a, b) for a, b in pieces], size, fallback)

    return chunk


def fast_chunks(size: int, delimiters: Sequence[str] = ()) -> Kernel:
    """Windows of at most `size` bytes, cut behind the delimiter that ends last in them; tokens are code points."""
    _positive(size)
    delimiters = tuple(delimiters) or FAST_DELIMITERS
    if any(not d for d in delimiters):
        raise ValueError("delimiters must not be empty strings")
    marks = [d.encode() for d in delimiters]

    def chunk(text: str) -> list[Span]:
        data, out, at, runes = text.encode(), [], 0, 0
        while at < len(data):
            stop = at + size
            if stop >= len(data):
                stop = len(data)
            else:
                while stop > at and data[stop] & 0xC0 == 0x80:
                    stop -= 1
                if stop == at:  # one character wider than the window
                    stop = at + 1
                    while stop < len(data) and data[stop] & 0xC0 == 0x80:
                        stop += 1
                else:
                    found = max((i + len(m) for m in marks if (i := data.rfind(m, at, stop)) >= 0), default=0)
                    stop = found or stop
            n = len(data[at:stop].decode())
            out.append(Span(runes, runes + n, n))
            at, runes = stop, runes + n
        return out

    return chunk


# Markdown


def line_spans(text: str) -> list[tuple[int, int]]:
    """(start, end) of each line with its line end."""
    ends = [m.end() for m in re.finditer("\n", text)]
    if text and (not ends or ends[-1] < len(text)):
        ends.append(len(text))
    return list(zip([0, *ends], ends))


def is_pipe_row(line: str) -> bool:
    t = line.strip(STRIP)
    return t.startswith("|") and t.count("|") > 1


def is_separator(line: str) -> bool:
    t = line.strip(STRIP)
    return "|" in t and "-" in t and set(t) <= set("|-: \t\n\r")


def table_runs(text: str, lines: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs [i, j) of lines that are pipe tables."""
    rows = [is_pipe_row(text[a:b]) for a, b in lines]
    out, i = [], 0
    while i + 1 < len(lines):
        if rows[i] and is_separator(text[slice(*lines[i + 1])]):
            j = i + 2
            while j < len(lines) and rows[j]:
                j += 1
            out.append((i, j))
            i = j
        else:
            i += 1
    return out


def find_tables(text: str) -> list[tuple[int, int]]:
    lines = line_spans(text)
    return [(lines[i][0], lines[j - 1][1]) for i, j in table_runs(text, lines)]


class Fence(NamedTuple):
    start: int
    end: int
    inner_start: int
    inner_end: int
    language: str


_OPEN = re.compile(r"[ \t]*(`{3,})([^`]*)[\r\n]*\Z")
_CLOSE = re.compile(r"[ \t]*`{3,}[ \t\r\n]*\Z")


def find_fences(text: str) -> list[Fence]:
    """Code between backtick fences; a fence that is not closed is none."""
    lines = line_spans(text)
    closes = [i for i, (a, b) in enumerate(lines) if _CLOSE.match(text[a:b])]
    out, i = [], 0
    while i < len(lines):
        m = _OPEN.match(text[slice(*lines[i])])
        k = bisect.bisect_right(closes, i)
        if m and k < len(closes):
            j = closes[k]
            out.append(Fence(lines[i][0], lines[j][1], lines[i][1], lines[j][0], m[2].strip(STRIP)))
            i = j
        i += 1
    return out


def table_chunks(ruler: Ruler, size: int) -> Kernel:
    """Tables by row, with the header as context of all but the first chunk; prose whole or in windows."""
    _positive(size)
    hard = token_chunks(ruler, size)

    def rows(text: str, lines: list[tuple[int, int]]) -> list[Span]:
        header = text[lines[0][0] : lines[1][1]]
        counts = [ruler.count(header), *(ruler.count(text[a:b]) for a, b in lines[2:])]
        edges = [(lines[0][0], lines[1][1]), *lines[2:]]
        return [Span(edges[i][0], edges[j - 1][1], ruler.count(text[edges[i][0] : edges[j - 1][1]]), header if i else "") for i, j in packed(counts, size)]

    def prose(text: str, a: int, b: int) -> list[Span]:
        n = ruler.count(text[a:b])
        return [Span(a, b, n)] if n <= size else [s.shifted(a) for s in hard(text[a:b])]

    def chunk(text: str) -> list[Span]:
        lines, out, at = line_spans(text), [], 0
        for i, j in table_runs(text, lines):
            if lines[i][0] > at:
                out += prose(text, at, lines[i][0])
            out += rows(text, lines[i:j])
            at = lines[j - 1][1]
        return out + (prose(text, at, len(text)) if at < len(text) else [])

    return chunk


def markdown_chunks(ruler: Ruler, size: int) -> Kernel:
    """Prose, tables and fenced code, each by its own chunker."""
    from textloom.functions.code import code_chunks, language_name

    prose, table = recursive_chunks(ruler, size), table_chunks(ruler, size)
    made: dict[str, Kernel] = {}

    def code_for(language: str) -> Kernel:
        try:
            name = language_name(language)
        except ValueError:
            name = ""
        if name not in made:
            made[name] = code_chunks(ruler, size, name)
        return made[name]

    def fenced(text: str, f: Fence) -> list[Span]:
        spans = [s.shifted(f.inner_start) for s in code_for(f.language)(text[f.inner_start : f.inner_end])]
        if not spans:
            return [Span(f.start, f.end, ruler.count(text[f.start : f.end]))]
        edges = [f.start, *(s.start for s in spans[1:]), f.end]
        return [Span(a, b, ruler.count(text[a:b])) for a, b in zip(edges, edges[1:])]

    def chunk(text: str) -> list[Span]:
        fences = find_fences(text)
        marks: list[tuple[int, int, Fence | None]] = [(f.start, f.end, f) for f in fences]
        marks += [(a, b, None) for a, b in find_tables(text) if not any(a < f.end and f.start < b for f in fences)]
        out, at = [], 0
        for a, b, fence in [*sorted(marks, key=lambda m: m[0]), (len(text), len(text), None)]:
            if a > at:
                out += [s.shifted(at) for s in prose(text[at:a])]
            if fence:
                out += fenced(text, fence)
            elif b > a:
                out += [s.shifted(a) for s in table(text[a:b])]
            at = b
        return out

    return chunk


# semantic


def topic_breaks(sims: Sequence[float | None], least: float) -> list[bool]:
    """Of each run of cut points under `least` the lowest, the first of equals. sims[i] is the point before piece i."""
    out = [False] * len(sims)
    run: list[int] = []
    for i in range(1, len(sims) + 1):
        if i < len(sims) and sims[i] is not None and sims[i] < least:
            run.append(i)
        elif run:
            out[min(run, key=lambda k: sims[k])] = True
            run = []
    return out


def semantic_chunks(ruler: Ruler, size: int, embed: Callable[[list[str]], Sequence[Sequence[float]]], min_sim: float | None = None, window: int = 1, min_runes: int = 0) -> Kernel:
    """Sentences packed to size, but not across a change of topic."""
    import numpy as np

    _positive(size)
    least = 0.5 if min_sim is None else min_sim
    if not 0 <= least <= 1:
        raise ValueError(f"min_sim must be in [0, 1], got {min_sim}")
    if window < 1:
        raise ValueError(f"similarity window must be >= 1, got {window}")
    split = split_at(SENTENCE_DELIMITERS, "prev", min_runes)
    fallback = recursive_chunks(ruler, size, FALLBACK_RULES)

    def chunk(text: str) -> list[Span]:
        pieces = split(text)
        if not pieces:
            return []
        parts = [text[a:b] for a, b in pieces]
        vectors = np.asarray(embed(parts), np.float32)
        if len(vectors) != len(parts):
            raise ValueError(f"embedder returned {len(vectors)} vectors for {len(parts)} sentences")
        sims: list[float | None] = [None] * len(parts)
        if len(parts) >= 2 * window:
            sums = np.concatenate((np.zeros((1, vectors.shape[1])), np.cumsum(vectors.astype(np.float64), axis=0)))
            means = (sums[window:] - sums[:-window]) / window  # of each full window
            a, b = means[:-window], means[window:]
            norms = np.sqrt((a * a).sum(1) * (b * b).sum(1))
            dots = np.divide((a * b).sum(1), norms, out=np.zeros(len(a)), where=norms > 0)
            sims[window : window + len(dots)] = dots.round(12).tolist()
        return _packed_sentences(text, pieces, [ruler.count(p) for p in parts], size, fallback, topic_breaks(sims, least))

    return chunk

"""Rulers measure text in tokens: the pieces of a text concatenate to it, and the count is their number."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Sequence

import numpy as np
import regex

from textloom.functions.classes import CJK_PYTHON, STRIP, WHITE_SPACE

_WORD = regex.compile(f"[{WHITE_SPACE}]+|[^{WHITE_SPACE}]+")
_BIGRAM = regex.compile(f"[{CJK_PYTHON}]{{1,2}}|[{WHITE_SPACE}]+|[^{CJK_PYTHON}{WHITE_SPACE}]+")
_TERM = regex.compile(f"[{CJK_PYTHON}]+|[\\p{{L}}\\p{{Nd}}--[{CJK_PYTHON}]]+", regex.V1)


class Ruler:
    """A named measure. split gives the pieces; count may be given where it is cheaper than splitting."""

    def __init__(self, name: str, split: Callable[[str], list[str]], count: Callable[[str], int] | None = None):
        self.name, self.split = name, split
        self.count = count or (lambda text: len(split(text)))

    def cuts(self, text: str) -> list[int]:
        """Code-point offsets of the piece ends; pieces may be empty."""
        at, out = 0, []
        for piece in self.split(text):
            at += len(piece)
            out.append(at)
        return out

    def counter(self, text: str) -> Callable[[int, int], int]:
        """(a, b) -> the count of text[a:b]; for many stretches of one text."""
        return lambda a, b: self.count(text[a:b])


class _Characters(Ruler):
    def __init__(self) -> None:
        super().__init__("character", list, len)

    def cuts(self, text: str) -> Sequence[int]:
        return range(1, len(text) + 1)

    def counter(self, text: str) -> Callable[[int, int], int]:
        return lambda a, b: b - a


#: Whether a code point is white space; the last cell is for all beyond.
_SPACE = np.zeros(max(map(ord, STRIP)) + 2, bool)
_SPACE[[ord(c) for c in STRIP]] = True
#: The least code point of a CJK script.
_WIDE = re.compile("[\u1100-\U0010ffff]")


class _Words(Ruler):
    """Runs of white space and of anything else; CJK, if it is counted by pairs, takes the pieces."""

    def __init__(self, name: str, pattern: regex.Pattern, pairs: bool):
        super().__init__(name, pattern.findall)
        self.pairs = pairs

    def counter(self, text: str) -> Callable[[int, int], int]:
        if self.pairs and _WIDE.search(text) and _CJK_RUN.search(text):
            return super().counter(text)
        space = _SPACE[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), len(_SPACE) - 1)]
        changes = (np.flatnonzero(space[1:] != space[:-1]) + 1).tolist()
        return lambda a, b: bisect_left(changes, b) - bisect_right(changes, a) + 1 if b > a else 0


CHARACTER = _Characters()
WORD = _Words("word", _WORD, False)
BIGRAM = _Words("bigram", _BIGRAM, True)


def encode_characters(text: str) -> list[int]:
    return [ord(c) for c in text]


def decode_characters(codes: Sequence[int]) -> str:
    return "".join(map(chr, codes))


def pieces_at_code_points(data: bytes, sizes: Sequence[int]) -> list[str]:
    """Byte runs as text: a run that ends inside a character leaves it to the run that completes it."""
    out, held, at = [], b"", 0
    for n in sizes:
        held += data[at : at + n]
        at += n
        keep = len(held)
        for back in range(1, min(4, keep) + 1):
            lead = held[keep - back]
            if lead & 0xC0 != 0x80:
                if lead >= 0xC0 and back < (2 if lead < 0xE0 else 3 if lead < 0xF0 else 4):
                    keep -= back
                break
        out.append(held[:keep].decode("utf-8", "replace"))
        held = held[keep:]
    if held and out:
        out[-1] += held.decode("utf-8", "replace")
    return out


def byte_pair(encoding) -> Ruler:
    """Over a tiktoken encoding (or anything with encode_ordinary and decode_single_token_bytes); special tokens are ordinary text."""

    def split(text: str) -> list[str]:
        parts = [encoding.decode_single_token_bytes(t) for t in encoding.encode_ordinary(text)]
        return pieces_at_code_points(b"".join(parts), [len(p) for p in parts])

    return _BytePairs(encoding, split)


class _BytePairs(Ruler):
    def __init__(self, encoding, split: Callable[[str], list[str]]):
        super().__init__("tiktoken", split, lambda text: len(encoding.encode_ordinary(text)))
        self.encoding = encoding
        self.sizes: dict[int, int] = {}

    def cuts(self, text: str) -> Sequence[int]:
        """A token that ends inside a character leaves it to the one that completes it."""
        tokens, sizes = self.encoding.encode_ordinary(text), self.sizes
        for t in set(tokens) - sizes.keys():
            sizes[t] = len(self.encoding.decode_single_token_bytes(t))
        data = text.encode("utf-8", "surrogatepass")
        ends = np.cumsum(np.fromiter(map(sizes.__getitem__, tokens), np.int64, len(tokens)))
        if not tokens or ends[-1] != len(data):  # the tokens are not those of the very text
            return super().cuts(text)
        if len(data) != len(text):
            leads = np.flatnonzero(np.frombuffer(data, np.uint8) & 0xC0 != 0x80)
            ends = np.searchsorted(np.append(leads[1:], len(data)), ends, side="right")
        return ends.tolist()


def load_byte_pair(path: str, pattern: str) -> Ruler:
    """From a file of base64 tokens and ranks, kept for the process."""
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return byte_pair(tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}))


_loaded: dict[tuple, Ruler] = {}


def make_ruler(name: str | Ruler | tuple[str, str, str] = "", encoding=None) -> Ruler:
    """By name; ("tiktoken", path, pattern) is a vocabulary file, read once for the process."""
    if isinstance(name, Ruler):
        return name
    if isinstance(name, tuple) and name[0] == "tiktoken":
        if name not in _loaded:
            _loaded[name] = load_byte_pair(*name[1:])
        return _loaded[name]
    if name in ("", "character"):
        return CHARACTER
    if name == "word":
        return WORD
    if name == "bigram":
        return BIGRAM
    if name == "tiktoken":
        if encoding is None:
            import tiktoken

            encoding = tiktoken.get_encoding("cl100k_base")
        return byte_pair(encoding)
    raise ValueError(f"unknown tokenizer {name!r}: want character, word, bigram or tiktoken")


_CJK_RUN = regex.compile(f"[{CJK_PYTHON}]")
#: Letters and digits; the same as _TERM for Latin text without numerals such as a raised 2.
_ALNUM = re.compile(r"[^\W_]+")
_UNUSUAL = re.compile("[^\x00-\u024f]|[\xb2\xb3\xb9\xbc-\xbe]")


def index_terms(text: str) -> list[str]:
    """Lower-case terms: letters and digits whole, CJK runs as sliding pairs."""
    low = text.replace("İ", "i").replace("Σ", "σ").lower()
    if low.isascii() or not _UNUSUAL.search(low):
        return _ALNUM.findall(low)
    out: list[str] = []
    for run in _TERM.findall(low):
        if len(run) > 1 and _CJK_RUN.match(run):
            out += [run[i : i + 2] for i in range(len(run) - 1)]
        else:
            out.append(run)
    return out


_CJK = regex.compile(f"[{CJK_PYTHON}]")


def is_cjk(c: str) -> bool:
    return bool(_CJK.match(c))

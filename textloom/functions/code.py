"""Where source code falls into top-level declarations, and the code chunker."""

from __future__ import annotations

import re
from collections.abc import Callable

from textloom.functions.classes import STRIP
from textloom.functions.rulers import Ruler
from textloom.functions.spans import Kernel, Span, line_spans, packed, token_chunks

LANGUAGES = {"": "", "go": "go", "golang": "go", "py": "python", "python": "python", "python2": "python", "python3": "python"}


def language_name(name: str) -> str:
    key = name.strip(STRIP).lower()
    if key not in LANGUAGES:
        raise ValueError(f"unknown language {name!r}: want go or python")
    return LANGUAGES[key]


_PYTHON = re.compile(
    r"""(?P<triple>\"{3}(?s:.*?)(?:\"{3}|\Z)|'{3}(?s:.*?)(?:'{3}|\Z))
      | (?P<string>"(?:\\[^\n]?|[^"\\\n])*"?|'(?:\\[^\n]?|[^'\\\n])*'?)
      | (?P<comment>\#[^\n]*)
      | (?P<more>\\(?=\n|\Z))
      | (?P<open>[(\[{])
      | (?P<close>[)\]}])
      | (?P<line>\n)""",
    re.X,
)


def _statement_lines(text: str) -> set[int]:
    """Offsets of lines that begin outside brackets and strings and do not continue the line before."""
    starts, depth, after = {0}, 0, ""
    for m in _PYTHON.finditer(text):
        kind = m.lastgroup
        if kind == "open":
            depth += 1
        elif kind == "close":
            depth = max(0, depth - 1)
        elif kind == "line" and not depth and after != "more":
            starts.add(m.end())
        after = kind
    return starts


def _is_definition(line: str) -> bool:
    return bool(re.match(r"(?:async )?(?:(?:def|class) |(?:def|class)\Z)", line.strip(STRIP)))


def _is_decorator(line: str) -> bool:
    return line.strip(STRIP).startswith("@")


def python_pieces(text: str) -> list[tuple[int, int]]:
    """(start, end) of stretches that each begin at a statement in the first column; none if there is no such statement."""
    lines = line_spans(text)
    starts = _statement_lines(text)
    texts = [text[a:b].rstrip("\n") for a, b in lines]
    comment = [t.lstrip(" \t").startswith("#") for t in texts]
    blank = [not t.strip(" \t\r") for t in texts]
    cuts = [i for i, (a, _) in enumerate(lines) if a in starts and not blank[i] and not comment[i] and texts[i][0] not in " \t" and not _is_decorator(texts[i])]
    if not cuts:
        return []
    edges = [0]
    for before, i in zip([-1, *cuts], cuts):
        at = i
        if _is_definition(texts[i]):  # its comments and decorators come along
            while at - 1 > before and not blank[at - 1] and (comment[at - 1] or _is_decorator(texts[at - 1])):
                at -= 1
        if lines[at][0] > edges[-1]:
            edges.append(lines[at][0])
    return list(zip(edges, [*edges[1:], len(text)]))


_GO = re.compile(
    r"""(?P<comment>//[^\n]*|/\*(?s:.*?)\*/)
      | (?P<literal>`[^`]*`|"(?:\\[^\n]|[^"\\\n])*"|'(?:\\[^\n]+?|[^'\\\n])'|[0-9][\w.]*)
      | (?P<word>[^\W\d]\w*)
      | (?P<open>[(\[{])
      | (?P<close>[)\]}])
      | (?P<line>\n)
      | (?P<space>[ \t\r]+)
      | (?P<semicolon>;)
      | (?P<step>\+\+|--)
      | (?P<sign>[+\-*/%&|^<>=!:,.~]+)
      | (?P<wrong>.)""",
    re.X,
)
_CLOSES = {"(": ")", "[": "]", "{": "}"}
_GO_DECLARATIONS = ("import", "const", "type", "var", "func")


def go_pieces(text: str) -> list[tuple[int, int]]:
    """(start, end) of stretches that each begin at a top-level declaration with its doc comment; none if it does not look like a Go file."""
    stack: list[str] = []
    edges: list[int] = [0]
    fresh, ended, package, imports = True, False, 0, True
    doc: tuple[int, int] | None = None  # (start of the comment group, number of line ends since it)
    for m in _GO.finditer(text):
        kind, token = m.lastgroup, m[0]
        if kind == "space":
            continue
        if kind == "comment":
            breaks = token.count("\n")
            doc = (doc[0] if doc and doc[1] <= 1 else m.start(), 0)
            if breaks and not stack and ended:
                fresh, ended = True, False
            continue
        if kind == "line":
            doc = (doc[0], doc[1] + 1) if doc else None
            if not stack and ended:
                fresh, ended = True, False
            continue
        if kind == "wrong" or (kind == "sign" and token == "/"):
            return []
        if kind == "semicolon":
            fresh, ended = (True, False) if not stack else (fresh, ended)
            doc = None
            continue
        if fresh and not stack:
            if not package:
                if token != "package":
                    return []
                package = 1
            elif package == 1:
                if kind != "word":
                    return []
                package = 2
            elif token not in _GO_DECLARATIONS or (token == "import" and not imports):
                return []
            else:
                imports = token == "import"
                start = doc[0] if doc and doc[1] == 1 else m.start()
                if start > edges[-1]:
                    edges.append(start)
            if package != 1:
                fresh = False
        doc = None
        if kind == "open":
            stack.append(_CLOSES[token])
        elif kind == "close" and (not stack or stack.pop() != token):
            return []
        ended = kind in ("word", "literal", "close", "step")
    if stack or package != 2:
        return []
    return list(zip(edges, [*edges[1:], len(text)]))


def code_chunks(ruler: Ruler, size: int, language: str = "", parse_go: Callable[[str], list[tuple[int, int]]] = go_pieces) -> Kernel:
    """Top-level declarations packed to size; what is longer, or not understood, in windows of tokens."""
    name = language_name(language)
    hard = token_chunks(ruler, size)

    def pieces_of(text: str) -> list[tuple[int, int]]:
        if name == "go":
            return parse_go(text)
        return python_pieces(text) if name else parse_go(text) or python_pieces(text)

    def chunk(text: str) -> list[Span]:
        pieces = pieces_of(text) if text else []
        if not pieces:
            return hard(text)
        counts = [ruler.count(text[a:b]) for a, b in pieces]
        out: list[Span] = []
        for i, j in packed(counts, size):
            a, b, n = pieces[i][0], pieces[j - 1][1], sum(counts[i:j])
            out += [Span(a, b, n)] if n <= size else [s.shifted(a) for s in hard(text[a:b])]
        return out

    return chunk

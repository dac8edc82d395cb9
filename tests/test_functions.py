"""Rulers, splitting, chunk kernels and code pieces, against golden rows and invariants."""

import random

import pytest

from textloom.functions import code, spans
from textloom.functions.rulers import BIGRAM, CHARACTER, WORD, decode_characters, encode_characters, index_terms, make_ruler, pieces_at_code_points
from textloom.functions.rules import rules_from_json
from textloom.operators.chunkers import make_kernel


def texts(kernel, text):
    return [text[s.start : s.end] for s in kernel(text)]


def pieces(text, delimiters, attach="prev", least=0):
    return [text[a:b] for a, b in spans.split_at(delimiters, attach, least)(text)]


@pytest.mark.parametrize(
    ("text", "delimiters", "attach", "least", "want"),
    [
        ("a.b.c", ["."], "prev", 0, ["a.", "b.", "c"]),
        ("a.b.c", ["."], "next", 0, ["a", ".b", ".c"]),
        ("a.b.c", ["."], "own", 0, ["a", ".", "b", ".", "c"]),
        ("a..b", ["."], "prev", 0, ["a.", ".", "b"]),
        ("hello\n\nworld\nend", ["\n", "\n\n"], "prev", 0, ["hello\n\n", "world\n", "end"]),
        ("你好。世界", ["。"], "prev", 0, ["你好。", "世界"]),
        ("a.b.c.d", ["."], "prev", 4, ["a.b.", "c.d"]),
        ("", ["."], "prev", 0, []),
        ("abc", [], "prev", 0, ["abc"]),
    ],
)
def test_split(text, delimiters, attach, least, want):
    assert pieces(text, delimiters, attach, least) == want


@pytest.mark.parametrize("args", [([""], "prev", 0), (["."], "up", 0), (["."], "prev", -1)])
def test_split_errors(args):
    with pytest.raises(ValueError):
        spans.split_at(*args)


@pytest.mark.parametrize(("text", "want"), [("大模型", ["大模", "型"]), ("猫", ["猫"]), ("大模型RAG", ["大模", "型", "RAG"]), ("你好，世界", ["你好", "，", "世界"]), ("hello world", ["hello", " ", "world"]), ("name,color", ["name,color"])])
def test_bigram(text, want):
    assert BIGRAM.split(text) == want


@pytest.mark.parametrize(("text", "want"), [("大模型", ["大模", "模型"]), ("猫", ["猫"]), ("大模型RAG", ["大模", "模型", "rag"]), ("你好，世界", ["你好", "世界"]), ("name,color", ["name", "color"]), ("한국어", ["한국", "국어"]), ("ΟΔΟΣ", ["οδοσ"])])
def test_terms(text, want):
    assert index_terms(text) == want


def test_other_rulers():
    assert WORD.split("a  b\u001cc\u0085d") == ["a", "  ", "b\u001cc", "\u0085", "d"]
    assert decode_characters(encode_characters("a😀é")) == "a😀é"
    assert pieces_at_code_points("你好".encode(), [2, 4]) == ["", "你好"]
    assert pieces_at_code_points("你好".encode(), [1, 1, 1, 3]) == ["", "", "你", "好"]
    with pytest.raises(ValueError):
        make_ruler("syllable")


def test_fast():
    assert texts(spans.fast_chunks(8, [" "]), "hello world") == ["hello ", "world"]
    assert texts(spans.fast_chunks(3, [" "]), "abcdefgh") == ["abc", "def", "gh"]
    assert [(s.start, s.end) for s in spans.fast_chunks(1)("你好")] == [(0, 1), (1, 2)]


def test_sentence_and_recursive():
    assert [(s.start, s.end) for s in spans.sentence_chunks(CHARACTER, 12)("Cats sleep. Dogs bark. Birds sing.")] == [(0, 11), (11, 22), (22, 34)]
    assert texts(spans.recursive_chunks(CHARACTER, 12), "Hello. World.\n\nHi. There.")[0] == "Hello."
    long = "x" * 512 + "\n\n" + "y" * 512
    assert [len(t) for t in texts(spans.recursive_chunks(CHARACTER, 512), long)] == [514, 512]
    got = spans.recursive_chunks(CHARACTER, 8, overlap=2)("word " * 8)
    assert all(b.start == a.end - 2 for a, b in zip(got, got[1:]))
    assert texts(spans.recursive_chunks(WORD, 1, spans.FALLBACK_RULES), "one\ntwo\nthree")[0] == "one\n"
    assert [s.tokens for s in spans.recursive_chunks(CHARACTER, 5)("   ")] == [3]


def test_table():
    text = "| h |\n| --- |\n| 1 |\n| 2 |\n"
    got = spans.table_chunks(CHARACTER, 18)(text)
    assert text[got[0].start : got[0].end].startswith("| h |") and not got[0].context
    assert got[-1].context == "| h |\n| --- |\n" and "| h |" not in text[got[-1].start : got[-1].end]
    assert len(spans.table_chunks(CHARACTER, 64)("before\n" + text + "after\n")) == 3


PYTHON = '''import os

# about a
@wrap
def a():
    return """
def not_here():
"""

x = (1,
2)
def b():
    pass
'''


def test_python_code():
    cut = [PYTHON[a:b] for a, b in code.python_pieces(PYTHON)]
    assert [c.split("\n")[0] for c in cut] == ["import os", "# about a", "x = (1,", "def b():"]
    assert code.python_pieces("  indented\n") == []
    kernel = code.code_chunks(CHARACTER, 40, "python")
    assert texts(kernel, "@d\n# c\ndef a():\n    pass\n\ndef b():\n    pass\n")[0].startswith("@d\n# c\ndef a")


GO = """package main

import "fmt"

// Hello says so.
// Twice.
func Hello() {
	fmt.Println("func ( {")
}

var x = `
func no()
`
"""


def test_go_code():
    cut = [GO[a:b] for a, b in code.go_pieces(GO)]
    assert [c.split("\n")[0] for c in cut] == ["package main", 'import "fmt"', "// Hello says so.", "var x = `"]
    for wrong in ("", "hello world", "package main\nx := 1\n", "package main\nfunc f() {", "def a(): pass"):
        assert code.go_pieces(wrong) == []
    with pytest.raises(ValueError):
        code.code_chunks(CHARACTER, 10, "cobol")


def test_markdown():
    text = "```python\ndef a():\n    pass\ndef b():\n    pass\n```\n"
    got = texts(spans.markdown_chunks(CHARACTER, 24), text)
    assert len(got) == 2 and got[1].startswith("def b():")
    inside = "```\n| a |\n| - |\n| b |\n```\n"
    got = spans.markdown_chunks(CHARACTER, 128)(inside)
    assert len(got) == 1 and not got[0].context
    assert spans.find_fences("```\nopen\n") == [] and spans.find_fences("~~~\nx\n~~~\n") == []


def test_semantic():
    from textloom.operators.embed import hash_texts

    text = "Cats sleep. Cats eat. Quantum chromodynamics is hard."
    got = texts(spans.semantic_chunks(CHARACTER, 512, hash_texts, 0.5), text)
    assert len(got) >= 2 and "Quantum" in got[-1]
    assert spans.topic_breaks([None, 0.9, 0.2, 0.1, 0.1, 0.8, 0.3], 0.5) == [False, False, False, True, False, False, True]
    with pytest.raises(ValueError):
        spans.semantic_chunks(CHARACTER, 512, hash_texts, 1.5)


def test_rules():
    assert rules_from_json("[]") == spans.DEFAULT_RULES
    assert rules_from_json("", spans.FALLBACK_RULES) == spans.FALLBACK_RULES
    assert rules_from_json('[{"delimiters": ["x"]}, {"token": true}]') == (spans.Level(("x",)), spans.Level(token=True))
    for wrong in ("{", "{}", "[{}]", '[{"token": true, "delimiters": ["x"]}]', '[{"delimiters": [""]}]', '[{"delimiters": ["x"], "attach": "next"}]', '[{"more": 1}]'):
        with pytest.raises(ValueError):
            rules_from_json(wrong)


def test_factory_errors():
    for name, options in (("other", {}), ("sentence", {"overlap": 1}), ("token", {"rules": "[]"}), ("markdown", {"lang": "go"}), ("token", {"size": 0}), ("token", {"size": 4, "overlap": 4})):
        with pytest.raises(ValueError):
            make_kernel(name, **options)


ALPHABETS = ["The cat sat. Was it? Yes! ", "你好。世界！猫？", "日本語とEnglishの混在。", "👩‍👩‍👧🇩🇪😀 ", "café “naïve” — …", "𠀀𠀁。", "line\r\n\r\nnext\r\n", "| a | b |\n| --- | --- |\n| 1 | 2 |\n", "# T\n```go\npackage p\nfunc f() {}\n```\n", "~~~\ncode\n~~~\n```\nopen\n", "def f(x):\n    return (x,\n1)\n@d\nclass C:\n", "\t\t  ", "x" * 40, "\x00\x7f", "a"]


@pytest.mark.parametrize("name", ["token", "sentence", "recursive", "fast", "table", "code", "markdown", "semantic"])
def test_tiling(name):
    rng = random.Random(name)
    for _ in range(150):
        text = "".join(rng.choice([rng.choice(ALPHABETS), rng.choice(ALPHABETS)[: rng.randint(1, 9)]]) for _ in range(rng.randint(0, 6)))
        size = rng.randint(1, 16)
        for ruler in ("character", "word", "bigram"):
            options = {"size": size} if name == "fast" else {"size": size, "tokenizer": ruler}
            got = make_kernel(name, **options)(text)
            at = 0
            for s in got:
                assert s.start == at and s.end > s.start and s.tokens >= 0
                if name in ("token", "code"):
                    assert s.tokens <= size
                at = s.end
            assert at == len(text)


@pytest.mark.parametrize("ruler", [CHARACTER, WORD, BIGRAM])
def test_counter(ruler):
    """The count of any stretch is that of its text, and no stretch is split where none holds CJK."""
    rng = random.Random(3)
    for alphabet in ("ab \u2003\t\u2019", "ab 大模\u3000か", " \x85", "\U0001f600x "):
        for _ in range(40):
            text = "".join(rng.choices(alphabet, k=rng.randrange(30)))
            count = ruler.counter(text)
            for _ in range(20):
                a, b = sorted(rng.choices(range(len(text) + 1), k=2))
                assert count(a, b) == ruler.count(text[a:b]), (text, a, b)


def test_pieces_are_counted_by_place(monkeypatch):
    """A chunker of words cuts the text into words once, not once for each piece."""
    kernel = make_kernel("recursive", tokenizer="word", size=8)
    calls = []
    monkeypatch.setattr(WORD, "count", lambda text: calls.append(text))
    assert kernel("a b, c d e f. g h i j k, l m. " * 20)
    assert not calls


def test_byte_pair_cuts():
    """Piece ends from the tokens' sizes are those of the pieces, inside characters too."""
    import public_tokenizers as P

    ruler = make_ruler(("tiktoken", P.path("byte_bpe_50k.tiktoken"), P.PATTERN))
    for text in ("", "plain words, 12", "大模型 😀x😀 ça\u2019 \U0001f9d1\u200d\U0001f680", "\n\n  é"):
        ends, at = [], 0
        for piece in ruler.split(text):
            at += len(piece)
            ends.append(at)
        assert list(ruler.cuts(text)) == ends

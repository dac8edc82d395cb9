"""Queries over small texts whose results are known: what the given tables can't show (tables, fences, code, CJK, files)."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import columns, rulers, spans
from textloom.operators import chunkers, refine, scoring
from textloom.operators.embed import cosine
from textloom.sources import readers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def literal(x) -> str:
    if x is None or isinstance(x, bool):
        return {None: "NULL", True: "true", False: "false"}[x]
    if isinstance(x, int):
        return f"{x}::BIGINT"
    if isinstance(x, float):
        return f"{x!r}::DOUBLE"
    return "E'" + x.replace("\\", "\\\\").replace("'", "''").replace("\n", "\\n").replace("\t", "\\t").replace("\r", "\\r") + "'"


def values(names: Sequence[str], rows: Sequence[tuple]) -> str:
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) AS t({', '.join(names)})"


def fixture(name: str, names: str, rows: Sequence[tuple]):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        ORACLE_SQL[name] = values(names.split(), rows)
        return f

    return add


def chunk_fixture(name: str, chunker: str, cases: dict[str, tuple[str, dict, list]]) -> None:
    """cases: name -> (text, options, chunks as texts or (text, context))."""
    want = []
    for case, (text, _, chunks) in cases.items():
        at = 0
        for i, c in enumerate(chunks):
            own, context = c if isinstance(c, tuple) else (c, "")
            want.append((case, i, own, at, at + len(own), context))
            at += len(own)
        assert at == len(text), (name, case)

    @fixture(name, "name chunk_index text chunk_start chunk_end context", want)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = None
        for case, (text, options, _) in cases.items():
            made = chunkers.chunk(spark.createDataFrame([(case, text)], "name string, text string"), chunker, **options)
            shown = made.select("name", F.col("chunk_index").cast("long").alias("chunk_index"), "text", F.col("start").cast("long").alias("chunk_start"), F.col("end").cast("long").alias("chunk_end"), "context")
            out = shown if out is None else out.unionByName(shown)
        return out


# Texts, options and the chunks they must give.
chunk_fixture("fast_fixtures", "fast", {
    "space": ("hello world", {"size": 8, "delimiters": (" ",)}, ["hello ", "world"]),
    "none": ("abcdefgh", {"size": 3, "delimiters": (" ",)}, ["abc", "def", "gh"]),
    "wide": ("你好", {"size": 1}, ["你", "好"]),
    "line": ("one two\nthree four", {"size": 12}, ["one two\n", "three four"]),
})
chunk_fixture("sentence_fixtures", "sentence", {
    "three": ("Cats sleep. Dogs bark. Birds sing.", {"size": 12}, ["Cats sleep.", " Dogs bark.", " Birds sing."]),
    "short": ("a.b.c.d", {"size": 4, "delimiters": (".",), "min_runes": 4}, ["a.b.", "c.d"]),
    "cjk": ("猫睡觉。狗叫！鸟唱？", {"size": 4}, ["猫睡觉。", "狗叫！", "鸟唱？"]),
    "clauses": ("one, two, three, four.", {"size": 10}, ["one, two,", " three,", " four."]),
})
chunk_fixture("recursive_fixtures", "recursive", {
    "words": ("Cats sleep twelve to sixteen hours a day. Dogs sleep ten to fourteen.", {"size": 30}, ["Cats sleep twelve to sixteen ", "hours a day.", " Dogs sleep ten to fourteen."]),
    "paragraphs": ("Hello. World.\n\nHi. There.", {"size": 12}, ["Hello.", " World.\n\n", "Hi. There."]),
    "blank": ("x" * 512 + "\n\n" + "y" * 512, {"size": 512}, ["x" * 512 + "\n\n", "y" * 512]),
    "front": ("x" * 512 + "\n\n" + "y" * 512 + "\n\n", {"size": 512}, ["x" * 512 + "\n\n", "y" * 512 + "\n\n"]),
    "fallback": ("one\ntwo\nthree", {"tokenizer": "word", "size": 1, "rules": spans.FALLBACK_RULES}, ["one\n", "two\n", "three"]),
    "json": ("a|b|cc", {"size": 2, "rules": '[{"delimiters": ["|"]}, {"token": true}]'}, ["a|", "b|", "cc"]),
    "cjk": ("你好。世界", {"size": 3}, ["你好。", "世界"]),
    "bigram": ("大模型大模型", {"tokenizer": "bigram", "size": 2}, ["大模型大", "模型"]),
})
chunk_fixture("table_fixtures", "table", {
    "header": ("| h |\n| --- |\n| 1 |\n| 2 |\n", {"size": 18}, ["| h |\n| --- |\n", ("| 1 |\n| 2 |\n", "| h |\n| --- |\n")]),
    "prose": ("intro\n\n| h |\n| --- |\n| 1 |\n\noutro\n", {"size": 64}, ["intro\n\n", "| h |\n| --- |\n| 1 |\n", "\noutro\n"]),
    "whole": ("| 名 | 值 |\n| --- | --- |\n| 猫 | 一 |\n", {"size": 64}, ["| 名 | 值 |\n| --- | --- |\n| 猫 | 一 |\n"]),
    "no separator": ("| a | b |\n| c | d |\n", {"size": 12}, ["| a | b |\n| ", "c | d |\n"]),
})
_REAL = "def real():\n    pass\n"
chunk_fixture("code_fixtures", "code", {
    **{case: (text + _REAL, {"lang": "python", "size": max(len(text), len(_REAL))}, [text, _REAL]) for case, text in {
        "string": 's = "def not real():"\n\n\n', "comment": "# def not real():\n\n\nx = 1\n\n\n", "triple": 's = """\ndef not real():\n"""\n\n\n', "brackets": "x = f(\n    a,\n    b,\n)\n\n\n",
        "backslash": "x = 1 + \\\n    2\n\n\n", "nested": "if True:\n    def nested():\n        pass\n\n\n",
    }.items()},
    "decorator": ("@cache\n# Returns a value.\ndef f():\n    return 1\n\n\ndef g():\n    return 2\n", {"lang": "py", "size": 60}, ["@cache\n# Returns a value.\ndef f():\n    return 1\n\n\n", "def g():\n    return 2\n"]),
    "class": ("class C:\n    def m(self):\n        return 1\n", {"lang": "python", "size": 512}, ["class C:\n    def m(self):\n        return 1\n"]),
    "go": ("package p\n\nfunc A() {}\n\nfunc B() {}\n", {"lang": "go", "size": 24}, ["package p\n\nfunc A() {}\n\n", "func B() {}\n"]),
    "go comment": ("package p\n\n// Hello does a thing.\nfunc Hello() {}\n", {"size": 40}, ["package p\n\n", "// Hello does a thing.\nfunc Hello() {}\n"]),
    "neither": ("not go source at all", {"size": 3}, ["not", " go", " so", "urc", "e a", "t a", "ll"]),
})
_TWO = "def a():\n    pass\n\n\ndef b():\n    pass\n"
chunk_fixture("markdown_fixtures", "markdown", {
    **{lang: (f"```{lang}\n{_TWO}```\n", {"size": 24}, [f"```{lang}\ndef a():\n    pass\n\n\n", "def b():\n    pass\n```\n"]) for lang in ("python", "py")},
    "pipes in code": ("```\n| h |\n| --- |\n| 1 |\n```\n", {"size": 128}, ["```\n| h |\n| --- |\n| 1 |\n```\n"]),
    "mixed": ("Some prose.\n\n| h |\n| --- |\n| 1 |\n\n```\ncode\n```\nEnd.", {"size": 64}, ["Some prose.\n\n", "| h |\n| --- |\n| 1 |\n", "\n", "```\ncode\n```\n", "End."]),
})
_CATS = ["cats sleep on soft beds.", "cats sleep in warm sun.", "cats sleep through rainy nights.", "cats dream.", "cats sleep all day long.", "cats sleep near warm fires.", "cats sleep after every meal.", "cats sleep until noon arrives."]
_QUANTA = ["Quantum entanglement links distant particles.", "Quantum superposition defies classical physics.", "Quantum computing uses qubits and gates.", "Quantum states collapse when measured."]
chunk_fixture("semantic_fixtures", "semantic", {
    "two topics": ("Cats sleep. Cats eat. Quantum chromodynamics is hard.", {"min_sim": 0.5}, ["Cats sleep. Cats eat.", " Quantum chromodynamics is hard."]),
    "window": ("".join(_CATS + _QUANTA), {"min_sim": 0.35, "window": 3}, ["".join(_CATS), "".join(_QUANTA)]),
    "small": ("Cats sleep. Cats eat.", {"size": 12, "min_sim": 0.0}, ["Cats sleep.", " Cats eat."]),
})


@fixture("recursive_overlap_fixtures", "chunk_index chunk_start chunk_end text", [(i, max(0, 5 * i - 2), 5 * i + 5, ("d " if i else "") + "word ") for i in range(8)])
def recursive_overlap_fixtures(spark, sf_dir):
    made = chunkers.chunk(spark.createDataFrame([("word " * 8,)], "text string"), "recursive", size=8, overlap=2)
    return made.select(F.col("chunk_index").cast("long").alias("chunk_index"), F.col("start").cast("long").alias("chunk_start"), F.col("end").cast("long").alias("chunk_end"), "text")


# Pieces of rulers and terms of an index, joined by a bar.
_RULED = [
    ("大模型", "大模|型", "大模|模型"), ("猫", "猫", "猫"), ("大模型RAG", "大模|型|RAG", "大模|模型|rag"), ("你好，世界", "你好|，|世界", "你好|世界"),
    ("hello world", "hello| |world", "hello|world"), ("name,color", "name,color", "name|color"), ("한국어", "한국|어", "한국|국어"),
]


@fixture("cjk_fixtures", "text pieces terms has_cjk", [(t, p, w, any(ord(c) > 0x2FFF and c != "，" for c in t)) for t, p, w in _RULED])
def cjk_fixtures(spark, sf_dir):
    df = spark.createDataFrame([(t,) for t, *_ in _RULED], "text string")
    return df.select("text", F.array_join(columns.ruler_pieces(F.col("text"), "bigram"), "|").alias("pieces"), F.array_join(columns.index_terms(F.col("text")), "|").alias("terms"), columns.is_cjk(F.col("text")).alias("has_cjk"))


# Pieces at delimiters.
_SPLIT = [("a.b.c", ".", "prev", "a.|b.|c"), ("a.b.c", ".", "next", "a|.b|.c"), ("a.b.c", ".", "own", "a|.|b|.|c"), ("a..b", ".", "prev", "a.|.|b"), ("hello##world#end", "# ##", "prev", "hello##|world#|end"), ("你好。世界", "。", "prev", "你好。|世界")]


@fixture("split_fixtures", "text attach pieces starts", [(t, a, p, "|".join(str(sum(map(len, p.split("|")[:i]))) for i in range(len(p.split("|"))))) for t, _, a, p in _SPLIT])
def split_fixtures(spark, sf_dir):
    out = None
    for text, delimiters, attach, _ in _SPLIT:
        pieces = columns.with_offsets(columns.split_pieces(F.col("text"), delimiters.split(), attach))
        one = spark.createDataFrame([(text,)], "text string").select("text", F.lit(attach).alias("attach"), F.array_join(pieces["text"], "|").alias("pieces"), F.array_join(F.transform(pieces["start"], lambda x: x.cast("string")), "|").alias("starts"))
        out = one if out is None else out.union(one)
    return out


# Bytes of text in runs that may end inside a character.
_RUNS = [("你好", [2, 4], "|你好"), ("你好", [1, 1, 1, 3], "||你|好"), ("aé", [1, 2], "a|é"), ("é😀", [1, 2, 3], "|é|😀")]


@fixture("byte_run_fixtures", "text sizes pieces", [(t, "+".join(map(str, s)), p) for t, s, p in _RUNS])
def byte_run_fixtures(spark, sf_dir):
    rows = [(t, "+".join(map(str, s)), "|".join(rulers.pieces_at_code_points(t.encode(), s))) for t, s, _ in _RUNS]
    return spark.createDataFrame(rows, "text string, sizes string, pieces string")


_MARKED = "a\n```go\nx\n```\n| h |\n| --- |\n| 1 |\n```\nopen"


@fixture("markup_fixtures", "kind span_start span_end language body", [("fence", 2, 14, "go", "x\n"), ("table", 14, 34, "", "")])
def markup_fixtures(spark, sf_dir):
    """The closed fence and the table of a text that ends in a fence left open."""
    rows = [("fence", f.start, f.end, f.language, _MARKED[f.inner_start : f.inner_end]) for f in spans.find_fences(_MARKED)] + [("table", a, b, "", "") for a, b in spans.find_tables(_MARKED)]
    return spark.createDataFrame(rows, "kind string, span_start long, span_end long, language string, body string")


_THREE = [(1, 0, "Cats sleep.", 0, 11, 11, ""), (1, 1, "Dogs bark.", 11, 21, 10, ""), (1, 2, "Birds sing.", 21, 32, 11, "")]


# neighbours' tokens in the texts.
@fixture("merge_fixtures", "how chunk_index text context token_count chunk_start", [
    ("prefix", 0, "Cats sleep.", "", 11, 0), ("prefix", 1, "ep.Dogs bark.", "ep.", 13, 11), ("prefix", 2, "rk.Birds sing.", "rk.", 14, 21),
    ("suffix", 0, "Cats sleep.Dog", "Dog", 14, 0), ("suffix", 1, "Dogs bark.Bir", "Bir", 13, 11), ("suffix", 2, "Birds sing.", "", 11, 21),
    ("justified", 0, "Cats sleep.Dog", "Dog", 14, 0), ("justified", 1, "ep.Dogs bark.Bir", "ep.Bir", 16, 11), ("justified", 2, "rk.Birds sing.", "rk.", 14, 21),
])
def merge_fixtures(spark, sf_dir):
    df = spark.createDataFrame(_THREE, "doc_id long, chunk_index int, text string, start int, end int, token_count int, context string")
    out = None
    for how in ("prefix", "suffix", "justified"):
        one = refine.merge(df, 3, how).select(F.lit(how).alias("how"), F.col("chunk_index").cast("long").alias("chunk_index"), "text", "context", F.col("token_count").cast("long").alias("token_count"), F.col("start").cast("long").alias("chunk_start"))
        out = one if out is None else out.union(one)
    return out


@fixture("csv_fixtures", "path chunk_index text context token_count", [("a.csv", 0, "apple,red", "name,color", 9), ("a.csv", 1, "banana,yellow", "name,color", 13), ("b.csv", 0, "Widget, large,two\nlines", "a,b", 23), ("t.tsv", 0, "1\t2", "x\ty", 3)])
def csv_fixtures(spark, sf_dir):
    df = spark.createDataFrame([("a.csv", "name,color\napple,red\nbanana,yellow\n"), ("b.csv", 'a,b\n"Widget, large","two\nlines"\n'), ("t.tsv", "x\ty\n1\t2\n")], "path string, text string")
    made = readers.tabular_chunks(df.where("path <> 't.tsv'")).unionByName(readers.tabular_chunks(df.where("path = 't.tsv'"), "\t"))
    return made.select("path", F.col("chunk_index").cast("long").alias("chunk_index"), "text", "context", F.col("token_count").cast("long").alias("token_count"))


def _book() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="x"><rootfiles><rootfile full-path="o/book.opf"/></rootfiles></container>')
        z.writestr("o/book.opf", '<package xmlns="y"><manifest><item id="b" href="two.xhtml"/><item id="a" href="one.xhtml"/></manifest><spine><itemref idref="a"/><itemref idref="b"/></spine></package>')
        z.writestr("o/one.xhtml", "<body><p>One one.</p><p>Two two.</p></body>")
        z.writestr("o/two.xhtml", "<p>Three three.</p>")
    return out.getvalue()


# What files become.
@fixture("file_fixtures", "path format text", [
    ("book.epub", "epub", "One one.\n\nTwo two.\n\nThree three."), ("a.html", "html", "Title\n\nFirst bold para.\n\nSecond para line."), ("b.htm", "html", "Tom & Jerry <3"), ("c.xhtml", "html", "Visible"), ("n.txt", "text", "plain"),
])
def file_fixtures(spark, sf_dir):
    files = [
        ("book.epub", _book()), ("a.html", b"<html><head><title>no</title></head><body><h1>Title</h1><p>First <b>bold</b>\n para.</p><p>Second<br>para line.</p></body></html>"), ("b.htm", b"<p>Tom &amp; Jerry &lt;3</p>"),
        ("c.xhtml", b"<script>var x='<p>';</script><style>p{}</style><p>Visible</p>"), ("n.txt", b"plain"),
    ]
    df = spark.createDataFrame(files, "path string, content binary")
    return readers.extract(df.select("path", readers.format_of(F.col("path")).alias("format"), "content"))


# What sparse scores must be to one another.
@fixture("scoring_fixtures", "rule holds", [("rare over frequent", True), ("absent is zero", True), ("context counts", True), ("best is one", True), ("empty text is zero", True)])
def scoring_fixtures(spark, sf_dir):
    docs = spark.createDataFrame([(0, "the cat sat", ""), (1, "the dog ran", ""), (2, "the fox napped", ""), (3, "cat cat cat", ""), (4, "apple,red", "name,color"), (5, "", "")], "record_id long, text string, context string")
    of = lambda q, i, **o: scoring.bm25(docs, q, **o).where(F.col("record_id") == i).select("score")
    one = lambda rule, df: df.select(F.lit(rule).alias("rule"), F.col("holds"))
    rows = [
        one("rare over frequent", scoring.bm25(docs, "cat", normalize=False).withColumnRenamed("score", "a").join(scoring.bm25(docs, "the", normalize=False), "record_id").where("record_id = 0").select((F.col("a") > F.col("score")).alias("holds"))),
        one("absent is zero", scoring.bm25(docs, "absent").agg((F.max("score") == 0).alias("holds"))),
        one("context counts", of("color", 4).select((F.col("score") > 0).alias("holds"))),
        one("best is one", scoring.bm25(docs, "cat").agg((F.max("score") == 1).alias("holds"))),
        one("empty text is zero", of("cat", 5).select((F.col("score") == 0).alias("holds"))),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out


@fixture("cosine_fixtures", "name score", [("same", 1.0), ("apart", 0.0), ("half", 0.707107), ("wider", 0.0), ("zero", 0.0), ("blend", 0.875)])
def cosine_fixtures(spark, sf_dir):
    df = spark.createDataFrame([("same", [1.0, 2.0], [2.0, 4.0]), ("apart", [1.0, 0.0], [0.0, 3.0]), ("half", [1.0, 0.0], [1.0, 1.0]), ("wider", [1.0], [1.0, 1.0]), ("zero", [0.0, 0.0], [1.0, 1.0])], "name string, a array<float>, b array<float>")
    scores = df.select("name", F.round(cosine(F.col("a"), F.col("b")), 6).alias("score"))
    return scores.union(spark.range(1).select(F.lit("blend"), scoring.blend(F.lit(0.5), F.lit(2.0), 0.75)))

"""Queries over files, stores, the command line and the service, with known results."""

from __future__ import annotations

import contextlib
import io
import json
import sqlite3
import struct
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom import cli, httpapi
from textloom.operators import chunkers, validate, visualize
from textloom.operators.embed import RemoteEmbedder, make_embedder
from textloom.plans import fixtures
from textloom.plans.fixtures import fixture
from textloom.schema import RECORD
from textloom.sources import readers

QUERIES, ORACLE_SQL = fixtures.QUERIES, fixtures.ORACLE_SQL


def scratch(spark: SparkSession) -> str:
    """A new folder's name in the folder that executors share, or, where none is named, in one of this machine's."""
    root = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="textloom-")
    return f"{root.rstrip('/')}/textloom/plans-{uuid.uuid4().hex}"


def put(spark: SparkSession, path: str, data: bytes) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p)
    out.write(data)
    out.close()


def records(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame([(t, s, s + len(t), len(t), c, v, src) for t, s, c, v, src in rows], RECORD)


_FILES = {"b.txt": b"B text.", "A.MD": b"A text.", "c.html": b"<p>C</p>", "t.tsv": b"x\ty\n1\t2\n", "skip.bin": b"no", "sub/z.txt": "Zoé".encode(), "sub/deep/e.epub": fixtures._book()}


# The files of a folder, as text.
@fixture("directory_fixtures", "path format text", [("A.MD", "text", "A text."), ("b.txt", "text", "B text."), ("c.html", "html", "C"), ("sub/deep/e.epub", "epub", "One one.\n\nTwo two.\n\nThree three."), ("sub/z.txt", "text", "Zoé"), ("t.tsv", "tsv", "x\ty\n1\t2\n")])
def directory_fixtures(spark, sf_dir):
    root = scratch(spark)
    for name, data in _FILES.items():
        put(spark, f"{root}/{name}", data)
    return readers.extract(readers.read_directory(spark, root, readers.parse_extensions(" txt, .MD,html,tsv,epub")))


@fixture("read_text_fixtures", "name text", [("b.txt", "B text.\nTwo lines.")])
def read_text_fixtures(spark, sf_dir):
    root = scratch(spark)
    put(spark, f"{root}/b.txt", b"B text.\nTwo lines.")
    return readers.read_text(spark, f"{root}/b.txt").select(F.regexp_extract("path", "[^/]*$", 0).alias("name"), "text")


@fixture("extension_fixtures", "names extensions", [("", ".txt|.md"), (" txt, .MD,,", ".txt|.md"), ("csv", ".csv")])
def extension_fixtures(spark, sf_dir):
    return spark.createDataFrame([(n, "|".join(readers.parse_extensions(n))) for n in ("", " txt, .MD,,", "csv")], "names string, extensions string")


# What stores hold after some writes.
@fixture("jsonl_fixtures", "text chunk_start context source vector", [("new", 5, "", "c", "1.0|1.0"), ("two", 3, "", "", "0.0|2.0")])
def jsonl_fixtures(spark, sf_dir):
    """Records in JSON Lines: added, given again under another source, replaced; a source deleted."""
    store = readers.open_index(spark, f"{scratch(spark)}/index.jsonl")
    store.upsert(records(spark, [("one", 0, "h", [1.0, 0.0], "a"), ("two", 3, "", [0.0, 2.0], ""), ("gone", 9, "", [1.0, 1.0], "x")]))
    store.upsert(records(spark, [("one", 0, "h", [3.0, 0.0], "c")]), mode="keyed")
    store.delete_source("x")
    store.index(records(spark, [("new", 5, "", [1.0, 1.0], "")]), source="c", replace=True)
    return store.records().select("text", F.col("start").cast("long").alias("chunk_start"), "context", "source", F.array_join(F.transform("vector", lambda x: x.cast("string")), "|").alias("vector"))


@fixture("sqlite_fixtures", "text chunk_start chunk_end token_count context source vector", [("one", 0, 3, 3, "h", "s", "1.5|-2.0"), ("猫", 3, 4, 1, "", "", "0.25|0.0")])
def sqlite_fixtures(spark, sf_dir):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE TABLE records (text TEXT, start INTEGER, end INTEGER, context TEXT, token_count INTEGER, vector BLOB, source TEXT)")
    con.executemany("INSERT INTO records VALUES (?, ?, ?, ?, ?, ?, ?)", [("one", 0, 3, "h", 3, struct.pack("<2f", 1.5, -2), "s"), ("猫", 3, 4, "", 1, struct.pack("<2f", 0.25, 0), "")])
    con.commit()
    path = f"{scratch(spark)}/index.db"
    put(spark, path, con.serialize())
    rows = readers.open_index(spark, path)
    return rows.select("text", F.col("start").cast("long").alias("chunk_start"), F.col("end").cast("long").alias("chunk_end"), F.col("token_count").cast("long").alias("token_count"), "context", "source", F.array_join(F.transform("vector", lambda x: x.cast("string")), "|").alias("vector"))


_VECTORS = [{"index": 1, "embedding": [2.0]}, {"index": 0, "embedding": [1.0]}]
_ANSWERS = {
    "in order": ({"data": _VECTORS}, 200), "one too few": ({"data": _VECTORS[:1]}, 200), "twice": ({"data": [_VECTORS[0], _VECTORS[0]]}, 200), "out of range": ({"data": [_VECTORS[0], {"index": 7, "embedding": [1]}]}, 200),
    "error": ({"error": {"message": "no"}}, 200), "status": ({}, 500), "no vector": ({"data": [_VECTORS[0], {"index": 0}]}, 200),
}


# Answers of an embedding service, and whether they are taken.
@fixture("remote_embedding_fixtures", "answer vectors", [(k, "1.0|2.0" if k == "in order" else "refused") for k in _ANSWERS] + [("named hashing", "64"), ("named other", "refused"), ("batches of 2", "2|2|1")])
def remote_embedding_fixtures(spark, sf_dir):
    rows = []

    def add(name, call):
        try:
            rows.append((name, call()))
        except ValueError:
            rows.append((name, "refused"))

    for name, (body, status) in _ANSWERS.items():
        remote = RemoteEmbedder("http://x", "k", "m", lambda *_, body=body, status=status: (status, json.dumps(body).encode()))
        add(name, lambda remote=remote: "|".join(str(v[0]) for v in remote(["a", "b"])))
    add("named hashing", lambda: str(len(make_embedder("hashing")(["a b"])[0])))
    add("named other", lambda: str(make_embedder("other")))
    sizes = spark.sparkContext.parallelize([None], 1)  # one task, so that batches are seen in order
    from textloom.operators.embed import embed

    texts = spark.createDataFrame(sizes.flatMap(lambda _: [(str(i),) for i in range(5)]), "text string")
    seen = embed(texts, F.col("text"), embedder=lambda own: [[float(len(own))] for _ in own], batch=2)
    counts = [int(r["vector"][0]) for r in seen.collect()]
    rows.append(("batches of 2", "|".join(map(str, [counts[0], counts[2], counts[4]]))))
    return spark.createDataFrame(rows, "answer string, vectors string")


# Command lines, their exit codes and what they print.
_COMMANDS = [
    ("sentence", 0, '[["Cats sleep.", 0, 11, 11], [" Dogs bark.", 11, 22, 11]]'), ("folder", 0, '["cats.txt", "t.csv"]'), ("query", 0, '["cats.txt"]'), ("sources", 0, '[["cats.txt", 1], ["t.csv", 1]]'), ("delete", 0, "1"), ("deleted", 0, '[["cats.txt", 1]]'),
    ("wrong size", 2, ""), ("k without query", 2, ""), ("query without index", 2, ""), ("unknown chunker", 2, ""), ("missing file", 1, ""),
]


@fixture("command_fixtures", "command code printed", _COMMANDS)
def command_fixtures(spark, sf_dir):
    root = scratch(spark)
    put(spark, f"{root}/d/cats.txt", b"Cats sleep. Dogs bark.")
    put(spark, f"{root}/d/t.csv", b"name,color\napple,red\n")
    index = ("-index", f"{root}/index")
    calls = {
        "sentence": (("-chunker", "sentence", "-size", "12", f"{root}/d/cats.txt"), lambda x: [[c["text"], c["start"], c["end"], c["token_count"]] for c in x]),
        "folder": (("-dir", f"{root}/d", "-ext", "txt,csv", *index), lambda x: [d["path"] for d in x]), "query": ((*index, "-query", "cats", "-k", "1", "-scoring", "hybrid"), lambda x: [h["record"]["source"] for h in x]),
        "sources": ((*index, "-list-sources"), lambda x: [[s["name"], s["count"]] for s in x]), "delete": ((*index, "-delete-source", "t.csv"), lambda x: x["deleted"]), "deleted": ((*index, "-list-sources"), lambda x: [[s["name"], s["count"]] for s in x]),
        "wrong size": (("-size", "0"), None), "k without query": (("-k", "3"), None), "query without index": (("-query", "x"), None), "unknown chunker": (("-chunker", "none"), None), "missing file": ((f"{root}/none.txt",), None),
    }
    rows = []
    for name, (argv, show) in calls.items():
        out = io.StringIO()
        with contextlib.redirect_stdout(out), contextlib.redirect_stderr(io.StringIO()):
            code = cli.run(list(argv), spark)
        rows.append((name, code, json.dumps(show(json.loads(out.getvalue()))) if show else out.getvalue()))
    return spark.createDataFrame(rows, "command string, code long, printed string")


# Requests, their status and a part of the answer.
_REQUESTS = [
    ("GET /health", "", 200, "ok"), ("POST /v1/chunk", '{"text": "Cats sleep. Dogs bark.", "chunker": "sentence", "size": 12}', 200, "Cats sleep.| Dogs bark."), ("POST /v1/index", '{"text": "Cats sleep.", "source": "a"}', 200, "1"),
    ("POST /v1/search", '{"query": "cats", "k": 1, "scoring": "bm25"}', 200, "1.0"), ("GET /v1/sources", "", 200, "a=1"), ("DELETE /v1/sources/a", "", 200, "1"), ("POST /v1/search", "{}", 400, ""), ("POST /v1/chunk", "no json", 400, ""), ("POST /v1/chunk", '{"other": 1}', 400, ""),
    ("GET /v1/chunk", "", 405, ""), ("GET /other", "", 404, ""), ("POST /v1/chunk", '{"size": 0}', 400, ""),
]


@fixture("request_fixtures", "request body status answer", _REQUESTS)
def request_fixtures(spark, sf_dir):
    service = httpapi.Service(spark, f"{scratch(spark)}/index")
    shown = {
        "GET /health": lambda x: x["status"], "POST /v1/chunk": lambda x: "|".join(c["text"] for c in x["chunks"]), "POST /v1/index": lambda x: str(x["indexed"]), "POST /v1/search": lambda x: "|".join(str(h["score"]) for h in x["hits"]),
        "GET /v1/sources": lambda x: "|".join(f"{s['name']}={s['count']}" for s in x["sources"]), "DELETE /v1/sources/a": lambda x: str(x["deleted"]),
    }
    rows = []
    for request, body, _, _ in _REQUESTS:
        try:
            status, answer = service.handle(*request.split(" "), body.encode())
            rows.append((request, body, status, shown[request](answer)))
        except httpapi.Refused as e:
            rows.append((request, body, e.status, ""))
        except ValueError:  # the server answers these with 400
            rows.append((request, body, 400, ""))
    return spark.createDataFrame(rows, "request string, body string, status long, answer string")


@fixture("client_fixtures", "call answer", [("health", "ok"), ("chunk", "one |two"), ("sources", ""), ("refused", "400")])
def client_fixtures(spark, sf_dir):
    """The server on a free port of this machine, and the client."""
    import threading

    server = httpapi.make_server(spark, f"{scratch(spark)}/index", port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        client = httpapi.Client(f"http://127.0.0.1:{server.server_address[1]}")
        rows = [("health", client.health()["status"]), ("chunk", "|".join(c["text"] for c in client.chunk("one two", size=4))), ("sources", "|".join(s["name"] for s in client.sources()))]
        try:
            client.search("")
        except httpapi.ClientError as e:
            rows.append(("refused", str(e.status)))
    finally:
        server.shutdown()
        server.server_close()
    return spark.createDataFrame(rows, "call string, answer string")


# Rows that no chunk may be.
@fixture("bad_chunk_fixtures", "name", [("crossed",), ("negative start",), ("negative tokens",), ("another length",)])
def bad_chunk_fixtures(spark, sf_dir):
    rows = [("good", "abc", 0, 3, 1), ("empty", "", 2, 2, 0), ("crossed", "", 5, 4, 1), ("negative start", "ab", -1, 1, 1), ("negative tokens", "a", 0, 1, -1), ("another length", "abcd", 0, 3, 1)]
    return validate.check_chunks(spark.createDataFrame(rows, "name string, text string, start int, end int, token_count int")).select("name")


# Options that are refused.
_OPTIONS = [
    ("token", {"size": 0}, False), ("token", {"size": 4, "overlap": 4}, False), ("token", {"size": 4, "overlap": 3}, True), ("sentence", {"overlap": 1}, False), ("fast", {"size": -1}, False), ("table", {"rules": "[]"}, False), ("markdown", {"lang": "go"}, False), ("code", {"lang": "rust"}, False),
    ("code", {"lang": "Python3"}, True), ("semantic", {"min_sim": 1.5}, False), ("semantic", {"window": 0}, False), ("other", {}, False), ("recursive", {"tokenizer": "other"}, False), ("recursive", {"rules": "{}"}, False), ("recursive", {"rules": '[{"token": true}]'}, True),
]


@fixture("option_fixtures", "chunker options taken", [(c, json.dumps(o), ok) for c, o, ok in _OPTIONS])
def option_fixtures(spark, sf_dir):
    rows = []
    for name, options, _ in _OPTIONS:
        try:
            chunkers.make_kernel(name, **options)
            rows.append((name, json.dumps(options), True))
        except ValueError:
            rows.append((name, json.dumps(options), False))
    return spark.createDataFrame(rows, "chunker string, options string, taken boolean")


@fixture("page_fixtures", "part holds", [("title is escaped", True), ("all text is there", True), ("one mark for each chunk", True)])
def page_fixtures(spark, sf_dir):
    """The HTML page of a text's chunks."""
    text = "Cats <sleep>. Dogs & birds."
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    segments = [r.asDict() for r in visualize.layout(chunkers.chunk(docs, "sentence", size=14), docs).orderBy("start").collect()]
    page = visualize.render(segments, "a <b>")
    import html
    import re

    body = page[page.index("<pre>") : page.index("</pre>")]
    rows = [("title is escaped", "a &lt;b&gt;" in page and "a <b>" not in page), ("all text is there", html.unescape(re.sub(r"<[^>]*>", "", body)) == text), ("one mark for each chunk", body.count("<span") == 2 or body.count("<mark") == 2)]
    return spark.createDataFrame(rows, "part string, holds boolean")

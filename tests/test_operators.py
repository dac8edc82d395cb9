"""DataFrame operators: columns against kernels, context, index, search, evaluation, sources, streaming, CLI."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from textloom import cli
from textloom.functions import columns, spans
from textloom.functions.rulers import BIGRAM, CHARACTER, WORD
from textloom.functions.rulers import index_terms as python_terms
from textloom.operators import chunkers, evaluate, index, refine, resident, scoring, validate, visualize
from textloom.operators.embed import RemoteEmbedder, cosine, embed, hash_texts, hashing_counts, hashing_vector, mean_vector, slot_column
from textloom.operators.embed import slot as python_slot
from textloom.sources import extract, readers

TEXTS = ["", "Hello, world! Ça va?\u0085\u001cx", "大模型RAG，你好。世界 kana かな", "  a  b\tc\n", "😀 x😀y", "ΑΣ İx"]


def frame(spark, texts=TEXTS):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_columns_match_kernels(spark):
    df = frame(spark)
    rows = df.select("text", columns.ruler_pieces(F.col("text"), "word").alias("w"), columns.ruler_pieces(F.col("text"), "bigram").alias("b"), columns.index_terms(F.col("text")).alias("t"), columns.character_codes(F.col("text")).alias("c"), columns.with_offsets(columns.split_pieces(F.col("text"), [".", "!", "。"])).alias("p"), columns.line_pieces(F.col("text")).alias("l")).collect()
    for r in rows:
        assert r.w == WORD.split(r.text) and r.b == BIGRAM.split(r.text) and r.t == python_terms(r.text)
        assert r.c == [ord(x) for x in r.text]
        assert [(p.start, p.end) for p in r.p] == spans.split_at([".", "!", "。"])(r.text)
        assert r.l == [r.text[a:b] for a, b in spans.line_spans(r.text)]


@pytest.mark.parametrize(("ruler", "size", "overlap"), [("character", 4, 0), ("character", 5, 2), ("word", 3, 1), ("bigram", 2, 0)])
def test_token_windows(spark, ruler, size, overlap):
    made = {"character": CHARACTER, "word": WORD, "bigram": BIGRAM}[ruler]
    kernel = spans.token_chunks(made, size, overlap)
    for r in frame(spark).select("text", columns.token_windows(F.col("text"), size, overlap, ruler).alias("w")).collect():
        assert [(w.start, w.end, w.token_count) for w in r.w] == [(s.start, s.end, s.tokens) for s in kernel(r.text)]


@pytest.mark.parametrize("name", chunkers.CHUNKERS)
def test_chunks_tile(spark, name):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*TEXTS, None, "A b. C d! " * 30])], "doc_id long, text string, extra string")
    got = chunkers.chunk(df, name, size=7)
    assert got.columns == ["doc_id", "extra", "chunk_index", "text", "start", "end", "token_count", "context"]
    assert validate.validate_chunks(got, df).where("NOT tiles").count() == 0
    assert validate.check_chunks(got).count() == 0


def test_chunk_errors_and_sql(spark):
    df = spark.createDataFrame([("a", 1)], "text string, start int")
    with pytest.raises(ValueError):
        chunkers.chunk(df)
    chunkers.register(spark)
    rows = spark.sql("SELECT text, start FROM chunk_text('Cats sleep. Dogs bark. Birds sing.', 'sentence', 'character', 12, 0)").collect()
    assert [r.start for r in rows] == [0, 11, 22]
    nested = chunkers.documents(chunkers.chunk(frame(spark), "token", size=3), ["doc_id"]).where("doc_id = 1").first()
    assert [c.chunk_index for c in nested.chunks] == list(range(len(nested.chunks)))


def three(spark):
    return spark.createDataFrame([(1, 0, "Cats sleep.", 0, 11, 11, ""), (1, 1, "Dogs bark.", 11, 21, 10, ""), (1, 2, "Birds sing.", 21, 32, 11, "")], "doc_id long, chunk_index int, text string, start int, end int, token_count int, context string")


def test_context(spark):
    merged = refine.merge(three(spark), 3, "justified").orderBy("chunk_index").collect()
    assert [r.text for r in merged] == ["Cats sleep.Dog", "ep.Dogs bark.Bir", "rk.Birds sing."]
    assert merged[1].context == "ep.Bir" and merged[1].start == 11
    prefixed = refine.merge(three(spark), 3).orderBy("chunk_index").collect()
    assert prefixed[1].text == "ep.Dogs bark." and prefixed[1].token_count == 13
    assert [r.context for r in refine.context_suffix(three(spark), 1, ruler="word").orderBy("chunk_index").collect()] == ["Dogs", "Birds", ""]
    for n, mode in ((-1, "prefix"), (1, "middle")):
        with pytest.raises(ValueError):
            refine.merge(three(spark), n, mode)


def test_layout(spark):
    docs = spark.createDataFrame([(1, "abcdefghij"), (2, "xyz")], "doc_id long, text string")
    chunks = spark.createDataFrame([(1, 0, "bcd", 1, 4, 3, ""), (1, 1, "cdEf", 2, 6, 4, ""), (1, 2, "cd", 2, 4, 2, "")], "doc_id long, chunk_index int, text string, start int, end int, token_count int, context string")
    rows = visualize.layout(chunks, docs).orderBy("doc_id", "start").collect()
    one = [r for r in rows if r.doc_id == 1]
    assert "".join(r.text for r in one) == "abcdefghij" and [r.text for r in rows if r.doc_id == 2] == ["xyz"]
    assert any(r.overlap and r.mismatch for r in one) and any(r.covered for r in one)
    assert "<pre>" in visualize.render([r.asDict() for r in one], "a <b>")


def test_embedding(spark):
    df = frame(spark)
    got = df.select("text", hashing_vector(F.col("text")).alias("v"), cosine(hashing_vector(F.col("text")), hashing_vector(F.col("text"))).alias("c")).collect()
    for r in got:
        assert r.v == hash_texts([r.text])[0].tolist()
        assert r.c == pytest.approx(1.0 if any(r.v) else 0.0)
    terms = spark.createDataFrame([("hello",), ("世界",)], "t string")
    assert [r.s for r in terms.select(slot_column(F.col("t")).alias("s")).collect()] == [python_slot("hello"), python_slot("世界")]
    assert [round(x, 6) for x in mean_vector(spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, 5.0])], "k int, vector array<float>"), ["k"]).first().mean] == [2.0, 3.5]


def test_remote_embedder(spark):
    def answer(rows, status=200):
        return RemoteEmbedder("http://x", "k", "m", lambda *_: (status, json.dumps(rows).encode()))

    two = [{"index": 1, "embedding": [2.0]}, {"index": 0, "embedding": [1.0]}]
    assert answer({"data": two})(["a", "b"]) == [[1.0], [2.0]]
    for rows, status in (({"data": two[:1]}, 200), ({"data": [two[0], two[0]]}, 200), ({"data": [two[0], {"index": 7, "embedding": [1]}]}, 200), ({"error": {"message": "no"}}, 200), ({}, 500), ({"data": [two[0], {"index": 0}]}, 200)):
        with pytest.raises(ValueError):
            answer(rows, status)(["a", "b"])
    got = embed(frame(spark), F.col("text"), embedder=lambda texts: [[float(len(t))] for t in texts], batch=2)
    assert {r.doc_id: r.vector for r in got.collect()} == {i: [float(len(t))] for i, t in enumerate(TEXTS)}


def records(spark, rows):
    return spark.createDataFrame([(t, s, s + len(t), len(t), c, v, src) for t, s, c, v, src in rows], index.RECORD)


def test_bm25(spark):
    docs = spark.createDataFrame([(0, "the cat sat", ""), (1, "the dog ran", ""), (2, "the fox napped", ""), (3, "cat cat cat", ""), (4, "apple,red", "name,color"), (5, "", "")], "record_id long, text string, context string")
    score = lambda q, **o: {r.record_id: r.score for r in scoring.bm25(docs, q, **o).collect()}
    assert score("cat", normalize=False)[0] > score("the", normalize=False)[0] and max(score("cat").values()) == 1.0
    assert score("color")[4] > 0 and set(score("absent").values()) == {0.0} and score("cat")[5] == 0
    many = scoring.bm25_many(docs, spark.createDataFrame([("q", "cat the")], "query_id string, query string"))
    one = score("cat the", normalize=False)
    assert {r.record_id: round(r.score, 9) for r in many.collect()} == {k: round(v, 9) for k, v in one.items() if v}
    with pytest.raises(ValueError):
        scoring.blend(F.lit(1.0), F.lit(1.0), 1.5)


def test_index(spark, tmp_path):
    store = index.ParquetIndex(spark, f"file://{tmp_path}/index")
    assert store.records().count() == 0
    store.upsert(records(spark, [("one", 0, "", [1.0, 0.0], "a.md"), ("two", 3, "", [0.0, 1.0], "")]))
    store.upsert(records(spark, [("one", 0, "", [0.5, 0.5], "b.md")]))
    assert {(r.text, r.source, tuple(r.vector)) for r in store.records().collect()} == {("one", "b.md", (0.5, 0.5)), ("two", "", (0.0, 1.0))}
    hits = store.search("x", vector=[0.0, 1.0], k=5).collect()
    assert [h.text for h in hits] == ["two", "one"] and hits[0].score == pytest.approx(1)
    assert [store.search("x", vector=[1.0, 0.0], source=s).count() for s in ("b.md", "", "nope")] == [1, 1, 0]
    with pytest.raises(Exception, match="dimensions"):
        store.search("x", vector=[1.0]).collect()
    for wrong in ({"k": 0}, {"mode": "other"}, {"stats_scope": "all"}):
        with pytest.raises(ValueError):
            store.search("x", vector=[1.0, 0.0], **wrong)
    for bad in ([], [float("nan"), 0.0]):
        with pytest.raises(ValueError):
            store.upsert(records(spark, [("bad", 0, "", bad, "")]))
    store.upsert(records(spark, [("two", 3, "", [0.0, 1.0], "c.md")]), mode="append")
    assert [(r["name"], r["count"]) for r in store.sources().collect()] == [("", 1), ("b.md", 1), ("c.md", 1)]
    assert store.delete_source("c.md") == 1 and store.delete_source("c.md") == 0
    chunks = chunkers.chunk(spark.createDataFrame([("New text. More text.",)], "text string"), "sentence", size=11, keep=[])
    store.index(chunks.drop("chunk_index"), source="b.md", replace=True)
    assert {r.text for r in store.records().where("source = 'b.md'").collect()} == {"New text.", " More text."}


def test_index_writes(spark, tmp_path):
    """Each text is embedded once; a change leaves other segments alone; the last given chunk stays; old versions go."""
    import os

    calls = spark.sparkContext.accumulator(0)

    def embedder(texts):
        calls.add(len(texts))
        return [[float(len(t)), 1.0] for t in texts]

    store = index.ParquetIndex(spark, f"file://{tmp_path}/index")
    docs = spark.createDataFrame([(f"text {i}", 0, 6, 6, "", f"s{i % 3}") for i in range(10)], "text string, start int, end int, token_count int, context string, source string")
    store.index(docs, source=F.col("source"), embedder=embedder)
    assert calls.value == 10 and store.records().count() == 10
    first = {s["name"] for s in store._segments()}
    store.index(docs.limit(0), source="x", embedder=embedder)
    assert store.delete_source("s1") == 3 and {s["name"] for s in store._segments()} > first
    assert [(r["name"], r["count"]) for r in store.sources().collect()] == [("s0", 4), ("s2", 3)]
    one = docs.where("text = 'text 0'").withColumn("ord", F.lit(1)).union(docs.where("text = 'text 0'").withColumns({"source": F.lit("last"), "ord": F.lit(2)}))
    for rows in (one, one.repartition(4).orderBy(F.desc("ord"))):
        store.index(rows, source=F.col("source"), embedder=embedder)
        assert {r.text: r.source for r in store.records().collect()} == {"text 0": "last"} | {f"text {i}": f"s{i % 3}" for i in range(1, 10) if i % 3 != 1}
    for mode in scoring.MODES:
        assert [r.source for r in store.search("text 0", k=1, mode=mode, vector=[6.0, 1.0], source="last").collect()] == ["last"]
    store.compact()
    assert len(store._segments()) == 1 and store.records().count() == 7
    store.compact()
    assert len([x for x in os.listdir(tmp_path / "index") if x.startswith("v")]) == index.KEPT
    stale = store._numbers()[-1] - 1
    with pytest.raises(RuntimeError):
        store._commit(stale, [])
    missing = index.ParquetIndex(spark, f"file://{tmp_path}/none")
    assert missing.sources().count() == 0 and missing.delete_source("x") == 0 and missing.search("x", mode="bm25").count() == 0


def test_index_merges(spark, tmp_path, monkeypatch):
    assert index.newest([{"rows": n} for n in (1000, 10, 3, 2, 2)]) == 3 and index.newest([{"rows": 1}]) == 1 and index.newest([{"rows": 5}, {"rows": 9}]) == 2
    monkeypatch.setattr(index, "MERGE_AT", 3)
    store = index.ParquetIndex(spark, f"file://{tmp_path}/index")
    for i in range(8):
        store.upsert(records(spark, [(f"t{i}", j, "", [1.0], f"s{i}") for j in range(2)]))
        assert len(store._segments()) <= 4
    assert store.records().count() == 16 and sum(s["rows"] for s in store._segments()) == 16
    assert {r.text for r in store.search("t5", k=2, mode="bm25", vector=[1.0]).collect()} == {"t5"}


def test_other_stores(spark, tmp_path):
    import sqlite3
    import struct

    store = readers.open_index(spark, str(tmp_path / "i.jsonl"))
    assert store.records().count() == 0 and store.delete_source("x") == 0
    store.upsert(records(spark, [("one", 0, "h", [1.0, 0.0], "a"), ("two", 3, "", [0.0, 2.0], "")]))
    store.upsert(records(spark, [("one", 0, "h", [1.0, 0.0], "b")]))
    assert [(r["name"], r["count"]) for r in store.sources().collect()] == [("", 1), ("a", 1), ("b", 1)]
    store.upsert(records(spark, [("one", 0, "h", [3.0, 0.0], "c")]), mode="keyed")
    assert {(r.text, r.source) for r in store.records().collect()} == {("one", "c"), ("two", "")}
    store.index(records(spark, [("new", 5, "", [1.0, 1.0], "")]), source="c", replace=True)
    assert {(r.text, r.source) for r in store.records().collect()} == {("new", "c"), ("two", "")}
    assert [r.text for r in store.search("x", vector=[0.0, 1.0], k=1).collect()] == ["two"] and store.delete_source("c") == 1
    con = sqlite3.connect(tmp_path / "i.db")
    con.execute("CREATE TABLE records (text TEXT, start INTEGER, end INTEGER, context TEXT, token_count INTEGER, vector BLOB, source TEXT)")
    con.execute("INSERT INTO records VALUES ('猫', 0, 1, 'h', 1, ?, 's')", [struct.pack("<2f", 1.5, -2)])
    con.commit()
    con.close()
    assert [tuple(r) for r in readers.open_index(spark, str(tmp_path / "i.db")).collect()] == [("猫", 0, 1, 1, "h", [1.5, -2.0], "s")]
    assert isinstance(readers.open_index(spark, str(tmp_path / "i")), index.ParquetIndex)


def test_byte_pair_chunks(spark, sf):
    import public_tokenizers as P
    import tiktoken

    from textloom.functions.rulers import load_byte_pair
    from textloom.plans.queries import QUERIES

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ruler = load_byte_pair(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert isinstance(ruler.split("x"), list) and tiktoken
    want = []
    for i, text in texts.items():
        pieces = ruler.split(text)
        assert "".join(pieces) == text
        for k in range(max(0, -(-(len(pieces) - 200) // 180)) + 1 if pieces else 0):
            own = "".join(pieces[k * 180 : k * 180 + 200])
            want.append((i, k, own, len("".join(pieces[: k * 180])), len(pieces[k * 180 : k * 180 + 200])))
    got = [(r.doc_id, r.chunk_index, r.text, r.chunk_start, r.token_count) for r in QUERIES["byte_pair_chunks"](spark, sf).collect()]
    assert sorted(got) == sorted(want)


def test_stored_search_equals_plain(spark, tmp_path):
    docs = spark.createDataFrame([(i, "s" + str(i % 2), f"cat {'dog ' * (i % 4)}{'猫睡' * (i % 3)} w{i}") for i in range(40)], "doc_id long, source string, text string")
    made = chunkers.chunk(docs, "token", size=30, keep=["source"]).withColumn("vector", hashing_vector(F.col("text")))
    store = index.ParquetIndex(spark, f"file://{tmp_path}/index")
    store.index(made.where("source = 's0'").drop("chunk_index"), source=F.col("source"), mode="append")
    store.index(made.where("source = 's1'").drop("chunk_index"), source=F.col("source"), mode="append")
    loaded = resident.ResidentIndex(store)
    with pytest.raises(ValueError):
        resident.ResidentIndex(store, max_bytes=100)
    with pytest.raises(ValueError):
        loaded.search("x", vector=[1.0])
    assert resident.ResidentIndex(index.ParquetIndex(spark, f"file://{tmp_path}/none")).search("x", mode="hybrid") == []
    show = lambda df: [(r.rank, r.text, r.start, r.source, round(r.score, 9)) for r in df.orderBy("rank").collect()]
    for mode in scoring.MODES:
        for options in ({}, {"source": "s1"}, {"source": "s1", "stats_scope": "corpus"}, {"k": 60}, {"k": 3}):
            for q in ("dog cat 猫睡", "w7", "absent"):
                want = show(index.search(made, q, mode=mode, **{"k": 8, **options}))
                assert show(store.search(q, mode=mode, **{"k": 8, **options})) == want, (mode, options, q)
                got = [(r["rank"], r["text"], r["start"], r["source"], round(r["score"], 9)) for r in loaded.search(q, mode=mode, **{"k": 8, **options})]
                assert [x[4] for x in got] == [x[4] for x in want] and sorted(x[1:] for x in got if x[4] > got[-1][4]) == sorted(x[1:] for x in want if x[4] > got[-1][4])
    queries = ["dog cat 猫睡", "w7", "absent"]
    for mode in scoring.MODES:
        ranked = evaluate.rank_cases(made, queries, k=4, mode=mode).collect()
        for i, q in enumerate(queries):
            got = sorted((r.rank, r.text, r.start, r.source, round(r.score, 9)) for r in ranked if r.case_id == i)
            want = show(index.search(made, q, mode=mode, k=4))
            assert [x[4] for x in got] == [x[4] for x in want]


def test_resident_or_spark(spark, tmp_path):
    """An index that is too large for memory is searched by Spark, with the same answer."""
    docs = spark.createDataFrame([(i, "s", f"cat {'dog ' * (i % 4)} w{i}") for i in range(30)], "doc_id long, source string, text string")
    store = index.ParquetIndex(spark, f"file://{tmp_path}/index")
    store.index(chunkers.chunk(docs, "token", size=30, keep=["source"]).drop("chunk_index"), source=F.col("source"), mode="append")
    show = lambda df: [(r.rank, r.text, r.start, r.source, round(r.score, 9)) for r in df.orderBy("rank").collect()]
    for mode in scoring.MODES:
        large, small = (resident.search(store, "dog w7", k=7, mode=mode, max_bytes=n) for n in (100, 1 << 20))
        assert show(large) == show(small) and len(show(large)) == 7


def test_stored_ties(spark, tmp_path, monkeypatch):
    """More ties at the last place than a search takes to the driver: they still go by start, text and source."""
    monkeypatch.setattr(index, "SPARE", 3)
    docs = spark.createDataFrame([(i, f"s{i % 3}", f"dog {chr(97 + i)}") for i in range(20)], "doc_id long, source string, text string")
    store = index.ParquetIndex(spark, f"file://{tmp_path}/index")
    store.index(chunkers.chunk(docs, "token", size=30, keep=["source"]).drop("chunk_index"), source=F.col("source"), mode="append")
    for mode in scoring.MODES:
        assert [r.text for r in store.search("dog", k=4, mode=mode).orderBy("rank").collect()] == [r.text for r in index.search(store.records(), "dog", k=4, mode=mode).orderBy("rank").collect()]


def test_stored_postings(spark, tmp_path):
    """Postings and sizes as plain Python counts them; one row for each term of a record, sorted in each file."""
    docs = frame(spark, [*TEXTS, "b a b", "a " * 50]).withColumn("source", F.concat(F.lit("s"), F.col("doc_id") % 2))
    store = index.ParquetIndex(spark, f"file://{tmp_path}/index")
    made = docs.select("text", F.lit(0).alias("start"), F.length("text").alias("end"), F.lit(1).alias("token_count"), F.lit("").alias("context"), F.array(F.lit(1.0).cast("float")).alias("vector"), "source")
    store.upsert(made, mode="append")
    segments = store._segments()
    records = store._union(segments, "records", index.STORED).collect()
    want = {(r.rid, r.source, len(set(ts)), t, ts.count(t)) for r in records for ts in [python_terms(r.text)] for t in ts}
    got = [(r.rid, r.source, r.dl, r.term, r.tf) for r in store._union(segments, "postings", index.POSTINGS).collect()]
    assert len(got) == len(want) and set(got) == want
    sizes = {r.source: (r.n, r.dl) for r in store._union(segments, "sizes", index.SIZES).collect()}
    assert sizes == {s: (sum(r.source == s for r in records), sum(len(set(python_terms(r.text))) for r in records if r.source == s)) for s in ("s0", "s1")}


def test_windows_take_no_search(spark):
    """Token windows come from the kernel: none is looked for from its text's beginning."""
    plan = chunkers.chunk(frame(spark), "token", size=3)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "substring" not in plan.lower()


def test_layout_moves_a_text_once(spark):
    """A document goes to its layout once, not once for each of its chunks."""
    docs = spark.createDataFrame([(1, "abcdefgh" * 40), (2, ""), (3, None)], "doc_id long, text string")
    rows = visualize.layout(chunkers.chunk(docs, "token", size=10, overlap=4), docs)
    assert "Window" not in rows._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.start, r.end, r.text) for r in rows.collect())
    assert "".join(t for _, _, t in got) == "abcdefgh" * 40 and all(r[2] == ("abcdefgh" * 40)[r[0] : r[1]] for r in got)


def test_hashing_counts(spark):
    """Only sums are moved: no row for a term; an id's rows are summed."""
    df = spark.createDataFrame([(1, "a b a"), (1, "a"), (2, None), (3, "猫睡 x")], "doc_id long, text string")
    out = hashing_counts(df, "doc_id", F.col("text"))
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()
    want = {}
    for d, text in ((1, "a b a a"), (3, "猫睡 x")):
        for t in python_terms(text):
            want[d, python_slot(t)] = want.get((d, python_slot(t)), 0) + 1
    assert {(r.doc_id, r.slot): r.n for r in out.collect()} == want


def test_many_queries(spark, monkeypatch):
    """Scores of many queries by the kernel are those of the joins; with k the best of each, ties by id."""
    docs = spark.createDataFrame([(i, f"cat {'dog ' * (i % 4)}{'猫睡' * (i % 3)} w{i % 5}" if i else None) for i in range(30)], "record_id long, text string").withColumn("context", F.lit(""))
    asked = spark.createDataFrame([("a", "dog 猫睡 dog"), ("b", "w3 none"), ("c", "none"), ("d", None)], "query_id string, query string")
    show = lambda df: sorted((r.query_id, r.record_id, round(r.score, 9)) for r in df.collect())
    whole, best = show(scoring.bm25_many(docs, asked)), show(scoring.bm25_many(docs, asked, k=3))
    assert len(whole) > 20 and best == sorted(x for q in "ab" for x in sorted((y for y in whole if y[0] == q), key=lambda y: (-y[2], y[1]))[:3])
    monkeypatch.setattr(scoring, "QUERY_CELLS", 0)
    assert show(scoring.bm25_many(docs, asked)) == whole and show(scoring.bm25_many(docs, asked, k=3)) == best
    total = scoring.term_totals(docs, F.col("text"), ["dog", "none"])
    assert total[0] == 30 and total[2] == {"dog": sum(1 for i in range(1, 30) if i % 4), "none": 0}


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_keyed_write_moves_no_text(spark, tmp_path, monkeypatch, most):
    """Of a chunk that comes twice in one write the last stays; its text is not sorted or ranked for that."""
    monkeypatch.setattr(index, "SENT_ROWS", most)
    ranked = []
    monkeypatch.setattr(index.F, "row_number", lambda: ranked.append(1) or F.lit(1))
    rows = [("a", "s1", 3), ("b", "s1", 2), ("a", "s2", 5), ("a", "s3", 4), ("c", "s1", 1)]
    made = spark.createDataFrame(rows, "text string, source string, ord int").select("text", F.lit(0).alias("start"), F.lit(1).alias("end"), F.lit(1).alias("token_count"), F.lit("").alias("context"), F.array(F.lit(1.0).cast("float")).alias("vector"), "source", "ord")
    store = index.ParquetIndex(spark, f"file://{tmp_path}/index")
    store.upsert(made)
    assert sorted((r.text, r.source) for r in store.records().collect()) == [("a", "s2"), ("b", "s1"), ("c", "s1")]
    store.upsert(made.where("text = 'b'").withColumn("source", F.lit("new")))
    assert sorted((r.text, r.source) for r in store.records().collect()) == [("a", "s2"), ("b", "new"), ("c", "s1")]
    assert not ranked


# A small retrieval set, three topics in two languages.
DOCS = {
    "cats.md": "Cats are small carnivores kept as pets. A cat sleeps for most of the day. Kittens learn to hunt by play.",
    "rockets.md": "Rockets burn propellant to reach orbit. A launch vehicle drops its stages. Reusable boosters land on barges.",
    "bread.md": "Bread dough rises with yeast. Bakers knead dough and let it rest. A hot oven gives a crisp crust.",
    "猫.md": "猫是小型食肉动物。猫每天睡很长时间。小猫通过玩耍学习捕猎。",
    "火箭.md": "火箭燃烧推进剂进入轨道。运载火箭会抛弃级段。可重复使用的助推器降落在驳船上。",
    "面包.md": "面团靠酵母发酵。面包师揉面并让它静置。热烤箱使外皮酥脆。",
}
CASES = [
    {"query": "how long does a cat sleep", "relevant": "cats.md", "answers": ["sleeps for most of the day"]},
    {"query": "reusable boosters land", "relevant": "rockets.md", "answers": ["land on barges"]},
    {"query": "yeast dough", "relevant": "bread.md", "answers": ["rises with  yeast"]},
    {"query": "猫睡多长时间", "relevant": "猫.md", "answers": ["睡很长时间"]},
    {"query": "可重复使用的助推器", "relevant": "火箭.md", "answers": ["降落在驳船上"]},
    {"query": "酵母发酵", "relevant": "面包.md", "answers": ["靠酵母发酵"]},
]


@pytest.mark.parametrize("mode", scoring.MODES)
def test_retrieval(spark, mode):
    docs = spark.createDataFrame(list(DOCS.items()), "source string, text string")
    chunks = chunkers.chunk(docs, "recursive", size=80, keep=["source"]).withColumn("vector", hashing_vector(F.col("text"))).cache()
    recall, mrr = evaluate.evaluate(chunks, CASES, k=3, mode=mode)
    assert recall >= 0.9 and mrr >= 0.75


def test_recall_mrr(spark):
    judged = spark.createDataFrame([(0, True, 2), (1, False, None)], "case_id int, hit boolean, rank int")
    row = evaluate.recall_mrr(judged).first()
    assert (row.recall, row.mrr) == (0.5, 0.25)
    assert tuple(evaluate.recall_mrr(judged.limit(0)).first()) == (0.0, 0.0)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<html><head><title>no</title></head><body><h1>Title</h1><p>First <b>bold</b>\n para.</p><p>Second<br>para line.</p></body></html>", "Title\n\nFirst bold para.\n\nSecond para line."),
        ("<script>var x='<p>';</script><style>p{}</style><p>Visible</p>", "Visible"),
        ("<p>Tom &amp; Jerry &lt;3</p>", "Tom & Jerry <3"),
        ("<p>a</p>tail", "atail"),
        ("<table><tr><td>a</td><td>b</td></tr></table>", "ab"),
        ("<!-- c --><div>x<template><p>y</p></template>z</div>", "xz"),
        ("", ""),
    ],
)
def test_html(page, want):
    assert extract.html_to_text(page) == want


def test_html_references():
    """A reference without its semicolon is a character as in HTML, or stays, by option."""
    page = "<h1>a&amp;&amp</h1><p>x &lt y &#65 &#66; &bogus; &notit; &nbsp;&</p><script>'&amp'</script>"
    assert extract.html_to_text(page) == "a&&\n\nx < y A B &bogus; ¬it; &"
    assert extract.html_to_text(page, bare=False) == "a&&amp\n\nx &lt y &#65 B &bogus; &notit; &"


def epub(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files.items():
            z.writestr(name, data)
    return out.getvalue()


BOOK = {
    "META-INF/container.xml": '<container xmlns="x"><rootfiles><rootfile full-path="o/book.opf"/></rootfiles></container>',
    "o/book.opf": '<package xmlns="y"><manifest><item id="b" href="two.xhtml"/><item id="a" href="one.xhtml"/></manifest><spine><itemref idref="a"/><itemref idref="b"/></spine></package>',
    "o/one.xhtml": "<body><p>One one.</p><p>Two two.</p></body>",
    "o/two.xhtml": "<p>Three three.</p>",
}


def test_epub():
    assert extract.epub_to_text(epub(BOOK)) == "One one.\n\nTwo two.\n\nThree three."
    for gone in BOOK:
        with pytest.raises(ValueError):
            extract.epub_to_text(epub({k: v for k, v in BOOK.items() if k != gone}))
    with pytest.raises(ValueError):
        extract.epub_to_text(b"no zip")


def test_csv():
    assert extract.table_rows("name,color\napple,red\nbanana,yellow\n") == ("name,color", ["apple,red", "banana,yellow"])
    assert extract.table_rows('a,b\n"Widget, large","two\nlines"\n') == ("a,b", ["Widget, large,two\nlines"])
    assert extract.table_rows("only,header\n") == ("", [])
    with pytest.raises(ValueError):
        extract.table_rows('a,b\n"open\n')


def test_readers(spark, tmp_path):
    (tmp_path / "d" / "sub").mkdir(parents=True)
    for name, text in (("b.txt", "B text."), ("A.MD", "A text."), ("c.html", "<p>C"), ("t.tsv", "x\ty\n1\t2\n"), ("skip.bin", "no"), ("sub/z é.txt", "Z")):
        (tmp_path / "d" / name).write_text(text)
    assert readers.parse_extensions(" txt, .MD,,") == (".txt", ".md") and readers.parse_extensions("") == (".txt", ".md")
    files = readers.read_directory(spark, str(tmp_path / "d"), (".txt", ".md", ".html", ".tsv"))
    got = readers.extract(files).orderBy("path").collect()
    assert [(r.path, r.format, r.text) for r in got] == [("A.MD", "text", "A text."), ("b.txt", "text", "B text."), ("c.html", "html", "C"), ("sub/z é.txt", "text", "Z"), ("t.tsv", "tsv", "x\ty\n1\t2\n")]
    rows = readers.tabular_chunks(readers.extract(files).where("format = 'tsv'"), "\t").collect()
    assert [(r.text, r.context, r.token_count) for r in rows] == [("1\t2", "x\ty", 3)]
    data = records(spark, [("one", 0, "h", [1.0], "a"), ("two", 3, "", [2.0], "")])
    readers.write_jsonl(data, str(tmp_path / "i.jsonl"))
    assert sorted(map(tuple, readers.read_jsonl(spark, str(tmp_path / "i.jsonl")).collect())) == sorted(map(tuple, data.collect()))
    assert readers.read_jsonl(spark, str(tmp_path / "none.jsonl")).count() == 0


def test_stream(spark, tmp_path, sf):
    from textloom.streaming.stream import chunk_stream, event_windows, index_stream

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "text").limit(20)
    docs.write.parquet(f"{tmp_path}/in")
    store = index.ParquetIndex(spark, f"file://{tmp_path}/index")
    stream = spark.readStream.schema(docs.schema).parquet(f"{tmp_path}/in")
    index_stream(stream, store, f"{tmp_path}/check", size=400).awaitTermination()
    want = chunkers.chunk(docs, "recursive", size=400).select("text", "start", "end").distinct().count()
    assert store.records().count() == want
    with pytest.raises(ValueError):
        chunk_stream(docs)
    events = spark.read.parquet(f"{sf}/events.parquet")
    got = event_windows(spark, f"{sf}/events*.parquet", events.schema)
    q = got.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT sum(n) FROM w").first()[0] == events.count()


def test_cli(spark, tmp_path, capsys):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "cats.txt").write_text("Cats sleep. Dogs bark.")
    (tmp_path / "d" / "t.csv").write_text("name,color\napple,red\n")
    at = f"file://{tmp_path}/index"

    def call(*argv):
        code = cli.run([str(a) for a in argv], spark)
        return code, capsys.readouterr().out

    code, out = call("-chunker", "sentence", "-size", 12, tmp_path / "d" / "cats.txt")
    assert code == 0 and [c["text"] for c in json.loads(out)] == ["Cats sleep.", " Dogs bark."]
    code, out = call("-dir", tmp_path / "d", "-ext", "txt,csv", "-index", at, "-html", tmp_path / "page.html")
    assert code == 0 and [d["path"] for d in json.loads(out)] == ["cats.txt", "t.csv"] and (tmp_path / "page.html").exists()
    assert call("-index", f"{tmp_path}/i.jsonl", "-source", "s", "-quiet", tmp_path / "d" / "cats.txt") == (0, "")
    assert json.loads(call("-index", f"{tmp_path}/i.jsonl", "-list-sources")[1]) == [{"name": "s", "count": 1}] and call("-index", "x.db", "-list-sources")[0] == 2
    code, out = call("-index", at, "-query", "cats", "-k", 1, "-scoring", "hybrid")
    assert code == 0 and json.loads(out)[0]["record"]["source"] == "cats.txt"
    assert json.loads(call("-index", at, "-list-sources")[1]) == [{"name": "cats.txt", "count": 1}, {"name": "t.csv", "count": 1}]
    assert json.loads(call("-index", at, "-delete-source", "t.csv")[1]) == {"deleted": 1}
    for wrong in (("-size", 0), ("-k", 3), ("-query", "x"), ("-query", "x", "-index", at, "file"), ("-index", at, "-list-sources", "-delete-source", "x"), ("-dir", "d", "file"), ("-chunker", "none"), ("-nope",)):
        assert call(*wrong)[0] == 2
    assert call(tmp_path / "missing.txt")[0] == 1

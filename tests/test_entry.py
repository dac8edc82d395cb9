"""The registered queries: each with SQL gives the SQL's rows on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__
from textloom.functions.spans import CLAUSES
from textloom.plans.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def sql(sf):
    con = duckdb.connect()
    for name in os.listdir(sf):
        path = f"{sf}/{name}"
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def rows_of(frame):
    names = sorted(frame.columns)
    return sorted(str(tuple(x)) for x in frame[names].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, sql, name):
    got = QUERIES[name](spark, sf).toPandas()
    assert len(got)
    if name in ORACLE_SQL:
        want = sql.execute(ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows_of(got) == rows_of(want)


def slow_packing(text, size=2048):
    """Sizes of the chunks of a text: pieces added one by one; what is too long by the next delimiters, at last by characters."""
    levels = ["。！？.!?", CLAUSES, " \t\n\r"]

    def cut(part, level):
        if level == len(levels):
            return [part[i : i + size] for i in range(0, len(part), size)]
        pieces, now = [], ""
        for c in part:
            now += c
            if c in levels[level]:
                pieces.append(now)
                now = ""
        out, run = [], ""
        for x in [*pieces, now] if now else pieces:
            if run and len(run) + len(x) > size:
                out.append(run)
                run = ""
            run += x
        return merged([y for x in [*out, run] if x for y in ([x] if len(x) <= size else cut(x, level + 1))], level)

    def merged(parts, level):
        """Blank parts of one long sentence go to the part before, those in front to the first with content."""
        if level != 1 or not any(x.strip() for x in parts):
            return parts
        out, front = [], ""
        for x in parts:
            if x.strip():
                out.append(front + x)
                front = ""
            elif out:
                out[-1] += x
            else:
                front += x
        return out

    return [len(x) for x in cut(text, 0)]


def test_sentence_packing(spark, sf):
    """Also against a packer that adds one character at a time."""
    sf = sf.replace("sf0.001", "sf0.01")
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if r.text}
    got = sorted((r.doc_id, r.chunk_index, r.token_count) for r in QUERIES["sentence_packing"](spark, sf).collect())
    assert got == [(d, i, n) for d in sorted(texts) for i, n in enumerate(slow_packing(texts[d]))]


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 10
    assert set(ORACLE_SQL) <= set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_without_llm(tmp_path):
    """With the llm folders gone, the entry module still gives all other queries, and they run."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    copy = tmp_path / "copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "llm"))
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q) and 'pipeline' not in q and 'dense_topk' in q and not [x for x in q if x[:2] == 'op' and x[2].isdigit()]"
    env = {**os.environ, "PYTHONPATH": str(copy)}
    for _ in range(2):
        subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, check=True, timeout=120)
        (copy / "corpus_pipeline.py").unlink(missing_ok=True)  # the driver may delete it too

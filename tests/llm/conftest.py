import random

import pytest

EXTRA = ["key", "th", "place", "n", "rid", "host", "queue", "drop", "score", "payload", "digest", "ids"]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    return " ".join(rng.choice(words) for _ in range(n))


def awkward_texts() -> list[tuple]:
    """(doc_id, text, source, lang): nulls, blanks, ties, repeated rows, copies, near copies, a very long text."""
    base = prose(1, 120)
    near = base.split(" ")
    near[60] = "changed"
    return [
        (None, None, None, None), (None, "two words", "s", "en"), (1, "", "s", None), (2, " \n\t ", "s", "en"), (3, "a", None, "en"), (3, "a", None, "en"), (3, "other text", "s", "fr"),
        (4, base, "s", "en"), (5, base, "s", "en"), (6, " ".join(near), "t", "fr"), (7, prose(2, 20_000), "t", "en"), (8, "x" * 30_000, "t", "en"), (9, "é漢😀 \x00 ▁ <s>", "t", "fr"), (10, "line\nline\nline\n" * 9, "t", "en"),
        (11, prose(3, 30) + " " + base + " " + prose(4, 30), "t", "fr"),
    ]


@pytest.fixture(scope="session")
def awkward(spark):
    rows = [(*r, *("clash",) * len(EXTRA)) for r in awkward_texts()]
    schema = "doc_id long, text string, source string, lang string, " + ", ".join(f"`{c}` string" for c in EXTRA)
    return spark.createDataFrame(rows, schema).cache()


@pytest.fixture(scope="session")
def empty(awkward):
    return awkward.limit(0)


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").toPandas()

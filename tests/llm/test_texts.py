"""Operators that judge or encode single texts: pieces, fingerprints, quality, packing, languages, licenses, token counts."""

import hashlib
import random
import re
import textwrap
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from textloom.llm import fingerprint, language, licenses, packing, pieces, quality, rollup

MODEL = P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def codec():
    with open(MODEL, "rb") as f:
        return pieces.PieceCodec(f.read())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def ids_of(data):
    return np.frombuffer(data, "<u4").tolist()


CODEC = pieces.PieceCodec(open(MODEL, "rb").read())
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab the\n \t▁éß漢😀<s>.0aab"), max_size=40), max_size=5))
def test_pieces_equal_library(texts):
    got = CODEC.encode(texts)
    assert [ids_of(x) for x in got] == [LIBRARY.encode(t, add_bos=True, add_eos=True) for t in texts]
    assert CODEC.decode(got) == [LIBRARY.decode(ids_of(x)) for x in got]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.sampled_from([0, 1, 2, 5, 200, 229, 231, 259, 29871]), st.integers(0, 31999)), max_size=12))
def test_decode_any_ids(ids):
    assert CODEC.decode([np.array(ids, "<u4").tobytes()]) == [LIBRARY.decode(ids)]


def test_merge_order(codec, library):
    rng = random.Random(0)
    for text in ["a" * 3000, "ab" * 2000, " " * 300, "\n" * 50, "".join(rng.choice("etaoin") for _ in range(4000))]:
        assert ids_of(codec.encode([text])[0]) == library.encode(text, add_bos=True, add_eos=True)


def test_pieces_query(spark, awkward, empty, library):
    rows = pieces.encode(awkward, MODEL, decoded=True).collect()
    texts = [r.text or "" for r in awkward.collect()]
    assert sorted(map(ids_of, (r.ids for r in rows))) == sorted(library.encode(t, add_bos=True, add_eos=True) for t in texts)
    back = pieces.decode(pieces.encode(awkward, MODEL), MODEL)
    assert sorted(r.decoded for r in back.collect()) == sorted(r.decoded for r in rows)
    assert pieces.encode(empty, MODEL).count() == 0
    with pytest.raises(ValueError):
        pieces.PieceCodec(b"")


def test_pieces_of_documents(spark, sf, documents, library):
    got = {r.doc_id: r for r in pieces.op3_sentencepiece(spark, sf).collect()}
    assert len(got) == len(documents)
    for i, text in zip(documents.doc_id, documents.text):
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        want = len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == want


def test_fingerprint_pairs(spark, awkward, empty):
    got = fingerprint.compare_edited(awkward).collect()
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "", r.doc_id) for r in awkward.collect()))
    want = []
    for (*_, a, i), (*_, b, _j) in zip(rows, rows[1:] + rows[:1]):
        e = a[: len(a) - len(a) // 4] + b[: len(a) // 4]
        x, y, z = fingerprint.sketches([a, e, b])
        want.append((i, len(a), hashlib.sha256(e.encode()).hexdigest(), fingerprint.write(x), fingerprint.write(y), fingerprint.likeness(x, y), fingerprint.likeness(x, z)))
    key = lambda t: str(t)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert fingerprint.compare_edited(empty).count() == 0
    prints = {r.fingerprint for r in fingerprint.fingerprint(awkward).where("doc_id = 1").collect()}
    assert prints == {fingerprint.write(fingerprint.sketches([""])[0])}


def test_fingerprint_ties(spark):
    """Ids that many rows share, also where one range of ids ends and the next begins: rows follow one another by text."""
    rng = random.Random(8)
    rows = [(rng.choice((1, 2, 2, 2, 3, 9, None)), "".join(rng.choice("abcd ") for _ in range(rng.randint(0, 60)))) for _ in range(60)]
    got = fingerprint.compare_edited(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = [(i, len(a), hashlib.sha256((a[: len(a) - len(a) // 4] + b[: len(a) // 4]).encode()).hexdigest()) for (i, a), (_, b) in zip(order, order[1:] + order[:1])]
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=str) == sorted(want, key=str)


def slow_sketch(text):
    """Every window's hash by plain whole-number arithmetic, those under a sixteenth kept."""
    m, mask = 0x9E3779B97F4A7C15, (1 << 64) - 1

    def mixed(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & mask
        return x ^ (x >> 31)

    ones = [(ord(c) + 1) * m & mask for c in text]
    ones = [x ^ (x >> 29) for x in ones]
    if 0 < len(text) < 16:
        found = {int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little") >> 16}
    else:  # the code points of a window are the digits of a number to the base m
        found = {mixed(sum(x * pow(m, 15 - j, 1 << 64) for j, x in enumerate(ones[i : i + 16])) & mask) >> 16 for i in range(len(text) - 15)}
    return sorted(x for x in found if x < 1 << 44)


def test_sketches_equal_slow(documents):
    texts = ["", "short", "exactly sixteen!", "é漢😀" * 9, *documents.text.head(40)]
    texts = [t[:3000] for t in texts]
    for t, s in zip(texts, fingerprint.sketches(texts), strict=True):
        assert s.hashes.tolist() == slow_sketch(t)
        assert (back := fingerprint.read(fingerprint.write(s))).digest == s.digest and np.array_equal(back.hashes, s.hashes)


def test_fingerprint_query(spark, sf, documents):
    """The query against plain sets of shingles: estimates stay near the true likeness."""
    docs = documents.sort_values("doc_id")
    texts = [t or "" for t in docs.text]
    grams = lambda t: {t[i : i + 16] for i in range(len(t) - 15)} if len(t) >= 16 else {t} - {""}
    got = {r.doc_id: r for r in fingerprint.op4_fingerprints(spark, sf).collect()}
    assert set(got) == set(docs.doc_id)
    for i, a, b in zip(docs.doc_id, texts, texts[1:] + texts[:1]):
        e = a[: len(a) - len(a) // 4] + b[: len(a) // 4]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(a), hashlib.sha256(e.encode()).hexdigest())
        x, y, z = grams(a), grams(e), grams(b)
        for near, other in ((got[i].near_edited, y), (got[i].near_next, z)):
            true = len(x & other) / max(1, len(x | other))
            assert abs(near - true) < 0.02 + 24 / max(24, len(x | other)) ** 0.5


def test_fingerprint_estimates(documents):
    texts = [t for t in documents.text if len(t) > 1500][:40]
    for a, b in zip(texts, texts[1:]):
        half = a[: len(a) // 2]
        x, y, z, both = fingerprint.sketches([a, half, b, a + "\0" * 20 + b])
        assert fingerprint.containment(y, x) > 0.9 and abs(fingerprint.likeness(x, y) - 0.5) < 0.2
        merged = fingerprint.merge(x, z)
        assert fingerprint.containment(x, both) == 1 and fingerprint.likeness(merged, both) > 0.9


def test_containment_of_very_unequal_texts(documents):
    """A text within one of 50 times its length; and one of which half lies within."""
    long_ = " ".join(t for t in documents.text if t)[:150_000]
    other = "".join(chr(0x4E00 + i % 5000) for i in range(7, 30_000, 3))
    for at in range(0, 90_000, 9_000):
        part = long_[at : at + 3000]
        whole, inside, half = fingerprint.sketches([long_, part, part[:1500] + other[at // 9 : at // 9 + 1500]])
        assert fingerprint.containment(inside, whole) == 1
        assert abs(fingerprint.containment(half, whole) - 0.5) < 0.17 and fingerprint.likeness(inside, whole) < 0.05


def slow_repeats(words, n=8):
    grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
    count = Counter(grams)
    return len({i + j for i, g in enumerate(grams) if count[g] > 1 for j in range(n)})


@given(st.lists(st.sampled_from([b"a", b"b"]), max_size=60))
def test_repeat_words(words):
    assert quality.repeat_words(words) == slow_repeats(words)


def test_quality_lines(spark, empty):
    body = lambda i: "\n".join(f"word{i} is number {i * 7 + j} of {i % 5} and more words here {chr(97 + i % 26) * (j + 1)}" for j in range(4))
    rows = [(i, f"Menu  Home 12\n{body(i)}" if i < 40 else "Menu Home 7\n" * 9 if i < 45 else body(i), "h") for i in range(80)]
    rows += [(100 + i, "One paragraph that is copied word for word many times over and has enough words to be kept as a document of its own here.", "h") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in quality.assess(docs, min_docs=20, max_share=0.1).collect()}
    assert [got[i].kept for i in (0, 42, 60, 110)] == [True, False, True, True]
    assert got[0].n_line_words == 3 and got[60].n_line_words == 0
    kept = {r.doc_id: r.text for r in quality.clean(docs, min_docs=20, max_share=0.1).collect()}
    assert kept[0] == body(0) and 42 not in kept and len(kept) == 135
    assert quality.assess(empty).count() == 0 and quality.clean(empty).count() == 0


def test_quality_long_lines(spark):
    notice = " ".join(f"clause{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    body = lambda i: " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + j)}" for j in range(26))
    rows = [(i, f"{notice}\n{body(i)}" if i < 40 else f"{notice}\nonly {body(i)[:4]}" if i < 60 else body(i), "h") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: (r.n_line_words, r.kept) for r in quality.assess(docs, min_docs=20, max_share=0.1).collect()}
    assert got == {i: (60 if i < 60 else 0, not 40 <= i < 60) for i in range(80)}
    kept = {r.doc_id: r.text for r in quality.clean(docs, min_docs=20, max_share=0.1).collect()}
    assert kept == {i: body(i) for i in range(80) if not 40 <= i < 60}


def test_quality_awkward(awkward):
    assert quality.assess(awkward).count() == awkward.count()
    kept = quality.clean(awkward)
    assert kept.columns == awkward.columns and {4, 5, 6, 7, 11} <= {r.doc_id for r in kept.collect()}


TOKENIZER = P.path("word_bpe_49k.json")


def check_packing(docs, got, length=2048):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    ids = Counter()
    for r in docs.collect():
        x = (*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1)
        ids[r.doc_id, x] += 1
    left, by_sequence = Counter(), {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        left[r.doc_id] += r.length
    want = Counter()
    for (doc, x), n in ids.items():
        want[doc] += n * len(x)
    assert left == want
    sums = Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got)
    for (doc, x), n in ids.items():
        at = 0
        while at < len(x):
            hit = next(k for k in sums if k[0] == doc and k[1] == at and k[4] == len(x) and sums[k] and zlib.crc32(np.array(x[at : at + k[2]], "<u4").tobytes()) == k[3])
            at += hit[2]
    for parts in by_sequence.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= length and at & (at - 1) == 0


@pytest.mark.parametrize("weights", [None, {"s": 3.0, "t": 1.0}])
def test_packing(awkward, empty, weights):
    got = packing.pack(awkward, TOKENIZER, weights=weights, lane_windows=4).collect()
    check_packing(awkward, got)
    assert packing.pack(empty, TOKENIZER).count() == 0


def test_packing_many_sources(spark):
    """More sources than queues: the large ones keep theirs, the small ones share; every token is packed."""
    rows = [(i, f"word{i} " * (200 if i % 40 == 0 else 3), f"s{i % 40 and i}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    check_packing(docs, packing.pack(docs, TOKENIZER, max_queues=20, lane_windows=2).collect())
    plan = packing.Lanes({str(i): 1000 for i in range(3000)}, None, 2048, 1024)
    assert plan.plan(0)[1].nbytes < 8 << 20 and np.diff(plan.plan(0)[1], axis=0)[3].sum() == 2048


def test_packing_query(spark, sf, documents):
    """Of whole documents, every id lies in exactly one piece."""
    check_packing(spark.read.parquet(f"{sf}/documents.parquet"), packing.op6_packing(spark, sf).collect())


def test_packing_mixture():
    totals = {"a": 50_000, "b": 30_001, "c": 7}
    plan = packing.Lanes(totals, None, 256, 16)
    seen = []
    for lane in range(plan.count):
        _, done, starts, ends = plan.plan(lane)
        grants = np.diff(done, axis=0)
        full = grants[: len(grants) - bool(len(ends))]
        assert (full.sum(axis=1) == 256).all() and (grants >= 0).all()
        assert np.abs(full[:, 0] - 256 * 50_000 / 80_008).max() < 2
        seen.append(done[-1])
    assert np.sum(seen, axis=0).tolist() == [50_000, 30_001, 7]
    heavy = packing.Lanes(totals, {"a": 1, "b": 1, "c": 1}, 256, 16)
    first = np.diff(heavy.plan(0)[1], axis=0)[5]
    assert abs(int(first[0]) - int(first[1])) < 3  # equal shares, whatever the sizes


def test_word_tokenizer_equals_library(monkeypatch):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    with open(TOKENIZER, encoding="utf-8") as f:
        own = packing.WordTokenizer(f.read())
    rng = random.Random(5)
    for alphabet in ("ab Tthe Ing's 've\n \t12.,;éÉİßΣ漢字😀é  <|endoftext|>", "ab Tthe Ing's\n12.,;éÉß--  \x1c\x85"):
        texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50))) for _ in range(600)]
        want = [[*e.ids, 1] for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
        for size in (2_000_000, 500):  # a store that is emptied again and again, too
            monkeypatch.setattr(packing, "STORE_WORDS", size)
            ids, sizes = own.encode(pa.array(texts), 1)
            assert [np.frombuffer(x, own.kind).tolist() for x in ids.to_pylist()] == want and sizes.tolist() == list(map(len, want))
            for i in range(0, 600, 25):
                assert own.encode(pa.array(texts[i : i + 25]), 1)[0].equals(ids[i : i + 25])
    assert len(own.encode(pa.array([], pa.string()), 1)[0]) == 0


def test_language(spark, sf, awkward, empty):
    rows = language.op7_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    filters = language.learn(awkward.where("lang IS NOT NULL"))
    got = language.predict(awkward.select("doc_id", "text"), filters).collect()
    assert len(got) == awkward.count() and {r.lang_pred for r in got if not any(c.isalpha() for c in r.text or "")} == {"und"}
    assert language.predict(empty.select("doc_id", "text"), filters).count() == 0 and language.learn(empty) is None
    assert {r.lang_pred for r in language.predict(awkward.select("doc_id", "text"), None).collect()} == {"und"}


def test_bloom_filter_holds_its_grams():
    names = [f"l{i}" for i in range(20)]
    table = language.Filters.empty(names, 1 << 10)
    texts = [f"some words of language {chr(97 + i) * 5}" for i in range(20)]
    for i, t in enumerate(texts):
        language.Filters.add(table, language.grams_of([t])[0], i)
    f = language.Filters(names, table)
    for i, t in enumerate(texts):
        a, b = language.Filters.places(language.grams_of([t])[0], 1 << 10)
        assert f.holds(table[:, a] & table[:, b], i).all()


def slow_grams(text):
    """All n-grams of letters in lower case, with one space for a run of anything else."""
    letters = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in f" {text} ")
    one = re.sub(" +", " ", letters)
    return [one[i : i + n] for n in language.SIZES for i in range(len(one) - n + 1)]


def test_language_equals_sets(documents, spark, sf):
    """With a filter large enough for no false positive, languages and coverage are those of plain sets of n-grams."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    filters = language.learn(docs, slots=1 << 24)
    labelled = documents[documents.lang.notna() & documents.text.notna()]
    known = {k: {g for t in own.text for g in slow_grams(t)} for k, own in labelled.groupby("lang")}
    assert filters.languages == sorted(known)
    texts = documents.text.tolist()
    got_lang, _, cover = filters.judge(texts)
    for t, lang, c in zip(texts, got_lang, cover.tolist(), strict=True):
        grams = slow_grams(t)
        shares = {k: sum(g in s for g in grams) / len(grams) for k, s in known.items()}
        assert abs(max(shares.values()) - c) < 0.01 and shares[lang] > max(shares.values()) - 0.01


def test_language_of_short_texts(spark):
    docs = spark.createDataFrame([(i, t, k) for i, (t, k) in enumerate([("the cat and the dog", "en"), ("le chat et le chien", "fr")] * 3)], "doc_id long, text string, lang string")
    filters = language.learn(docs)
    lang, score, cover = filters.judge(["cat", "le", "chat", "q", "123", ""])
    assert lang == ["en", "fr", "fr", "en", "und", "und"] and score.tolist() == [1, 1, 1, 0, 0, 0] and cover[0] == 1


def test_language_clashing(awkward):
    filters = language.learn(awkward)
    got = language.predict(awkward, filters)
    assert got.columns == [*(c for c in awkward.columns if c != "score"), "lang_pred", "score", "coverage"] and got.schema["score"].dataType.simpleString() == "double"


def test_licenses(spark, sf, awkward, empty):
    lines = {
        "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Licensed under CC BY 4.0": "CC-BY-4.0", "  released under the MIT license  ": "MIT", "This work is licensed under the GNU General Public License, version 2.": "GPL-2.0",
        "All rights reserved.": "LicenseRef-All-Rights-Reserved", "A driving license is needed to rent the car.": None, "Licensed under the Apache License, Version 2.0. " + "blah " * 3000: "Apache-2.0",
    }
    docs = spark.createDataFrame([(i, f"intro\n{x}\nend") for i, x in enumerate(lines)], "doc_id long, text string")
    got = {r.block: r for r in licenses.scan(docs).collect()}
    assert {k: got[k].license for k in lines} == lines
    assert got["Licensed under CC BY 4.0"].lacks == [] and got["All rights reserved."].line == 2
    changed = licenses.Scanner(licenses.TEMPLATES).scan("This work is licensed under the GNU General Public License, version three.", 0.2)
    assert changed[0] and changed[2] and changed[3]
    rows = licenses.op9_license_scan(spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    known = {t: n for n, own in licenses.TEMPLATES.items() for t in own}
    want = sorted((d, n, known.get(x)) for d, t in texts.items() for n, x in enumerate(t.split("\n"), 1) if x in known)
    assert sorted((r.doc_id, r.line, r.license) for r in rows if r.block in known) == want
    assert licenses.scan(awkward).count() == 0 and licenses.scan(empty).count() == 0


def slow_notice(template, words):
    """Least differences (words lacking and added) of the template to a stretch of words."""

    def apart(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(row[j] if x == y else min(row[j + 1], new[j]) + 1)
            row = new
        return row[-1]

    return min(apart(template, words[i:j]) for i in range(len(words)) for j in range(i + 1, len(words) + 1))


@given(st.lists(st.sampled_from("abc"), min_size=1, max_size=8), st.lists(st.sampled_from("abcd"), min_size=1, max_size=12), st.sampled_from([0.1, 0.25, 0.5]))
def test_license_stretches(template, words, most):
    scanner = licenses.Scanner({"x": [" ".join(template)]})
    found = scanner.stretches(words, most)
    least = slow_notice(template, words)
    assert least <= most * len(template) if found else least
    for score, _, at, to in found:
        lacks, adds = scanner.differences(template, words[at:to])
        assert len(lacks) + len(adds) <= most * len(template) and score == len(template) - 2 * len(lacks) - len(adds)


def test_license_stretches_whole():
    template, rng = [f"w{i}" for i in range(40)], random.Random(5)
    scanner = licenses.Scanner({"x": [" ".join(template)]})
    for _ in range(100):
        changed = template[:]
        for at in rng.sample(range(1, 39), 4):  # of 40 words, 4 may differ
            changed[at] = None if rng.random() < 0.5 else f"{changed[at]} more"
        gone, notice = changed.count(None), " ".join(x for x in changed if x).split()
        words = template[:20] + ["x"] * 30 + notice + ["y"] * 30 + template[20:]
        score, _, at, to = scanner.stretches(words, 0.1)[0]
        assert (score, words[at:to]) == (40 - gone - 4, notice)
    assert not scanner.stretches(["x", *template[:-3], "other", "words", "here"], 0.1)
    assert scanner.stretches(["x", *template[:-3]], 0.1)


def test_license_texts(spark):
    """A short license as it stands at the head of a file, its paragraphs apart, and of repeated rows and lines each one."""
    own = licenses.TEMPLATES["MIT"][1:]
    head = "// Copyright (c) 2020 Someone\n//\n" + "\n//\n".join("\n".join("// " + x for x in textwrap.wrap(t, 70, break_on_hyphens=False)) for t in own) + "\n\ncode();\n"
    docs = spark.createDataFrame([(1, head), (1, head), (2, "All rights reserved.\n\nAll rights reserved."), (None, "Licensed under CC BY 4.0.")], "doc_id long, text string")
    got = [(r.doc_id, r.license, r.lacks, r.adds) for r in licenses.scan(docs).collect()]
    assert sorted((x for x in got if x[0] == 1), key=str) == sorted([(1, None, [], [])] * 2 + [(1, "MIT", [], [])] * 6, key=str)
    assert [x[1] for x in got if x[0] == 2] == ["LicenseRef-All-Rights-Reserved"] * 2 and [x[1] for x in got if x[0] is None] == ["CC-BY-4.0"]
    assert len({tuple(licenses.words_of(t)) for own in licenses.TEMPLATES.values() for t in own}) == sum(map(len, licenses.TEMPLATES.values()))


def test_license_query_equals_slow(spark, sf):
    """Short lines of the documents that hold a cue, against every template and every stretch of their words."""
    sf = sf.replace("sf0.001", "sf0.01")
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    templates = [(name, licenses.words_of(t)) for name, own in licenses.TEMPLATES.items() for t in own]
    got = {}
    for r in licenses.op9_license_scan(spark, sf).collect():
        got.setdefault((r.doc_id, r.line), set()).add(r.license)
    checked = 0
    for d, text in texts.items():
        for n, line in enumerate((text or "").split("\n"), 1):
            words = licenses.words_of(line)
            if len(words) < 14 and re.search(licenses.CUE, line):
                near = {name for name, t in templates if len(t) < 14 and slow_notice(t, words) <= 0.1 * len(t)}
                checked += 1
                assert got[d, n] - {None} <= near if near else got[d, n] == {None}, line
    assert checked > 20 and any(x - {None} for x in got.values())


def test_licenses_long_line(documents):
    text = " ".join(" ".join(t.split()) for t in documents.text if t and not re.search(licenses.CUE, t))
    scanner = licenses.Scanner(licenses.TEMPLATES)
    for n, (name, own) in enumerate(licenses.TEMPLATES.items()):
        for k, notice in enumerate(own):
            at = (7919 * (3 * n + k)) % 28_000
            block = f"{text[n * 30_000 :][:at]} {notice} {text[n * 30_000 + at :][: 30_000 - at]}"
            got = scanner.scan(block, 0.1)
            assert (got[0], got[2], got[3]) == (name, [], [])


def test_licenses_of_one_line(spark):
    mit, by = licenses.TEMPLATES["MIT"][1], licenses.TEMPLATES["CC-BY-4.0"][1]
    line = f"some words {mit} {'blah ' * 400} {by} {'words ' * 200} all under the Licence of Nowhere"
    docs = spark.createDataFrame([(1, line), (2, f"intro\n{by} {mit} {by}")], "doc_id long, text string")
    got = [(r.doc_id, r.line, r.license, r.lacks, r.adds) for r in licenses.scan(docs).collect()]
    assert sorted(got[:3], key=str) == sorted([(1, 1, x, [], []) for x in ("MIT", "CC-BY-4.0", None)], key=str)
    assert got[3:] == [(2, 2, x, [], []) for x in ("CC-BY-4.0", "MIT", "CC-BY-4.0")]


def test_licenses_wrapped(spark):
    wrap = lambda t, mark: "\n".join(mark + x for x in textwrap.wrap(t, 60, break_on_hyphens=False))
    wrapped = [(name, wrap(own[-1], mark)) for name, own in licenses.TEMPLATES.items() for mark in ("", "# ", " * ")]
    docs = spark.createDataFrame([(i, f"Title\n#\nsome words before\n{x}\nwords after\n\nmore") for i, (_, x) in enumerate(wrapped)] + [(99, "all rights\nreserved\n©\n\nsold, all rights\nreserve")], "doc_id long, text string")
    got = licenses.scan(docs).collect()
    assert [(r.doc_id, r.line, r.license, r.block, r.lacks, r.adds) for r in got if r.doc_id < 99] == [(i, 4, name, x, [], []) for i, (name, x) in enumerate(wrapped)]
    assert [(r.line, r.license, r.block) for r in got if r.doc_id == 99] == [(1, "LicenseRef-All-Rights-Reserved", "all rights\nreserved"), (3, None, "©")]


def test_rollup(spark, tmp_path):
    store = rollup.TokenRollup(spark, f"{tmp_path}/store")  # a path without its file system
    make = lambda *rows: spark.createDataFrame(list(rows), "kind string, source string, lang string, tokenizer string, tokens long, old_tokens long")
    total = lambda: {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens) for r in store.totals().collect()}
    assert total() == {}
    first = make(("insert", "s", "en", "t", 10, None), ("insert", "s", "en", "t", 5, None), ("insert", None, None, "t", None, None))
    assert store.apply("b1", first) and not store.apply("b1", first)
    assert total() == {("s", "en", "t"): (2, 15), (None, None, "t"): (1, 0)}
    assert store.apply("b2", make(("revise", "s", "en", "t", 4, 10), ("delete", "s", "en", "t", 5, None), ("delete", None, None, "t", 0, None)))
    assert total() == {("s", "en", "t"): (1, 4)}
    assert store.compact() and total() == {("s", "en", "t"): (1, 4)} and not store.apply("b2", first)
    assert store.apply("b3", first.limit(0)) and store.apply("b4", make(("insert", "u", "fr", "t", 7, None))) and store.compact()
    assert total() == {("s", "en", "t"): (1, 4), ("u", "fr", "t"): (1, 7)}
    with pytest.raises(Exception, match="unknown kind"):
        store.apply("b5", make(("move", "s", "en", "t", 1, None)))
    assert store.apply("b5", make(("insert", "u", "fr", "t", 1, None)))
    with pytest.raises(ValueError):
        store.apply("../b", first)


def test_rollup_compaction_meets_commits(spark, tmp_path):
    """A batch that is committed while a base is made counts once, before and after; what was planned before a compaction still runs."""
    make = lambda *rows: spark.createDataFrame(list(rows), "kind string, source string, lang string, tokenizer string, tokens long, old_tokens long")
    path = f"file://{tmp_path}/store"

    class Meets(rollup.TokenRollup):
        def _sums(self, base, batches):
            rollup.TokenRollup(spark, path).apply("late", make(("insert", "s", "en", "t", 5, None)))
            return super()._sums(base, batches)

    store = rollup.TokenRollup(spark, path)
    total = lambda: [(r.docs, r.tokens) for r in store.totals().collect()]
    assert store.apply("b1", make(("insert", "s", "en", "t", 10, None)))
    planned = store.totals()
    assert Meets(spark, path).compact() and total() == [(2, 15)]
    assert [(r.docs, r.tokens) for r in planned.collect()] == [(1, 10)]
    for _ in range(3):
        assert store.compact() and total() == [(2, 15)]
    assert not store._names("batches") and store._names("done") == ["b1", "late"] and len(store._names("bases")) == 2
    assert not store.apply("b1", make(("insert", "s", "en", "t", 10, None))) and total() == [(2, 15)]


def test_rollup_query(spark, sf, documents):
    import tiktoken

    encodings = {f"{n}@1": tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=rollup.load_ranks(P.path(f"{n}.tiktoken")), special_tokens={}) for n in ("byte_bpe_50k", "byte_bpe_multi_50k")}
    want, seen = Counter(), set()
    for r in documents.sort_values("doc_id").itertuples():
        if r.text not in seen:
            seen.add(r.text)
            for name, e in encodings.items():
                want[r.source, r.lang, name, "docs"] += 1
                want[r.source, r.lang, name, "tokens"] += len(e.encode_ordinary(rollup.without_repeats(r.text)))
    got = Counter()
    for r in rollup.op2_token_rollups(spark, sf).collect():
        got[r.source, r.lang, r.tokenizer, "docs"], got[r.source, r.lang, r.tokenizer, "tokens"] = r.docs, r.tokens
    assert got == want


def test_word_counter(awkward, empty):
    import tiktoken

    ranks = rollup.load_ranks(P.path("byte_bpe_50k.tiktoken"))
    whole = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    counter = rollup.WordCounter(ranks, P.PATTERN)
    rng = random.Random(2)
    for text in [r.text or "" for r in awkward.collect()] + ["".join(rng.choice("ab the\n\t  'll1.é ") for _ in range(rng.randint(0, 40))) for _ in range(800)]:
        assert counter.count(text) == len(whole.encode_ordinary(text)), repr(text)
    assert rollup.count_tokens(awkward, {"a": (ranks, P.PATTERN)}, {"x": ("a", False)}).agg(F.count("x")).first()[0] == awkward.count()
    assert rollup.count_tokens(empty, {"a": (ranks, P.PATTERN)}, {"x": ("a", False)}).count() == 0

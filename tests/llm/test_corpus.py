"""Operators over whole corpora: WARC, the Jaccard join, substring removal, and the pipeline."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from textloom.llm import common, components, jaccard, language, substrings, warc


def test_warc(spark, sf, awkward, empty):
    pages = awkward.selectExpr("doc_id AS page_id", "source AS url", "text AS html")
    index = warc.write_archives(pages, frame_bytes=2000, bundle_bytes=4000)
    got = warc.read_archives(index).collect()
    keep = {}
    for r in pages.collect():
        d = hashlib.sha1((r.html or "").encode()).digest()
        keep[d] = max((x for x in (keep.get(d), r.page_id) if x is not None), default=None)
    want = []
    for r in pages.collect():
        data = (r.html or "").encode()
        d = hashlib.sha1(data).digest()
        revisit = keep[d] is not None and r.page_id != keep[d]
        want.append((r.page_id, len(data), base64.b32encode(d).decode(), "revisit" if revisit else "response", keep[d] if revisit else None, None if revisit else data))
    key = lambda t: str(t)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in got), key=key) == sorted(want, key=key)
    assert index.select("bundle").distinct().count() > 1
    one = index.where("page_id = 7")
    record = bytes(warc.fetch(index, one).first().record)
    assert record.startswith(b"WARC/1.1\r\n") and b"X-Page-ID: 7\r\n" in record and len(record) == one.first().length
    # every record by its frame and place there, against the archives read in sequence
    by_id = defaultdict(list)
    for r in got:
        by_id[r.record_id].append(r)
    fetched = warc.fetch(index, index).collect()
    assert len(fetched) == len(got) and {r.record_id for r in fetched} == set(by_id)
    for r in fetched:
        (headers, size, payload), *more = warc.parse_records(bytes(r.record))
        same = by_id[r.record_id][0]
        assert not more and headers["WARC-Record-ID"] == f"<{r.record_id}>" and size == same.payload_bytes and headers["WARC-Type"] == same.record_type
        assert headers["WARC-Payload-Digest"] == f"sha1:{same.payload_digest}" and (same.record_type == "revisit" or payload == bytes(same.payload))
    small = warc.write_archives(pages, min_revisit_bytes=5)
    assert {r.page_id for r in warc.read_archives(small).collect() if r.record_type == "revisit"} == {4}
    assert warc.read_archives(warc.write_archives(empty.selectExpr("doc_id AS page_id", "source AS url", "text AS html"))).count() == 0
    assert warc.op1_warc(spark, sf).count() == spark.read.parquet(f"{sf}/pages.parquet").count()


def test_warc_is_plain_zstd_and_checked(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.fs
    import zstandard

    fs = pa.fs.LocalFileSystem()
    w = warc.BundleWriter(fs, f"{tmp_path}/b.warc.zst", 3)
    parts = [warc.make_record(i, "http://x/\r\nevil", b"p" * i, hashlib.sha1(b"p" * i).digest(), None, False, "d")[1] for i in range(3)]
    for p in parts:
        w.frame(p)
    w.close()
    raw = (tmp_path / "b.warc.zst").read_bytes()
    assert zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read() == b"".join(parts)
    with fs.open_input_file(f"{tmp_path}/b.warc.zst") as f:
        assert [warc.read_frame(f, *x) for x in warc.seek_table(f)] == parts
    with pytest.raises(ValueError):
        list(warc.parse_records(parts[1][:-2]))


def sets_of(texts, k):
    out = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        out[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    return out


def slow_components(texts, k, num):
    """{id: (set size, least id)} by all pairs."""
    sets = sets_of(texts, k)
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and find(a) != find(b):
                both = len(sets[a] & sets[b])
                if 100 * both >= num * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("k", "num", "limit"), [(3, 90, 512), (3, 60, 3), (5, 80, 3), (3, 100, 2)])
def test_jaccard(spark, k, num, limit):
    rng = random.Random(k * num)
    base = [rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randint(1, 3) for _ in range(80)]
    texts = {}
    for i in range(120):
        words = list(base if i % 3 else base[:40] + base[50:])
        for _ in range(rng.choice((0, 0, 1, 2, 4, 9))):
            words[rng.randrange(len(words))] = rng.choice("xyz") * 4
        texts[i] = " ".join(w.upper() if rng.random() < 0.1 else w for w in words) if i % 10 else rng.choice(("", "one two", "ONE two", "three"))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(docs, shingle=k, num=num, limit=limit).collect()}
    assert got == slow_components(texts, k, num)


def test_jaccard_query(spark, sf, documents):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.op8_jaccard_join(spark, sf).collect()}
    assert got == slow_components(dict(zip(documents.doc_id, documents.text)), 3, 90)


def test_jaccard_awkward(awkward, empty):
    rows = jaccard.join(awkward).collect()
    assert len(rows) == awkward.count()
    by_id = defaultdict(set)
    for r in rows:
        by_id[r.doc_id].add((r.n_shingles, r.component_id))
    assert by_id[4] == {(118, 4)} and by_id[5] == {(118, 4)} and by_id[1] == {(0, 1)} and by_id[None] == {(0, None), (1, None)}
    kept = jaccard.keep_one(awkward, shingle=5, num=80)
    assert kept.columns == awkward.columns and not {5, 6} & {r.doc_id for r in kept.collect()}
    assert jaccard.join(empty).count() == 0
    with pytest.raises(ValueError):
        jaccard.join(empty, num=0)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sets(st.integers(0, 14), min_size=1), min_size=2, max_size=40), st.sampled_from([50, 75, 90]), st.booleans())
def test_links_of_list(sets, num, labelled):
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    sizes = [len(s) for s in sets]
    labels = [i % 3 if labelled and i % 4 else None for i in range(len(sets))]
    links = jaccard.links_of(list(range(len(sets))), sizes, arrays, labels, num, 100)
    # all in one list, as if its token came before all that they share
    groups = jaccard.possible_groups(sizes, sizes, [0] * len(sets), [jaccard.parity(a) for a in arrays], labels, num, 100)

    def joined(pairs):
        label = list(range(len(sets)))
        for a, b in pairs:
            old, new = label[a], label[b]
            label = [new if x == old else x for x in label]
        return {frozenset(i for i, x in enumerate(label) if x == y) for y in label}

    known = [(a, b) for a in range(len(sets)) for b in range(a) if labels[a] is not None and labels[a] == labels[b]]
    want = [(a, b) for a in range(len(sets)) for b in range(a) if (a, b) not in known and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    assert joined([*links, *known]) == joined([*want, *known])
    assert all(any({a, b} <= set(g.tolist()) for g in groups) for a, b in want)


def test_jaccard_groups_of_many(spark):
    """Near copies far over the limit, some far from the rest, with exact copies and tokens that are in nearly all documents."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    texts = {}
    for i in range(240):
        words = list(base)
        for _ in range(rng.choice((0, 1, 1, 2, 5, 8))):
            words[rng.randrange(60)] = f"x{rng.randrange(40)}"
        texts[i] = " ".join(words if i % 5 else base[:12] + [f"y{rng.randrange(9)}" for _ in range(rng.randint(0, 30))])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for limit in (8,):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(docs, shingle=2, num=80, limit=limit).collect()}
        assert got == slow_components(texts, 2, 80)


def test_counts_are_exact(monkeypatch):
    """Blobs of several units and buckets give each token's document count; frequent ones are not moved."""
    import pyarrow as pa

    monkeypatch.setattr(jaccard, "UNIT_TOKENS", 60)
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 40))) for _ in range(50)]
    sets = [jaccard.shingle_sets([t.encode()], 2)[0] for t in texts]
    count = defaultdict(int)
    for s in sets:
        for x in s.tolist():
            count[x] += 1
    hot = sorted(count, key=count.get)[-3:]

    class Sent:
        value = np.array(sorted(hot), np.uint64), np.full(3, jaccard.MANY + 1)

    rows = pa.RecordBatch.from_arrays([pa.array(range(50), pa.int64()), pa.array(range(50), pa.int64()), pa.array(texts)], names=["place", "doc_id", "text"])
    dealt = [r for b in jaccard.deal_tokens(2, 3, Sent)(rows.slice(i, 5) for i in range(0, 50, 5)) for r in b.to_pylist()]
    assert len({r["unit"] for r in dealt}) > 5
    got = defaultdict(list)
    place = {(r["unit"], r["idx"]): r["doc_id"] for r in dealt if r["bucket"] is None}
    for target in range(3):
        mine = [r for r in dealt if r["target"] == target]
        batch = pa.RecordBatch.from_pylist(mine, pa.schema(list(zip(jaccard.NAMES, jaccard.KINDS, strict=True)))) if mine else None
        for r in (x for b in jaccard.count_tokens(iter([batch] if mine else [])) for x in b.to_pylist() if x["bucket"] is not None):
            owners, counts = jaccard.unpack_owners(r["owners"]).tolist(), np.frombuffer(r["counts"], "<u2").tolist()
            for o, c in zip(owners, counts, strict=True):
                got[place[r["unit"], o]].append(c)
    want = {i: sorted(jaccard.MANY + 1 if x in hot else count[x] for x in s.tolist() if count[x] > 1) for i, s in enumerate(sets)}
    assert {i: sorted(x) for i, x in got.items()} == {i: x for i, x in want.items() if x}


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + rng.randint(1, 50)) for _ in range(40)] + [(7, 7), (300, 200)]
    got = {r.node: r.root for r in components.components(common.Workspace(spark, "test"), spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[300] == got[200] == 200 and all(got[b] == 100 for a, b in links if a == 100)
    assert components.components(common.Workspace(spark, "test"), spark.createDataFrame([], "a long, b long")).count() == 0


def slow_removal(texts, window=13):
    """{id: (words, removed, digest)}"""
    words = {i: (t or "").encode().split() for i, t in texts.items()}
    first = {}
    for i in sorted(words):
        for j in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][j : j + window]), i)
    out = {}
    for i, w in words.items():
        gone = {j + d for j in range(len(w) - window + 1) if first[tuple(w[j : j + window])] < i for d in range(window)}
        kept = [x for j, x in enumerate(w) if j not in gone]
        out[i] = len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()
    return out


@pytest.mark.parametrize(("window", "gram", "hot"), [(13, 5, 1000), (13, 5, 3), (4, 2, 2), (4, 4, 5)])
def test_substrings(spark, window, gram, hot):
    rng = random.Random(window + hot)
    shared = [" ".join(rng.choice("abc") * rng.randint(1, 3) for _ in range(rng.randint(window, 3 * window))) for _ in range(6)]
    texts = {i: " ".join(rng.choice((rng.choice(shared), " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 20))))) for _ in range(rng.randint(0, 5))) for i in range(70)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.measure_repeats(docs, window=window, gram=gram, hot=hot).collect()}
    assert got == slow_removal(texts, window)


def test_substrings_awkward(awkward, empty):
    got = substrings.measure_repeats(awkward).collect()
    assert len(got) == awkward.count()
    removed = {r.doc_id: r.n_removed for r in got if r.doc_id is not None}
    assert removed[4] == 0 and removed[5] == 120 and removed[6] == 119 and removed[11] == 120 and removed[7] == 0
    kept = substrings.clean(awkward)
    assert kept.columns == awkward.columns
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert 5 not in texts and texts[6].strip() == "changed" and len(texts[11].split()) == 60
    assert substrings.measure_repeats(empty).count() == 0 and substrings.clean(empty).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=14), max_size=5), st.lists(st.sampled_from("ab"), max_size=20), st.integers(1, 5))
def test_automaton(sequences, asked, least):
    automaton = substrings.SuffixAutomaton()
    for label, s in enumerate(sequences):
        automaton.add(s, label)
    want = []
    for end in range(least, len(asked) + 1):
        w = asked[end - least : end]
        at = next((i for i, s in enumerate(sequences) if any(s[j : j + least] == w for j in range(len(s) - least + 1))), None)
        if at is not None:
            want.append((end, at))
    assert list(automaton.matches(asked, least)) == want


def test_remove_known(spark):
    docs = spark.createDataFrame([(1, "x one two three four five y"), (2, "six seven"), (3, None)], "doc_id long, text string")
    reference = spark.createDataFrame([("one two three four five",), (None,)], "text string")
    assert {r.doc_id: (r.n_words, r.n_removed) for r in substrings.remove_known(docs, reference, window=4).collect()} == {1: (7, 5), 2: (2, 0), 3: (0, 0)}
    with pytest.raises(ValueError):
        substrings.remove_known(docs, reference, max_bytes=3)


def test_cut_words():
    gone = np.array([False, True, True, False])
    assert substrings.cut_words("a b  c\nd", gone) == "a  \nd"


def slow_quality(rows, min_docs=10, max_share=0.01, max_docs=1000):
    """{id: text without frequent lines} of the documents that the rules keep."""

    def normal(line):
        return b" ".join(re.sub(b"[0-9]+", b"0", line.encode().lower()).split())

    holders, texts = defaultdict(set), defaultdict(set)
    for r in rows:
        texts[r.source].add(r.text or "")
        for line in (r.text or "").split("\n"):
            if normal(line):
                holders[r.source, normal(line)].add(r.text)
    over = {k for k, own in holders.items() if len(own) > min_docs and (len(own) > max_share * len(texts[k[0]]) or len(own) > max_docs)}
    out = {}
    for r in rows:
        words = (r.text or "").encode().split()
        grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        count = Counter(grams)
        repeated = len({i + j for i, g in enumerate(grams) if count[g] > 1 for j in range(8)})
        kept = [line for line in (r.text or "").split("\n") if not normal(line) or (r.source, normal(line)) not in over]
        left = len("\n".join(kept).encode().split())
        if len(words) >= 20 and 100 * repeated <= 30 * len(words) and left >= 20 and left >= 0.3 * len(words):
            out[r.doc_id] = "\n".join(kept)
    return out


def slow_grams(text):
    letters = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in f" {text} ")
    one = re.sub(" +", " ", letters)
    return [one[i : i + n] for n in language.SIZES for i in range(len(one) - n + 1)]


def check_stage(spark, name, docs, got, sf):
    """What the stage did to docs, against a slow version where there is one."""
    before = {r.doc_id: r.text for r in docs.collect()}
    after = {r.doc_id: r.text for r in got.collect()}
    assert set(after) <= set(before)
    if name == "quality_rules":
        assert after == slow_quality(docs.collect())
    if name == "jaccard_join":
        want = slow_components(before, 5, 80)
        assert after == {i: before[i] for i, (_, least) in want.items() if i == least}
    if name == "substring_dedup":
        want = slow_removal(before)
        assert {i: hashlib.sha256(b" ".join(t.encode().split())).hexdigest() for i, t in after.items()} == {i: w[2] for i, w in want.items() if w[0] > w[1]}
    if name == "language_id":
        known = defaultdict(set)
        for r in docs.collect():
            known[r.lang] |= set(slow_grams(r.text))
        known.pop(None, None)
        share = {i: max(sum(g in own for g in slow_grams(t)) for own in known.values()) / max(1, len(slow_grams(t))) for i, t in before.items()}
        unsure = {i for i, x in share.items() if abs(x - corpus_pipeline.MIN_COVERAGE) < 0.02}  # within the filter's false positives
        assert set(after) - unsure == {i for i, x in share.items() if x >= corpus_pipeline.MIN_COVERAGE} - unsure
        assert after == {i: before[i] for i in after} and len(unsure) < 3


def test_pipeline(spark, sf):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ws = common.Workspace(spark, "test-pipeline")
    more = [(10_000 + i, f"Home 12 | News\nEvery page of src0 has this menu and this list of {i % 3} links to other pages\n" + " ".join(f"w{i}x{j}" for j in range(4 if i % 4 == 0 else 60)), "en", "src0") for i in range(24)]
    docs = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string, source string"), allowMissingColumns=True)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = ws.write(stage(spark, docs, sf), name)
        assert got.schema.names == docs.schema.names
        check_stage(spark, name, docs, got, sf)
        docs = got
    rows = corpus_pipeline.pack(spark, docs, sf).collect()
    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    ids = {r.doc_id: [*tokenizer.encode(r.text, add_special_tokens=False).ids, 1] for r in docs.collect()}
    seen = defaultdict(int)
    for r in rows:
        assert zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
        seen[r.doc_id] += r.length
    assert seen == {i: len(x) for i, x in ids.items()}


def test_pipeline_awkward(spark, awkward, tmp_path):
    docs = awkward
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count()
    docs = awkward.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0

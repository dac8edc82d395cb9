"""SQL for the chunkers that split, pack and split again, level by level.

A level takes spans that are too long, cuts them into pieces, and packs pieces one by
one; what is still too long goes to the next level, and at last to windows of tokens.
"""

from __future__ import annotations

from collections.abc import Sequence

from textloom.functions.spans import DEFAULT_RULES, FALLBACK_RULES, Level

SPACE = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
NO_SPACE = SPACE.replace("[", "[^", 1)
CJK = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}"
#: A token of each ruler, as a pattern.
TOKENS = {"character": "(?s).", "word": f"{SPACE}+|{NO_SPACE}+", "bigram": f"[{CJK}]{{1,2}}|{SPACE}+|[^{CJK}{SPACE[1:-1]}]+"}
SHOWN = "doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1)::BIGINT AS chunk_index, a::BIGINT AS chunk_start, b::BIGINT AS chunk_end, tokens::BIGINT AS token_count"


def count_of(text: str, ruler: str) -> str:
    return f"length({text})" if ruler == "character" else f"len(regexp_extract_all({text}, '{TOKENS[ruler]}'))"


def pattern_of(delimiters: Sequence[str]) -> str:
    marks = "|".join("".join(f"\\x{{{ord(c):X}}}" for c in d) for d in sorted(delimiters, key=lambda d: -len(d.encode())))
    return f"(?s).*?(?:{marks})|(?s).+\\z"


def packed(name: str, source: str, pieces: str, size: int, ruler: str, breaks: str = "") -> str:
    """CTEs: {name}_p has the pieces of the spans (doc_id, k, a, part) of source, {name}_g the packed runs (doc_id, k, a, part, tokens).

    breaks: further CTEs, that give {name}_b (doc_id, i): pieces at which a run begins anyway.
    """
    over = f"r.tally + p.w > {size}" + (" OR p.broken" if breaks else "")
    if breaks:
        name_q = f"""{breaks},
{name}_q AS (SELECT p.*, b.i IS NOT NULL AS broken FROM {name}_p p LEFT JOIN {name}_b b ON b.doc_id = p.doc_id AND b.i = p.i)"""
        rows = f"{name}_q"
    else:
        name_q, rows = "", f"{name}_p"
    return f"""
{name}_u AS (SELECT doc_id, k, a AS pa, part, {pieces} AS p FROM {source}),
{name}_v AS (SELECT doc_id, k, pa, unnest(range(1, len(p) + 1)) AS i, unnest(p) AS t FROM {name}_u),
{name}_p AS (SELECT *, {count_of("t", ruler)} AS w, pa + sum(length(t)) OVER (PARTITION BY doc_id, k, pa ORDER BY i) - length(t) AS a FROM {name}_v),{name_q + "," if name_q else ""}
{name}_r AS (
  SELECT doc_id, k, pa, i, 0 AS run, w::BIGINT AS tally FROM {rows} WHERE i = 1
  UNION ALL
  SELECT p.doc_id, p.k, p.pa, p.i, CASE WHEN {over} THEN r.run + 1 ELSE r.run END, CASE WHEN {over} THEN p.w ELSE r.tally + p.w END
  FROM {name}_r r JOIN {rows} p ON p.doc_id = r.doc_id AND p.k = r.k AND p.pa = r.pa AND p.i = r.i + 1),
{name}_g AS (SELECT doc_id, k, min(a) AS a, string_agg(t, '' ORDER BY i) AS part, sum(w) AS tokens FROM {name}_r JOIN {name}_p USING (doc_id, k, pa, i) GROUP BY doc_id, k, pa, run)"""


def levels(name: str, source: str, rules: Sequence[Level], size: int, ruler: str) -> str:
    """CTEs from spans (doc_id, k, a, part) to {name}_m: chunks (doc_id, k, a, b, tokens), blank ones merged within a k."""
    out, now, done = [], source, []
    for n, level in enumerate(rules):
        step = f"{name}{n}"
        if level.token:
            out.append(f"""
{step}_t AS (SELECT doc_id, k, a AS pa, regexp_extract_all(part, '{TOKENS[ruler]}') AS p FROM {now}),
{step}_w AS (SELECT *, unnest(range(0, ceil(len(p) / {size}.0)::BIGINT)) AS j FROM {step}_t),
{step}_g AS (SELECT doc_id, k, pa + length(array_to_string(p[1:j * {size}], '')) AS a, array_to_string(p[j * {size} + 1:(j + 1) * {size}], '') AS part, len(p[j * {size} + 1:(j + 1) * {size}]) AS tokens FROM {step}_w)""")
            done.append(f"SELECT * FROM {step}_g")
            break
        out.append(packed(step, now, f"regexp_extract_all(part, '{pattern_of(level.delimiters)}')", size, ruler))
        out.append(f"\n{step}_n AS (SELECT doc_id, k, a, part FROM {step}_g WHERE tokens > {size})")
        done.append(f"SELECT * FROM {step}_g WHERE tokens <= {size}")
        now = f"{step}_n"
    out.append(f"""
{name}_s AS ({" UNION ALL ".join(done)}),
{name}_o AS (SELECT *, regexp_full_match(part, '{SPACE}*') AS blank FROM {name}_s),
{name}_f AS (SELECT doc_id, k, a, a + length(part) AS b, tokens, coalesce(max(CASE WHEN NOT blank THEN a END) OVER (PARTITION BY doc_id, k ORDER BY a), min(CASE WHEN NOT blank THEN a END) OVER (PARTITION BY doc_id, k), a) AS owner FROM {name}_o),
{name}_m AS (SELECT doc_id, k, min(a) AS a, max(b) AS b, sum(tokens) AS tokens FROM {name}_f GROUP BY doc_id, k, owner)""")
    return ",".join(out)


def recursive_sql(size: int, ruler: str = "character", text: str = "text", table: str = "documents") -> str:
    whole = f"SELECT doc_id, 0 AS k, 0::BIGINT AS a, {text} AS part, {count_of(text, ruler)} AS tokens FROM {table} WHERE {text} <> ''"
    return f"""WITH RECURSIVE whole AS ({whole}), long AS (SELECT doc_id, k, a, part FROM whole WHERE tokens > {size}),{levels("x", "long", DEFAULT_RULES, size, ruler)},
chunks AS (SELECT doc_id, a, b, tokens FROM x_m UNION ALL SELECT doc_id, a, length(part), tokens FROM whole WHERE tokens <= {size})
SELECT {SHOWN} FROM chunks"""


def sentence_sql(size: int, delimiters: Sequence[str], ruler: str = "character", min_runes: int = 0) -> str:
    """Sentences, those under min_runes joined with the next ones, packed; one that is too long goes through the fallback levels."""
    cut = f"regexp_extract_all(text, '{pattern_of(delimiters)}')"
    if min_runes:
        start = f"""
y AS (SELECT doc_id, unnest(range(1, len(p) + 1)) AS i, unnest(p) AS t FROM (SELECT doc_id, {cut} AS p FROM documents WHERE text <> '')),
z AS (
  SELECT doc_id, i, 0 AS run, length(t)::BIGINT AS tally FROM y WHERE i = 1
  UNION ALL
  SELECT y.doc_id, y.i, CASE WHEN z.tally >= {min_runes} THEN z.run + 1 ELSE z.run END, CASE WHEN z.tally >= {min_runes} THEN length(y.t) ELSE z.tally + length(y.t) END FROM z JOIN y ON y.doc_id = z.doc_id AND y.i = z.i + 1),
joined AS (SELECT doc_id, run, string_agg(t, '' ORDER BY i) AS t FROM z JOIN y USING (doc_id, i) GROUP BY doc_id, run),
docs AS (SELECT doc_id, 0 AS k, 0::BIGINT AS a, list(t ORDER BY run) AS part FROM joined GROUP BY doc_id),"""
        pieces = "part"
    else:
        start = "\ndocs AS (SELECT doc_id, 0 AS k, 0::BIGINT AS a, text AS part FROM documents WHERE text <> ''),"
        pieces = f"regexp_extract_all(part, '{pattern_of(delimiters)}')"
    return f"""WITH RECURSIVE {start}{packed("s", "docs", pieces, size, ruler)},
long AS (SELECT doc_id, a AS k, a, part FROM s_g WHERE tokens > {size}),{levels("x", "long", FALLBACK_RULES, size, ruler)},
chunks AS (SELECT doc_id, a, b, tokens FROM x_m UNION ALL SELECT doc_id, a, a + length(part), tokens FROM s_g WHERE tokens <= {size})
SELECT {SHOWN} FROM chunks"""


def fast_sql(size: int) -> str:
    """Windows of bytes; all default delimiters end with one of nine characters."""
    window = f"left(rest, list_max(list_filter(range(1, least({size}, length(rest)) + 1), lambda n: strlen(left(rest, n)) <= {size})))"
    return f"""WITH RECURSIVE r AS (
  SELECT doc_id, 0::BIGINT AS a, 0::BIGINT AS b, text AS rest FROM documents WHERE text <> ''
  UNION ALL
  SELECT doc_id, b AS a, b + n AS b, substring(rest, n + 1) AS rest FROM (
    SELECT doc_id, b, rest, CASE WHEN strlen(rest) <= {size} THEN length(rest) ELSE coalesce(nullif(length(regexp_extract(w, '(?s)\\A(.*[\\n\\r。！？.?! \\t])', 1)), 0), length(w)) END AS n
    FROM (SELECT *, CASE WHEN strlen(rest) > {size} THEN {window} END AS w FROM r WHERE rest <> ''))),
chunks AS (SELECT doc_id, a, b, b - a AS tokens FROM r WHERE b > 0)
SELECT {SHOWN} FROM chunks"""


def table_sql(size: int) -> str:
    """Of documents without tables: whole texts, or windows of tokens."""
    return f"""WITH chunks AS (SELECT doc_id, k * {size} AS a, least((k + 1) * {size}, length(text)) AS b, b - a AS tokens FROM (SELECT *, unnest(range(0, ceil(length(text) / {size}.0)::BIGINT)) AS k FROM documents))
SELECT {SHOWN} FROM chunks"""


def semantic_sql(size: int, delimiters: Sequence[str], terms: str, slots: str, least: float = 0.5, window: int = 1) -> str:
    """Sentences packed to size, but not across the lowest cut point of each run of them under `least`.

    The similarity of a cut point is the cosine of the summed term vectors of the `window`
    sentences before and after it. terms: the terms of a column text; slots: CTEs from
    t (doc_id, i, term) to slots (term, slot).
    """
    breaks = f"""
t AS (SELECT doc_id, i, unnest({terms}) AS term FROM (SELECT doc_id, i, t AS text FROM s_p)), {slots},
v AS (SELECT doc_id, i, slot, count(*)::DOUBLE AS n FROM t JOIN slots USING (term) GROUP BY ALL),
last AS (SELECT doc_id, max(i) AS m FROM s_p GROUP BY doc_id),
points AS (SELECT p.doc_id, p.i FROM s_p p JOIN last USING (doc_id) WHERE p.i > {window} AND p.i + {window} - 1 <= m),
side_a AS (SELECT q.doc_id, q.i, slot, sum(n) AS n FROM points q JOIN v ON v.doc_id = q.doc_id AND v.i >= q.i - {window} AND v.i < q.i GROUP BY ALL),
side_b AS (SELECT q.doc_id, q.i, slot, sum(n) AS n FROM points q JOIN v ON v.doc_id = q.doc_id AND v.i >= q.i AND v.i < q.i + {window} GROUP BY ALL),
norms AS (SELECT doc_id, i, max(x) AS x, max(y) AS y FROM (SELECT doc_id, i, sum(n * n) AS x, 0 AS y FROM side_a GROUP BY ALL UNION ALL SELECT doc_id, i, 0, sum(n * n) FROM side_b GROUP BY ALL) GROUP BY ALL),
dots AS (SELECT a.doc_id, a.i, sum(a.n * b.n) AS d FROM side_a a JOIN side_b b USING (doc_id, i, slot) GROUP BY ALL),
sims AS (SELECT q.doc_id, q.i, CASE WHEN x > 0 AND y > 0 THEN round(coalesce(d, 0) / sqrt(x * y), 9) ELSE 0 END AS sim FROM points q LEFT JOIN norms USING (doc_id, i) LEFT JOIN dots USING (doc_id, i)),
low AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS stretch FROM sims WHERE sim < {least}),
s_b AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id, stretch ORDER BY sim, i) AS r FROM low) WHERE r = 1)"""
    return f"""WITH RECURSIVE docs AS (SELECT doc_id, 0 AS k, 0::BIGINT AS a, text AS part FROM documents WHERE text <> ''),{packed("s", "docs", f"regexp_extract_all(part, '{pattern_of(delimiters)}')", size, "character", breaks)},
long AS (SELECT doc_id, a AS k, a, part FROM s_g WHERE tokens > {size}),{levels("x", "long", FALLBACK_RULES, size, "character")},
chunks AS (SELECT doc_id, a, b, tokens FROM x_m UNION ALL SELECT doc_id, a, a + length(part), tokens FROM s_g WHERE tokens <= {size})
SELECT {SHOWN} FROM chunks"""

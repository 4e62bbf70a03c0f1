"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slabwise.llm import decontaminate, line_dedup, packing, pii, quality, secret_scan, simhash_dedup, suffix_dedup, topk_search, toxicity
from slabwise.llm.common import held_out, table


def _classified(scored: DataFrame, parts: int, part: int, at: float) -> DataFrame:
    return scored.select("doc_id", held_out("doc_id", parts, part).alias("held_out"), "score", (F.col("score") >= at).cast("int").alias("predicted"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out("id", 4, 2))
    return _classified(toxicity.score_documents(docs, model), 4, 2, 0.3)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.dedup_bytes(table(spark, sf_dir, "documents")))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), ~held_out("id", 3, 1))
    return _classified(quality.score_documents(docs, model), 3, 1, 0.5)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(table(spark, sf_dir, "documents")))


def op6_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.digest(line_dedup.dedup_lines(docs))


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.digest(simhash_dedup.near_duplicates(table(spark, sf_dir, "documents")))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan_secrets(table(spark, sf_dir, "documents")))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack(docs, packing.word_count(docs.text))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_toxicity, op2_suffix_dedup, op3_decontamination, op4_quality, op5_pii, op6_topk_search, op7_line_dedup, op8_simhash_dedup, op9_secret_scan, op10_packing)}

_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANK = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

# XXH64 in SQL, step by step in 128-bit arithmetic modulo 2^64.
# The five primes of XXH64.
_P1, _P2, _P3, _P4, _P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5
_MOD = "18446744073709551616::UHUGEINT"


def _u(n: int) -> str:
    return f"{n}::UHUGEINT"


def _times(x: str, n: int) -> str:
    return f"(({x}) * {_u(n)} % {_MOD})"


def _turned(x: str, bits: int) -> str:
    return f"(({x}) * {_u(1 << bits)} % {_MOD} + ({x}) // {_u(1 << 64 - bits)})"


def _folded(x: str, bits: int) -> str:
    return f"xor({x}, ({x}) // {_u(1 << bits)})"


def _little(h: str, at: str, size: int) -> str:
    """A little-endian number of ``size`` bytes out of a hex text, from byte ``at`` on."""
    return "('0x' || " + " || ".join(f"substr({h}, 2 * ({at}) + {2 * i + 1}, 2)" for i in reversed(range(size))) + ")::UBIGINT::UHUGEINT"


def _accumulator(lane: int, seed: int) -> str:
    start = (seed + (_P1 + _P2, _P2, 0, -_P1)[lane]) % (1 << 64)
    step = _times(_turned(f"((acc + {_times('x', _P2)}) % {_MOD})", 31), _P1)
    return f"list_reduce(list_transform(range(n // 32), lambda i: {_little('h', f'32 * i + {8 * lane}', 8)}), lambda acc, x: {step}, {_u(start)})"


def _xxh64_sql(source: str, seed: int) -> str:
    """(s, x): the hash of each distinct text s of ``source`` (h its hex, n its bytes)."""
    one = lambda v: _times(_turned(_times(v, _P2), 31), _P1)
    merged = "c0"
    tail = f"""list_transform(range((n % 32) // 8), lambda i: {{'k': {one(_little('h', 'n // 32 * 32 + 8 * i', 8))}, 'a': {_u(1 << 27)}, 'b': {_u(1 << 37)}, 'p': {_u(_P1)}, 'q': {_u(_P4)}}})
|| list_transform(range((n % 8) // 4), lambda i: {{'k': {_times(_little('h', 'n // 8 * 8', 4), _P1)}, 'a': {_u(1 << 23)}, 'b': {_u(1 << 41)}, 'p': {_u(_P2)}, 'q': {_u(_P3)}}})
|| list_transform(range(n % 4), lambda i: {{'k': {_times(_little('h', 'n // 4 * 4 + i', 1), _P5)}, 'a': {_u(1 << 11)}, 'b': {_u(1 << 53)}, 'p': {_u(_P1)}, 'q': {_u(0)}}})"""
    step = f"((xor(acc, x.k) * x.a % {_MOD} + xor(acc, x.k) // x.b) * x.p + x.q) % {_MOD}"
    ctes = [f"SELECT s, h, n, {', '.join(f'{_accumulator(i, seed)} AS v{i}' for i in range(4))} FROM {source}"]
    ctes.append(f"SELECT *, ({' + '.join(_turned(f'v{i}', b) for i, b in enumerate((1, 7, 12, 18)))}) % {_MOD} AS c0 FROM t0")
    for i in range(4):
        merged = f"({_times(f'xor(c{i}, {one(f"v{i}")})', _P1)} + {_u(_P4)}) % {_MOD}"
        ctes.append(f"SELECT *, {merged} AS c{i + 1} FROM t{i + 1}")
    ctes.append(f"SELECT s, list_reduce({tail}, lambda acc, x: {step}, (CASE WHEN n >= 32 THEN c4 ELSE {_u((seed + _P5) % (1 << 64))} END + n::UHUGEINT) % {_MOD}) AS y FROM t5")
    ctes.append(f"SELECT s, {_times(_folded('y', 33), _P2)} AS y FROM t6")
    ctes.append(f"SELECT s, {_times(_folded('y', 29), _P3)} AS y FROM t7")
    ctes.append(f"SELECT s, CAST({_folded('y', 32)} AS UBIGINT) AS x FROM t8")
    return ",\n".join(f"t{i} AS ({c})" for i, c in enumerate(ctes))


_BITS = " + ".join(f"CASE WHEN 2 * sum((x >> {b}) & 1) > count(*) THEN {1 << b}::HUGEINT ELSE 0 END" for b in range(64))

_END, _RUN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+", r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
_BYTE = "0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(len({_DIGITS})), lambda i: CASE WHEN i % 2 = 0 THEN CAST(reverse({_DIGITS})[i + 1] AS INTEGER) ELSE CAST(reverse({_DIGITS})[i + 1] AS INTEGER) * 2 - CASE WHEN CAST(reverse({_DIGITS})[i + 1] AS INTEGER) > 4 THEN 9 ELSE 0 END END)) % 10 = 0"
_KINDS_SQL = (
    (0, "email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true", _LOWER.format("m")),
    (1, "ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", rf"regexp_full_match(m, '{_BYTE}(\.{_BYTE}){{3}}')", "m"),
    (2, "card", r"[0-9]([\x20-]?[0-9])+", f"CASE WHEN len({_DIGITS}) BETWEEN 13 AND 19 THEN {_LUHN} ELSE false END", _DIGITS),
    (3, "phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"len({_DIGITS}) BETWEEN 9 AND 15", _DIGITS),
)


def _placed_sql(source: str, text: str, pattern: str, keys: str) -> str:
    """({keys}, m, a, z): matches with their places in code points; what lies between them gives the places."""
    pairs = f"SELECT {keys}, unnest(list_zip(string_split_regex({text}, '{pattern}')[:-2], regexp_extract_all({text}, '{pattern}'))) AS p, unnest(range(len(regexp_extract_all({text}, '{pattern}')))) AS i FROM {source} WHERE regexp_matches({text}, '{pattern}')"
    ends = f"SELECT {keys}, p[2] AS m, CAST(sum(length(p[1]) + length(p[2])) OVER (PARTITION BY {keys} ORDER BY i) AS BIGINT) AS z FROM ({pairs})"
    return f"SELECT {keys}, m, z - length(m) AS a, z FROM ({ends})"


_PII_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
b AS ({" UNION ALL ".join(f"SELECT r, {k} AS k, '{kind}' AS kind, a, z, {value} AS v FROM ({_placed_sql('d', 't', pattern, 'r')}) WHERE {good}" for k, kind, pattern, good, value in _KINDS_SQL)}),
x AS (SELECT t, kind || ':' || v AS entity, substring(t, greatest(a - 64, 0) + 1, least(a, 64)) AS before, substring(t, z + 1, 64) AS after FROM b JOIN d USING (r)),
c AS (SELECT t, entity, before, after, list_distinct(list_filter(list_reverse(string_split_regex({_LOWER.format("' ' || before")}, '{_END}'))[1:4] || string_split_regex({_LOWER.format("after || ' '")}, '{_END}')[1:4], lambda w: length(w) >= 3)) AS terms FROM x),
held AS (SELECT entity, t, count(*) AS uses, sum(len(terms)) AS slots FROM c GROUP BY entity, t),
entities AS (SELECT entity, sum(uses) AS uses, sum(slots) AS slots, count(*) AS texts FROM held GROUP BY entity),
near AS (SELECT entity, term, count(*) AS times, sum(n) AS n FROM (SELECT entity, term, before, after, count(*) AS n FROM (SELECT entity, before, after, unnest(terms) AS term FROM c) GROUP BY ALL) GROUP BY ALL),
said AS (SELECT t, term, count(*) AS n FROM (SELECT t, unnest(string_split_regex({_LOWER.format("t")}, '{_END}')) AS term FROM d WHERE r IN (SELECT r FROM b)) WHERE length(term) >= 3 GROUP BY ALL),
whole AS (SELECT entity, term, count(*) AS times, sum(n) AS n FROM held JOIN said USING (t) GROUP BY ALL),
pairs AS (SELECT 1 AS kind, * FROM near UNION ALL SELECT 0, * FROM whole),
tests AS (SELECT kind, count(*) AS tests FROM pairs GROUP BY kind),
uses AS (SELECT term, count(*) AS everywhere FROM (SELECT unnest(string_split_regex({_LOWER.format("t")}, '{_END}')) AS term FROM d) WHERE length(term) >= 3 GROUP BY term),
sums AS (SELECT (SELECT sum(everywhere) FROM uses) AS words, (SELECT count(*) FROM d) AS docs, (SELECT sum(uses) FROM entities) AS total),
counted AS (SELECT term, CAST(n AS DOUBLE) AS n, CAST(times AS DOUBLE) AS times, CAST(greatest(everywhere, n) AS DOUBLE) AS likely, CAST(e.uses AS DOUBLE) AS uses, CAST(total AS DOUBLE) AS total, tests / 0.05::DOUBLE AS needed,
CASE WHEN pairs.kind = 1 THEN CAST(greatest(everywhere, n) * slots AS DOUBLE) / words ELSE CAST(greatest(everywhere, n) * texts AS DOUBLE) / docs END AS mean
FROM pairs JOIN uses USING (term) JOIN entities e USING (entity) JOIN tests ON tests.kind = pairs.kind, sums),
terms AS (SELECT DISTINCT term FROM counted WHERE n / likely >= 0.5 AND log2((n + 0.5) / (likely + 1) / ((uses + 0.5) / (total + 1))) >= 3 AND CASE WHEN times > mean THEN (times * ln(times / mean) - times + mean) / ln(2) ELSE 0 END >= log2(needed)),
marks AS (SELECT r, 4 AS k, 'term' AS kind, a, z FROM ({_placed_sql("(SELECT r, " + _LOWER.format("t") + " AS t FROM d)", "t", _RUN, "r")}) WHERE m IN (SELECT term FROM terms)),
every AS (SELECT r, k, a, kind || ':' || a || ':' || z AS s FROM (SELECT r, k, kind, a, z FROM b UNION ALL SELECT * FROM marks)),
told AS (SELECT r, string_agg(s, ',' ORDER BY k, a) AS spans, coalesce(string_agg(s, ',' ORDER BY k, a) FILTER (k < 4), '') AS base, {", ".join(f"count(*) FILTER (k = {k}) AS n_{kind}" for k, kind, *_ in _KINDS_SQL)} FROM every GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for _, kind, *_ in _KINDS_SQL)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN told USING (r)"""

ORACLES: dict[str, str] = {
    "op2_suffix_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, q, substring(h, 200 * q + 1, 400) AS c FROM (SELECT doc_id, h, unnest(range((len(h) // 2 - 100) // 100 + 1)) AS q FROM d WHERE len(h) >= 200)),
w AS (SELECT doc_id, 100 * q + t AS p, substring(c, 2 * t + 1, 200) AS s FROM (SELECT doc_id, q, c, unnest(range(least(100, len(c) // 2 - 99))) AS t FROM c)),
m AS (SELECT s, min({'d': doc_id, 'p': p}) AS f FROM w GROUP BY s HAVING count(*) > 1),
r AS (SELECT doc_id, p FROM w JOIN m USING (s) WHERE f <> {'d': doc_id, 'p': p}),
g AS (SELECT *, sum(CASE WHEN p <= last + 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS i FROM (SELECT *, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS last FROM r)),
x AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS z FROM g GROUP BY doc_id, i),
k AS (SELECT doc_id, string_agg(substring(h, 2 * b + 1, 2 * (a - b)), '' ORDER BY a) AS head, sum(z - a) AS gone, count(*) AS runs, max(z) AS stop
FROM (SELECT *, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS b FROM x) JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(runs, 0) AS n_spans,
sha256(unhex(coalesce(head, '') || substring(h, 2 * coalesce(stop, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)""",
    "op3_decontamination": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
sized AS (SELECT item, w, least(8, len(w)) AS n FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM sized)),
sizes AS (SELECT DISTINCT n FROM win),
gram AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, gram.n, i, item FROM gram JOIN win ON gram.n = win.n AND gram.g = win.g),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
sha256(coalesce(s, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)""",
    "op5_pii": _PII_SQL,
    "op6_topk_search": """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op7_line_dedup": rf"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT doc_id, i, line, trim({_LOWER.format("line")}, {_BLANK}) AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT k.*, f.key IS NOT NULL AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id""",
    "op8_simhash_dedup": rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER.format("text")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT r, array_to_string(w[i:i + least(3, len(w)) - 1], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - least(3, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)),
u AS (SELECT s, hex(encode(s)) AS h, strlen(s) AS n FROM (SELECT DISTINCT s FROM sh)),
{_xxh64_sql("u", 42)},
f AS (SELECT r, CAST({_BITS} AS UBIGINT) AS fp FROM sh JOIN t9 USING (s) GROUP BY r),
p AS (SELECT doc_id, coalesce(fp, 0) AS fp FROM d LEFT JOIN f USING (r)),
e AS (SELECT fp, min(doc_id) AS least FROM p GROUP BY fp),
l AS (SELECT a.fp AS a, b.fp AS b FROM e a JOIN e b ON a.fp <> b.fp AND bit_count(xor(a.fp, b.fp)) <= 3),
reach AS (SELECT fp AS a, fp AS b FROM e UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
c AS (SELECT reach.a AS fp, min(least) AS component_id FROM reach JOIN e ON e.fp = reach.b GROUP BY reach.a)
SELECT doc_id, lower(lpad(to_hex(fp), 16, '0')) AS fingerprint, component_id FROM p JOIN c USING (fp)""",
    "op10_packing": r"""
WITH RECURSIVE d AS (SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n FROM documents),
h AS (SELECT n, count(*) AS c FROM d GROUP BY n),
cells AS (SELECT row_number() OVER (ORDER BY n) AS j, n, CAST(sum(c) OVER (ORDER BY n) AS BIGINT) AS cc, CAST(sum(c * n) OVER (ORDER BY n) AS BIGINT) AS tt FROM h),
ends AS (SELECT * FROM cells UNION ALL SELECT 0, 0, 0, 0),
dp AS (SELECT 1 AS k, j, n * cc - tt AS cost, CAST(0 AS BIGINT) AS frm FROM cells
UNION ALL SELECT any_value(dp.k) + 1, c.j, min(dp.cost + c.n * (c.cc - e.cc) - (c.tt - e.tt)), max_by(dp.j, (-(dp.cost + c.n * (c.cc - e.cc) - (c.tt - e.tt)), dp.j))
FROM dp JOIN ends e ON e.j = dp.j JOIN cells c ON c.j > dp.j WHERE dp.k < 16 GROUP BY c.j, c.n),
top AS (SELECT k, j FROM dp WHERE j = (SELECT max(j) FROM cells) ORDER BY cost, k LIMIT 1),
path AS (SELECT k, j FROM top UNION ALL SELECT path.k - 1, dp.frm FROM path JOIN dp ON dp.k = path.k AND dp.j = path.j WHERE path.k > 1),
bounds AS (SELECT CAST(path.k - 1 AS INTEGER) AS bucket_id, n AS bucket_len, coalesce(lag(n) OVER (ORDER BY path.k), -1) AS low FROM path JOIN cells USING (j)),
placed AS (SELECT doc_id, d.n, bucket_id, bucket_len, row_number() OVER (PARTITION BY bucket_id ORDER BY doc_id NULLS FIRST, d.n) - 1 AS i, greatest(1, 16384 // greatest(bucket_len, 1)) AS room FROM d JOIN bounds ON d.n > low AND d.n <= bucket_len)
SELECT doc_id, n AS n_tokens, bucket_id, bucket_len, CAST(i // room AS BIGINT) AS batch_no, CAST(i % room AS INTEGER) AS slot FROM placed""",
}

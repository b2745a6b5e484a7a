"""The queries of this subpackage: each operator over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, licenses, near_dedup, quality, secrets, sharding, substring_dedup, token_files, warc

RANKS, TOKENIZER, END = "byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.json", 2


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.codec_rows(_table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), k=4, percent=80)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"), window=50).drop("spans")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read(token_files.write(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN, END))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents")).drop("found")


def op9_warc_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.histories(_table(spark, sf_dir, "pages")).drop("archive", "offset", "length", "range_id", "position")


def op10_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(_table(spark, sf_dir, "documents"), shards=24)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_bpe_codec, op2_quality_rules, op3_minhash_near_dedup, op4_substring_dedup, op5_token_files, op6_decontamination, op7_license_scan, op8_secret_scan, op9_warc_histories, op10_feistel_sharding)
    return {f.__name__: f for f in found}


NEAR_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(ws[i : i + 3], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.h = y.h AND x.doc_id < y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 80 * (na.n + nb.n - k)),
g AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(node, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT g.b, r.root FROM r JOIN g ON g.a = r.node WHERE r.root < g.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.root) AS component_id, min(r.root) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN r ON r.node = d.doc_id GROUP BY d.doc_id, n.n"""

REPEATS_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
k AS (SELECT doc_id, i, md5(array_to_string(ws[i : i + 49], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
f AS (SELECT h, min(doc_id) AS m FROM k GROUP BY h HAVING count(*) > 1),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM k JOIN f USING (h) WHERE f.m < k.doc_id),
x AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM w),
t AS (SELECT x.doc_id, count(*) AS n, count(r.j) AS gone, string_agg(x.word, ' ' ORDER BY x.j) FILTER (r.j IS NULL) AS kept FROM x LEFT JOIN r ON r.doc_id = x.doc_id AND r.j = x.j GROUP BY x.doc_id)
SELECT w.doc_id, coalesce(n, 0) AS n_words, coalesce(gone, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN t USING (doc_id)"""


def _placed_sql(name: str, pattern: str, least: int, group: int = 0) -> str:
    """A CTE (doc_id, kind, s, e, v) of a pattern's matches with their places, counted in code points."""
    p = pattern.replace("'", "''")
    return f"""{name} AS (SELECT doc_id, '{name}' AS kind, s, s + length(m) AS e, m AS v FROM (
  SELECT doc_id, ms[i] AS m, gs[i] AS g, list_sum(list_transform(parts[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS s
  FROM (SELECT doc_id, regexp_extract_all(t, '{p}', 0) AS ms, regexp_extract_all(t, '{p}', {group}) AS gs, string_split_regex(t, '{p}') AS parts, unnest(range(1, len(regexp_extract_all(t, '{p}', 0)) + 1)) AS i FROM d))
 WHERE length(g) >= {least})"""


def _secrets_sql() -> str:
    limits, w = secrets.LIMITS, secrets.WINDOW
    allowed = " OR ".join(f"regexp_matches(v, '{p}')" for p in secrets.ALLOWED)
    ctes = [_placed_sql("assign", secrets.ASSIGN, 6, 2), _placed_sql("access", secrets.ACCESS, 1), _placed_sql("hex", secrets.HEX, 1), _placed_sql("candidate", secrets.CANDIDATE, 1)]
    told = lambda table: f"SELECT doc_id, string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, k) AS spans, count(*) FILTER (k = 0) AS n0, count(*) FILTER (k = 1) AS n1, count(*) FILTER (k = 2) AS n2, count(*) FILTER (k = 3) AS n3 FROM {table} GROUP BY doc_id"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), {', '.join(ctes)},
base AS (SELECT doc_id, kind, s, e, 0 AS k FROM assign UNION ALL SELECT doc_id, kind, s, e, 1 FROM access UNION ALL SELECT doc_id, kind, s, e, 2 FROM hex),
c AS (SELECT doc_id, s, v, CASE WHEN regexp_full_match(v, '[0-9a-f]+|[0-9A-F]+') THEN {limits['hex']} WHEN regexp_full_match(v, '[0-9a-z]+') THEN {limits['base36']} ELSE {limits['base64']} END AS least,
 regexp_extract_all(v, '{secrets.HARMLESS}', 0) AS hm, string_split_regex(v, '{secrets.HARMLESS}') AS hp FROM candidate WHERE NOT ({allowed})),
w AS (SELECT doc_id, s AS origin, least, hm, hp, unnest(range(0, length(v) - {w} + 1)) AS i, v FROM c),
f AS (SELECT doc_id, origin, i FROM w WHERE list_entropy(string_split(substr(v, i + 1, {w}), '')) >= least
 AND NOT list_bool_or(list_concat([false], list_transform(range(1, len(hm) + 1), lambda j: list_sum(list_transform(hp[1:j], lambda x: length(x))) + coalesce(list_sum(list_transform(hm[1:j - 1], lambda x: length(x))), 0) < i + {w}
  AND i < list_sum(list_transform(hp[1:j], lambda x: length(x))) + list_sum(list_transform(hm[1:j], lambda x: length(x))))))),
g AS (SELECT *, sum(CASE WHEN i - before > {w} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, origin ORDER BY i) AS part FROM (SELECT *, lag(i) OVER (PARTITION BY doc_id, origin ORDER BY i) AS before FROM f)),
raised AS (SELECT doc_id, 'entropy' AS kind, origin + min(i) AS s, origin + max(i) + {w} AS e, 3 AS k FROM g GROUP BY doc_id, origin, part),
every AS (SELECT * FROM base UNION ALL SELECT * FROM raised r WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = r.doc_id AND b.s <= r.s AND r.e <= b.e)),
x AS ({told('base')}), y AS ({told('every')})
SELECT d.doc_id, coalesce(y.n0, 0) AS n_assign, coalesce(y.n1, 0) AS n_access, coalesce(y.n2, 0) AS n_hex, coalesce(y.n3, 0) AS n_entropy, sha256(coalesce(x.spans, '')) AS base_sha256, coalesce(y.spans, '') AS spans
FROM d LEFT JOIN x USING (doc_id) LEFT JOIN y USING (doc_id)"""


def _shards_sql(shards: int = 24, seed: int = 0) -> str:
    """CRC-32 by its table, which the polynomial gives; rounds of the network as steps; the walk as recursion."""
    table = "SELECT i, i AS x FROM range(256) r(i)"
    for _ in range(8):
        table = f"SELECT i, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END AS x FROM ({table})"
    ctes = []
    prime = sharding.PRIME
    for k, (c, m, d) in enumerate(sharding._keys(seed)):
        side, size, out = ("r", "a", "l") if k % 2 == 0 else ("l", "b", "r")
        t = f"(({side} % {prime} + {c}) % {prime} * {m} % {prime})"
        new = f"({out} + ({t} * {t} + {d}) % {prime} % {size}) % {size}"
        ctes.append((out, new))
    inner = "(SELECT id, n, a, b, x % a AS l, x // a AS r, steps FROM walk WHERE steps = 0 OR x >= n)"
    for out, new in ctes:
        other = "r" if out == "l" else "l"
        inner = f"(SELECT id, n, a, b, {new} AS {out}, {other}, steps FROM {inner})"
    return f"""WITH RECURSIVE tab AS (SELECT list(x ORDER BY i) AS t FROM ({table})),
size AS (SELECT doc_id, strlen(coalesce(text, '')) + 8 AS size,
 CAST(xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda y: ('0x' || y)::BIGINT)), lambda c, y: xor(c >> 8, t[xor(c & 255, y) + 1])), 4294967295::BIGINT) AS BIGINT) AS crc FROM documents, tab),
num AS (SELECT *, row_number() OVER (ORDER BY ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || crc || '|' || size), 1, 8))::BIGINT % {sharding.BUCKETS}, doc_id NULLS FIRST, crc, size) - 1 AS id, count(*) OVER () AS n FROM size),
side AS (SELECT *, greatest(1, CAST(ceil(sqrt(n)) AS BIGINT)) AS a FROM num),
walk(id, n, a, b, x, steps) AS (SELECT id, n, a, (n + a - 1) // a, id, 0 FROM side UNION ALL SELECT id, n, a, b, r * a + l, steps + 1 FROM {inner}),
done AS (SELECT id, x FROM walk WHERE steps > 0 AND x < n)
SELECT doc_id, CAST(size AS BIGINT) AS size, crc AS text_crc32, 'rows' AS law, CAST(x % {shards} AS INTEGER) AS shard, x // {shards} AS slot, CAST(NULL AS INTEGER) AS grown_shard, id AS row_no, n AS n_rows FROM side JOIN done USING (id)"""


#: base32 of SHA-1: each 5 hexadecimal digits are 4 letters. URLs are taken apart as ``warc.url_key`` does; what it percent-encodes doesn't occur.
HISTORIES_SQL = r"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h),
u AS (SELECT p.*, first, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme, regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM p JOIN f USING (h)),
k AS (SELECT *, lower(regexp_replace(regexp_extract(rest, '^[^/?]*'), '^.*@', '')) AS host, regexp_replace(rest, '^[^/?]*/?', '') AS path FROM u),
n AS (SELECT *, CASE WHEN scheme = 'http' THEN regexp_replace(host, ':(80)?$', '') WHEN scheme = 'https' THEN regexp_replace(host, ':(443)?$', '') ELSE regexp_replace(host, ':$', '') END AS name FROM k)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
 list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((('0x' || substr(h, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1 AS INTEGER), 1)), 'string_agg', '') AS payload_digest,
 CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to,
 CASE WHEN url = '' THEN '-' ELSE list_aggregate(list_reverse(string_split(regexp_extract(name, '^[^:]*'), '.')), 'string_agg', ',') || regexp_extract(name, ':.*$') || ')/' || path END AS url_key,
 strftime(TIMESTAMP '2020-01-01' + to_seconds(abs(page_id) % 2147483648), '%Y%m%d%H%M%S') AS capture_time
FROM n"""


def _leaks_sql() -> str:
    """Every item scored against every passage of its length class; what reaches the limit is verified."""
    d = decontaminate
    words = lambda text: f"regexp_extract_all(lower({text}), '[\\pL\\pN_]+')"
    mark, stop = r"(?im)^\s*(?:answer|a)\s*:", r"[.!?]\s+"
    last = lambda text, pattern: f"string_split_regex({text}, '{pattern}')[-1]"
    runs = lambda part: f"list_transform(range(1, len({part}) - n + 2), lambda i: array_to_string({part}[i:i + n - 1], ' '))"

    def covered(part: str) -> str:
        own = (
            f"(SELECT {runs('own')} AS mine, {runs('passage')} AS there, len(own) AS m, n FROM (SELECT {part} AS own, passage, least({d.GRAM}, "
            f"greatest(1, len({part}) // 2)) AS n))"
        )
        hit = "len(list_filter(range(greatest(1, j - n + 1), least(j, m - n + 1) + 1), lambda i: list_contains(there, mine[i]))) > 0"
        return f"(SELECT CASE WHEN m = 0 THEN 1.0 ELSE len(list_filter(range(1, m + 1), lambda j: {hit})) / m END FROM {own})"

    return f"""WITH t AS (SELECT row_number() OVER () AS iid, item_id, text, regexp_replace(text, '\\s+$', '') AS r, {words('text')} AS ws FROM benchmark WHERE text IS NOT NULL),
i AS (SELECT iid, item_id, ws, CAST(pow(2, ceil(log2(len(ws)))) AS BIGINT) AS size,
 CASE WHEN regexp_matches(text, '{mark}') THEN {words(f"left(text, length(text) - length({last('text', mark)}) - length(regexp_extract_all(text, '{mark}')[-1]))")}
  WHEN regexp_matches(r, '{stop}') THEN {words(f"left(r, length(r) - length({last('r', stop)}))")} ELSE ws[1:len(ws) - len(ws) // 4] END AS question,
 CASE WHEN regexp_matches(text, '{mark}') THEN {words(last('text', mark))} WHEN regexp_matches(r, '{stop}') THEN {words(last('r', stop))} ELSE ws[len(ws) - len(ws) // 4 + 1:] END AS answer
 FROM t WHERE len(ws) > 0),
n AS (SELECT count(*) AS n, avg(len(ws)) AS mean FROM i),
c AS (SELECT iid, w, count(*) AS f FROM (SELECT iid, unnest(ws) AS w FROM i) GROUP BY ALL),
df AS (SELECT w, count(*) AS df FROM c GROUP BY w),
x AS (SELECT iid, size, w, ln(1 + (n - df + 0.5) / (df + 0.5)) * f * {d.K1 + 1} / (f + {d.K1} * ({1 - d.B} + {d.B} * len(ws) / mean)) AS impact FROM c JOIN df USING (w) JOIN i USING (iid), n),
share AS (SELECT iid, size, w, impact / sum(impact) OVER (PARTITION BY iid) AS part FROM x),
docs AS (SELECT row_number() OVER () AS rid, doc_id, {words("coalesce(text, '')")} AS ws FROM documents),
d AS (SELECT rid, len(ws) AS m, unnest(ws) AS w, unnest(range(len(ws))) AS pos FROM docs),
ch AS (SELECT DISTINCT rid, m, size, pos // size AS ch, w FROM d JOIN (SELECT DISTINCT w, size FROM share) USING (w)),
pw AS (SELECT DISTINCT rid, size, w, unnest([ch - 1, ch]) AS p, m FROM ch),
hits AS (SELECT rid, iid, p, sum(part) AS score FROM pw JOIN share USING (size, w) WHERE p >= 0 AND p < greatest(1, (m + size - 1) // size - 1) GROUP BY ALL HAVING sum(part) >= {d.LIMIT} - 1e-9),
cand AS (SELECT rid, iid, doc_id, item_id, score, p * size AS first_word, question, answer, docs.ws[p * size + 1:(p + 2) * size] AS passage FROM hits JOIN i USING (iid) JOIN docs USING (rid)),
v AS (SELECT *, {covered('question')} AS q, {covered('answer')} AS a FROM cand),
b AS (SELECT *, row_number() OVER (PARTITION BY rid, iid ORDER BY round(score, 11) DESC, first_word) AS rn FROM v WHERE q >= {d.VERIFY} AND a >= {d.VERIFY})
SELECT doc_id, item_id, round(score, 6) AS score, round(q, 6) AS question_overlap, round(a, 6) AS answer_overlap, CAST(first_word AS BIGINT) AS first_word FROM b WHERE rn = 1"""


def oracle_sql() -> dict[str, str]:
    """SQL where it can say the whole result; the other queries are tested against brute force."""
    return {"op3_minhash_near_dedup": NEAR_SQL, "op4_substring_dedup": REPEATS_SQL, "op6_decontamination": _leaks_sql(), "op8_secret_scan": _secrets_sql(), "op9_warc_histories": HISTORIES_SQL, "op10_feistel_sharding": _shards_sql()}

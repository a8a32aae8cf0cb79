"""Registered queries of the training-data operators and the SQL that some of them can be held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docaudit.llm import decontaminate, langid, lines, lm, neardup, negatives, packing, phrases, quality, secrets, substrings, topk, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (langid.fold("doc_id", 3) == 1).alias("held_out"))
    return langid.language_id(docs, ~F.col("held_out"), ["doc_id", "held_out"])


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), size=3, num=85, den=100).drop("th")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_classes(table(spark, sf_dir, "documents"), lines.BY_LENGTH).drop("th")


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.katz_scores(table(spark, sf_dir, "documents"), langid.fold("doc_id", 7) == 2, order=3)


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = warc.archive_directory(spark)
    index = warc.write_archives(table(spark, sf_dir, "pages"), at)
    return warc.read_records(index, at).drop("url")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("long")
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


OP6_SQL = """
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings),
p AS (SELECT q.n AS n, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.n <> c.n),
r AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""


#: Spans of an expression: gaps before its matches and the matches themselves, whose lengths give the places.
def _spans(kind: int, name: str, pattern: str, valid: str) -> str:
    pattern = pattern.replace("'", "''")
    return f"""SELECT doc_id, {kind} AS k, '{name}' AS name, CAST(list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda m: length(m))), 0) AS BIGINT) AS s, found[i] AS m
FROM (SELECT doc_id, found, gaps, unnest(range(1, len(found) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS found, string_split_regex(t, '{pattern}') AS gaps FROM texts)) WHERE {valid}"""


_ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_CHECKED = r"(?:gh[pousr]|npm)_[A-Za-z0-9]{36,}"
#: CRC-32 of the thirty characters behind a token's prefix, as six digits to the base 62.
_CRC = """list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, 31), lambda j: ascii(m[4 + j])::UBIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), list_transform(range(8), lambda z: 0::UBIGINT)), lambda x, y: xor(x >> 1, 3988292384::UBIGINT * (x & 1))))"""
_DIGITS = "list_reduce(list_transform([916132832, 14776336, 238328, 3844, 62, 1], lambda d: '0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz'[CAST(1 + (crc // d) % 62 AS BIGINT)]), lambda a, b: a || b)"
OP1_SQL = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({_spans(0, "assign", _ASSIGN, "length(regexp_extract(m, '[:=] *[\"'']?([A-Za-z0-9+/_.=-]+)$', 1)) >= 8")}
UNION ALL {_spans(1, "access", "AKIA[A-Z0-9]+", "length(m) >= 16")}
UNION ALL {_spans(2, "hex", "[0-9a-f]+", "length(m) >= 32")}
UNION ALL SELECT doc_id, CASE WHEN starts_with(m, 'npm') THEN 4 ELSE 3 END, CASE WHEN starts_with(m, 'npm') THEN 'npm_token' ELSE 'github_token' END, s, m
  FROM (SELECT *, xor({_CRC}, 4294967295::UBIGINT) AS crc FROM ({_spans(3, "checked", _CHECKED, "length(m) = 40")})) WHERE substr(m, 35, 6) = {_DIGITS}),
listed AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex, count(*) FILTER (k > 2) AS n_checked,
  coalesce(string_agg(name || ':' || s || ':' || s + length(m), ',' ORDER BY s, k) FILTER (k < 3), '') AS base, string_agg(name || ':' || s || ':' || s + length(m), ',' ORDER BY s, k) AS spans FROM found GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, coalesce(n_checked, 0) AS n_checked, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM texts LEFT JOIN listed USING (doc_id)
"""

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP4_SQL = rf"""
WITH RECURSIVE words AS (SELECT doc_id, list_filter(string_split_regex(coalesce({_LOWER}, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM words),
classes AS MATERIALIZED (SELECT min(doc_id) AS c, list_sort(s) AS s FROM sets WHERE len(s) > 0 GROUP BY list_sort(s)),
members AS MATERIALIZED (SELECT c, len(s) AS n, unnest(s) AS g FROM classes),
pairs AS (SELECT a.c AS u, b.c AS v FROM members a JOIN members b ON a.g = b.g AND a.c < b.c AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
links AS MATERIALIZED (SELECT u, v FROM pairs UNION ALL SELECT v, u FROM pairs),
reach(c, r) AS (SELECT c, c FROM classes UNION SELECT l.u, reach.r FROM reach JOIN links l ON l.v = reach.c AND reach.r < l.u),
least_of AS (SELECT c, min(r) AS m FROM reach GROUP BY c)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(m, s.doc_id) AS component_id, s.doc_id = coalesce(m, s.doc_id) AS kept FROM sets s LEFT JOIN classes k ON k.s = list_sort(s.s) LEFT JOIN least_of USING (c)
"""

#: DuckDB counts edits in bytes, so the tables' accented letters become single ones that no text has.
_ACCENTED = "äöüßéèêçñíóÄÖÜÉÈÊÇÑÍÓ"
_ONE_BYTE = "".join(chr(c) for c in [*range(0x01, 0x09), *range(0x0E, 0x20)][: len(_ACCENTED)])
_EDITS = "CASE " + " ".join(f"WHEN n >= {least} THEN {edits}" for least, edits in reversed(lines.BY_LENGTH)) + " END"
OP5_SQL = f"""
WITH RECURSIVE parts AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL),
l AS MATERIALIZED (SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_no, p[i] AS line FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM parts) WHERE p[i] <> ''),
d AS MATERIALIZED (SELECT line, translate(line, '{_ACCENTED}', '{_ONE_BYTE}') AS bytes, length(line) AS n, row_number() OVER (ORDER BY line) AS c FROM (SELECT DISTINCT line FROM l)),
shorter AS (SELECT *, {_EDITS} AS e FROM d WHERE n >= 6),
pairs AS (SELECT a.c AS u, b.c AS v FROM (SELECT *, unnest(range(0, e + 1)) AS k FROM shorter) a JOIN d b ON b.n = a.n + a.k WHERE (k > 0 OR a.c < b.c) AND levenshtein(a.bytes, b.bytes) <= e),
links AS MATERIALIZED (SELECT u, v FROM pairs UNION SELECT v, u FROM pairs),
reach(c, r) AS (SELECT DISTINCT u, u FROM links UNION SELECT l.u, reach.r FROM reach JOIN links l ON l.v = reach.c AND reach.r < l.u),
labels AS (SELECT c, min(r) AS label FROM reach GROUP BY c),
named AS MATERIALIZED (SELECT doc_id, line_no, coalesce(label, c) AS label FROM l JOIN d USING (line) LEFT JOIN labels USING (c)),
heads AS (SELECT label, arg_min(doc_id, (doc_id IS NOT NULL, doc_id, line_no)) AS class_id, arg_min(line_no, (doc_id IS NOT NULL, doc_id, line_no)) AS class_line_no FROM named GROUP BY label)
SELECT doc_id, line_no, class_id, class_line_no, doc_id IS NOT DISTINCT FROM class_id AND line_no = class_line_no AS kept FROM named JOIN heads USING (label)
"""

OP9_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, list_reduce(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + ((CAST('0x' || substr(sha1(b), 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31)]), lambda x, y: x || y) AS payload_digest FROM p),
w AS (SELECT payload_digest, max(page_id) AS winner FROM d GROUP BY 1)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN page_id = winner THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> winner THEN winner END AS refers_to FROM d JOIN w USING (payload_digest)
"""

OP10_SQL = """
WITH t AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id NULLS FIRST) AS o, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT o, unnest(range(0, length(h) // 2 - 99)) AS i, h FROM t WHERE length(h) >= 200),
m AS MATERIALIZED (SELECT o, i, md5_number(substr(h, 2 * i + 1, 200)) AS x FROM s),
r AS (SELECT o, i FROM (SELECT o, i, row_number() OVER (PARTITION BY x ORDER BY o, i) AS n FROM m) WHERE n > 1),
g AS (SELECT o, i, CASE WHEN i - lag(i) OVER (PARTITION BY o ORDER BY i) <= 100 THEN 0 ELSE 1 END AS new FROM r),
q AS (SELECT o, min(i) AS a, max(i) + 100 AS z FROM (SELECT o, i, sum(new) OVER (PARTITION BY o ORDER BY i) AS n FROM g) GROUP BY o, n),
k AS (SELECT o, a, z, coalesce(lag(z) OVER (PARTITION BY o ORDER BY a), 0) AS before FROM q),
c AS (SELECT o, sum(z - a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(z) + 1) AS kept FROM k JOIN t USING (o) GROUP BY o)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM t LEFT JOIN c USING (o)
"""

OP11_SQL = """
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS n, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
  FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS MATERIALIZED (SELECT a.n AS an, a.vec_id AS anchor_id, c.n AS cn, c.vec_id AS vec_id, a.label = c.label AS same, CAST(list_inner_product(a.e, c.e) AS BIGINT) AS score FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.n <> c.n),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY an ORDER BY score DESC, vec_id, cn) AS r FROM s WHERE same) WHERE r <= 5),
w AS (SELECT p.an, p.r, p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.an, p.r ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.an = p.an AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM w WHERE rank <= 10
"""

OP13_SQL = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces),
grams AS (SELECT lang, 1 AS size, unnest(w) AS phrase FROM words
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM words
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM words),
f AS MATERIALIZED (SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY 1, 2, 3),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY lang),
candidates AS MATERIALIZED (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND f >= 10),
cuts AS (SELECT lang, size, phrase, a, k, array_to_string(w[1:k], ' ') AS first, array_to_string(w[k + 1:], ' ') AS rest FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates)),
scored AS (SELECT c.lang, c.size, c.phrase, c.a, l.f AS l, r.f AS r, CAST(1000000::HUGEINT * c.a * c.a // (l.f::HUGEINT * r.f) AS BIGINT) AS score,
  row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY 1000000::HUGEINT * c.a * c.a // (l.f::HUGEINT * r.f), k) AS i FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = first JOIN f r ON r.lang = c.lang AND r.phrase = rest),
longer AS (SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM candidates WHERE size = 3 UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM candidates WHERE size = 3),
ranked AS (SELECT lang, phrase, a, l, r, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM scored s
  WHERE i = 1 AND NOT EXISTS (SELECT 1 FROM longer x WHERE x.lang = s.lang AND x.phrase = s.phrase AND 100 * x.a >= 50 * s.a))
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_hard_negatives": OP11_SQL, "op13_phrase_collocations": OP13_SQL, "op1_secret_scan": OP1_SQL, "op4_minhash_near_dedup": OP4_SQL, "op5_line_dedup": OP5_SQL, "op6_exact_top_k": OP6_SQL, "op9_warc": OP9_SQL, "op10_substring_dedup": OP10_SQL}

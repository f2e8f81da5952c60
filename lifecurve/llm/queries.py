"""The registered queries of the text operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lifecurve.llm import bpe, curriculum, exactdedup, hardnegatives, histsort, langid, licenses, merkle, planes, simhash, spotsigs, surrogates, tokencount

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


#: CRC-32 in SQL: ``t`` has the table of one byte, ``far`` those of a byte 64 bytes further on, so pieces of a text are
#: reduced side by side. The four bytes in front of a text turn an empty register into the usual first one.
CRC_TABLE = """
t AS (
  SELECT list(c ORDER BY n) AS crc FROM (
    SELECT n, list_reduce(list_concat([n::BIGINT], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS n)))"""
CRC_OF_TEXTS = """
far AS (
  SELECT list(c ORDER BY n) FILTER (k = 0) AS f0, list(c ORDER BY n) FILTER (k = 1) AS f1,
    list(c ORDER BY n) FILTER (k = 2) AS f2, list(c ORDER BY n) FILTER (k = 3) AS f3
  FROM (SELECT n, k, list_reduce(list_concat([n::BIGINT << (8 * k)], range(64)), lambda c, j: xor(c >> 8, t.crc[(c & 255) + 1])) AS c
        FROM (SELECT unnest(range(256)) AS n), (SELECT unnest(range(4)) AS k), t)),
hexed AS (SELECT doc_id, '62F52692' || hex(encode(coalesce(text, ''))) AS x FROM documents),
padded AS (SELECT doc_id, lpad(x, (((len(x) + 127) // 128) * 128)::INT, '0') AS x FROM hexed),
pieces AS (SELECT doc_id, k, substr(x, 128 * k + 1, 128) AS x FROM (SELECT doc_id, x, unnest(range(len(x) // 128)) AS k FROM padded)),
bytes_of AS (
  SELECT doc_id, k, list_transform(range(64), lambda i: (instr('0123456789ABCDEF', x[2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', x[2 * i + 2]) - 1) AS y FROM pieces),
crcs AS (
  SELECT doc_id, list(c ORDER BY k) AS cs
  FROM (SELECT doc_id, k, list_reduce(list_concat([0::BIGINT], y), lambda c, b: xor(c >> 8, t.crc[(xor(c, b) & 255) + 1])) AS c FROM bytes_of, t) GROUP BY doc_id),
crc_of_texts AS (
  SELECT doc_id, xor(list_reduce(cs, lambda c, y: xor(y, xor(xor(f0[(c & 255) + 1], f1[((c >> 8) & 255) + 1]), xor(f2[((c >> 16) & 255) + 1], f3[(c >> 24) + 1])))), 4294967295) AS text_crc32
  FROM crcs, far)"""


def query(name: str, sql: str | None = None, table: str = "documents"):
    def keep(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet"))
        if sql:
            ORACLES[name] = sql.strip()
        return fn

    return keep


@query("op1_plane_ids")
def op1(docs: DataFrame) -> DataFrame:
    return planes.ids_table(docs)


@query("op2_surrogates")
def op2(docs: DataFrame) -> DataFrame:
    return surrogates.surrogates(docs)


@query("op3_bpe_round_trip")
def op3(docs: DataFrame) -> DataFrame:
    return bpe.round_trip(docs)


@query("op4_simhash_components")
def op4(docs: DataFrame) -> DataFrame:
    found = simhash.near_duplicates(docs)
    return found.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


@query("op5_token_counts")
def op5(docs: DataFrame) -> DataFrame:
    return tokencount.token_counts(docs)


@query("op6_language")
def op6(docs: DataFrame) -> DataFrame:
    return langid.identify(docs, langid.fit(docs))


@query("op7_spotsigs")
def op7(docs: DataFrame) -> DataFrame:
    return spotsigs.fingerprint_edits(docs)


@query(
    "op8_curriculum_mix",
    r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk FROM per),
weighted AS (
  SELECT *, CASE rk % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap FROM ranked),
steps AS (
  SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS everything,
    coalesce(sum(cap) OVER w, 0.0::DOUBLE) AS filled,
    sum(weight) OVER () - coalesce(sum(weight) OVER w, 0.0::DOUBLE) AS still
  FROM weighted WINDOW w AS (ORDER BY cap / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
fitting AS (
  SELECT (everything - filled) / still AS lv FROM steps
  WHERE cap / weight >= (everything - filled) / still ORDER BY cap / weight, rk LIMIT 1),
aimed AS (
  SELECT source, source_size, rk, coalesce(least(cap, (SELECT lv FROM fitting) * weight), cap) AS target FROM steps),
placed AS (
  SELECT s.doc_id, s.size, a.source_size, a.rk, a.target,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY md5(s.doc_id::VARCHAR)
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS begins,
    CASE WHEN a.source_size > 0 THEN floor(a.target / a.source_size) ELSE 0 END AS whole
  FROM sized s JOIN aimed a ON s.source IS NOT DISTINCT FROM a.source),
used AS (
  SELECT *, (whole + CASE WHEN size > 0 AND begins + size / 2 <= target - whole * source_size THEN 1 ELSE 0 END)::BIGINT AS passes,
    CASE rk % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 1.5 ELSE 1.0 END::DOUBLE AS a, CASE rk % 3 WHEN 0 THEN 1.5 WHEN 1 THEN 0.5 ELSE 1.0 END::DOUBLE AS b FROM placed),
-- The time at which the integral of the line from a to b reaches a part of its whole, for the first and the last use.
timed AS (
  SELECT *, 2 * p * 1.0 / (a + sqrt(a * a + 2 * (b - a) * p)) AS first_time, 2 * q * 1.0 / (a + sqrt(a * a + 2 * (b - a) * q)) AS last_time
  FROM (SELECT *, CASE WHEN target > 0 THEN least(1.0, begins / target) ELSE 0.0 END AS p,
          CASE WHEN target > 0 THEN least(1.0, (begins + (passes - 1) * source_size) / target) ELSE 0.0 END AS q FROM used)),
demand AS (SELECT coalesce(sum(target) FILTER (WHERE rk % 3 = 0), 0) AS d0, coalesce(sum(target) FILTER (WHERE rk % 3 = 1), 0) AS d1, coalesce(sum(target) FILTER (WHERE rk % 3 = 2), 0) AS d2 FROM aimed)
SELECT doc_id, size, source_size, round(target, 4) AS target, size * passes AS taken, passes,
  CASE WHEN passes > 0 THEN round(d0 * (0.5 * first_time + 0.5 * first_time * first_time) + d1 * (1.5 * first_time - 0.5 * first_time * first_time) + d2 * first_time, 2) END AS position,
  CASE WHEN passes > 0 THEN round(first_time, 9) END AS first_time, CASE WHEN passes > 0 THEN round(last_time, 9) END AS last_time
FROM timed, demand
""",
)
def op8(docs: DataFrame) -> DataFrame:
    mix = curriculum.training_order(docs)
    times = [F.round(F.element_at("times", k), 9).alias(f"{n}_time") for n, k in (("first", 1), ("last", -1))]
    return mix.select("doc_id", "size", "source_size", F.round("target", 4).alias("target"), "taken", "passes", F.round("position", 2).alias("position"), *times)


@query("op9_licenses")
def op9(docs: DataFrame) -> DataFrame:
    return licenses.scan(docs)


@query(
    "op10_perfect_hash_dedup",
    r"""
WITH n AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM n GROUP BY text_sha256)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, n.text_sha256 FROM n JOIN g USING (text_sha256)
""",
)
def op10(docs: DataFrame) -> DataFrame:
    found = exactdedup.dedup(docs)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


@query(
    "op11_histogram_shards",
    rf"""
WITH {CRC_TABLE},
{CRC_OF_TEXTS},
keyed AS (
  SELECT doc_id, strlen(coalesce(text, ''))::BIGINT + 16 AS size,
    substr(md5(coalesce(text, '')), 1, 16) || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 16) AS key FROM documents),
aims AS (SELECT k, k * (SELECT sum(size) FROM keyed)::BIGINT AS aim FROM (SELECT unnest(range(1, 40)) AS k)),
cells AS (
  SELECT d, substr(key, 1, d) AS cell, sum(size)::BIGINT AS bytes, count(*) AS n
  FROM keyed, (SELECT unnest([3, 6, 9, 12, 15, 18, 21, 24, 27, 30, 32]) AS d) GROUP BY 1, 2),
below AS (
  SELECT *, coalesce(sum(bytes) OVER (PARTITION BY d ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS below FROM cells),
ends AS (
  SELECT k, d, cell, n, aim - 40 * below AS before, 40 * (below + bytes) - aim AS after
  FROM aims JOIN below ON 40 * below < aim AND aim <= 40 * (below + bytes)),
first AS (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY d) AS turn FROM ends
  WHERE least(before, after) <= 0.01::DOUBLE * (SELECT sum(size) FROM keyed) OR n = 1 OR d = 32),
splitters AS (SELECT cell || CASE WHEN after < before THEN '~' ELSE '' END AS bound FROM first WHERE turn = 1),
dealt AS (SELECT *, (SELECT count(*) FROM splitters WHERE bound <= key)::INT AS shard FROM keyed)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY key, doc_id) - 1 AS slot, NULL::INT AS grown_shard
FROM dealt JOIN crc_of_texts USING (doc_id)
""",
)
def op11(docs: DataFrame) -> DataFrame:
    return histsort.assign(docs)


@query(
    "op12_merkle_proofs",
    rf"""
WITH RECURSIVE {CRC_TABLE},
marked AS (
  SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(len(doc_id::VARCHAR)), lambda i: instr('0123456789', (doc_id::VARCHAR)[i + 1]) + 47)),
    lambda c, y: xor(c >> 8, t.crc[(xor(c, y) & 255) + 1])), 4294967295) % 7 = 0 AS tampered FROM documents, t),
said AS (
  SELECT doc_id, lang, n_chars, tampered, strlen(doc_id::VARCHAR) || ':' || doc_id || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS tail FROM marked),
leaves AS (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
    CASE WHEN tampered THEN sha256(head || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || tail) END AS changed,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM said),
lower_tree AS (
  SELECT lang, 0 AS h, i, leaf AS d, n FROM leaves
  UNION ALL
  SELECT lang, h + 1, i // 2, sha256(string_agg(d, '' ORDER BY i)), (n + 1) // 2 FROM lower_tree WHERE n > 1 GROUP BY lang, h, i // 2, n),
subroots AS (
  SELECT lang, d AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM lower_tree WHERE n = 1),
upper_tree AS (
  SELECT 0 AS h, i, subroot AS d, n FROM subroots
  UNION ALL
  SELECT h + 1, i // 2, sha256(string_agg(d, '' ORDER BY i)), (n + 1) // 2 FROM upper_tree WHERE n > 1 GROUP BY h, i // 2, n),
steps AS (
  SELECT l.doc_id, s.h, (l.i >> s.h) & 1 = 1 AS odd, u.d
  FROM leaves l JOIN (SELECT DISTINCT lang, h FROM lower_tree WHERE n > 1) s ON l.lang IS NOT DISTINCT FROM s.lang
  LEFT JOIN lower_tree u ON u.lang IS NOT DISTINCT FROM l.lang AND u.h = s.h AND u.i = xor(l.i >> s.h, 1)
  UNION ALL
  SELECT l.doc_id, 100 + s.h, (r.i >> s.h) & 1 = 1, u.d
  FROM leaves l JOIN subroots r ON l.lang IS NOT DISTINCT FROM r.lang JOIN (SELECT DISTINCT h FROM upper_tree WHERE n > 1) s ON true
  LEFT JOIN upper_tree u ON u.h = s.h AND u.i = xor(r.i >> s.h, 1)),
ways AS (SELECT doc_id, list({{'d': d, 'odd': odd}} ORDER BY h) AS way, coalesce(string_agg(d, '' ORDER BY h), '') AS siblings FROM steps GROUP BY doc_id),
folded AS (
  SELECT doc_id, lang, leaf, siblings, list_reduce(list_concat([{{'d': coalesce(changed, leaf), 'odd': false}}], coalesce(way, [])),
    lambda c, s: {{'d': sha256(CASE WHEN s.d IS NULL THEN c.d WHEN s.odd THEN s.d || c.d ELSE c.d || s.d END), 'odd': false}}).d AS folded_root
  FROM leaves LEFT JOIN ways USING (doc_id))
SELECT f.doc_id, f.leaf, r.subroot, u.d AS root, sha256(coalesce(f.siblings, '')) AS proof_sha256, f.folded_root, f.folded_root = u.d AS verified
FROM folded f JOIN subroots r ON f.lang IS NOT DISTINCT FROM r.lang, (SELECT d FROM upper_tree WHERE n = 1) u
""",
)
def op12(docs: DataFrame) -> DataFrame:
    return merkle.manifest(docs)


@query(
    "op13_hard_negatives",
    r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id, b.label, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE label = own
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE label <> own AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 3
""",
    table="embeddings",
)
def op13(table: DataFrame) -> DataFrame:
    return hardnegatives.mine(table)

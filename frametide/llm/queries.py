"""The operators as queries over the whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bilinear, chaining, decontaminate, lattice, middle, minhash, mixing, quality, repair, sharding, suffixes, walks, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.dedup(table(spark, sf_dir, "documents"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    out = quality.score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (quality.fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op5_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bilinear.score(table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.classes(table(spark, sf_dir, "embeddings"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op10_chaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chaining.passages(table(spark, sf_dir, "documents"))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(repair.damage(table(spark, sf_dir, "conversations")), dropped="dropped")


def op12_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walks.edited(table(spark, sf_dir, "documents"))


def op13_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = middle.restore(middle.transform(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffixes": op1_suffixes,
        "op2_minhash": op2_minhash,
        "op3_decontamination": op3_decontamination,
        "op4_quality": op4_quality,
        "op5_bilinear": op5_bilinear,
        "op6_sharding": op6_sharding,
        "op7_lattice": op7_lattice,
        "op8_mixing": op8_mixing,
        "op9_warc": op9_warc,
        "op10_chaining": op10_chaining,
        "op11_repair": op11_repair,
        "op12_walks": op12_walks,
        "op13_middle": op13_middle,
    }


OP8_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('17|' || COALESCE(doc_id::VARCHAR, '') || '|' || COALESCE(text, '')), 1, 15))::BIGINT AS k
  FROM documents),
sources AS (
  SELECT source, SUM(size)::BIGINT AS source_size,
         [5.0::DOUBLE, 2.0, 1.0][1 + ((ROW_NUMBER() OVER (ORDER BY source IS NULL, source) - 1) % 3)] AS w
  FROM sized GROUP BY source),
-- the level at which the limits (three times a source) and the weights share out all words
levels AS (
  SELECT *, 3.0::DOUBLE * source_size AS lim,
         ((SELECT SUM(source_size) FROM sources) - COALESCE(SUM(3.0::DOUBLE * source_size) OVER o, 0))
         / ((SELECT SUM(w) FROM sources) - COALESCE(SUM(w) OVER o, 0)) AS level
  FROM sources WINDOW o AS (ORDER BY 3.0::DOUBLE * source_size / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goals AS (
  SELECT source, source_size, LEAST(lim, w * COALESCE((SELECT arg_min(level, lim / w) FROM levels WHERE lim >= w * level), 0)) AS target
  FROM levels),
placed AS (
  SELECT d.doc_id, d.size, g.source_size, g.target,
         COALESCE(SUM(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s
  FROM sized d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       (GREATEST(0, LEAST(size, round_even(target, 0) - s)) + GREATEST(0, LEAST(size, round_even(target, 0) - s - source_size))
        + GREATEST(0, LEAST(size, round_even(target, 0) - s - 2 * source_size)))::BIGINT AS taken
FROM placed
"""


#: The checksum is made a byte at a time from its table, which follows from the polynomial 0xEDB88320 in eight steps.
OP6_SQL = r"""
WITH RECURSIVE steps AS (
  SELECT i, 0 AS n, i::UBIGINT AS c FROM range(256) t(i)
  UNION ALL
  SELECT i, n + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END FROM steps WHERE n < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE n = 8),
rows_ AS (
  SELECT doc_id, octet_length(encode(COALESCE(text, '')))::BIGINT + 8 AS size,
         xor(list_reduce(
           list_transform(regexp_extract_all(hex(encode(COALESCE(text, ''))), '..'), lambda p: ('0x' || p)::UBIGINT),
           lambda c, b: xor(c >> 8, t[(xor(c, b) & 255)::BIGINT + 1]), 4294967295::UBIGINT), 4294967295::UBIGINT)::BIGINT AS text_crc32
  FROM documents, crc),
placed AS (
  SELECT *, (SUM(size) OVER o)::BIGINT AS upto, (SUM(size) OVER ())::BIGINT AS total
  FROM rows_ WINDOW o AS (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING)),
cut AS (SELECT *, LEAST(23, ((2 * upto - size) * 24) // (2 * total))::INTEGER AS shard FROM placed)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, (ROW_NUMBER() OVER (PARTITION BY shard ORDER BY upto) - 1)::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM cut
"""


#: States: 0 nothing yet, 1 after s, 2 after u, 3 after a. `edges` are all ways through one row: up to two insertions, then one edit.
OP11_SQL = r"""
WITH RECURSIVE steps AS (
  SELECT i, 0 AS n, i::UBIGINT AS c FROM range(256) t(i)
  UNION ALL
  SELECT i, n + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END FROM steps WHERE n < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE n = 8),
given AS (
  SELECT DENSE_RANK() OVER (ORDER BY conv_id NULLS FIRST) AS conv, conv_id, turn, COALESCE(role, ' ') AS role, COALESCE(text, ' ') AS text,
         xor(list_reduce(
           list_transform(regexp_extract_all(hex(encode(COALESCE(conv_id::VARCHAR, ' ') || ':' || COALESCE(turn::VARCHAR, ' '))), '..'), lambda p: ('0x' || p)::UBIGINT),
           lambda c, b: xor(c >> 8, t[(xor(c, b) & 255)::BIGINT + 1]), 4294967295::UBIGINT), 4294967295::UBIGINT) % 20 AS d
  FROM conversations, crc),
damaged AS (
  SELECT conv, turn, CASE d WHEN 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM given, unnest(CASE d WHEN 0 THEN []::INT[] WHEN 3 THEN [1, 2] ELSE [1] END) copies(copy)),
ordered AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text) AS k FROM damaged),
seen AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY conv, role, text ORDER BY k) AS nth, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM ordered),
faulty AS (
  SELECT conv, turn, role, text, k, left(role, 1) AS ini,
         CASE WHEN bare = '' THEN 1 WHEN nth > 1 THEN 2 WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
         LAG(left(role, 1)) OVER (PARTITION BY conv ORDER BY k) AS ini_before FROM seen),
counts AS (
  SELECT conv, MAX(turn) - MIN(turn) + 1 - COUNT(DISTINCT turn) AS gaps, COUNT(*) FILTER (fault = 1) AS blank, COUNT(*) FILTER (fault = 2) AS duplicate,
         COUNT(*) FILTER (fault = 3) AS truncated, COUNT(*) FILTER (k > 1 AND ini_before || ini NOT IN ('su', 'ua', 'au')) AS illegal, MAX(k) AS n
  FROM faulty GROUP BY conv),
writes(q, q2) AS (VALUES (0, 2), (1, 2), (2, 3), (3, 2)),
inserts AS (
  SELECT q, '' AS edits, q AS q2, 0 AS cost FROM writes
  UNION ALL SELECT q, 'I', q2, 3 FROM writes
  UNION ALL SELECT a.q, 'II', b.q2, 6 FROM writes a JOIN writes b ON a.q2 = b.q),
legal(ini, q, q2) AS (VALUES ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('u', 3, 2), ('a', 2, 3)),
edges AS (
  SELECT q, edits || 'D' AS edits, q2, cost + 4 AS cost, 'D' AS edit, NULL::VARCHAR AS ini FROM inserts
  UNION ALL SELECT i.q, i.edits || 'R', w.q2, i.cost + 3, 'R', NULL FROM inserts i JOIN writes w ON i.q2 = w.q
  UNION ALL SELECT i.q, i.edits || 'K', l.q2, i.cost, 'K', l.ini FROM inserts i JOIN legal l ON i.q2 = l.q),
cheapest AS (
  SELECT conv, 0::BIGINT AS k, 0 AS q, {'cost': 0, 'audit': ''} AS best FROM counts
  UNION ALL
  SELECT f.conv, f.k, e.q2, MIN({'cost': (c.best).cost + e.cost + CASE WHEN f.fault = 3 AND e.edit <> 'D' THEN 3 ELSE 0 END, 'audit': (c.best).audit || e.edits})
  FROM cheapest c JOIN faulty f ON f.conv = c.conv AND f.k = c.k + 1
  JOIN edges e ON e.q = c.q AND (e.edit = 'D' OR f.fault NOT IN (1, 2) AND (e.edit = 'R' OR e.ini = f.ini))
  GROUP BY f.conv, f.k, e.q2),
final AS (
  SELECT c.conv, MIN({'cost': (c.best).cost + i.cost, 'audit': (c.best).audit || i.edits}) AS best
  FROM cheapest c JOIN counts n ON n.conv = c.conv AND n.n = c.k JOIN inserts i ON i.q = c.q AND i.q2 IN (0, 3) GROUP BY c.conv),
edits AS (
  SELECT conv, pos, (best).audit[pos] AS edit FROM final, unnest(range(1, length((best).audit) + 1)) t(pos)),
placed AS (
  SELECT *, COUNT(*) FILTER (edit <> 'I') OVER o AS k, COUNT(*) FILTER (edit <> 'D') OVER o - 1 AS nth, COUNT(*) FILTER (edit <> 'D') OVER (PARTITION BY conv) % 2 AS odd
  FROM edits WINDOW o AS (PARTITION BY conv ORDER BY pos)),
texts AS (
  SELECT p.conv, string_agg(CASE WHEN edit = 'K' THEN f.role WHEN (nth + odd) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE f.text END, chr(10) ORDER BY nth) AS whole
  FROM placed p LEFT JOIN faulty f ON f.conv = p.conv AND f.k = p.k WHERE edit <> 'D' GROUP BY p.conv)
SELECT g.conv_id, COALESCE(gaps, 0)::BIGINT AS gaps, COALESCE(blank, 0)::BIGINT AS blank, COALESCE(duplicate, 0)::BIGINT AS duplicate, COALESCE(truncated, 0)::BIGINT AS truncated,
       COALESCE(illegal, 0)::BIGINT AS illegal, COALESCE((best).cost, 0)::BIGINT AS cost, COALESCE((best).audit, '') AS audit, sha256(COALESCE(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv, conv_id FROM given) g LEFT JOIN counts USING (conv) LEFT JOIN final USING (conv) LEFT JOIN texts USING (conv)
"""


OP13_SQL = r"""
WITH drawn AS (
  SELECT doc_id, COALESCE(text, '') AS text, sha256('7:' || COALESCE(doc_id::VARCHAR, '')) AS h, regexp_extract_all(COALESCE(text, ''), '[^\n]*\n|[^\n]+') AS units
  FROM documents),
cut AS (
  SELECT doc_id, text, units, len(units) AS n, [('0x' || h[1:8])::BIGINT % (len(units) + 1), ('0x' || h[9:16])::BIGINT % (len(units) + 1)] AS cuts,
         ('0x' || h[17:24])::BIGINT % 100 AS h3, ('0x' || h[25:32])::BIGINT % 100 AS h4 FROM drawn),
parts AS (
  SELECT doc_id, text, n, array_to_string(units[1:list_min(cuts)], '') AS p, array_to_string(units[list_min(cuts) + 1:list_max(cuts)], '') AS m, array_to_string(units[list_max(cuts) + 1:], '') AS s,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 >= 100 THEN 'plain' WHEN h4 < 50 THEN 'spm' ELSE 'psm' END AS form FROM cut)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_sharding": OP6_SQL, "op8_mixing": OP8_SQL, "op11_repair": OP11_SQL, "op13_middle": OP13_SQL}

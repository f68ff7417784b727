"""The registered queries of the text operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from staylens.llm import alignment, conversation, exact_dedup, language, merkle, mixing, ngram_join, packing, pii, quality, simhash, substring_dedup, toxicity
from staylens.llm.common import documents


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir)).drop("xx")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(documents(spark, sf_dir))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(documents(spark, sf_dir))


def op4_merkle_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.edit_trial(documents(spark, sf_dir))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir)).drop("piece_id")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(documents(spark, sf_dir))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_words(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(documents(spark, sf_dir))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(documents(spark, sf_dir))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.repair_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(documents(spark, sf_dir))


def _grown(state: int, cost: str, letter: str) -> str:
    """SQL: the cheapest audit from a state (eight digits of cost, then letters) behind one more edit."""
    return f"lpad(CAST(CAST(a[{state}][:8] AS INT) + {cost} AS VARCHAR), 8, '0') || '{letter}' || a[{state}][9:]"


def _repair_sql() -> str:
    """Cheapest audits from the last row to the first, for the states nothing yet, after s, after u, after a (1 to 4)."""
    inserts = [f"least(a[{q}], {_grown(4 if q == 3 else 3, '2', 'I')})" for q in range(1, 5)]
    more = "((s - 1) // 4)"  # symbols: 0 has to go; 1 + 4 * truncated + (s, u, a, other); 9 only inserts
    keeps = {1: "(s - 1) % 4 = 0 THEN " + _grown(2, more, "K") + " WHEN (s - 1) % 4 = 1 THEN " + _grown(3, more, "K")}
    keeps |= {2: "(s - 1) % 4 = 1 THEN " + _grown(3, more, "K"), 3: "(s - 1) % 4 = 2 THEN " + _grown(4, more, "K")}
    keeps[4] = keeps[2]
    edits = [
        f"CASE WHEN s = 0 THEN {_grown(q, '3', 'D')} ELSE least({_grown(q, '3', 'D')}, {_grown(4 if q == 3 else 3, f'2 + {more}', 'R')}, "
        f"CASE WHEN {keeps[q]} ELSE '~' END) END"
        for q in range(1, 5)
    ]
    return rf"""
WITH crc AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) r(i)
), keyed AS (
  SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations
), kinds AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce([4294967295] || list_transform(range(1, len(k) + 1), lambda i: CAST(ascii(k[i]) AS BIGINT)),
                         lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 20 AS kind
  FROM keyed, crc
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM kinds
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos FROM damaged
), seen AS (
  SELECT *, role[:1] AS initial, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again,
         rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS said,
         lag(role[:1]) OVER (PARTITION BY conv_id ORDER BY pos) || '|' || role[:1] AS pair
  FROM placed
), marked AS (
  SELECT *, CASE WHEN said = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN said[-1:] NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM seen
), folded AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (pair NOT IN ('s|u', 'u|a', 'a|u')) AS illegal,
         list_reduce([9, 9, 9] || flatten(list([CASE WHEN fault IN ('blank', 'duplicate') THEN 0 ELSE 1 + 4 * CAST(fault = 'truncated' AS INT)
                       + CASE initial WHEN 's' THEN 0 WHEN 'u' THEN 1 WHEN 'a' THEN 2 ELSE 3 END END, 9, 9, 9] ORDER BY pos DESC)),
                     lambda a, s: CASE WHEN s = 9 THEN [{", ".join(inserts)}] ELSE [{", ".join(edits)}] END,
                     ['00000000', '10000000', '10000000', '00000000'])[1] AS best
  FROM marked GROUP BY conv_id
), letters AS (
  SELECT conv_id, unnest(range(1, len(best) - 7)) AS i, unnest(string_split(best[9:], '')) AS letter FROM folded WHERE len(best) > 8
), counted AS (
  SELECT *, count(*) FILTER (letter != 'I') OVER w AS pos, count(*) FILTER (letter != 'D') OVER w AS line FROM letters
  WINDOW w AS (PARTITION BY conv_id ORDER BY i)
), lines AS (
  SELECT c.conv_id, i, letter, line, m.role, CASE WHEN letter = 'I' THEN '' ELSE m.text END AS text,
         max(CAST(letter = 'K' AND line = 1 AND initial = 's' AS INT)) OVER (PARTITION BY c.conv_id) AS system
  FROM counted c LEFT JOIN marked m ON c.conv_id IS NOT DISTINCT FROM m.conv_id AND c.pos = m.pos WHERE letter != 'D'
), texts AS (
  SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (line - system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY i) AS text
  FROM lines GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(CAST(best[:8] AS BIGINT), 0) AS cost, coalesce(best[9:], '') AS audit, sha256(coalesce(text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN folded f ON o.conv_id IS NOT DISTINCT FROM f.conv_id
     LEFT JOIN texts x ON o.conv_id IS NOT DISTINCT FROM x.conv_id
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_merkle_fingerprint": op4_merkle_fingerprint,
    "op5_packing": op5_packing,
    "op6_language_id": op6_language_id,
    "op7_pii": op7_pii,
    "op8_quality": op8_quality,
    "op9_source_mix": op9_source_mix,
    "op10_toxicity": op10_toxicity,
    "op11_token_alignment": op11_token_alignment,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_simhash_dedup": op13_simhash_dedup,
}

SQL: dict[str, str] = {
    "op1_exact_dedup": r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)
""",
    "op2_substring_dedup": r"""
WITH t AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), starts AS (
  SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM t WHERE len(words) >= 50
), windows AS (
  SELECT doc_id, i, md5(array_to_string(words[i : i + 49], ' ')) AS h FROM starts
), first_doc AS (
  SELECT h, min(doc_id) AS owner FROM windows GROUP BY h
), hits AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM windows JOIN first_doc USING (h) WHERE owner < doc_id
), word AS (
  SELECT doc_id, unnest(range(1, len(words) + 1)) AS p, unnest(words) AS word FROM t
), kept AS (
  SELECT doc_id, count(h.p) AS n_removed, string_agg(CASE WHEN h.p IS NULL THEN word END, ' ' ORDER BY p) AS kept
  FROM word LEFT JOIN hits h USING (doc_id, p) GROUP BY doc_id
)
SELECT t.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM t LEFT JOIN kept USING (doc_id)
""",
    "op3_ngram_jaccard_join": r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM t WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), both_in AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common
  FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM both_in JOIN sizes p ON a = p.doc_id JOIN sizes q ON b = q.doc_id
  WHERE 100 * common >= 75 * (p.n + q.n - common)
), edges AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reach AS (
  SELECT doc_id, doc_id AS r FROM t
  UNION
  SELECT reach.doc_id, edges.b FROM reach JOIN edges ON reach.r = edges.a
)
SELECT t.doc_id, coalesce(n, 0) AS n_shingles, c.component_id
FROM t LEFT JOIN sizes USING (doc_id) JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id)
""",
    "op12_conversation_repair": _repair_sql(),
}

"""One query per operator over its whole table, and SQL where it can express the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, chat, decontam, embdedup, jaccard, langid, linedup, merkle, mixing, quality, tokencount, toxicity, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_languages(_read(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is read back from the archives that were written of all pages."""
    return warc.read_archives(*warc.write_archives(_read(spark, sf_dir, "pages"))).drop("html", "url")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(chat.with_probe(_read(spark, sf_dir, "conversations")))


def op4_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and benchmark item that it covers by half or more."""
    return decontam.find_leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.score_documents(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return found.withColumn("segments", F.size("segments")).withColumnRenamed("segments", "n_segments")


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_read(spark, sf_dir, "documents"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embdedup.near_duplicate_vectors(_read(spark, sf_dir, "embeddings"), cosine=0.93)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokencount.count_tokens(_read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_read(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per deleted run: document, its words, and an earlier document and word that its longest part repeats."""
    runs = linedup.merged_runs(_read(spark, sf_dir, "documents"))
    return runs.selectExpr("id AS doc_id", "first AS first_word", "last - first AS n_words", "sid AS source_doc_id", "sfirst AS source_word")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tampered_proofs(_read(spark, sf_dir, "documents"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align.align(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")).documents


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_warc": op2_warc,
    "op3_chat_format": op3_chat_format,
    "op4_benchmark_leaks": op4_benchmark_leaks,
    "op5_toxicity": op5_toxicity,
    "op6_source_mix": op6_source_mix,
    "op7_embedding_near_dedup": op7_embedding_near_dedup,
    "op8_token_counts": op8_token_counts,
    "op9_ngram_jaccard": op9_ngram_jaccard,
    "op10_line_dedup": op10_line_dedup,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_token_alignment": op12_token_alignment,
    "op13_quality_rules": op13_quality_rules,
}

_COMPONENTS = """
both_ AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a AS id, b AS other FROM both_ UNION SELECT r.id, e.b FROM reach r JOIN both_ e ON e.a = r.other),
least AS (SELECT id, min(other) AS least FROM reach GROUP BY id)"""

#: Base-32 digits of a SHA-1, five hexadecimal digits at a time.
_BASE32 = "array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + (CAST('0x' || substr(h, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) % 32 AS BIGINT), 1)), '')"

_ESCAPED = "length({0}) + length(regexp_extract_all({0}, '[\\\\#:<]'))"

#: Levels of a tree that the SQL of op11 knows: groups of up to 8^7 rows.
_LEVELS = 7


def _merkle_levels(name: str, leaves: str) -> str:
    """Tables name0 (of g, i, n, d: group, index, nodes on the level, digest), name1, ...; what is alone on its level stays as it is."""
    up = "SELECT g, i // 8 AS i, (any_value(n) + 7) // 8 AS n, CASE WHEN any_value(n) = 1 THEN any_value(d) ELSE sha256(string_agg(d, '' ORDER BY i)) END AS d FROM {0} GROUP BY g, i // 8"
    return f"{name}0 AS ({leaves}),\n" + ",\n".join(f"{name}{k + 1} AS ({up.format(f'{name}{k}')})" for k in range(_LEVELS))


def _merkle_siblings(name: str, level: int, group: str, place: str) -> str:
    """(doc_id, lev, before, after) of every leaf on one level."""
    number = level if name == "t" else _LEVELS + level
    return f"""SELECT l.doc_id, {number} AS lev, coalesce(string_agg(x.d, '' ORDER BY x.i) FILTER (WHERE x.i < {place} // {8**level}), '') AS a, coalesce(string_agg(x.d, '' ORDER BY x.i) FILTER (WHERE x.i > {place} // {8**level}), '') AS b, max(x.n) = 1 AS one
  FROM leaf l LEFT JOIN {name}{level} x ON x.g = {group} AND x.i // 8 = {place} // {8 ** (level + 1)} GROUP BY l.doc_id"""


_FIELDS = "concat_ws('', {0}, {1}, {2}, {3}, {4})".format(*(f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars", "text")))
_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: CRC-32 of a decimal, character by character and bit by bit.
_CRC32 = "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, x: list_reduce(list_prepend(xor(c, x), range(8)), lambda v, _: CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295)"


def _merkle_folds() -> str:
    """Tables f0, f1, ...: what each row's leaf has become after that many levels."""
    step = "SELECT f.doc_id, CASE WHEN s.a || s.b = '' AND s.one THEN f.d ELSE sha256(s.a || f.d || s.b) END AS d FROM {0} f JOIN side s ON s.doc_id = f.doc_id AND s.lev = {1}"
    return ",\n".join(f"f{k + 1} AS ({step.format(f'f{k}', k)})" for k in range(2 * _LEVELS))


ORACLE_SQL: dict[str, str] = {
    "op2_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
h AS (SELECT page_id, octet_length(encode(t)) AS n, sha1(t) AS h, min(page_id) OVER (PARTITION BY t) AS f FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN f = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN f <> page_id THEN f END AS refers_to FROM h""",
    "op3_chat_format": f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
g AS (SELECT conv_id, count(*) AS n, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS a, coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS l,
  sum(15 + {_ESCAPED.format('role')} + {_ESCAPED.format('text')}) AS f FROM c GROUP BY conv_id)
SELECT conv_id, n AS n_turns, sha256(a) AS turns_sha256, CAST(length(l) AS BIGINT) AS loss_chars, sha256(l) AS loss_sha256, CAST(f AS BIGINT) AS formatted_chars FROM g""",
    "op7_embedding_near_dedup": f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM ok p JOIN ok q ON q.label = p.label AND q.vec_id > p.vec_id AND len(q.e) = len(p.e) WHERE list_cosine_similarity(p.e, q.e) >= 0.93),{_COMPONENTS},
n AS (SELECT a, count(*) AS n FROM both_ GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, least(v.vec_id, coalesce(l.least, v.vec_id)) AS component_id, v.vec_id = least(v.vec_id, coalesce(l.least, v.vec_id)) AS kept FROM v LEFT JOIN n ON n.a = v.vec_id LEFT JOIN least l ON l.id = v.vec_id""",
    "op9_ngram_jaccard": f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS k FROM s p JOIN s q ON q.s = p.s AND q.doc_id > p.doc_id GROUP BY 1, 2),
links AS (SELECT c.a, c.b FROM common c JOIN n x ON x.doc_id = c.a JOIN n y ON y.doc_id = c.b WHERE 100 * c.k >= 85 * (x.n + y.n - c.k)),{_COMPONENTS}
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(l.least, w.doc_id)) AS component_id FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN least l ON l.id = w.doc_id""",
    "op11_merkle_manifest": f"""
WITH leaf AS (SELECT doc_id, coalesce(lang, '') || CASE WHEN lang IS NULL THEN '0' ELSE '1' END AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n, sha256({_FIELDS}) AS d,
  dense_rank() OVER (ORDER BY lang IS NOT NULL, encode(coalesce(lang, ''))) - 1 AS r, {_CRC32} % 3 = 0 AS hit, sha256({_FIELDS.replace("(text ", "(" + _LOWERED + " ")}) AS changed FROM documents),
{_merkle_levels("t", "SELECT g, i, n, d FROM leaf")},
{_merkle_levels("u", f"SELECT 0 AS g, l.r AS i, (SELECT count(DISTINCT g) FROM leaf) AS n, t.d FROM (SELECT DISTINCT g, r FROM leaf) l JOIN t{_LEVELS} t ON t.g = l.g")},
side AS ({" UNION ALL ".join([_merkle_siblings("t", k, "l.g", "l.i") for k in range(_LEVELS)] + [_merkle_siblings("u", k, "0", "l.r") for k in range(_LEVELS)])}),
f0 AS (SELECT doc_id, CASE WHEN hit THEN changed ELSE d END AS d FROM leaf),
{_merkle_folds()},
proof AS (SELECT doc_id, sha256(string_agg(a || b, '' ORDER BY lev)) AS p FROM side GROUP BY doc_id)
SELECT l.doc_id, l.d AS leaf, t.d AS subroot, u.d AS root, p.p AS proof_sha256, f.d AS folded_root, f.d = u.d AS verified
FROM leaf l JOIN t{_LEVELS} t ON t.g = l.g JOIN proof p ON p.doc_id = l.doc_id JOIN f{2 * _LEVELS} f ON f.doc_id = l.doc_id CROSS JOIN u{_LEVELS} u""",
}

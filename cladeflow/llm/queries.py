"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, codes, decontaminate, forest, langmodel, merkle, metric_join, mixing, quality, recompression, suffix_dedup, tokens, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_join.jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op8_recompression_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = recompression.dedup_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"), texts=False)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_qgram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op4_toxicity_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_forest_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("rate")


OP6_SQL = """
WITH RECURSIVE counts AS (SELECT coalesce(source, '') AS source_key, count(*) AS n FROM documents GROUP BY 1),
rates AS (SELECT source_key, (SELECT sum(n)::DOUBLE FROM counts) * 1.0 * 1.0 / (SELECT count(*)::DOUBLE FROM counts) / n AS rate FROM counts),
drawn AS (
  SELECT doc_id, source, text, lang, n_chars, rate,
    ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u
  FROM documents JOIN rates ON coalesce(source, '') = source_key),
steps AS (
  SELECT doc_id, rate, u, -rate AS log, exp(-rate) AS total, 0 AS n FROM drawn
  UNION ALL
  SELECT doc_id, rate, u, log + ln(rate) - ln(n + 1), total + exp(log + ln(rate) - ln(n + 1)), n + 1 FROM steps WHERE total <= u AND n < ceil(rate + 12 * sqrt(rate) + 40)),
quantile AS (SELECT doc_id, max(n)::INTEGER AS n_copies FROM steps GROUP BY doc_id)
SELECT d.doc_id, d.source, d.text, d.lang, d.n_chars, n_copies, copy::INTEGER AS copy,
  md5('shuffle17:' || coalesce(d.doc_id::VARCHAR, 'null') || ':' || copy) AS shuffle_key
FROM drawn d JOIN quantile USING (doc_id), LATERAL (SELECT unnest(range(1, n_copies + 1)) AS copy)
"""

VOCABULARY = "word_bpe_49k.json"


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.token_output(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(VOCABULARY))


#: the conversation that holds the template's own control strings
CONTROL = r"\### Assistant: </turn> ok"


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    control = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL).alias("text"))
    return chat.digest(chat.format_turns(turns.unionByName(control)))


OP10_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn)) AS loss_sha256,
  sum(4 + length(replace(replace(replace(replace(role, '\', '\b'), '<', '\l'), '#', '\h'), ':', '\c')) + 2
    + length(replace(replace(replace(text, '\', '\b'), '<', '\l'), '#', '\h')) + 8)::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _op11_sql() -> str:
    """Nearest entries by comparison with all 64; two rounds of floored means."""
    near = """(SELECT p.vec_id, p.part, p.x, c.entry, c.d FROM {parts} p, LATERAL (
      SELECT b.entry, list_sum(list_transform(range(1, len(p.x) + 1), lambda k: (p.x[k] - b.x[k]) * (p.x[k] - b.x[k]))) AS d FROM {book} b WHERE b.part = p.part ORDER BY d, b.entry LIMIT 1) c)"""
    moved = """(SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM {book} b LEFT JOIN (
      SELECT part, entry, list(v ORDER BY k) AS x FROM (
        SELECT part, entry, k, floor(sum(x[k])::DOUBLE / count(*))::BIGINT AS v FROM {near} a, LATERAL (SELECT unnest(range(1, len(a.x) + 1)) AS k) GROUP BY part, entry, k) GROUP BY part, entry) m
      ON m.part = b.part AND m.entry = b.entry)"""
    return f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT vec_id, part, v[part * (len(v) // 16) + 1 : (part + 1) * (len(v) // 16)] AS x FROM kept, LATERAL (SELECT unnest(range(16)) AS part)),
seeds AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT 64),
book0 AS MATERIALIZED (SELECT part, entry, x FROM parts JOIN seeds USING (vec_id)),
near0 AS MATERIALIZED {near.format(parts="parts", book="book0")},
book1 AS MATERIALIZED {moved.format(book="book0", near="near0")},
near1 AS MATERIALIZED {near.format(parts="parts", book="book1")},
book2 AS MATERIALIZED {moved.format(book="book1", near="near1")},
near2 AS MATERIALIZED {near.format(parts="parts", book="book2")},
coded AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM near2 GROUP BY vec_id),
total AS (SELECT label, sum(error)::BIGINT AS label_error FROM coded JOIN kept USING (vec_id) GROUP BY label)
SELECT c.vec_id, code, error, label_error, (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) FROM book2) AS codebooks_sha256
FROM coded c JOIN kept k ON k.vec_id = c.vec_id JOIN total t ON t.label IS NOT DISTINCT FROM k.label
"""


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify(merkle.build(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def _op12_sql() -> str:
    """Leaves, all levels of both trees by recursion over runs of 8, and for each leaf its way up."""
    part = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0} END"
    leaf = lambda text: "sha256(" + " || ".join(part.format(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    climb = """SELECT t, level + 1, pos // 8, (max(n) + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM {0} WHERE n > 1 GROUP BY t, level, pos // 8"""
    beside = """SELECT t, level, pos, n, h, coalesce(string_agg(h, '' ORDER BY pos) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS pre,
      coalesce(string_agg(h, '' ORDER BY pos) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS post FROM {0} WINDOW w AS (PARTITION BY t, level, pos // 8 ORDER BY pos)"""
    return f"""
WITH RECURSIVE bits AS (
  SELECT doc_id, 1 AS i, 4294967295::BIGINT AS crc FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)
  UNION ALL
  SELECT doc_id, i + 1, list_reduce(list_prepend(xor(crc, ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT), range(8)::BIGINT[]), lambda c, k: xor(c >> 1, 3988292384 * (c & 1))) FROM bits WHERE i <= length(doc_id::VARCHAR)),
thirds AS (SELECT doc_id FROM bits WHERE i = length(doc_id::VARCHAR) + 1 AND xor(crc, 4294967295) % 3 = 0),
leaves AS (SELECT doc_id, CASE WHEN lang IS NULL THEN '0' ELSE '1' || lang END AS t, {leaf("text")} AS h, {leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS low FROM documents),
ranked AS (SELECT t, doc_id, h, CASE WHEN doc_id IN (SELECT doc_id FROM thirds) THEN low ELSE h END AS tampered,
  row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY t) AS n FROM leaves),
nodes(t, level, pos, n, h) AS (SELECT t, 0, pos, n, h FROM ranked UNION ALL {climb.format("nodes")}),
subs AS (SELECT t, h, row_number() OVER (ORDER BY t) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops(t, level, pos, n, h) AS (SELECT '', 0, pos, n, h FROM subs UNION ALL {climb.format("tops")}),
node_sides AS ({beside.format("nodes")}), top_sides AS ({beside.format("tops")}),
up(rid, t, level, pos, h, proof, done) AS (
  SELECT t || ':' || pos, t, 0, pos, tampered, '', n = 1 FROM ranked
  UNION ALL
  SELECT u.rid, u.t, u.level + 1, u.pos // 8, sha256(s.pre || u.h || s.post), u.proof || s.pre || s.post, s.n <= 8 FROM up u JOIN node_sides s ON s.t = u.t AND s.level = u.level AND s.pos = u.pos WHERE NOT u.done),
over(rid, level, pos, h, proof, done) AS (
  SELECT u.rid, 0, s.pos, u.h, u.proof, s.n = 1 FROM up u JOIN subs s USING (t) WHERE u.done
  UNION ALL
  SELECT o.rid, o.level + 1, o.pos // 8, sha256(s.pre || o.h || s.post), o.proof || s.pre || s.post, s.n <= 8 FROM over o JOIN top_sides s ON s.level = o.level AND s.pos = o.pos WHERE NOT o.done)
SELECT r.doc_id, r.h AS leaf, s.h AS subroot, root.h AS root, sha256(o.proof) AS proof_sha256, o.h AS folded_root, o.h = root.h AS verified
FROM ranked r JOIN subs s USING (t) JOIN over o ON o.done AND o.rid = r.t || ':' || r.pos, (SELECT h FROM tops WHERE n = 1) root
"""


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langmodel.fit_and_score(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_WORDS = r"coalesce(regexp_extract_all({0}, '[^\x20\x09-\x0D]+'), []) AS w"

#: windows of bytes as hexadecimal digits; a window repeats where it is not the first of its content
OP1_SQL = """
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
windows AS (SELECT doc_id, p, md5_number(substr(h, 2 * p + 1, 200)) AS k, substr(h, 2 * p + 1, 200) AS content FROM docs, LATERAL (SELECT unnest(range(0, n - 99)) AS p)),
shared AS (SELECT k FROM windows GROUP BY k HAVING count(*) > 1),
again AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY content ORDER BY doc_id, p) AS r FROM windows WHERE k IN (SELECT k FROM shared)) WHERE r > 1),
islands AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM (SELECT doc_id, p, coalesce(p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) > 100, true)::INTEGER AS new FROM again)),
runs AS (SELECT doc_id, min(p) AS b, max(p) + 100 AS e FROM islands GROUP BY doc_id, run),
gaps AS (SELECT doc_id, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY b), 0) AS b, b AS e FROM runs UNION ALL SELECT doc_id, max(e), NULL FROM runs GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * b + 1, 2 * (coalesce(e, n) - b)), '' ORDER BY b) AS h FROM gaps JOIN docs USING (doc_id) GROUP BY doc_id),
sums AS (SELECT doc_id, sum(e - b) AS gone, count(*) AS spans FROM runs GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept.h, docs.h))) AS kept_sha256
FROM docs LEFT JOIN sums USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

OP7_SQL = f"""
WITH RECURSIVE docs AS (SELECT doc_id, {_WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} FROM documents),
shingles AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) BETWEEN 1 AND 2 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i : i + 2], ' ') for i in range(1, len(w) - 1)] END) AS s FROM docs),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
met AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM met JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 90 * (p.n + q.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(id, other) AS (SELECT a, b FROM both_ways UNION SELECT r.id, b.b FROM reach r JOIN both_ways b ON b.a = r.other)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(min(other), d.doc_id))::BIGINT AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN reach ON id = d.doc_id GROUP BY d.doc_id, n
"""

OP8_SQL = f"""
WITH docs AS (SELECT doc_id, {_WORDS.format("text")} FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i : i + 49], ' ') AS k FROM docs, LATERAL (SELECT unnest(range(1, len(w) - 48)) AS i)),
firsts AS (SELECT k, min(doc_id) AS first FROM windows GROUP BY k HAVING min(doc_id) < max(doc_id)),
again AS (SELECT doc_id, i AS j FROM windows JOIN firsts USING (k) WHERE doc_id > first),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM docs),
marked AS (SELECT doc_id, word, j, count(a.j) OVER (PARTITION BY doc_id ORDER BY j ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) > 0 AS gone FROM words LEFT JOIN again a USING (doc_id, j)),
kept AS (SELECT doc_id, count(*) AS n, count(*) FILTER (gone) AS gone, coalesce(string_agg(word, ' ' ORDER BY j) FILTER (NOT gone), '') AS t FROM marked GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(gone, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM documents LEFT JOIN kept USING (doc_id)
"""


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_suffix_array_dedup, op2_quality_cotraining, op3_qgram_decontamination, op4_toxicity_ordinal, op5_forest_near_dedup, op6_mix_sources, op7_jaccard_join, op8_recompression_dedup, op9_token_output, op10_chat_format, op11_vector_codes, op12_merkle_manifest, op13_lm_scoring)}
ORACLE_SQL: dict[str, str] = {"op1_suffix_array_dedup": OP1_SQL, "op7_jaccard_join": OP7_SQL, "op8_recompression_dedup": OP8_SQL, "op6_mix_sources": OP6_SQL, "op10_chat_format": OP10_SQL, "op11_vector_codes": _op11_sql(), "op12_merkle_manifest": _op12_sql()}

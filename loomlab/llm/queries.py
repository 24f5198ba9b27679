"""The registered queries of this folder, one per operator, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from loomlab.llm import (
    chat, decontaminate, hard_negatives, langid, licenses, mixing, quality, secret_scan, simhash, token_files, url_rules, vector_codes, warc,
)
from loomlab.llm.common import table

TOKENIZER = "word_bpe_49k.json"
#: (verdict, host, path)
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def op1_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and component of every document: 4-word shingles, links at 4 or fewer bits."""
    found = simhash.near_duplicates(table(spark, folder, "documents"), shingle=4, max_bits=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Words that the mix takes of every document: weights 1, 2, 3 in turn, at most 3 passes."""
    found = mixing.taken(mixing.sized(table(spark, folder, "documents")), weights=[1, 2, 3], passes=3)
    return found.select("doc_id", "source", "size", "source_size", "target", "taken")


def op3_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict on every page: written rules first, then rules mined from the labels of the documents with these ids."""
    pages, labels = table(spark, folder, "pages"), table(spark, folder, "labels")
    bad = labels.select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    labelled = pages.select("page_id", "url").join(bad, "page_id").select("url", "bad")
    judged = url_rules.judge(pages.select("page_id", "url"), labelled, URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "confidence")


def op4_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Every document that holds an item of the benchmark, with the item."""
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("text_key")


def op5_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of every conversation and one planted one, read back from the formatted examples."""
    said = "</s>[INST] ok [/INST]"
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant"))
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(said).alias("text"))
    return chat.digests(chat.examples(rows.unionByName(planted)))


def op6_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document, learned from two thirds of them."""
    return langid.identify(table(spark, folder, "documents")).select("doc_id", "held_out", "lang_pred", "score", "mixture")


def op7_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with a known licence text or notice, with the licence."""
    return licenses.scan(table(spark, folder, "documents"))


def op8_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Spans of secrets in every document."""
    return secret_scan.scan(table(spark, folder, "documents"), keep=["doc_id"])


def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics and verdict on every document."""
    return quality.judge(table(spark, folder, "documents")).drop("lang", "source")


def op10_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Place, number and CRC of every document's ids, read back from the Arrow files written of all documents."""
    return token_files.token_files(table(spark, folder, "documents"), public_tokenizers.path(TOKENIZER), end_id=2, length=2048)


def op11_warc_normalise(spark: SparkSession, folder: str) -> DataFrame:
    """Every page as a WARC record, read back from archives with one gzip member per record."""
    found = warc.archive(table(spark, folder, "pages"), least_bytes=0)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op12_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Code and error of every embedding: 8 parts, 16 entries, 6 rounds."""
    return vector_codes.compress(table(spark, folder, "embeddings"), parts=8, count=16, rounds=6, scale=4096)


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives of every embedding whose id is divisible by 50; those divisible by 7 move to the next label."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    rows = table(spark, folder, "embeddings").withColumn("label", moved)
    return hard_negatives.mine(rows, F.col("vec_id") % 50 == 0, positives=5, negatives=3, least_pct=50, most_pct=95, scale=256)


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of the whole pipeline's last stage."""
    return corpus_pipeline.run(spark, folder)


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash_near_dedup, op2_mix_sources, op3_url_filter, op4_decontaminate, op5_chat_format, op6_language_id, op7_license_scan,
        op8_secret_scan, op9_quality_rules, op10_token_files, op11_warc_normalise, op12_vector_codes, op13_hard_negatives, pipeline,
    )
}


def _escaped_sql(text: str, control: list[str]) -> str:
    for i, c in enumerate(control):
        text = f"replace({text}, {'chr(10)' if c == chr(10) else repr(c)}, '{chat.MARK}{i}')"
    return text


OP5_SQL = f"""WITH rows AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
turns AS (
  SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS t,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS i FROM rows),
sizes AS (
  SELECT *, {len(chat.START) + 1 + len(chat.END)} + length({_escaped_sql('r', chat.ROLE_CONTROL)}) + length({_escaped_sql('t', chat.CONTROL)}) AS chars FROM turns),
walk AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY i) AS upto, max(i) OVER (PARTITION BY conv_id) AS last FROM sizes)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(sum(CASE WHEN r = 'assistant' THEN length(t) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN r = 'assistant' THEN t ELSE '' END, '' ORDER BY i)) AS loss_sha256,
  CAST(sum(CASE WHEN r = 'assistant' OR i = last THEN upto ELSE 0 END) AS BIGINT) AS formatted_chars
FROM walk GROUP BY conv_id"""

ONE, HALF = 1 << mixing.BITS, (1 << 21) - 1
OP2_SQL = f"""WITH sized AS (
  SELECT doc_id, source, CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size FROM documents),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
numbered AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number, 3 * source_size AS most,
         CAST(sum(source_size) OVER () AS BIGINT) AS total FROM sums),
weighed AS (SELECT *, CAST(1 + number % 3 AS DOUBLE) AS weight FROM numbered),
steps AS (
  SELECT *, (total - coalesce(sum(most) OVER (ORDER BY most / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY most / weight, number ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
found AS (SELECT coalesce(min_by(level, number_of) FILTER (level * weight <= most), 0.0) AS level
  FROM (SELECT *, row_number() OVER (ORDER BY most / weight, number) AS number_of FROM steps)),
aimed AS (SELECT w.*, least(CAST(most AS DOUBLE), weight * f.level) AS target FROM weighed w, found f),
reached AS (
  SELECT *, floor(sum(target) OVER (ORDER BY number) / sum(target) OVER () * {ONE}) AS edge, max(number) FILTER (target > 0) OVER () AS final FROM aimed),
spans AS (SELECT *, CAST(CASE WHEN number >= final THEN {ONE} ELSE edge END AS BIGINT) AS high FROM reached),
bounds AS (SELECT *, coalesce(lag(high) OVER (ORDER BY number), 0) AS low FROM spans),
points AS (
  SELECT (((n >> 21) * {(mixing.GOLDEN << 21) % ONE}) % {ONE} + ((n & {HALF}) * {mixing.GOLDEN}) % {ONE}) % {ONE} AS point
  FROM (SELECT unnest(range(1, (SELECT CAST(ceil(max(total) / 64.0) AS BIGINT) FROM weighed) + 1)) AS n)),
given AS (
  SELECT b.number, least(CAST(floor(any_value(b.target)) AS BIGINT), 64 * count(p.point)) AS words
  FROM bounds b LEFT JOIN points p ON p.point >= b.low AND p.point < b.high GROUP BY b.number),
placed AS (
  SELECT s.doc_id, s.source, s.size, b.source_size, b.target, g.words,
    CAST(coalesce(sum(s.size) OVER (PARTITION BY b.number ORDER BY md5(CAST(s.doc_id AS VARCHAR) || ':mix'), s.doc_id, s.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ahead
  FROM sized s JOIN bounds b ON s.source IS NOT DISTINCT FROM b.source JOIN given g ON g.number = b.number)
SELECT doc_id, source, size, source_size, target,
  """ + " + ".join(f"greatest(0, least(words, {i} * source_size + ahead + size) - ({i} * source_size + ahead))" for i in range(3)) + """ AS taken FROM placed"""

OP11_SQL = """WITH rows AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages),
hashed AS (SELECT *, sha1(h) AS hex, CAST(strlen(h) AS BIGINT) AS payload_bytes, min(page_id) OVER (PARTITION BY h) AS first FROM rows)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST((CAST('0x' || substr(hex, 1 + 10 * (i // 8), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS INTEGER)) & 31 AS INTEGER), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM hashed"""


def _rounds_sql(rounds: int) -> str:
    """Assignments ``a`` and codebooks ``c`` of each round, as one table each."""
    near = """a{0} AS MATERIALIZED (
  SELECT r, part, q, d // 16 AS error, d % 16 AS e FROM (
    SELECT p.r, p.part, any_value(p.q) AS q,
      min(CAST(list_sum(list_transform(list_zip(p.q, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) * 16 + c.e) AS d
    FROM p JOIN c{0} c ON p.part = c.part GROUP BY p.r, p.part))"""
    mean = """s{0} AS (
  SELECT part, e, i, CAST(sum(q[i]) AS BIGINT) AS t, count(*) AS n FROM a{0}, range(1, 9) AS x(i) GROUP BY part, e, i),
m{0} AS (SELECT part, e, list((t - ((t % n) + n) % n) // n ORDER BY i) AS c FROM s{0} GROUP BY part, e),
c{1} AS MATERIALIZED (SELECT c.part, c.e, coalesce(m.c, c.c) AS c FROM c{0} c LEFT JOIN m{0} m ON c.part = m.part AND c.e = m.e)"""
    return ",\n".join([x.format(i, i + 1) for i in range(rounds) for x in (near, mean)] + [near.format(rounds)])


OP12_SQL = f"""WITH kept AS MATERIALIZED (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS r, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT r, part, v[part * (len(v) // 8) + 1:(part + 1) * (len(v) // 8)] AS q FROM kept, range(8) AS x(part)),
c0 AS MATERIALIZED (SELECT part, r - 1 AS e, q AS c FROM p WHERE r <= 16),
{_rounds_sql(6)},
sha AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, e, i)) AS codebooks_sha256
  FROM (SELECT part, e, unnest(c) AS x, generate_subscripts(c, 1) AS i FROM c6)),
coded AS (SELECT r, string_agg(format('{{:02x}}', e), '' ORDER BY part) AS code, CAST(sum(error) AS BIGINT) AS error FROM a6 GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN kept USING (r), sha"""

OP13_SQL = """WITH kept AS MATERIALIZED (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS g,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS MATERIALIZED (
  SELECT a.id AS anchor_id, a.g = b.g AS alike, b.id AS id, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM kept a JOIN kept b ON a.id % 50 = 0 AND a.id <> b.id),
positive AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
  id AS negative_id, positive_score, score AS negative_score
FROM positive JOIN scored USING (anchor_id)
WHERE NOT alike AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= 3"""

ORACLES: dict[str, str] = {
    "op2_mix_sources": OP2_SQL, "op5_chat_format": OP5_SQL,
    "op11_warc_normalise": OP11_SQL, "op12_vector_codes": OP12_SQL, "op13_hard_negatives": OP13_SQL,
}
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL

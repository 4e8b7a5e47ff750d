"""Registered queries of the training-data operators and their DuckDB twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tillroll.llm import (bpe, chat, exactdedup, fingerprint, langid, lexical, linededup, mixture, packing, simhash,
                          toxicity, vectorcode, warc)
from tillroll.llm.common import field, with_group_sum

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hex_of(digest: str):
    return F.lower(F.hex(digest))


CONTROL_CASE = "\\### Assistant: </turn> ok"


@query
def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_CASE).alias("text"))
    out = chat.format_chat(chat.log_of_rows(rows.unionByName(planted)))
    turns = chat.read_turns(F.col("formatted"))
    read = out.select("conv_id", "formatted", turns.alias("turns"),
                      chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"),
                       F.sha2(joined, 256).alias("turns_sha256"),
                       F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


ORACLES["op1_chat_formatting"] = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
turns AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '#', '\#'), '</', '<\/') AS body,
    replace(replace(replace(replace(role, '\', '\\'), '#', '\#'), '</', '<\/'), ':', '\c') AS who
  FROM rows)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('### ' || who || ': ' || body || '</turn>' || chr(10)))::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id"""


@query
def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


@query
def op3_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archive_round_trip(table(spark, sf_dir, "pages")).where("kind = 'record'")
    return records.select(warc.page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest",
                          "record_type", warc.page_of(F.col("refers_to")).alias("refers_to"))


ORACLES["op3_warc_salvage"] = """
WITH hashed AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h
  FROM pages),
won AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS winner FROM hashed)
SELECT page_id, payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(h, (5 * (i // 4) + 1)::INT, 5))::BIGINT >> (5 * (3 - i % 4))::INT) & 31)::INT, 1)
    FOR i IN range(32)], '') AS payload_digest,
  CASE WHEN page_id = winner THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> winner THEN winner END AS refers_to
FROM won"""


@query
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    return rows.select(field("doc_id").alias("doc_id"), "lines.n_lines", "lines.n_dropped",
                       F.sha2("lines.kept_text", 256).alias("kept_sha256"))


ORACLES["op4_line_dedup"] = r"""
WITH split AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM split),
counted AS (
  SELECT *, length(key) >= 10 AND min(doc_id) OVER (PARTITION BY key) <> max(doc_id) OVER (PARTITION BY key)
    AND doc_id <> min(doc_id) OVER (PARTITION BY key) AS dropped FROM keyed)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (dropped)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM counted GROUP BY doc_id"""


@query
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.fit(docs))
    return found.select(field("doc_id").alias("doc_id"), langid.held_out(field("doc_id")).alias("held_out"),
                        "lang_pred", "score")


@query
def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    coded = bpe.encode(table(spark, sf_dir, "documents"), path, pattern)
    read = bpe.decode(coded, path, pattern)
    return read.select(field("doc_id").alias("doc_id"), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op8_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                         "offset", "source", "padded_length")


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select(field("doc_id").alias("doc_id"), toxicity.held_out(field("doc_id")).alias("held_out"),
                         F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


@query
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exactdedup.exact_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", hex_of("digest").alias("text_sha256"))


ORACLES["op10_exact_dedup"] = """
WITH folded AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))
    AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, text_sha256
FROM folded WINDOW g AS (PARTITION BY text_sha256)"""


@query
def op11_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixture.mix(table(spark, sf_dir, "documents"), ["doc_id"])
    return mixed.select(field("doc_id").alias("doc_id"), "size", "source_size", "target", "taken", "source")


@query
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vectorcode.compress(table(spark, sf_dir, "embeddings"), keep=["vec_id", "label"])
    rows = coded.select(field("vec_id").alias("vec_id"), field("label").alias("label"), hex_of("code").alias("code"),
                        "error")
    return with_group_sum(rows, "label", "error", "label_error").select(
        "vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def _codes_sql(rounds: int = 4) -> str:
    """The rounds as a chain of tables: codebook ``b``, assignment ``a``, codebook, ... assignment."""
    steps = [f"""
a{i} AS MATERIALIZED (
  SELECT vec_id, label, p, x, min(d * 256 + e) % 256 AS e, min(d * 256 + e) // 256 AS d FROM (
    SELECT vec_id, label, r.p, r.x, e,
      list_sum([(r.x[i] - b.x[i]) * (r.x[i] - b.x[i]) FOR i IN range(1, len(r.x) + 1)]) AS d
    FROM parts r JOIN b{i} b ON r.p = b.p) GROUP BY vec_id, label, p, x),""" + (f"""
m{i} AS (
  SELECT p, e, list((s - ((s % n + n) % n)) // n ORDER BY j) AS x FROM (
    SELECT p, e, j, sum(x[j]) AS s, count(*) AS n FROM a{i}, unnest(range(1, len(x) + 1)) t(j) GROUP BY p, e, j)
  GROUP BY p, e),
b{i + 1} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM b{i} b LEFT JOIN m{i} m ON b.p = m.p AND b.e = m.e),"""
             if i < rounds else "") for i in range(rounds + 1)]
    return f"""
WITH kept AS (
  SELECT vec_id, label, [floor(1024 * c::DOUBLE)::BIGINT FOR c IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([c FOR c IN embedding IF c IS NULL OR NOT isfinite(c)]) = 0),
parts AS MATERIALIZED (
  SELECT vec_id, label, p, v[p * (len(v) // 4) + 1:(p + 1) * (len(v) // 4)] AS x FROM kept, range(4) t(p)),
b0 AS MATERIALIZED (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x FROM parts QUALIFY e < 256),
{"".join(steps)}
books AS (
  SELECT sha256(string_agg(x[j]::VARCHAR, ',' ORDER BY p, e, j)) AS h FROM b{rounds}, unnest(range(1, len(x) + 1)) t(j)),
coded AS (
  SELECT vec_id, label, string_agg(printf('%02x', e::BIGINT), '' ORDER BY p) AS code, sum(d)::BIGINT AS error
  FROM a{rounds} GROUP BY vec_id, label)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256
FROM coded, books"""


ORACLES["op12_vector_codes"] = _codes_sql()


@query
def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = lexical.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["item_id"])
    return ranked.select(field("item_id").alias("item_id"), "rank", "doc_id", "score")


ORACLES["op13_lexical_search"] = r"""
WITH docs AS MATERIALIZED (
  SELECT uid, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS uid, doc_id, text FROM documents)),
items AS (
  SELECT DISTINCT uid, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS uid, item_id, text FROM benchmark)),
tfs AS MATERIALIZED (SELECT uid, doc_id, term, count(*)::BIGINT AS tf FROM docs GROUP BY uid, doc_id, term),
whole AS (SELECT count(DISTINCT uid)::BIGINT AS n_docs, count(*)::BIGINT AS n_terms FROM docs),
lengths AS (
  SELECT uid, 10 + (90 * sum(tf)::BIGINT * n_docs) // n_terms AS m FROM tfs, whole GROUP BY uid, n_docs, n_terms),
weights AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM tfs, whole GROUP BY term, n_docs),
scored AS (
  SELECT i.uid, i.item_id, t.uid AS doc, t.doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM items i JOIN tfs t USING (term) JOIN weights USING (term) JOIN lengths l ON l.uid = t.uid
  GROUP BY i.uid, i.item_id, t.uid, t.doc_id HAVING score > 0)
SELECT item_id, (row_number() OVER (PARTITION BY uid ORDER BY score DESC, doc_id NULLS LAST))::INT AS rank, doc_id, score
FROM scored QUALIFY rank <= 10"""

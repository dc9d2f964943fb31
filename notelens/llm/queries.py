"""The registered query of each operator, over its whole table, and its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelens.llm import cap_filters, chat_format, decontaminate, divergence, exact_dedup, filter_audit, html_extract, jaccard_join, licenses, quality, sentencepiece_codec, substring_dedup, warc
from notelens.sources.tables import shared_dir, table

PIECES = "/opt/tokenizers/piece_bpe_32k.model"
QUALITY_FLOOR = 0.3


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.remove_repeats(spark, table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), path, min_bytes=0)
    return warc.read_archive(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item that occurs in it: the span and its edits."""
    return decontaminate.find_contamination(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.with_score(docs, model).withColumn("held_out", quality.held_out())
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= QUALITY_FLOOR).cast("int").alias("predicted"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str, model_file: str = PIECES) -> DataFrame:
    """Ids of every whole text, and whether they decode to the very text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = sentencepiece_codec.encode(spark, docs, model_file, decoded=True)
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return coded.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"), same.alias("round_trip"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(spark, table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and license template whose wording it holds."""
    return licenses.scan_licenses(spark, table(spark, sf_dir, "documents")).select("doc_id", "license", "share", "first_word")


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(spark, table(spark, sf_dir, "documents"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    parsed = chat_format.parse_chats(chat_format.format_chats(chats.unionByName(extra)))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return parsed.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(spark, table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_documents(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cap_filters.link_vectors(spark, table(spark, sf_dir, "embeddings"))


SQL = {
    "op2_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body, sha1(coalesce(html, '')) AS hex FROM pages),
g AS (SELECT *, min(page_id) OVER (PARTITION BY body) AS first_id FROM p)
SELECT page_id, octet_length(body) AS payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((('0x' || substr(hex, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1 AS BIGINT), 1) FOR i IN range(32)], '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM g
""",
    "op6_exact_dedup": """
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
""",
    "op10_chat_format": r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
esc AS (
  SELECT *, length(text) + length(text) - length(replace(text, '\', ''))
           + list_sum([0] || [CASE WHEN substr(text, i, 3) = '###' OR substr(text, i, 6) = '<turn>' OR substr(text, i, 7) = '</turn>' THEN 1 ELSE 0 END FOR i IN range(1, length(text) + 1)]) AS n,
         coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) = role, false) AS same
  FROM rows)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n + 8 + CASE WHEN same THEN 0 ELSE 6 + length(role) END) AS BIGINT) AS formatted_chars
FROM esc GROUP BY conv_id
""",
    "op11_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x60\x7B-\x7F]+') AS terms FROM documents),
t AS (SELECT row, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT row) >= 10),
lang_total AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
groups AS (SELECT DISTINCT lang, source FROM d),
totals AS (SELECT lang, source, sum(n) AS total FROM counts GROUP BY lang, source),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         (1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (coalesce(s.total, 0) + 2 * l.v))::BIGINT AS p,
         (1 + 1000000000::HUGEINT * (k.n + 2) // (l.total + 2 * l.v))::BIGINT AS q
  FROM groups g JOIN kept k USING (lang) JOIN lang_total l USING (lang) LEFT JOIN totals s USING (lang, source) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
             FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
marks AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM pairs
UNION ALL
SELECT * FROM (SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM marks) WHERE rank <= 10
""",
    "op12_filter_audit": r"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
d AS (
  SELECT part, (len(words) < 50)::INT + 2 * (100 * len(list_distinct(words)) < 65 * len(words))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::INT
               + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS fails,
         coalesce(g.good, false) AS good, coalesce(g.toxic, false) AS toxic
  FROM w LEFT JOIN (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id) g USING (doc_id)),
n AS (SELECT part, fails, good, toxic, count(*) AS n FROM d GROUP BY ALL),
o AS (SELECT a || b || c || x || y AS filter_order FROM unnest(['A','B','C','D','E']) t1(a), unnest(['A','B','C','D','E']) t2(b), unnest(['A','B','C','D','E']) t3(c), unnest(['A','B','C','D','E']) t4(x), unnest(['A','B','C','D','E']) t5(y)
      WHERE len(list_distinct([a, b, c, x, y])) = 5),
s AS (SELECT filter_order, step, (1 << (ascii(filter_order[step]) - 65)) AS bit, list_sum([0] || [1 << (ascii(filter_order[i]) - 65) FOR i IN range(1, step)]) AS before
      FROM o, unnest([1, 2, 3, 4, 5]) t(step)),
r AS (
  SELECT part, filter_order, step, bit,
         sum(n * ((fails & (before::BIGINT | bit)) = 0)::INT)::BIGINT AS kept, sum(n * ((fails & bit) > 0 AND (fails & before::BIGINT) = 0)::INT)::BIGINT AS removed,
         sum(n * ((fails & bit) > 0 AND (fails & before::BIGINT) > 0)::INT)::BIGINT AS redundant, sum(n * (fails = bit)::INT)::BIGINT AS unique_fails,
         sum(n * ((fails & bit) > 0 AND (fails & before::BIGINT) = 0 AND good)::INT)::BIGINT AS good_lost, sum(n * ((fails & bit) > 0 AND (fails & before::BIGINT) = 0 AND toxic)::INT)::BIGINT AS toxic_lost
  FROM n, s GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley FROM r
""",
    "op13_cap_filters": """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
u AS (SELECT * FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(list_filter(x, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(x, lambda e: e <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND len(a.x) = len(b.x) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.x, b.x) >= 0.93),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM links WHERE links.a = c.vec_id)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM c
""",
}


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # it imports this module

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {f.__name__: f for f in (op1_suffix_dedup, op2_warc, op3_decontamination, op4_quality, op5_sentencepiece, op6_exact_dedup, op7_licenses, op8_html, op9_jaccard_join, op10_chat_format, op11_divergence, op12_filter_audit, op13_cap_filters, pipeline)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

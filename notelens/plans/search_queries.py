"""Search queries over the documents table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelens.functions.text import tokenize
from notelens.operators import postings
from notelens.operators import search as S
from notelens.plans import adapters
from notelens.sources import note_files
from notelens.sources.config import View
from notelens.sources.tables import shared_dir, table

QUERY = "annt reed oure anst"
CONCEPTS = (S.Concept("alpha", ("annt", "heat", "reor anor")), S.Concept("beta", ("reed oure", "innd")), S.Concept("gamma", ("zebra", "lion")))
TYPED = dict.fromkeys(S.query_tokens(QUERY), 1.0)


def _result(scored: DataFrame, k: int = 10) -> DataFrame:
    return S.top(scored, k).select(F.col("path").alias("doc_id"), F.round("score", 6).alias("score"), F.col("passage_no").cast("long").alias("passage_no"))


def tokenize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = adapters.notes(spark, sf_dir).select("type", F.explode(tokenize(F.col("body"))).alias("token"))
    return tokens.groupBy("type", "token").agg(F.count(F.lit(1)).alias("n")).groupBy("type").agg(F.count(F.lit(1)).alias("distinct_tokens"), F.sum("n").alias("tokens"), F.max("n").alias("most"))


def search_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The posting table that the searches read, built where it is not there yet: its notes, postings of bodies and tokens."""
    index = adapters.note_index(spark, sf_dir)
    held = spark.read.parquet(f"{index.root}/postings").filter(F.col("no") != postings.NAMES)
    counted = held.agg(F.count("*").alias("postings"), F.count_distinct("token").alias("tokens"), F.sum("tf").cast("long").alias("occurrences"))
    return index.notes.agg(F.count("*").alias("notes")).crossJoin(counted)  # one row each


def search_bm25_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _result(postings.ranked(adapters.note_index(spark, sf_dir), QUERY, sections=False, names=False))


def search_bm25_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _result(postings.ranked(adapters.note_index(spark, sf_dir), QUERY))


def search_filtered_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters of type and tag, and a missing dimension, each note counted at the first that rejects it."""
    filters = S.Filters(types=("en", "de"), tags=("SRC_1", "src-2"))
    return filters.tally(adapters.notes(spark, sf_dir))


def search_after_filter_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequencies and lengths come from what the filters leave."""
    index = adapters.note_index(spark, sf_dir)
    good = table(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("path"))
    return _result(postings.ranked(index, QUERY, kept=S.Filters(types=("en",)).select(index.notes).join(good, "path", "left_semi")))


def search_expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    added, _, _ = S.expand_query(QUERY, CONCEPTS)
    return _result(postings.ranked(adapters.note_index(spark, sf_dir), QUERY, added))


def expansion_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the lexicon adds to the query, and how many notes hold each added token."""
    _, used, _ = S.expand_query(QUERY, CONCEPTS)
    rows = spark.createDataFrame([(name, term, t) for name, term, added in used for t in added], "concept string, matched string, token string")
    held = adapters.notes(spark, sf_dir).select(F.explode(F.array_distinct(tokenize(F.col("body")))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("notes"))
    return rows.join(held, "token", "left").select("concept", "matched", "token", F.coalesce("notes", F.lit(0)).alias("notes"))


def search_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = "annt reed zebra"
    best = S.top(postings.ranked(adapters.note_index(spark, sf_dir), query), 1)
    return S.confidence(best, list(dict.fromkeys(S.query_tokens(query)))).withColumnRenamed("path", "doc_id")


def search_zero_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons for an empty result under three filters: quality 2, none, and an empty scope."""
    every = adapters.labelled(spark, sf_dir)
    cases = [("filtered", F.lit(True), F.coalesce(F.col("quality") == 2, F.lit(False))), ("no-overlap", F.lit(True), F.lit(True)), ("empty-scope", F.col("type") == "xx", F.lit(True))]
    counted = every.agg(F.array(*[F.struct(F.lit(name).alias("case"), F.count_if(scope).alias("candidates"), F.count_if(scope & kept).alias("matched")) for name, scope, kept in cases]).alias("c"))
    return counted.select(F.inline("c")).withColumn("reason", S.zero_reason(F.col("candidates"), F.col("matched"), F.lit(0)))


def search_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = postings.bodies(adapters.notes(spark, sf_dir).select("path", "body"), S.top(postings.ranked(adapters.note_index(spark, sf_dir), QUERY), 10))
    return S.snippet(best, list(TYPED)).select(F.col("path").alias("doc_id"), F.col("line").cast("long").alias("line"), F.col("hits").cast("long").alias("hits"), "snippet")


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings.search(adapters.note_index(spark, sf_dir), adapters.notes(spark, sf_dir), QUERY, 10, concepts=CONCEPTS)


def search_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RNK-11 and RNK-12: which of the typed words each note of an expanded search holds, and where."""
    return _found(spark, sf_dir).select(F.col("path").alias("doc_id"), F.inline("signals"))


def search_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RNK-13: what the lexicon added to each note of an expanded search."""
    return _found(spark, sf_dir).select(F.col("path").alias("doc_id"), F.inline("expansion"))


CHAT_QUERY = "thble onin ering assistant"
CHAT_FILTERS = S.Filters(types=("open",), tags=("Chats", "turns-9"), after="2024-01-15")


def _chat_top(spark: SparkSession, sf_dir: str, filters: S.Filters = S.Filters()) -> DataFrame:
    index = adapters.chat_index(spark, sf_dir)
    return S.top(postings.ranked(index, CHAT_QUERY, kept=filters.select(index.notes)), 10)


def notes_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as Markdown notes, ranked by their best section between headings, from the posting table."""
    return _chat_top(spark, sf_dir).select("path", F.round("score", 6).alias("score"), F.col("passage_no").cast("long").alias("passage_no"))


def notes_filtered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same under filters of type, tag and date from the metadata block; statistics are those of what is left."""
    return _chat_top(spark, sf_dir, CHAT_FILTERS).select("path", F.round("score", 6).alias("score"), F.col("passage_no").cast("long").alias("passage_no"))


def notes_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RNK-14 over heading sections: the best line with its neighbours, its heading and its line in the file."""
    found = postings.bodies(adapters.chat_notes(spark, sf_dir).select("path", "lines", "body_start_line"), _chat_top(spark, sf_dir))
    return S.snippet(found, S.query_tokens(CHAT_QUERY)).select("path", F.col("line").cast("long").alias("line"), "heading", F.col("hits").cast("long").alias("hits"), "snippet")


VIEWS = {"recent": View("recent", CHAT_QUERY, ("open",), scope="chats", top_k=5, date_field="date", window_days=60)}
VIEW_DAY = "2024-04-30"


def view_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RNK-26: a saved view, run on a day."""
    held = adapters.chat_notes(spark, sf_dir).select("path", "lines", "body_start_line")
    _, found = postings.run_view(adapters.chat_index(spark, sf_dir), held, VIEWS, "recent", VIEW_DAY)
    return found.select("path", F.round("score", 6).alias("score"), "heading", F.col("line").cast("long").alias("line"))


CASES = {
    "filtered": ("that", S.Filters(types=("none",)), None), "no overlap": ("zzzz qqqq", S.Filters(types=("open",)), None), "empty scope": ("that", S.Filters(), "nowhere"),
    "broken filter": ("that", S.Filters(after="2999-01-01", tags=("chat",)), "chats"),
}


def search_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RNK-17: why four searches are empty, with the counts behind it."""
    index = adapters.chat_index(spark, sf_dir)
    found = {name: postings.diagnose(index, *case) for name, case in CASES.items()}
    rows = [(name, d.reason, d.facts["candidates"], d.facts["matched"], d.facts["filters_active"], len(d.retries)) for name, d in found.items()]
    return spark.createDataFrame(rows, "case string, reason string, candidates long, matched long, filters_active boolean, retries int")


def note_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-7: conversations written as note files, and their metadata by type from the first chunks of the files."""
    folder = shared_dir(spark, "vault")
    note_files.write_notes(adapters.chat_files(spark, sf_dir), folder)
    known = note_files.head_metadata(note_files.read_heads(spark, folder, chunk=512))
    return known.groupBy("type").agg(F.count("*").alias("notes"), F.sum("size").alias("bytes"), F.sum("bytes_read").alias("bytes_read"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


TOK = "regexp_extract_all(lower({}), '[a-z0-9]+')"


#: From passages (doc_id, no, toks, length), fields (doc_id, w, token), base (doc_id) and q (token, w) to the ten best.
RANKED = """names AS (SELECT doc_id, token, sum(w) AS tf FROM fields GROUP BY ALL),
name_length AS (SELECT doc_id, sum(w) AS name_length FROM fields GROUP BY ALL),
mean AS (SELECT doc_id, avg(length) AS mean_length FROM passages GROUP BY doc_id),
sized AS (SELECT b.doc_id, coalesce(n.name_length, 0) AS name_length, coalesce(m.mean_length, 0) AS mean_length FROM base b LEFT JOIN name_length n USING (doc_id) LEFT JOIN mean m USING (doc_id)),
corpus AS (SELECT count(*) AS n, greatest(avg(name_length + mean_length), 1.0) AS avg_len FROM sized),
postings AS (SELECT doc_id, no, token, count(*) AS tf FROM (SELECT doc_id, no, unnest(toks) AS token FROM passages) WHERE token IN (SELECT token FROM q) GROUP BY ALL),
held AS (SELECT DISTINCT doc_id, token FROM postings UNION SELECT doc_id, token FROM names WHERE token IN (SELECT token FROM q)),
df AS (SELECT q.token, q.w, count(h.doc_id) AS df, ln(1 + (any_value(n) - count(h.doc_id) + 0.5) / (count(h.doc_id) + 0.5)) AS idf FROM q CROSS JOIN corpus LEFT JOIN held h ON h.token = q.token GROUP BY q.token, q.w),
units AS (SELECT doc_id, no, length FROM passages UNION ALL SELECT doc_id, 0, 0 FROM sized WHERE doc_id NOT IN (SELECT doc_id FROM passages)),
hits AS (SELECT u.doc_id, u.no, u.length, d.token, d.w, d.idf, coalesce(x.tf, 0) + coalesce(p.tf, 0) AS f
  FROM units u JOIN held h ON h.doc_id = u.doc_id JOIN df d ON d.token = h.token
  LEFT JOIN names x ON x.doc_id = u.doc_id AND x.token = d.token LEFT JOIN postings p ON p.doc_id = u.doc_id AND p.no = u.no AND p.token = d.token),
section AS (SELECT h.doc_id, h.no, sum(h.w * h.idf * (h.f * 2.5 / (h.f + 1.5 * (1 - 0.75 + 0.75 * (s.name_length + greatest(h.length, s.mean_length)) / c.avg_len)))) AS score
  FROM hits h JOIN sized s USING (doc_id) CROSS JOIN corpus c WHERE h.f > 0 GROUP BY h.doc_id, h.no),
scored AS (SELECT doc_id, CAST(no AS BIGINT) AS passage_no, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, no) AS r FROM section) WHERE r = 1 AND score > 0),
top AS (SELECT * FROM scored ORDER BY score DESC, lower(CAST(doc_id AS VARCHAR)), doc_id LIMIT 10)
"""


def _bm25_sql(where: str = "true", weights: dict[str, float] = TYPED, names: bool = True, sections: bool = True, notes: str = "documents") -> str:
    """The ranking as joins and aggregations over exploded tokens. Ends with the relations ``scored``
    (doc_id, passage_no, score), ``df`` (token, w, idf) and ``hits``."""
    terms = ", ".join(f"('{t}', {w})" for t, w in weights.items())
    cut = "string_split(text, chr(10))" if sections else "[text]"
    title = TOK.format("split_part(text, chr(10), 1)")
    tags = TOK.format("lang || chr(10) || source")
    fields = f"SELECT doc_id, 6.0 AS w, unnest({title}) AS token FROM base UNION ALL SELECT doc_id, 3.0, unnest({tags}) FROM base" if names else "SELECT doc_id, 6.0 AS w, '' AS token FROM base WHERE false"
    return f"""
WITH q(token, w) AS (VALUES {terms}),
base AS (SELECT doc_id, text, lang, source FROM {notes} WHERE {where}),
parts AS (SELECT doc_id, i - 1 AS no, {TOK.format('l[i]')} AS toks FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, {cut} AS l FROM base))),
passages AS (SELECT doc_id, no, toks, len(toks) AS length FROM parts WHERE len(toks) > 0),
fields AS ({fields}),
""" + RANKED


def _chat_sql(where: str = "true") -> str:
    """Sections of conversations as Markdown notes: 1 is the title, each turn is one below its heading."""
    terms = ", ".join(f"('{t}', 1.0)" for t in S.query_tokens(CHAT_QUERY))
    return f"""
WITH q(token, w) AS (VALUES {terms}),
turns AS (SELECT *, 'chats/' || conv_id || '.md' AS doc_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS r, coalesce(text, '') AS said, coalesce(role, '') || ' ' || turn AS heading FROM conversations),
chats AS (SELECT doc_id, any_value(conv_id) AS conv_id, count(*) AS n, CASE WHEN bool_or(role = 'system') THEN 'guided' ELSE 'open' END AS type, DATE '2024-01-01' + CAST(any_value(conv_id) % 300 AS INT) AS date FROM turns GROUP BY doc_id),
base AS (SELECT * FROM chats WHERE {where}),
sections AS (SELECT doc_id, 1 AS no, 'Conversation ' || conv_id AS heading, '# Conversation ' || conv_id AS body, 0 AS start FROM base
  UNION ALL SELECT doc_id, r + 1, heading, '## ' || heading || chr(10) || said, 1 + coalesce(sum(3 + length(said) - length(replace(said, chr(10), '')) - 1) OVER (PARTITION BY doc_id ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) FROM turns SEMI JOIN base USING (doc_id)),
passages AS (SELECT *, len(toks) AS length FROM (SELECT doc_id, no, {TOK.format('body')} AS toks FROM sections) WHERE len(toks) > 0),
fields AS (SELECT doc_id, 6.0 AS w, unnest(['conversation', CAST(conv_id AS VARCHAR)]) AS token FROM base UNION ALL SELECT doc_id, 3.0, unnest(['chat', 'turns', CAST(n AS VARCHAR)]) FROM base UNION ALL SELECT doc_id, 2.0, unnest({TOK.format('heading')}) FROM sections),
""" + RANKED


FINAL = "SELECT doc_id, round(score, 6) AS score, passage_no FROM top"
_ADDED = dict.fromkeys(S.expand_query(QUERY, CONCEPTS)[0], S.EXPANDED_WEIGHT)

SQL = {
    "tokenize_counts": f"SELECT lang AS type, count(*) AS distinct_tokens, CAST(sum(n) AS BIGINT) AS tokens, max(n) AS most FROM (SELECT lang, token, count(*) AS n FROM (SELECT lang, unnest({TOK.format('text')}) AS token FROM documents) GROUP BY ALL) GROUP BY lang",
    "search_index": f"""
WITH t AS (SELECT doc_id, i, unnest({TOK.format('l[i]')}) AS token FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))),
p AS (SELECT doc_id, i, token, count(*) AS tf FROM t GROUP BY ALL)
SELECT (SELECT count(*) FROM documents) AS notes, count(*) AS postings, count(DISTINCT token) AS tokens, CAST(sum(tf) AS BIGINT) AS occurrences FROM p""",
    "search_bm25_flat": _bm25_sql(names=False, sections=False) + FINAL,
    "search_bm25_sections": _bm25_sql() + FINAL,
    "notes_search": _chat_sql() + "SELECT doc_id AS path, round(score, 6) AS score, passage_no FROM top",
    "notes_filtered_search": _chat_sql("type = 'open' AND date >= DATE '2024-01-15' AND (n >= 0 OR n = 9)") + "SELECT doc_id AS path, round(score, 6) AS score, passage_no FROM top",
    "notes_snippet": _chat_sql() + f""",
ln AS (SELECT t.doc_id, s.heading, s.start, i - 1 AS i, trim(l[i]) AS line, {TOK.format('l[i]')} AS toks FROM top t JOIN sections s ON s.doc_id = t.doc_id AND s.no = t.passage_no, LATERAL (SELECT string_split(s.body, chr(10)) AS l), LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i)),
rated AS (SELECT *, list_sum([least(len(list_filter(toks, lambda x: x = t)), 3) FOR t IN [{', '.join(f"'{t}'" for t in S.query_tokens(CHAT_QUERY))}]]) AS hits FROM ln),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits > 0 DESC, hits DESC, i = 0, i) AS k FROM rated WHERE hits > 0 OR (i > 0 AND line <> ''))
SELECT b.doc_id AS path, CAST(6 + b.start + b.i AS BIGINT) AS line, b.heading, CAST(b.hits AS BIGINT) AS hits, CASE WHEN length(w.text) > 480 THEN rtrim(substr(w.text, 1, 479)) || '…' ELSE coalesce(w.text, '') END AS snippet
FROM best b LEFT JOIN (SELECT b.doc_id, trim(regexp_replace(string_agg(n.line, ' ' ORDER BY n.i), '\\s+', ' ', 'g')) AS text FROM best b JOIN ln n ON n.doc_id = b.doc_id AND abs(n.i - b.i) <= 1 AND n.i > 0 AND n.line <> '' WHERE b.k = 1 GROUP BY b.doc_id) w ON w.doc_id = b.doc_id
WHERE b.k = 1""",
    "view_search": _chat_sql("type = 'open' AND date BETWEEN DATE '2024-03-02' AND DATE '2024-04-30'") + f""",
few AS (SELECT * FROM top ORDER BY score DESC, lower(doc_id), doc_id LIMIT 5),
ln AS (SELECT t.doc_id, s.heading, s.start, i - 1 AS i, trim(l[i]) AS line, {TOK.format('l[i]')} AS toks FROM few t JOIN sections s ON s.doc_id = t.doc_id AND s.no = t.passage_no, LATERAL (SELECT string_split(s.body, chr(10)) AS l), LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i)),
rated AS (SELECT *, list_sum([least(len(list_filter(toks, lambda x: x = t)), 3) FOR t IN [{', '.join(f"'{t}'" for t in S.query_tokens(CHAT_QUERY))}]]) AS hits FROM ln),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits > 0 DESC, hits DESC, i = 0, i) AS k FROM rated WHERE hits > 0 OR (i > 0 AND line <> ''))
SELECT f.doc_id AS path, round(f.score, 6) AS score, b.heading, CAST(6 + b.start + b.i AS BIGINT) AS line FROM few f JOIN best b ON b.doc_id = f.doc_id AND b.k = 1""",
    "search_diagnosis": """
WITH c AS (SELECT conv_id, bool_or(role = 'system') AS guided FROM conversations GROUP BY conv_id), n AS (SELECT count(*) AS n, count(*) FILTER (NOT guided) AS plain FROM c)
SELECT 'filtered' AS "case", 'all-candidates-filtered' AS reason, n AS candidates, 0::BIGINT AS matched, true AS filters_active, 2::INT AS retries FROM n
UNION ALL SELECT 'no overlap', 'no-token-overlap', n, plain, true, 3 FROM n UNION ALL SELECT 'empty scope', 'no-searchable-documents', 0, 0, false, 2 FROM n UNION ALL SELECT 'broken filter', 'all-candidates-filtered', n, 0, true, 2 FROM n""",
    "note_heads": """
WITH turns AS (SELECT conv_id, count(*) AS n, bool_or(role = 'system') AS guided, sum(5 + octet_length(encode(coalesce(role, ''))) + length(CAST(turn AS VARCHAR)) + 1 + octet_length(encode(coalesce(text, '')))) AS said FROM conversations GROUP BY conv_id),
files AS (SELECT CASE WHEN guided THEN 'guided' ELSE 'open' END AS type, DATE '2024-01-01' + CAST(conv_id % 300 AS INT) AS date,
  length('---' || chr(10) || 'type: ' || CASE WHEN guided THEN 'guided' ELSE 'open' END || chr(10) || 'date: 2024-01-01' || chr(10) || 'tags: [chat, turns-' || n || ']' || chr(10) || '---' || chr(10) || '# Conversation ' || conv_id || chr(10)) + said AS size FROM turns)
SELECT type, count(*) AS notes, CAST(sum(size) AS BIGINT) AS bytes, CAST(sum(least(size, 512)) AS BIGINT) AS bytes_read, min(date) AS first_date, max(date) AS last_date FROM files GROUP BY type""",
    "search_filtered_tally": """
SELECT reason, count(*) AS excluded FROM (SELECT CASE WHEN lang NOT IN ('en', 'de') THEN 'type' WHEN source NOT IN ('src1', 'src2') AND lang NOT IN ('src1', 'src2') THEN 'tag' END AS reason FROM documents)
WHERE reason IS NOT NULL GROUP BY reason""",
    "search_after_filter_stats": _bm25_sql("lang = 'en' AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)") + FINAL,
    "search_expanded": _bm25_sql(weights=TYPED | _ADDED) + FINAL,
    "expansion_concepts": f"""
WITH added(concept, matched, token) AS (VALUES ('alpha', 'annt', 'heat'), ('alpha', 'annt', 'reor'), ('alpha', 'annt', 'anor'), ('beta', 'reed oure', 'innd')),
held AS (SELECT token, count(*) AS notes FROM (SELECT DISTINCT doc_id, unnest({TOK.format('text')}) AS token FROM documents) GROUP BY token)
SELECT concept, matched, a.token, coalesce(notes, 0) AS notes FROM added a LEFT JOIN held h ON h.token = a.token""",
    "search_matches": _bm25_sql(weights=TYPED | _ADDED) + f""",
w AS (SELECT t.doc_id, 1 AS o, 'title' AS kind, {TOK.format("split_part(text, chr(10), 1)")} AS toks FROM top t JOIN documents d USING (doc_id)
  UNION ALL SELECT t.doc_id, 2, 'tag', {TOK.format("lang || chr(10) || source")} FROM top t JOIN documents d USING (doc_id)
  UNION ALL SELECT t.doc_id, 3, 'body', p.toks FROM top t JOIN passages p ON p.doc_id = t.doc_id AND p.no = t.passage_no)
SELECT doc_id, kind, left(array_to_string(m, ', '), 160) AS detail FROM (SELECT doc_id, kind, list_sort(list_filter([{', '.join(f"'{t}'" for t in TYPED)}], lambda x: list_contains(toks, x))) AS m FROM w) WHERE len(m) > 0""",
    "search_signals": _bm25_sql(weights=TYPED | _ADDED) + f""",
w AS (SELECT t.doc_id, list_concat({TOK.format("split_part(text, chr(10), 1) || chr(10) || lang || chr(10) || source")}, coalesce(p.toks, [])) AS toks
  FROM top t JOIN documents d USING (doc_id) LEFT JOIN passages p ON p.doc_id = t.doc_id AND p.no = t.passage_no),
c(matched, added) AS (VALUES ('annt', ['heat', 'reor', 'anor']), ('reed oure', ['innd']))
SELECT doc_id, 'expansion' AS kind, left(matched || ' → ' || array_to_string(list_filter(added, lambda x: list_contains(toks, x)), ', '), 160) AS detail
FROM w CROSS JOIN c WHERE len(list_filter(added, lambda x: list_contains(toks, x))) > 0""",
    "search_confidence": _bm25_sql(weights={"annt": 1.0, "reed": 1.0, "zebra": 1.0}) + """,
best AS (SELECT * FROM top ORDER BY score DESC, lower(CAST(doc_id AS VARCHAR)), doc_id LIMIT 1),
cover AS (SELECT sum(d.idf) AS total, sum(CASE WHEN EXISTS (SELECT 1 FROM hits h, best b WHERE h.doc_id = b.doc_id AND h.no = b.passage_no AND h.token = d.token AND h.f > 0) THEN d.idf ELSE 0 END) AS held,
  coalesce(string_agg(CASE WHEN d.df = 0 THEN d.token END, ',' ORDER BY d.token), '') AS unseen FROM df d)
SELECT b.doc_id, round(held / total, 3) AS coverage, unseen, CASE WHEN held / total >= 0.30 AND unseen = '' THEN 'evidence' ELSE 'none' END AS level FROM best b CROSS JOIN cover""",
    "search_zero_reason": """
WITH d AS (SELECT d.doc_id, lang, quality FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT 'filtered' AS "case", count(*) AS candidates, count(*) FILTER (quality = 2) AS matched, 'all-candidates-filtered' AS reason FROM d
UNION ALL SELECT 'no-overlap', count(*), count(*), 'no-token-overlap' FROM d
UNION ALL SELECT 'empty-scope', count(*) FILTER (lang = 'xx'), count(*) FILTER (lang = 'xx'), 'no-searchable-documents' FROM d""",
    "search_snippet": _bm25_sql() + f""",
lines AS (SELECT t.doc_id, passage_no, string_split(text, chr(10))[passage_no + 1] AS line FROM top t JOIN documents d USING (doc_id)),
texts AS (SELECT *, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS s, {TOK.format('line')} AS toks FROM lines)
SELECT doc_id, passage_no + 1 AS line, CAST(hits AS BIGINT) AS hits, CASE WHEN hits = 0 THEN '' WHEN length(s) > 480 THEN rtrim(substr(s, 1, 479)) || '…' ELSE s END AS snippet
FROM (SELECT *, list_sum([least(len(list_filter(toks, lambda x: x = t)), 3) FOR t IN [{', '.join(f"'{t}'" for t in TYPED)}]]) AS hits FROM texts)""",
}


def queries() -> dict:
    found = (tokenize_counts, search_index, search_bm25_flat, search_bm25_sections, search_filtered_tally, search_after_filter_stats, search_expanded, expansion_concepts, search_confidence, search_zero_reason, search_snippet, search_matches, search_signals, notes_search, notes_filtered_search, notes_snippet, note_heads, view_search, search_diagnosis)
    return {f.__name__: f for f in found}

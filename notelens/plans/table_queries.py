"""Link, tag, review, workflow and evaluation queries over the tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notelens.functions.markdown import notes_of
from notelens.functions.text import content_chars, normal_name, note_date, tag_key
from notelens.operators import audit, boards, corpus, folders, links, receipt_rules, receipts, resume, reviews, search, workflow
from notelens.plans import adapters
from notelens.sources.config import load_views
from notelens.sources.tables import shared_dir, staged, table
from notelens.streaming import board, staging

AS_OF = adapters.AS_OF


# --- pages as a link graph -------------------------------------------------------------------------

def _page_title(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "html", F.regexp_extract_all(F.lower(F.regexp_extract("html", "<title>([^<]*)</title>", 1)), F.lit("[a-z0-9]+"), F.lit(0)).alias("t"))


def _page_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links of pages by href, and keys of pages: the first title token names a page, the others are aliases."""
    pages = _page_title(table(spark, sf_dir, "pages"))
    keys = pages.select(F.col("page_id").alias("path"), F.posexplode(F.array_distinct("t")).alias("i", "key")).select("key", F.when(F.col("i") == 0, 1).otherwise(3).alias("priority"), "path")
    found = pages.select(F.col("page_id").alias("source"), F.posexplode(F.regexp_extract_all("html", F.lit('<a href="/([^"]*)"'), F.lit(1))).alias("line", "href"))
    edges = found.select("source", "line", F.lower("href").alias("name"), F.lit("body").alias("origin"))
    return pages.select(F.col("page_id").alias("path")), edges, keys


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, edges, keys = _page_graph(spark, sf_dir)
    return links.resolve_names(edges, keys).groupBy("state").agg(F.count(F.lit(1)).alias("links"), F.count_distinct("source").alias("sources"), F.sum("n_targets").alias("targets"))


def page_backlinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct neighbours of each page in either direction."""
    _, edges, keys = _page_graph(spark, sf_dir)
    return links.degrees(links.resolve_names(edges, keys)).withColumnRenamed("path", "page_id")


def page_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of the page with most backlinks (the smallest such)."""
    _, edges, keys = _page_graph(spark, sf_dir)
    resolved = links.resolve_names(edges, keys)
    known = resolved.filter("state = 'resolved' and source <> target")
    ranked = known.groupBy("target").agg(F.count_distinct("source").alias("n"))
    seed = ranked.orderBy(F.col("n").desc(), "target").limit(1).collect()
    found = links.neighbourhood(resolved, seed[0]["target"] if seed else None)
    return found.select(F.col("neighbour").alias("page_id"), F.array_join("directions", "+").alias("directions"), "edges")


def page_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QRY-8: the edges of that page, with the names that resolve to no page or to several."""
    _, edges, keys = _page_graph(spark, sf_dir)
    resolved = links.resolve_names(edges, keys)
    ranked = resolved.filter("state = 'resolved' and source <> target").groupBy("target").agg(F.count_distinct("source").alias("n"))
    seed = ranked.orderBy(F.col("n").desc(), "target").limit(1).collect()
    found = links.neighbourhood_edges(resolved, seed[0]["target"] if seed else None)
    return found.select(F.col("neighbour").alias("page_id"), "name", "direction", "line", "state")


def project_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects that the queue of an early day passes over, as they are dated after it."""
    return reviews.project_issues(adapters.projects(spark, sf_dir), "1998-06-01").withColumnRenamed("path", "o_orderkey")


def project_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    projects = adapters.projects(spark, sf_dir)
    return reviews.queue_summary(projects, reviews.project_queue(projects, adapters.tasks(spark, sf_dir), AS_OF, stale_days=60), AS_OF)


def page_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that nothing refers to; every third page is indexed."""
    nodes, edges, keys = _page_graph(spark, sf_dir)
    resolved = links.resolve_names(edges, keys)
    indexed = nodes.filter("path % 3 = 0")
    lone = links.orphans(nodes, resolved, indexed).select("path", F.lit("orphan-note").alias("code"))
    return lone.unionByName(links.disconnected(nodes, resolved, indexed).select("path", F.lit("disconnected-note").alias("code"))).withColumnRenamed("path", "page_id")


def page_visible_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-3 and TXT-24: characters of pages outside comments and outside lines that begin with #, without white space."""
    from notelens.functions.markdown import without_comments
    from notelens.functions.text import content_chars

    return table(spark, sf_dir, "pages").select("page_id", content_chars(without_comments(F.col("html"))).cast("long").alias("chars"))


_GRAPH = """
WITH p AS (SELECT page_id, html, regexp_extract_all(lower(regexp_extract(html, '<title>([^<]*)</title>', 1)), '[a-z0-9]+') AS t FROM pages),
k0 AS (SELECT page_id AS path, i, t[i] AS key FROM (SELECT page_id, t, unnest(range(1, len(t) + 1)) AS i FROM p)),
k1 AS (SELECT path, key, min(i) AS i FROM k0 GROUP BY ALL),
keys AS (SELECT key, CASE WHEN i = 1 THEN 1 ELSE 3 END AS priority, path FROM k1),
ranked AS (SELECT key, priority, count(*) AS n, min(path) AS only_path FROM keys GROUP BY ALL),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY priority) AS r FROM ranked) WHERE r = 1),
l AS (SELECT page_id AS source, lower(unnest(regexp_extract_all(html, '<a href="/([^"]*)"', 1))) AS name FROM pages),
resolved AS (SELECT source, name, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'unresolved' WHEN n > 1 THEN 'ambiguous' ELSE 'resolved' END AS state, CASE WHEN n = 1 THEN only_path END AS target FROM l LEFT JOIN best ON best.key = l.name),
known AS (SELECT source, target FROM resolved WHERE state = 'resolved' AND source <> target)
"""


# --- part names, tags and folders -------------------------------------------------------------------

def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("path"), F.col("p_name").alias("title"), F.col("p_brand").alias("type"), F.array(F.col("p_type"), F.col("p_brand")).alias("tags"), F.col("p_type").alias("folder"))


def name_exact_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    boosted = _parts(spark, sf_dir).select("path", search.name_boost("Small  RING", F.col("title")).alias("boost")).filter("boost > 0")
    return boosted.select(F.col("path").alias("p_partkey"), "boost")


def name_fuzzy_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles near to a query by the matcher's ratio: four times the ratio from 0.72 on."""
    names = _parts(spark, sf_dir).select("title", normal_name(F.col("title")).alias("name"), F.lit(" ".join(search.query_tokens("smal rings"))).alias("query")).distinct()
    return names.withColumn("ratio", corpus.sequence_ratio("query", "name")).filter(F.col("ratio") >= search.FUZZY_FLOOR).select("title", F.round(search.FUZZY_BOOST * F.col("ratio"), 6).alias("boost"))


def tag_normalise_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = table(spark, sf_dir, "part").select(F.explode(F.array("p_brand", F.lower("p_brand"), F.concat(F.lower("p_type"), F.lit("s")), "p_type", F.replace(F.col("p_name"), F.lit(" "), F.lit("-")), "p_name")).alias("tag"))
    return corpus.near_duplicate_tags(tags).select("tag_key", F.array_join("spellings", ",").alias("spellings"))


def duplicate_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.duplicate_titles(adapters.notes(spark, sf_dir))


def similar_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.similar_titles(_parts(spark, sf_dir)).select("a", "b", F.round("ratio", 6).alias("ratio"))


def suggest_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _parts(spark, sf_dir)
    related = parts.filter("path % 10 = 3").select("path")
    return corpus.suggest_links(parts.filter("path = 1"), parts, related).withColumnRenamed("path", "p_partkey")


def tag_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.tag_vocabulary(adapters.notes(spark, sf_dir), generic=("en",))


def crowded_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.expr("n_regionkey = r_regionkey"))
    placed = table(spark, sf_dir, "customer").join(nations, F.expr("c_nationkey = n_nationkey")).select(F.concat("r_name", F.lit("/"), "n_name").alias("folder"))
    return corpus.crowded_folders(placed)


def subject_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.subject_clusters(_parts(spark, sf_dir)).withColumn("place", F.col("place").cast("long"))


# --- reviews ----------------------------------------------------------------------------------------

def project_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = reviews.project_queue(adapters.projects(spark, sf_dir), adapters.tasks(spark, sf_dir), AS_OF, stale_days=60)
    return reviews.queue_order(queue, 20).withColumnRenamed("path", "o_orderkey")


def project_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole queue by priority and status."""
    queue = reviews.project_queue(adapters.projects(spark, sf_dir), adapters.tasks(spark, sf_dir), AS_OF, stale_days=60)
    return queue.groupBy("priority", "status").agg(F.count(F.lit(1)).alias("projects"), F.sum("ranking_tasks").alias("tasks"), F.max("age_days").alias("oldest"))


def _loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    dated = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_orderpriority").alias("type"), F.to_date("o_orderdate").alias("date"))
    return reviews.open_loops(adapters.tasks(spark, sf_dir), dated)


def open_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = _loops(spark, sf_dir).orderBy(F.col("date").asc_nulls_last(), "path", "line").limit(50)
    return first.select(F.col("path").alias("o_orderkey"), F.col("line").cast("long").alias("line"), "text", "type", F.col("date").cast("string").alias("date"))


def open_loop_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews.loop_summary(_loops(spark, sf_dir))


def _captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    shipped = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max(F.to_date("l_shipdate")).alias("shipped"))
    made = table(spark, sf_dir, "orders").join(shipped, F.expr("o_orderkey = l_orderkey"))
    return reviews.cold_captures(made.select(F.col("o_orderkey").alias("path"), F.col("o_orderpriority").alias("type"), F.to_date("o_orderdate").alias("created"), F.when(F.col("o_orderkey") % 5 != 0, F.col("shipped")).alias("revised"), F.col("shipped").alias("modified")))


def cold_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    cold = _captures(spark, sf_dir).filter("cold").withColumn("cold_days", F.datediff(F.lit(AS_OF).cast("date"), "touched"))
    return cold.orderBy(F.col("cold_days").desc(), "path").limit(50).select(F.col("path").alias("o_orderkey"), "type", F.col("cold_days").cast("long").alias("cold_days"), "evidence")


def capture_revisit_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews.revisit_rates(_captures(spark, sf_dir))


def view_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RNK-26 and RNK-27: a saved view over the 90 days that end on the day, both ends included."""
    view = load_views('{"schema_version": 1, "views": [{"id": "recent", "query": "orders", "date_field": "date", "window_days": 90}]}')["recent"]
    dated = view.filters(AS_OF).select(table(spark, sf_dir, "orders").select("o_orderstatus", "o_totalprice", F.to_date("o_orderdate").alias("date")))
    return dated.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.min("date").cast("string").alias("first_day"), F.max("date").cast("string").alias("last_day"))


def resume_sources_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources by location, project field and related link, each path once."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"), F.to_date("o_orderdate").alias("date"), "o_custkey", "o_orderpriority")
    near = orders.filter("o_orderpriority like '5%'")
    field = orders.filter("o_orderpriority like '1%' or o_orderpriority like '5%'")
    shipped = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("path"), F.to_date("l_shipdate").alias("date"))
    merged = workflow.sources_union([("location", 0, near), ("project-field", 1, field), ("related-link", 2, shipped)])
    return merged.select(F.col("path").alias("o_orderkey"), "trust", F.col("date").cast("string").alias("date"), "origins")


def _customer_members(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers as projects and their sources: own orders lie in the folder of a customer, those of priority 1 name it, and
    items shipped by the supplier of its number are links that do."""
    customers = table(spark, sf_dir, "customer")
    orders = table(spark, sf_dir, "orders").join(customers.select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey", "left")
    notes = orders.select(F.col("o_orderkey").cast("string").alias("path"), F.col("o_custkey").alias("folder"), F.when(F.col("o_orderpriority").startswith("1"), F.col("c_name")).alias("project"), F.to_date("o_orderdate").alias("date"))
    projects = customers.select(F.concat(F.lit("customer "), F.col("c_custkey").cast("string")).alias("project"), F.col("c_name").alias("name"), F.col("c_custkey").alias("folder"))
    shipped = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("path"), F.col("l_suppkey").alias("folder")).distinct()
    return projects, resume.project_members(notes, projects, shipped.join(projects.select("folder", "name"), "folder").select("path", "name"))


def resume_project_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-12, SET-1 and SRT-8 over the whole tables: the sources of every customer as a project."""
    _, members = _customer_members(spark, sf_dir)
    return members.select("project", F.col("path").cast("long").alias("o_orderkey"), "trust", F.col("date").cast("string").alias("date"), F.array_join("origins", "+").alias("origins"))


def resume_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QRY-9 for every customer: what its own note and its first sources say of six questions."""
    projects, members = _customer_members(spark, sf_dir)
    answers = lambda df, path, rules: df.select(path.alias("path"), F.explode(F.array_compact(F.array(*[F.when(rule, F.struct(F.lit(name).alias("field"), F.concat(F.lit(f"{name} of "), path).alias("text"))) for name, rule in rules.items()]))).alias("f")).select("path", "f.*")
    key = F.col("o_orderkey")
    said = answers(table(spark, sf_dir, "orders"), key.cast("string"), {"goal": key % 2 == 0, "constraints": key % 7 == 0, "decisions": key % 3 == 0, "evidence": F.col("o_orderstatus") == "F", "next_actions": F.col("o_orderstatus") == "O"})
    number = F.col("c_custkey")
    own = answers(table(spark, sf_dir, "customer"), F.concat(F.lit("customer "), number.cast("string")), {"goal": number % 2 == 0, "decisions": number % 3 == 0, "blockers": F.col("c_mktsegment") == "BUILDING", "next_actions": number % 5 != 0})
    packs = resume.resume_pack(projects, own.unionByName(said), members, ("goal", "decisions", "blockers", "next_actions"))
    each = lambda entries, text: F.array_join(F.transform(entries, text), "; ")
    return packs.select(
        "project", each(F.map_entries("resume"), lambda e: F.concat(e["key"], F.lit("="), e["value"])).alias("resume"),
        each(F.map_entries("from_sources"), lambda e: F.concat(e["key"], F.lit("="), F.array_join(F.transform(e["value"], lambda x: x["path"]), ","))).alias("from_sources"),
        F.array_join("contested", ",").alias("contested"), F.array_join("missing", ",").alias("missing"), each("sources", lambda x: F.concat(x["path"], F.lit(":"), F.array_join(x["origins"], "+"))).alias("sources"), "sources_available", "truncated",
    )


# --- events -------------------------------------------------------------------------------------------

def _seconds(column: str):
    return F.unix_micros(F.col(column).cast("timestamp"))


def retention_keep_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    backups = events.select(F.col("event_id").alias("path"), F.col("user_id").alias("relative_note"), F.to_date("ts").alias("stamp"), _seconds("ts").alias("mtime"), (F.col("event_type") == "purchase").alias("protected"))
    kept = workflow.retention(backups, 5, F.col("protected"))
    return kept.groupBy(F.col("relative_note").alias("user_id")).agg(F.count(F.lit(1)).alias("backups"), F.count_if("deleted").alias("deleted"), F.sum(F.when(~F.col("deleted"), F.col("path"))).alias("kept_ids"))


def cache_prune_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    entries = events.select(F.col("event_type").alias("cache"), F.col("event_id").alias("key"), F.col("ts").alias("staged"), (F.col("user_id") * 100).alias("bytes"))
    pruned = workflow.cache_prune(entries, 64, 400_000, F.lit("2024-01-20 00:00:00").cast("timestamp"))
    return pruned.groupBy("cache").agg(F.count(F.lit(1)).alias("live"), F.count_if("kept").alias("kept"), F.sum(F.when(F.col("kept"), F.col("bytes"))).alias("bytes"), F.min(F.when(F.col("kept"), F.col("key"))).alias("oldest_kept"))


ACTIONS = {"signup": "capture", "click": "capture", "purchase": "tick", "error": "cancel"}


def board_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as board actions: user 10 x board + item; views reschedule."""
    action = F.lit("reschedule")
    for kind, name in ACTIONS.items():
        action = F.when(F.col("event_type") == kind, name).otherwise(action)
    events = table(spark, sf_dir, "events").select(F.floor(F.col("user_id") / 10).alias("board"), F.col("user_id").alias("item"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), action.alias("action"))
    return workflow.board_fold(events)


def board_spoken_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-16: orders as dated items; where they stand and where they belong."""
    items = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderpriority").startswith("1"), boards.OPEN[0]).when(F.col("o_orderpriority").startswith("2"), boards.OPEN[1]).otherwise(boards.OPEN[2]).alias("section"), F.when(F.col("o_orderkey") % 11 != 0, F.to_date("o_orderdate")).alias("due"), (F.col("o_orderstatus") == "F").alias("done"))
    return workflow.board_view(items, "1998-06-01").groupBy("spoken").agg(F.count(F.lit(1)).alias("items"), F.count_if("misplaced").alias("misplaced"))


def _board_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as actions on rows of boards: user 10 x board + row, due some days on."""
    action = F.lit("reschedule")
    for kind, name in ACTIONS.items():
        action = F.when(F.col("event_type") == kind, name).otherwise(action)
    k = F.get_json_object("props", "$.k").cast("int")
    at = F.timestamp_millis(F.floor(F.expr("unix_micros(CAST(CAST(ts AS STRING) || 'Z' AS TIMESTAMP))") / 1000))
    due = F.when(k % 7 != 0, F.date_add(F.to_date("ts"), k % 5))
    return table(spark, sf_dir, "events").select(F.floor(F.col("user_id") / 10).alias("board"), F.concat(F.lit("row "), F.col("user_id").cast("string")).alias("item"), at.alias("at"), F.col("event_id").alias("seq"), action.alias("action"), due.alias("due"))


BOARD_LOG = ("board", "item", "at_ms", "seq", "action", "code", "section", "mark")


def board_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QRY-16 over the whole table: what becomes of every action, and every move to today's section."""
    return workflow.board_log(_board_actions(spark, sf_dir)).withColumn("at_ms", F.unix_millis("at")).select(*BOARD_LOG)


def board_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream: actions in two parts, with a new start from the checkpoint between them."""
    actions = _board_actions(spark, sf_dir)
    folder, out, state = (shared_dir(spark, f"board-{n}") for n in ("in", "out", "state"))
    middle = actions.agg(F.percentile_approx(F.unix_millis("at"), 0.5).alias("m")).first().m or 0
    for part in (F.unix_millis("at") <= middle, F.unix_millis("at") > middle):
        actions.filter(part).write.mode("append").parquet(folder)
        board.follow_boards(spark, spark.readStream.schema(actions.schema).parquet(folder), out, state)
    return spark.read.parquet(out).select(*BOARD_LOG)


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests to stores of fifty users: signups and clicks stage a content of the user, the rest loads one; some
    ask for another type, title or vault, some by no hash."""
    k, user = F.get_json_object("props", "$.k").cast("int"), F.col("user_id")
    staging_now = F.col("event_type").isin("signup", "click")
    at = F.timestamp_millis(F.floor(F.expr("unix_micros(CAST(CAST(ts AS STRING) || 'Z' AS TIMESTAMP))") / 1000))
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return table(spark, sf_dir, "events").select(
        F.floor(user / 50).alias("store"), at.alias("at"), F.col("event_id").alias("seq"), F.when(staging_now, "stage").otherwise("load").alias("kind"),
        F.when(k % 17 == 0, "no hash").otherwise(F.sha2(text(user.cast("string"), "-", (k % 2).cast("string")), 256)).alias("sha256"),
        F.when(~staging_now & (k % 13 == 0), "elsewhere").otherwise("vault").alias("vault"), text("type ", (F.col("event_id") % 2).cast("string")).alias("type"),
        F.when(~staging_now & (k % 11 == 0), "other").otherwise(text("user ", user.cast("string"))).alias("title"), (400_000 + 100_000 * (user % 5)).alias("bytes"),
    )


def staged_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-5 and MSC-11: the answer to every request, with a new start from the checkpoint in between."""
    asked = _requests(spark, sf_dir)
    folder, out, state = (shared_dir(spark, f"staged-{n}") for n in ("in", "out", "state"))
    middle = asked.agg(F.percentile_approx(F.unix_millis("at"), 0.5).alias("m")).first().m or 0
    for part in (F.unix_millis("at") <= middle, F.unix_millis("at") > middle):
        asked.filter(part).write.mode("append").parquet(folder)
        staging.follow_requests(spark, spark.readStream.schema(asked.schema).parquet(folder), out, state)
    return spark.read.parquet(out)


INDEX_CONFIGS = {
    "own names": folders.IndexConfig(enabled=True, graph_overwrite=True, exclude_folders=("Brand#3",), exclude_patterns=("*/blue",)),
    "one name": folders.IndexConfig(enabled=True, graph_overwrite=True, user_specified=True, index_filename="INDEX"),
}


def _part_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as notes in folders of brand, type and the first word of the name; of three in four folders an index note is
    there, under the folder's name, as INDEX.md, or both, by a digest of the folder."""
    parts = table(spark, sf_dir, "part")
    folder = F.concat_ws("/", "p_brand", "p_type", F.split_part("p_name", F.lit(" "), F.lit(1)))
    notes = parts.select(F.concat(folder, F.lit("/part-"), F.col("p_partkey").cast("string"), F.lit(".md")).alias("path"), F.lit(False).alias("declares"))
    each = parts.select(F.explode(F.array(F.col("p_brand"), F.concat_ws("/", "p_brand", "p_type"), folder)).alias("f")).distinct()
    digit = F.conv(F.substring(F.md5("f"), 1, 1), 16, 10).cast("int")
    own = F.when(digit.between(4, 12) | (digit == 15), F.concat("f", F.lit("/"), F.element_at(F.split("f", "/"), -1), F.lit(".md")))
    plain = F.when(digit >= 13, F.concat("f", F.lit("/INDEX.md")))
    return notes.unionByName(each.select(F.explode(F.array_compact(F.array(own, plain))).alias("path"), F.lit(True).alias("declares")))


def folder_graph_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folder-index codes of parts as a vault, under two configurations of the plugin."""
    files = _part_files(spark, sf_dir)
    found = [folders.index_findings(files, config).withColumn("config", F.lit(name)) for name, config in INDEX_CONFIGS.items()]
    return found[0].unionByName(found[1])


def folder_graph_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each folder, whether the graph leads to it from the root, and where it breaks."""
    return folders.graph_reach(_part_files(spark, sf_dir), INDEX_CONFIGS["own names"])


def character_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-9: pairs of adjacent letters in the words of documents, by language and by how many documents have them; pairs of
    one count that overlap are joined."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{2,}"), F.lit(0)))
    pairs = F.array_distinct(F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: F.substr(w, i, F.lit(2))))))
    held = table(spark, sf_dir, "documents").filter("lang IS NOT NULL").select(F.col("lang").alias("folder"), F.explode(pairs).alias("term"))
    return corpus.merge_pairs(held.groupBy("folder", "term").agg(F.count("*").alias("notes")))


def _receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as captured notes, each with a receipt; eleven in twelve receipts have a fault, by number."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))).alias("t"))
    fault = F.col("conv_id") % 12
    unless = lambda n, good, bad: F.when(fault == n, F.lit(bad)).otherwise(F.lit(good))
    said = F.concat(F.lit("It took "), F.col("n").cast("string"), F.lit(" minutes, I infer."))
    text = F.concat(F.lit("---\ntype: web-clip\n---\n# Conversation\n"), said, F.lit("\n"), F.array_join(F.transform("t", lambda t: t["text"]), "\n"))
    source = F.concat(F.lit("https://example.org/"), F.col("conv_id").cast("string"))
    item = lambda k, kind: F.struct(F.lit(f"m{k}").alias("id"), kind.alias("kind"), unless(11, "resolved", "open").alias("status"), source.alias("source"), unless(9, "It took", "It never took").alias("note_anchor"))
    kinds = [F.lit("prerequisite"), F.lit("procedure"), F.lit("verification"), unless(4, "failure-mode", "risk")]
    claim = F.struct(said.alias("note_excerpt"), unless(6, "primary-source", "hearsay").alias("provenance"), source.alias("source"), F.lit("one run").alias("measurement_context"))
    receipt = F.to_json(F.struct(
        F.lit(1).alias("schema_version"), F.when(fault == 1, F.sha2("rendered", 512)).otherwise(F.sha2("rendered", 256)).alias("content_sha256"), F.array(F.lit("tutorial-procedure")).alias("profiles"), unless(2, "complete", "partial").alias("source_access"),
        F.array(F.when(fault == 10, F.lit("https://example.com/other")).otherwise(source)).alias("primary_sources"), F.array().cast("array<string>").alias("supplemental_sources"), F.when(fault == 3, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("unresolved_items"),
        F.array(*[item(k, kind) for k, kind in enumerate(kinds)]).alias("material_items"), F.when(fault == 5, F.array().cast("array<struct<note_excerpt:string,provenance:string,source:string,measurement_context:string>>")).otherwise(F.array(claim)).alias("numeric_claims"),
        F.array(F.struct(said.alias("note_excerpt"), F.lit("the text").alias("basis"), unless(7, "I infer", "a guess").alias("label"))).alias("inferences"), F.struct(unless(8, "reproducible-procedure", "poem").alias("kind"), F.lit("Conversation").alias("note_anchor")).alias("practical_artifact"),
    ))
    return turns.withColumn("rendered", text).select(F.col("conv_id").alias("path"), receipt.alias("receipt"), "rendered", F.lit("verified").alias("depth"), source.alias("source"))


def receipt_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QRY-26: the first refusal of every receipt."""
    return receipt_rules.refuse(_receipts(spark, sf_dir)).select(F.col("path").alias("conv_id"), "code", "step", "entry")


def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dynamic metadata: one field of the JSON of each event."""
    meta = F.try_parse_json("props")
    return table(spark, sf_dir, "events").select("event_type", F.variant_get(meta, "$.k", "long").alias("k")).groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total"), F.count_distinct("k").alias("distinct_k"))


# --- conversations and texts ----------------------------------------------------------------------------

ROUTES = ((("meeting", "und "), "10-Work"), (("article", " la "), "20-Learning"), (("idea", " the "), "30-Insights"))


def inbox_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = table(spark, sf_dir, "conversations")
    items = chats.select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("path"), F.col("role").alias("type"), "text", (F.length("text") < 1200).alias("readable"), F.when(F.col("conv_id") % 9 == 0, F.array(F.lit("Incomplete"))).otherwise(F.array().cast("array<string>")).alias("tags"))
    return workflow.inbox_plan(items, {"system": "90-Meta"}, ROUTES).groupBy("target", "skip_code").agg(F.count(F.lit(1)).alias("items"))


def required_kinds_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("path"), F.col("role").alias("kind"))
    lacking = workflow.missing_kinds(chats, ("assistant", "system", "user")).filter(F.size("missing") > 0)
    return lacking.select(F.col("path").alias("conv_id"), F.array_join("missing", ",").alias("missing"))


def declared_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MSC-18 and FLT-14: the last outcome word of each message wins, unless the clause denies it."""
    said = receipts.last_claim(F.col("text"), ("die", "the", "que"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", said.alias("outcome")).filter("outcome is not null").groupBy("outcome").agg(F.count(F.lit(1)).alias("messages"), F.count_distinct("conv_id").alias("conversations"))


#: Characters at the start of a short excerpt that key it.
START = 8


def _held_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, excerpt, text of every body that holds an excerpt. Excerpts of six words or more are keyed by
    their second to fifth word, which stand whole in a body, so bodies are searched by equality on word runs. The ends of
    shorter ones may be parts of words: these are keyed by their first characters, and bodies by all runs of so many."""
    words = lambda c: F.filter(F.split(c, r"[ \n]+", -1), lambda w: w != "")
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("excerpt")).withColumn("w", words(F.col("excerpt")))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    keyed = items.filter(F.size("w") >= 6).select("item_id", "excerpt", F.xxhash64(*[F.get("w", F.lit(i)) for i in range(1, 5)]).alias("key"))
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - 4, F.lit(0))), lambda i: F.xxhash64(*[F.get("w", i + j) for j in range(4)]))
    found = docs.withColumn("w", words(F.col("text"))).select("doc_id", F.explode(F.array_distinct(runs)).alias("key")).join(keyed, "key").select("doc_id", "item_id", "excerpt")
    short = items.filter((F.size("w") < 6) & (F.length("excerpt") > 0)).withColumn("size", F.least(F.length("excerpt"), F.lit(START)))
    for size in sorted(r["size"] for r in short.select("size").distinct().collect()):  # START values at most
        starts = short.filter(F.col("size") == size).select("item_id", "excerpt", F.xxhash64(F.substring("excerpt", 1, size)).alias("key"))
        pieces = F.transform(F.array_distinct(F.regexp_extract_all("text", F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1))), lambda x: F.xxhash64(x))
        found = found.unionByName(docs.select("doc_id", F.explode(pieces).alias("key")).join(starts, "key").select("doc_id", "item_id", "excerpt"))
    return found.distinct().join(docs, "doc_id").filter(F.contains("text", "excerpt")).select("doc_id", "item_id", "excerpt", "text")


def evidence_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-4: whole excerpts found in bodies, with the first place and the excerpt's digest."""
    return _held_excerpts(spark, sf_dir).select("doc_id", "item_id", F.instr("text", F.col("excerpt")).cast("long").alias("position"), F.sha2("excerpt", 256).alias("sha256"))


def evidence_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-14: a row for each occurrence of an excerpt in a body, overlapping ones too."""
    held = _held_excerpts(spark, sf_dir)
    return held.select("doc_id", "item_id", F.explode(receipts.occurrences("text", "excerpt")).alias("position"), F.sha2("excerpt", 256).alias("sha256"))


def metric_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-30: number-shaped spans that need a source."""
    return table(spark, sf_dir, "documents").select("lang", F.explode(receipts.metric_spans(F.col("text"))).alias("span")).groupBy("lang").agg(F.count(F.lit(1)).alias("spans"), F.count_distinct("span").alias("distinct_spans"))


def metric_span_uncovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-13 on time spans: purchases outside the sessions that signups open for a day."""
    events = table(spark, sf_dir, "events").withColumn("s", F.unix_seconds(F.col("ts").cast("timestamp")))
    spans = events.filter("event_type = 'purchase'").select(F.col("user_id").alias("doc"), F.col("s").alias("start"), (F.col("s") + 60).alias("end"), "event_id")
    excerpts = events.filter("event_type = 'signup'").select(F.col("user_id").alias("doc"), F.col("s").alias("start"), (F.col("s") + 86400).alias("end"))
    return workflow.uncovered_spans(spans, excerpts).select("event_id", F.col("doc").alias("user_id"))


def eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as cases by priority: expected is the order's first part; results are its parts by price."""
    items = table(spark, sf_dir, "lineitem")
    ranked = items.groupBy("l_orderkey", "l_partkey").agg(F.max("l_extendedprice").alias("price"))
    from pyspark.sql import Window

    results = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.col("price").desc(), "l_partkey"))).select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("path"), "rank")
    first = items.groupBy("l_orderkey").agg(F.min(F.struct("l_linenumber", "l_partkey"))["l_partkey"].alias("part"))
    cases = table(spark, sf_dir, "orders").join(first, F.expr("o_orderkey = l_orderkey")).select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("group"), F.when(F.col("o_orderkey") % 7 == 0, F.array().cast("array<bigint>")).otherwise(F.array("part")).alias("expected"))
    return workflow.evaluate(results, cases, at=2).withColumnRenamed("group", "priority")


def _ranked_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as cases: their parts as results, by price."""
    parts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("path")).agg(F.max("l_extendedprice").alias("price"))
    order = Window.partitionBy("id").orderBy(F.col("price").desc(), "path")
    return parts.withColumn("rank", F.row_number().over(order)).select("id", "path", "rank")


def case_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-19: orders as cases by priority, of which the last has no answer; the first line's part is expected, returned
    ones must be seen, and those of large quantity are hard negatives."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").withColumnsRenamed({"l_orderkey": "id", "l_partkey": "path"})
    group = F.when(F.col("o_orderpriority").startswith("5"), "no-answer").otherwise(F.col("o_orderpriority"))
    cases = orders.select(F.col("o_orderkey").alias("id"), group.alias("group"))
    seen, hard = lines.filter("l_returnflag = 'R'").select("id", "path"), lines.filter("l_quantity > 45").select("id", "path")
    report = workflow.case_report(cases, _ranked_parts(spark, sf_dir), seen, hard, lines.filter("l_linenumber = 1").select("id", "path").distinct(), at=3)
    return workflow.case_groups(report)


def family_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-20: brands as families of the three dearest parts of an order."""
    results = _ranked_parts(spark, sf_dir).filter("rank <= 3").select("id", "path")
    families = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("path"), F.col("p_brand").alias("family"))
    return workflow.family_occupancy(results, families).withColumnRenamed("id", "o_orderkey")


def duplicate_project_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-12: urgent orders as project notes, in a directory for each customer."""
    from notelens.operators import audit

    orders = table(spark, sf_dir, "orders").filter("o_orderpriority like '1%'")
    return audit.duplicate_project_notes(orders.select(F.col("o_orderkey").alias("path"), F.col("o_orderstatus").alias("entity_folder"), F.col("o_custkey").cast("string").alias("instance")))


def vault_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QRY-12 over the documents: languages as types, sources as folders."""
    return corpus.vault_summary(adapters.notes(spark, sf_dir).withColumn("folder", F.col("tags")[1]))


def candidate_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RNK-24: parts as notes in a folder for each type, types as folders named by their part names."""
    parts = table(spark, sf_dir, "part")
    notes = parts.select(F.concat(F.lit("p/"), F.col("p_type"), F.lit("/"), F.col("p_partkey").cast("string")).alias("path"), F.col("p_name").alias("title"), F.array("p_brand").alias("tags"))
    folders = parts.select(F.concat(F.lit("p/"), F.col("p_name")).alias("folder")).unionByName(parts.select(F.concat(F.lit("p/"), F.col("p_type")).alias("folder"))).distinct()
    return corpus.candidate_folders(notes, folders)


def nearest_rank_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("lang", "n_chars")
    return workflow.nearest_rank(docs, "lang", "n_chars", (0.5, 0.95))


def _audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings of documents as Markdown files: the rules on one note, and equal titles."""
    parsed = notes_of(adapters.document_files(spark, sf_dir)).withColumn("content_chars", content_chars(F.col("body")))
    notes = staged(spark, parsed.drop("text", "body", "lines", "aliases", "related"), "audited")  # each file is parsed once
    return audit.findings(notes, audit.metadata_rules(("guide", "web-clip", "log"))).unionByName(audit.duplicate_titles(notes))


def audit_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules of the audit on documents as files, counted by code and severity."""
    return _audited(spark, sf_dir).groupBy("code", "severity").agg(F.count(F.lit(1)).alias("findings"), F.count_distinct("path").alias("notes"))


def table_audit_worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-9: the first findings in order of severity, path, code and message."""
    rank = F.when(F.col("severity") == "defect", 0).when(F.col("severity") == "hygiene", 1).otherwise(2)
    return _audited(spark, sf_dir).orderBy(rank, "path", "code", "message").limit(40).select(F.col("path").alias("doc_id"), "code", "severity")


def note_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guarded dates: real calendar dates at the start of texts, others null."""
    made = table(spark, sf_dir, "events").select(F.concat_ws("-", F.lit("2023"), F.lpad((F.col("user_id") % 14).cast("string"), 2, "0"), F.lpad((F.col("event_id") % 33).cast("string"), 2, "0")).alias("d"))
    return made.select(note_date(F.col("d")).alias("date")).groupBy("date").agg(F.count(F.lit(1)).alias("n")).select(F.col("date").cast("string").alias("date"), "n")


_MEMBERS = """
WITH names AS (SELECT lower(c_name) AS key, any_value(c_custkey) AS c FROM customer GROUP BY ALL HAVING count(*) = 1),
o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, o_custkey, o_orderpriority, lower(c_name) AS key FROM orders LEFT JOIN customer ON c_custkey = o_custkey),
u AS (SELECT c_custkey AS c, o_orderkey, d, 0 AS trust, 'location' AS origin FROM o JOIN customer ON c_custkey = o_custkey
  UNION ALL SELECT c, o_orderkey, d, 1, 'project-field' FROM o JOIN names USING (key) WHERE o_orderpriority LIKE '1%'
  UNION ALL SELECT n.c, o_orderkey, d, 2, 'related-link' FROM lineitem JOIN customer ON c_custkey = l_suppkey JOIN names n ON n.key = lower(c_name) JOIN o ON o_orderkey = l_orderkey),
members AS (SELECT 'customer ' || c AS project, CAST(o_orderkey AS VARCHAR) AS path, min(trust) AS trust, max(d) AS date, string_agg(DISTINCT origin, '+' ORDER BY origin) AS origins FROM u GROUP BY c, o_orderkey)
"""
SQL = {
    "page_links": _GRAPH + "SELECT state, count(*) AS links, count(DISTINCT source) AS sources, CAST(sum(n) AS BIGINT) AS targets FROM resolved GROUP BY state",
    "page_backlinks": _GRAPH + ", e AS (SELECT DISTINCT * FROM known) SELECT path AS page_id, CAST(sum(o) AS BIGINT) AS n_out, CAST(sum(i) AS BIGINT) AS n_in FROM (SELECT source AS path, 1 AS o, 0 AS i FROM e UNION ALL SELECT target, 0, 1 FROM e) GROUP BY path",
    "page_neighbourhood": _GRAPH + """, seed AS (SELECT target AS s FROM (SELECT target, count(DISTINCT source) AS n FROM known GROUP BY target) ORDER BY n DESC, target LIMIT 1),
n AS (SELECT target AS page_id, 'out' AS d FROM known, seed WHERE source = s UNION ALL SELECT source, 'in' FROM known, seed WHERE target = s)
SELECT page_id, string_agg(DISTINCT d, '+' ORDER BY d) AS directions, count(*) AS edges FROM n GROUP BY page_id ORDER BY page_id LIMIT 20""",
    "page_orphans": _GRAPH + """SELECT page_id, 'orphan-note' AS code FROM pages WHERE page_id NOT IN (SELECT target FROM known) AND page_id % 3 <> 0
UNION ALL SELECT page_id, 'disconnected-note' FROM pages WHERE page_id % 3 = 0 AND page_id NOT IN (SELECT target FROM known) AND page_id NOT IN (SELECT source FROM known)""",
    "page_visible_chars": r"""
WITH c AS (SELECT page_id, string_split(html, '<!--') AS p FROM pages),
v AS (SELECT page_id, p[1] || array_to_string(list_transform(p[2:], lambda x: regexp_replace(split_part(x, '-->', 1), '[^\n]', '', 'g') || CASE WHEN contains(x, '-->') THEN substr(x, length(split_part(x, '-->', 1)) + 4) ELSE '' END), '') AS t FROM c)
SELECT page_id, length(regexp_replace(array_to_string(list_filter(string_split(t, chr(10)), lambda l: NOT starts_with(ltrim(l), '#')), ''), '\s', '', 'g')) AS chars FROM v""",
    "name_exact_boost": "SELECT p_partkey, 12.0::DOUBLE AS boost FROM part WHERE array_to_string(regexp_extract_all(lower(p_name), '[a-z0-9]+'), ' ') = 'small ring'",
    "tag_normalise_groups": """
WITH tags AS (SELECT DISTINCT unnest([p_brand, lower(p_brand), lower(p_type) || 's', p_type, replace(p_name, ' ', '-'), p_name]) AS tag FROM part),
keyed AS (SELECT tag, regexp_replace(lower(tag), '[_\\- ]', '', 'g') AS k FROM tags)
SELECT CASE WHEN length(k) > 1 AND k LIKE '%s' THEN left(k, length(k) - 1) ELSE k END AS tag_key, string_agg(tag, ',' ORDER BY tag) AS spellings FROM keyed GROUP BY 1 HAVING count(*) > 1""",
    "duplicate_titles": "SELECT lower(trim(split_part(text, chr(10), 1))) AS title_key, count(*) AS notes FROM documents GROUP BY 1 HAVING count(*) > 1",
    "suggest_links": """
WITH c AS (SELECT p_partkey, p_name, p_brand, [p_type, p_brand] AS tags FROM part),
used AS (SELECT tag, count(*) AS n FROM (SELECT p_partkey, unnest(list_distinct(tags)) AS tag FROM c) GROUP BY tag),
common AS (SELECT coalesce(list(tag), []) AS g FROM used, (SELECT count(*) AS t FROM c) WHERE n >= 2 AND n * 2 >= t),
toks AS (SELECT *, list_filter(list_distinct(regexp_extract_all(lower(p_name), '[a-z0-9]+')), lambda x: length(x) >= 2 AND NOT regexp_full_match(x, '[0-9]+') AND x NOT IN ('guide', 'tutorial', 'overview', 'introduction', 'intro', 'practice', 'explained', 'article', 'note', 'notes', 'post', 'summary')) AS w FROM c),
s AS (SELECT p_brand AS sb, list_filter(tags, lambda x: NOT list_contains(g, x)) AS st, w AS sw FROM toks, common WHERE p_partkey = 1)
SELECT p_partkey, score FROM (SELECT p_partkey, CAST(3 * len(list_intersect(st, tags)) + CASE WHEN sb = p_brand THEN 1 ELSE 0 END + least(6, 2 * len(list_intersect(sw, w))) AS BIGINT) AS score FROM toks, s WHERE p_partkey <> 1 AND p_partkey % 10 <> 3)
WHERE score >= 3 ORDER BY score DESC, p_partkey LIMIT 10""",
    "tag_vocabulary": "SELECT tag, count(*) AS notes FROM (SELECT doc_id, unnest(list_distinct([lang, source])) AS tag FROM documents) WHERE tag <> 'en' GROUP BY tag ORDER BY notes DESC, tag LIMIT 40",
    "crowded_folders": "SELECT r_name || '/' || n_name AS folder, count(*) AS direct_notes FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1 HAVING count(*) >= 20 ORDER BY 2 DESC, 1 LIMIT 20",
    "subject_clusters": """
WITH n AS (SELECT p_partkey, p_type AS folder, p_name, list_distinct([p_type, p_brand]) AS tags FROM part),
t AS (SELECT folder, 'tag' AS kind, lower(unnest(tags)) AS term FROM n UNION ALL
  SELECT folder, 'title', unnest(list_filter(list_distinct(regexp_extract_all(lower(p_name), '[a-z0-9]+')), lambda x: length(x) >= 2 AND NOT regexp_full_match(x, '[0-9]+') AND x NOT IN ('and', 'for', 'the', 'with', 'note', 'notes', 'index')
    AND NOT list_contains(flatten([regexp_extract_all(lower(g), '[a-z0-9]+') FOR g IN tags]), x))) FROM n),
c AS (SELECT folder, kind, term, count(*) AS notes FROM t GROUP BY ALL), s AS (SELECT folder, count(*) AS size FROM n GROUP BY folder)
SELECT folder, kind, term, notes, place FROM (SELECT folder, kind, term, notes, row_number() OVER (PARTITION BY folder ORDER BY notes DESC, kind, term) AS place FROM c JOIN s USING (folder) WHERE notes >= 5 AND size - notes >= 5 AND term <> lower(folder)) WHERE place <= 6""",
    "retention_keep_n": """
SELECT user_id, count(*) AS backups, count(*) FILTER (r > 5) AS deleted, CAST(sum(CASE WHEN r <= 5 THEN event_id END) AS BIGINT) AS kept_ids
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY (event_type = 'purchase') DESC, epoch_us(ts) DESC, CAST(ts AS DATE) DESC, event_id DESC) AS r FROM events) GROUP BY user_id""",
    "cache_prune_budget": """
WITH r AS (SELECT *, user_id * 100 AS b, row_number() OVER w AS p, sum(user_id * 100) OVER (PARTITION BY event_type ORDER BY ts DESC, event_id ROWS UNBOUNDED PRECEDING) AS run FROM events WHERE ts >= TIMESTAMP '2024-01-20' WINDOW w AS (PARTITION BY event_type ORDER BY ts DESC, event_id))
SELECT event_type AS cache, count(*) AS live, count(*) FILTER (p <= 64 AND run <= 400000) AS kept, CAST(sum(b) FILTER (p <= 64 AND run <= 400000) AS BIGINT) AS bytes, min(event_id) FILTER (p <= 64 AND run <= 400000) AS oldest_kept FROM r GROUP BY event_type""",
    "board_fold": """
WITH a AS (SELECT user_id // 10 AS board, user_id AS item, ts, event_id, CASE event_type WHEN 'signup' THEN 'capture' WHEN 'click' THEN 'capture' WHEN 'purchase' THEN 'tick' WHEN 'error' THEN 'cancel' ELSE 'reschedule' END AS action FROM events),
j AS (SELECT *, lag(action) OVER (PARTITION BY item ORDER BY ts, event_id) AS prev, coalesce(sum(CASE WHEN action = 'capture' THEN 1 ELSE 0 END) OVER (PARTITION BY item ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps FROM a),
g AS (SELECT board, item, arg_max(action, struct_pack(ts := ts, e := event_id)) AS last_action, count(*) FILTER (action = 'capture' AND prev IN ('capture', 'reschedule')) AS duplicates, count(*) FILTER (action <> 'capture' AND caps = 0) AS no_match FROM j GROUP BY ALL)
SELECT board, item, last_action, CASE last_action WHEN 'tick' THEN 'done' WHEN 'cancel' THEN 'cancelled' ELSE 'open' END AS state, duplicates, no_match FROM g""",
    "board_spoken_sections": """
WITH i AS (SELECT CASE WHEN o_orderpriority LIKE '1%' THEN '今天' WHEN o_orderpriority LIKE '2%' THEN '之后' ELSE '没定日子' END AS section, CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderdate AS DATE) END AS due, o_orderstatus = 'F' AS done FROM orders),
s AS (SELECT *, CASE WHEN done THEN '已完成' WHEN due IS NULL THEN '没定日子' WHEN due <= DATE '1998-06-01' THEN '今天' ELSE '之后' END AS spoken FROM i)
SELECT spoken, count(*) AS items, count(*) FILTER (section <> spoken) AS misplaced FROM s GROUP BY spoken
""",
    "json_props": "SELECT event_type, count(k) AS n, CAST(sum(k) AS BIGINT) AS total, count(DISTINCT k) AS distinct_k FROM (SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY event_type",
    "project_queue": """
WITH p AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 'blocked' WHEN 'F' THEN 'closed' ELSE 'active' END AS status, CASE WHEN o_orderkey % 17 <> 0 THEN CAST(o_orderdate AS DATE) END AS activity FROM orders),
t AS (SELECT l_orderkey, count(*) FILTER (l_linestatus = 'O') AS open_tasks, count(*) FILTER (l_linestatus = 'O' AND l_returnflag = 'N') AS scoped, bool_or(l_returnflag = 'N') AS section,
  arg_min('part ' || l_partkey, struct_pack(a := l_linenumber, b := 'part ' || l_partkey)) FILTER (l_linestatus = 'O') AS any_first, arg_min('part ' || l_partkey, struct_pack(a := l_linenumber, b := 'part ' || l_partkey)) FILTER (l_linestatus = 'O' AND l_returnflag = 'N') AS scoped_first FROM lineitem GROUP BY l_orderkey),
a AS (SELECT *, date_diff('day', activity, DATE '2001-08-01') AS age_days FROM p WHERE status <> 'closed' AND (activity IS NULL OR activity <= DATE '2001-08-01')),
j AS (SELECT a.*, coalesce(open_tasks, 0) AS open_tasks, CASE WHEN coalesce(section, false) THEN scoped ELSE coalesce(open_tasks, 0) END AS ranking_tasks, CASE WHEN coalesce(section, false) THEN scoped_first ELSE any_first END AS next_action FROM a LEFT JOIN t ON o_orderkey = l_orderkey WHERE status = 'blocked' OR activity IS NULL OR age_days >= 60),
q AS (SELECT o_orderkey, status, age_days, open_tasks, ranking_tasks, CASE WHEN status = 'blocked' THEN 0 WHEN activity IS NULL THEN 1 WHEN ranking_tasks > 0 THEN 2 ELSE 3 END AS priority,
  concat_ws(',', CASE WHEN status = 'blocked' THEN 'blocked' END, CASE WHEN activity IS NULL THEN 'missing-activity-date' END, CASE WHEN age_days >= 60 THEN 'stale:' || age_days || '-days' END, CASE WHEN ranking_tasks > 0 THEN 'open-tasks:' || ranking_tasks END) AS reasons, next_action FROM j)
SELECT * FROM q ORDER BY priority, coalesce(age_days, -1) DESC, ranking_tasks DESC, o_orderkey LIMIT 20""",
    "open_loops": """
SELECT l_orderkey AS o_orderkey, CAST(l_linenumber AS BIGINT) AS line, 'part ' || l_partkey AS text, o_orderpriority AS type, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linestatus = 'O' AND l_returnflag = 'N' ORDER BY CAST(o_orderdate AS DATE), l_orderkey, l_linenumber LIMIT 50""",
    "open_loop_summary": "SELECT coalesce(o_orderpriority, 'all') AS type, count(*) AS loops, count(DISTINCT l_orderkey) AS notes FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linestatus = 'O' AND l_returnflag = 'N' GROUP BY ROLLUP (o_orderpriority)",
    "view_window": """
SELECT o_orderstatus, count(*) AS orders, round(sum(o_totalprice), 2) AS total, CAST(min(CAST(o_orderdate AS DATE)) AS VARCHAR) AS first_day, CAST(max(CAST(o_orderdate AS DATE)) AS VARCHAR) AS last_day
FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '2001-08-01' - 89 AND DATE '2001-08-01' GROUP BY o_orderstatus""",
    "resume_sources_union": """
WITH u AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, 0 AS trust, 'location' AS origin FROM orders WHERE o_orderpriority LIKE '5%'
  UNION ALL SELECT o_orderkey, CAST(o_orderdate AS DATE), 1, 'project-field' FROM orders WHERE o_orderpriority LIKE '1%' OR o_orderpriority LIKE '5%'
  UNION ALL SELECT l_orderkey, CAST(l_shipdate AS DATE), 2, 'related-link' FROM lineitem)
SELECT o_orderkey, min(trust) AS trust, CAST(max(d) AS VARCHAR) AS date, string_agg(DISTINCT origin, '+' ORDER BY origin) AS origins FROM u GROUP BY o_orderkey""",
    "resume_project_members": _MEMBERS + "SELECT project, CAST(path AS BIGINT) AS o_orderkey, trust, CAST(date AS VARCHAR) AS date, origins FROM members",
    "resume_packs": _MEMBERS + """,
placed AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY trust, date DESC NULLS LAST, path) AS place FROM members),
bounded AS (SELECT * FROM placed WHERE place <= 5),
said AS (SELECT CAST(o_orderkey AS VARCHAR) AS path, unnest(list_filter([CASE WHEN o_orderkey % 2 = 0 THEN 'goal' END, CASE WHEN o_orderkey % 7 = 0 THEN 'constraints' END, CASE WHEN o_orderkey % 3 = 0 THEN 'decisions' END, CASE WHEN o_orderstatus = 'F' THEN 'evidence' END, CASE WHEN o_orderstatus = 'O' THEN 'next_actions' END], lambda x: x IS NOT NULL)) AS field FROM orders),
own AS (SELECT 'customer ' || c_custkey AS project, unnest(list_filter([CASE WHEN c_custkey % 2 = 0 THEN 'goal' END, CASE WHEN c_custkey % 3 = 0 THEN 'decisions' END, CASE WHEN c_mktsegment = 'BUILDING' THEN 'blockers' END, CASE WHEN c_custkey % 5 <> 0 THEN 'next_actions' END], lambda x: x IS NOT NULL)) AS field FROM customer),
o1 AS (SELECT project, string_agg(field || '=' || field || ' of ' || project, '; ' ORDER BY field) AS resume, list(field) AS fields FROM own GROUP BY project),
t0 AS (SELECT project, field, string_agg(path, ',' ORDER BY place) AS paths FROM bounded JOIN said USING (path) GROUP BY project, field),
t1 AS (SELECT project, string_agg(field || '=' || paths, '; ' ORDER BY field) AS from_sources, list(field) AS fields FROM t0 GROUP BY project),
s1 AS (SELECT project, string_agg(path || ':' || origins, '; ' ORDER BY place) AS sources FROM bounded GROUP BY project),
n1 AS (SELECT project, count(*) AS n FROM members GROUP BY project)
SELECT p.project, coalesce(resume, '') AS resume, coalesce(from_sources, '') AS from_sources, array_to_string(list_sort(list_filter(coalesce(o1.fields, []), lambda f: list_contains(coalesce(t1.fields, []), f))), ',') AS contested,
  array_to_string(list_filter(['goal', 'decisions', 'blockers', 'next_actions'], lambda f: NOT list_contains(coalesce(o1.fields, []), f)), ',') AS missing, coalesce(sources, '') AS sources, coalesce(n, 0) AS sources_available, coalesce(n, 0) > 5 AS truncated
FROM (SELECT 'customer ' || c_custkey AS project FROM customer) p LEFT JOIN o1 USING (project) LEFT JOIN t1 USING (project) LEFT JOIN s1 USING (project) LEFT JOIN n1 USING (project)""",
    "inbox_routes": r"""
WITH i AS (SELECT CASE WHEN role = 'system' THEN '90-Meta' WHEN contains(lower(text), 'meeting') OR contains(lower(text), 'und ') THEN '10-Work' WHEN contains(lower(text), 'article') OR contains(lower(text), ' la ') THEN '20-Learning'
  WHEN contains(lower(text), 'idea') OR contains(lower(text), ' the ') THEN '30-Insights' END AS target, length(text) < 1200 AS readable, conv_id % 9 = 0 OR regexp_matches(text, '\{\{[^{}]*\}\}') AS draft FROM conversations)
SELECT target, CASE WHEN NOT readable THEN 'unreadable' WHEN draft THEN 'draft' WHEN target IS NULL THEN 'unknown-target' END AS skip_code, count(*) AS items FROM i GROUP BY ALL""",
    "required_kinds_missing": """
SELECT conv_id, missing FROM (SELECT conv_id, array_to_string([k FOR k IN ['assistant', 'system', 'user'] IF NOT list_contains(list(DISTINCT role), k)], ',') AS missing FROM conversations GROUP BY conv_id) WHERE missing <> ''""",
    "evidence_containment": "SELECT doc_id, item_id, strpos(d.text, b.text) AS position, sha256(b.text) AS sha256 FROM documents d JOIN benchmark b ON contains(d.text, b.text)",
    "evidence_occurrences": """
SELECT doc_id, item_id, p AS position, sha256(x) AS sha256 FROM (SELECT doc_id, item_id, d.text AS t, b.text AS x, unnest(range(1, length(d.text) - length(b.text) + 2)) AS p FROM documents d JOIN benchmark b ON b.text <> '' AND contains(d.text, b.text))
WHERE substr(t, p, length(x)) = x""",
    # signs that are no word characters stand twice, so that one of each pair can end a span and the other begin the next
    "metric_spans": r"""
WITH d AS (SELECT lang, unnest(regexp_extract_all(regexp_replace(text, '([^\p{L}\p{N}_])', '\1\1', 'g'),
  '(^|[^\p{L}\p{N}_])(\d+(?:\.\.\d+)?\s*(?:%|％)|\d+(?:\.\.\d+)?\s*(?:ms|s|min|mins|minutes?|hours?|days?|weeks?|months?|years?)(?:[^\p{L}\p{N}_]|$)|\d+(?:\.\.\d+)?\s*(?://|::|：：)\s*\d+(?:\.\.\d+)?|\d+(?:\.\.\d+)?\s*(?:[kKmMbB]|thousand|million|billion)(?:[^\p{L}\p{N}_]|$)|\d{1,3}(?:,,\d{3})+(?:\+)?)', 2)) AS x FROM documents)
SELECT lang, count(*) AS spans, count(DISTINCT span) AS distinct_spans
FROM (SELECT lang, regexp_replace(regexp_replace(x, '(\p{L})[^\p{L}\p{N}_]$', '\1'), '([^\p{L}\p{N}_])[^\p{L}\p{N}_]', '\1', 'g') AS span FROM d) GROUP BY lang""",
    "metric_span_uncovered": """
WITH e AS (SELECT event_id, user_id, event_type, epoch_us(ts) // 1000000 AS s FROM events)
SELECT event_id, user_id FROM e p WHERE event_type = 'purchase' AND NOT EXISTS (SELECT 1 FROM e x WHERE x.event_type = 'signup' AND x.user_id = p.user_id AND p.s >= x.s AND p.s + 60 <= x.s + 86400)""",
    "eval_metrics": """
WITH r AS (SELECT l_orderkey AS id, l_partkey AS path, row_number() OVER (PARTITION BY l_orderkey ORDER BY max(l_extendedprice) DESC, l_partkey) AS rank FROM lineitem GROUP BY l_orderkey, l_partkey),
f AS (SELECT l_orderkey, arg_min(l_partkey, struct_pack(a := l_linenumber, b := l_partkey)) AS part FROM lineitem GROUP BY l_orderkey),
c AS (SELECT o_orderkey AS id, o_orderpriority AS priority, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE part END AS part FROM orders JOIN f ON o_orderkey = l_orderkey),
j AS (SELECT c.*, r.rank FROM c LEFT JOIN r ON r.id = c.id AND r.path = c.part)
SELECT priority, count(*) AS cases, round(avg(CASE WHEN part IS NOT NULL THEN CASE WHEN rank <= 2 THEN 1.0 ELSE 0.0 END END), 4) AS recall, round(avg(CASE WHEN part IS NOT NULL THEN coalesce(1.0 / rank, 0.0) END), 4) AS mrr,
  round(avg(CASE WHEN part IS NULL THEN 1.0 END), 4) AS false_positive_rate FROM j GROUP BY priority""",
    "nearest_rank_percentile": """
WITH r AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) AS p, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT lang, max(CASE WHEN p = greatest(ceil(n * 0.5), 1) THEN n_chars END) AS p50, max(CASE WHEN p = greatest(ceil(n * 0.95), 1) THEN n_chars END) AS p95 FROM r GROUP BY lang""",
    "note_dates": "SELECT CAST(d AS VARCHAR) AS date, count(*) AS n FROM (SELECT TRY_CAST('2023-' || lpad(CAST(user_id % 14 AS VARCHAR), 2, '0') || '-' || lpad(CAST(event_id % 33 AS VARCHAR), 2, '0') AS DATE) AS d FROM events) GROUP BY 1",
}

_CAPTURES = """
WITH s AS (SELECT l_orderkey, max(CAST(l_shipdate AS DATE)) AS touched FROM lineitem GROUP BY l_orderkey),
c AS (SELECT o_orderkey, o_orderpriority AS type, touched, CASE WHEN o_orderkey % 5 <> 0 THEN 'git-history' ELSE 'file-mtime' END AS evidence, date_diff('day', CAST(o_orderdate AS DATE), touched) <= 0 AS cold FROM orders JOIN s ON o_orderkey = l_orderkey)
"""
SQL["cold_captures"] = _CAPTURES + "SELECT o_orderkey, type, date_diff('day', touched, DATE '2001-08-01') AS cold_days, evidence FROM c WHERE cold ORDER BY cold_days DESC, o_orderkey LIMIT 50"
SQL["capture_revisit_rates"] = _CAPTURES + "SELECT coalesce(type, 'all') AS type, count(*) AS captures, count(*) FILTER (cold) AS never_reopened, round(1 - count(*) FILTER (cold) / count(*), 3) AS revisit_rate FROM c GROUP BY ROLLUP (type)"
_QUEUE = SQL["project_queue"].replace("SELECT * FROM q ORDER BY priority, coalesce(age_days, -1) DESC, ranking_tasks DESC, o_orderkey LIMIT 20", "")
SQL["project_reasons"] = _QUEUE + "SELECT priority, status, count(*) AS projects, CAST(sum(ranking_tasks) AS BIGINT) AS tasks, max(age_days) AS oldest FROM q GROUP BY ALL"
_SEED = """, seed AS (SELECT target AS s FROM (SELECT target, count(DISTINCT source) AS n FROM known GROUP BY target) ORDER BY n DESC, target LIMIT 1)"""
SQL["page_edges"] = _GRAPH + _SEED + """,
l2 AS (SELECT page_id AS source, CAST(i - 1 AS INT) AS line, lower(h[i]) AS name FROM (SELECT page_id, h, unnest(range(1, len(h) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '<a href="/([^"]*)"', 1) AS h FROM pages))),
r2 AS (SELECT DISTINCT l2.*, r.state, r.target FROM l2 JOIN resolved r USING (source, name)),
best20 AS (SELECT page_id FROM (SELECT target AS page_id FROM known, seed WHERE source = s UNION SELECT source FROM known, seed WHERE target = s) ORDER BY page_id LIMIT 20)
SELECT target AS page_id, name, 'out' AS direction, line, state FROM r2, seed WHERE source = s AND state = 'resolved' AND target <> s AND target IN (SELECT page_id FROM best20)
UNION ALL SELECT NULL, name, 'out', line, state FROM r2, seed WHERE source = s AND state <> 'resolved'
UNION ALL SELECT source, name, 'in', line, state FROM r2, seed WHERE target = s AND state = 'resolved' AND source <> s AND source IN (SELECT page_id FROM best20)"""
_PROJECTS = "WITH p AS (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 17 <> 0 THEN CAST(o_orderdate AS DATE) END AS activity FROM orders) "
SQL["project_issues"] = _PROJECTS + "SELECT o_orderkey, 'future-activity-date' AS code, 'activity date ' || activity || ' is after 1998-06-01' AS message FROM p WHERE activity > DATE '1998-06-01'"
SQL["project_summary"] = _PROJECTS + "SELECT count(*) AS projects, count(*) FILTER (activity > DATE '2001-08-01') AS skipped, count(*) FILTER (o_orderstatus = 'F') AS closed, count(*) FILTER (o_orderstatus <> 'F' AND (o_orderstatus = 'P' AND (activity IS NULL OR activity <= DATE '2001-08-01') OR activity IS NULL OR date_diff('day', activity, DATE '2001-08-01') >= 60)) AS candidates FROM p"
_DENIED = " OR ".join([f"regexp_matches(c, '{receipts.denial().replace(chr(39), chr(39) * 2)}')", *(f"contains(c, '{m.replace(chr(39), chr(39) * 2)}')" for m in receipts.NEGATION_MARKERS)])
SQL["declared_outcome"] = rf"""
WITH p AS (SELECT conv_id, turn, list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(text, '')), '(\.)\s+', '\1' || chr(1), 'g'), '([!?;。！？；，、])\s*', '\1' || chr(1), 'g'), '\b(?:but|however|yet)\b|但是|但|然而|不过', chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS parts FROM conversations),
c AS (SELECT conv_id, turn, list_filter(parts, lambda c: regexp_matches(c, '(?:^|\s)(?:die|the|que)(?:\s|$)') AND NOT ({_DENIED})) AS said FROM p),
o AS (SELECT conv_id, regexp_extract(coalesce(said[-1], ''), '.*(?:^|\s)(die|the|que)(?:\s|$)', 1) AS outcome FROM c)
SELECT outcome, count(*) AS messages, count(DISTINCT conv_id) AS conversations FROM o WHERE outcome <> '' GROUP BY outcome"""
_KINDS = " ".join(f"WHEN '{kind}' THEN '{name}'" for kind, name in ACTIONS.items())
SQL["board_log"] = SQL["board_stream"] = f"""
WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events),
a AS (SELECT user_id // 10 AS board, 'row ' || user_id AS item, epoch_us(ts) // 1000 AS at_ms, event_id AS seq, CASE event_type {_KINDS} ELSE 'reschedule' END AS action, CASE WHEN k % 7 <> 0 THEN CAST(ts AS DATE) + k % 5 END AS due FROM e),
o AS (SELECT *, coalesce(last_value(CASE WHEN action <> 'reschedule' THEN action END IGNORE NULLS) OVER (PARTITION BY board, item ORDER BY at_ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 'capture', false) AS opened FROM a),
c AS (SELECT *, CASE WHEN action = 'capture' AND opened THEN 'board-duplicate' WHEN action <> 'capture' AND NOT opened THEN 'board-no-match' ELSE 'ok' END AS code,
  CASE WHEN action IN ('tick', 'cancel') THEN '已完成' WHEN due IS NULL THEN '没定日子' WHEN due <= CAST(epoch_ms(at_ms) AS DATE) THEN '今天' ELSE '之后' END AS place FROM o),
t AS (SELECT *, lead(at_ms) OVER (PARTITION BY board, item ORDER BY at_ms, seq) AS next_ms, epoch_ms(CAST(due AS TIMESTAMP)) AS day_ms FROM c WHERE code = 'ok')
SELECT CAST(board AS BIGINT) AS board, item, at_ms, seq, action, code, CASE WHEN code = 'ok' THEN place END AS section, CASE WHEN code = 'ok' AND action = 'tick' THEN '勾掉' WHEN code = 'ok' AND action = 'cancel' THEN '取消' END AS mark FROM c
UNION ALL SELECT CAST(board AS BIGINT), item, day_ms, NULL, 'rebucket', 'ok', '今天', NULL FROM t WHERE place = '之后' AND coalesce(day_ms <= next_ms, day_ms < (SELECT max(at_ms) FROM a))"""
SQL["staged_content"] = """
WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k, event_type IN ('signup', 'click') AS st FROM events),
r AS (SELECT user_id // 50 AS store, epoch_us(ts) // 1000 AS at_ms, event_id AS seq, CASE WHEN st THEN 'stage' ELSE 'load' END AS kind, CASE WHEN k % 17 = 0 THEN 'no hash' ELSE sha256(user_id || '-' || (k % 2)) END AS sha256,
  CASE WHEN NOT st AND k % 13 = 0 THEN 'elsewhere' ELSE 'vault' END AS vault, 'type ' || (event_id % 2) AS type, CASE WHEN NOT st AND k % 11 = 0 THEN 'other' ELSE 'user ' || user_id END AS title, 400000 + 100000 * (user_id % 5) AS bytes, at_ms * 1000000 + event_id AS pos FROM e),
s AS (SELECT *, lead(pos) OVER (PARTITION BY store, sha256 ORDER BY pos) AS next_pos FROM r WHERE kind = 'stage' AND sha256 <> 'no hash'),
l AS (SELECT r.*, (SELECT max(pos) FROM s WHERE s.store = r.store AND s.pos < r.pos) AS last_pos FROM r WHERE kind = 'load'),
found AS (SELECT l.*, s.pos AS s_pos, s.at_ms AS s_at, s.seq AS s_seq, s.vault AS s_vault, s.type AS s_type, s.title AS s_title, s.bytes AS s_bytes FROM l LEFT JOIN s ON s.store = l.store AND s.sha256 = l.sha256 AND s.pos < l.pos AND (s.next_pos IS NULL OR s.next_pos > l.pos)),
newer AS (SELECT f.pos, count(n.pos) AS n, coalesce(sum(n.bytes), 0) AS bytes FROM found f LEFT JOIN s n ON n.store = f.store AND n.pos > f.s_pos AND n.pos <= f.last_pos AND (n.next_pos IS NULL OR n.next_pos > f.last_pos) WHERE f.s_pos IS NOT NULL GROUP BY f.pos),
kept AS (SELECT f.*, f.s_pos IS NOT NULL AND f.last_pos // 1000000 - f.s_at <= 86400000 AND w.n < 64 AND w.bytes + f.s_bytes <= 33554432 AS there FROM found f LEFT JOIN newer w USING (pos)),
c AS (SELECT *, CASE WHEN sha256 = 'no hash' THEN 'invalid-preflight-reference' WHEN NOT coalesce(there, false) THEN 'unknown-preflight-content' WHEN s_vault <> vault THEN 'preflight-vault-mismatch' WHEN s_type <> type OR s_title <> title THEN 'preflight-context-mismatch' ELSE 'ok' END AS code FROM kept)
SELECT CAST(store AS BIGINT) AS store, at_ms, seq, kind, sha256, code, CASE code WHEN 'unknown-preflight-content' THEN 'sha256' WHEN 'preflight-vault-mismatch' THEN 'vault'
  WHEN 'preflight-context-mismatch' THEN array_to_string(list_filter([CASE WHEN s_type <> type THEN 'type' END, CASE WHEN s_title <> title THEN 'title' END], lambda x: x IS NOT NULL), ',') END AS differs,
  CASE WHEN code NOT IN ('invalid-preflight-reference', 'unknown-preflight-content') THEN s_seq END AS staged_seq FROM c
UNION ALL SELECT CAST(store AS BIGINT), at_ms, seq, kind, sha256, CASE WHEN sha256 = 'no hash' THEN 'not-staged' ELSE 'staged' END, NULL, CASE WHEN sha256 <> 'no hash' THEN seq END FROM r WHERE kind = 'stage'"""
_FOLDERS = """
WITH RECURSIVE p AS (SELECT p_brand AS a, p_brand || '/' || p_type AS b, p_brand || '/' || p_type || '/' || split_part(p_name, ' ', 1) AS c, p_partkey FROM part),
f AS (SELECT a AS folder FROM p UNION SELECT b FROM p UNION SELECT c FROM p),
d AS (SELECT folder, string_split(folder, '/')[-1] AS name, ('0x' || substr(md5(folder), 1, 1))::INT AS digit FROM f),
files AS (SELECT c || '/part-' || p_partkey || '.md' AS path, false AS declares, c AS folder FROM p
  UNION ALL SELECT folder || '/' || name || '.md', true, folder FROM d WHERE digit BETWEEN 4 AND 12 OR digit = 15 UNION ALL SELECT folder || '/INDEX.md', true, folder FROM d WHERE digit >= 13),
s AS (SELECT folder, 'own names' AS config, folder || '/' || name || '.md' AS expected, folder || '/' || name || '.md' AS target FROM d WHERE NOT (folder = 'Brand#3' OR folder LIKE 'Brand#3/%' OR folder LIKE '%/blue')
  UNION ALL SELECT folder, 'one name', folder || '/INDEX.md', folder || '/' || name || '.md' FROM d),
"""
SQL["folder_graph_findings"] = _FOLDERS + """
x AS (SELECT config, folder AS path, 'missing-folder-index' AS code FROM s WHERE expected NOT IN (SELECT path FROM files)
  UNION ALL SELECT DISTINCT config, '.', 'missing-folder-index' FROM s
  UNION ALL SELECT config, path, 'misnamed-folder-index' FROM files JOIN s USING (folder) WHERE declares AND path <> expected
  UNION ALL SELECT config, expected, 'broken-folder-graph-chain' FROM s WHERE expected <> target AND expected IN (SELECT path FROM files)
  UNION ALL SELECT 'one name', '.obsidian/plugins/obsidian-folder-index/data.json', 'graph-incompatible-index-config' FROM (SELECT 1 FROM s LIMIT 1))
SELECT *, CASE WHEN code IN ('missing-folder-index', 'misnamed-folder-index') THEN 'hygiene' ELSE 'defect' END AS severity FROM x"""
SQL["folder_graph_reach"] = _FOLDERS + """
k AS (SELECT folder, len(string_split(folder, '/')) AS depth, target IN (SELECT path FROM files) AS linked FROM s WHERE config = 'own names'),
walk(folder, depth, broken_at, next) AS (
  SELECT folder, depth, CASE WHEN NOT linked THEN folder END, regexp_replace(folder, '/?[^/]*$', '') FROM k
  UNION ALL SELECT w.folder, w.depth, coalesce(CASE WHEN NOT k.linked THEN k.folder END, w.broken_at), regexp_replace(w.next, '/?[^/]*$', '') FROM walk w LEFT JOIN k ON k.folder = w.next WHERE w.next <> '')
SELECT folder, CAST(depth AS INT) AS depth, broken_at, broken_at IS NULL AS reached FROM walk WHERE next = ''"""
SQL["receipt_refusals"] = """
SELECT conv_id, CASE f WHEN 1 THEN 'capture-receipt-content-mismatch' WHEN 2 THEN 'incomplete-source-access' WHEN 3 THEN 'unresolved-material-items' WHEN 4 THEN 'incomplete-profile-evidence' WHEN 5 THEN 'uncovered-numeric-claim'
    WHEN 6 THEN 'missing-numeric-provenance' WHEN 7 THEN 'unlabeled-inference' WHEN 8 THEN 'missing-practical-artifact' WHEN 9 THEN 'missing-receipt-anchor' WHEN 10 THEN 'source-receipt-mismatch' WHEN 11 THEN 'unresolved-material-items' END AS code,
  CASE f WHEN 1 THEN 5 WHEN 2 THEN 7 WHEN 3 THEN 20 WHEN 4 THEN 23 WHEN 5 THEN 27 WHEN 6 THEN 26 WHEN 7 THEN 29 WHEN 8 THEN 30 WHEN 9 THEN 22 WHEN 10 THEN 11 WHEN 11 THEN 22 END AS step, CASE WHEN f > 0 THEN 0 END AS entry
FROM (SELECT DISTINCT conv_id, conv_id % 12 AS f FROM conversations)"""
_AUDIT = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
n AS (SELECT *, doc_id % 19 <> 0 AS has_meta, doc_id % 19 <> 0 AND doc_id % 23 <> 0 AS known, coalesce(nullif(trim(split_part(text, chr(10), 1)), ''), 'Untitled') AS title,
  length(regexp_replace(array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT starts_with(ltrim(x), '#')), ''), '\s', '', 'g')) + CASE WHEN doc_id % 43 = 0 THEN 8 ELSE 0 END + CASE WHEN doc_id % 41 = 0 THEN 7 ELSE 0 END
    + CASE WHEN doc_id % 19 <> 0 AND doc_id % 23 = 0 THEN 1000 ELSE 0 END AS chars FROM d),
f AS (SELECT doc_id, 'missing-frontmatter' AS code, 'defect' AS severity FROM n WHERE NOT has_meta
  UNION ALL SELECT doc_id, 'invalid-frontmatter', 'defect' FROM n WHERE has_meta AND NOT known
  UNION ALL SELECT doc_id, 'missing-type', 'defect' FROM n WHERE known AND lang NOT IN ('en', 'fr', 'de')
  UNION ALL SELECT doc_id, 'invalid-type', 'defect' FROM n WHERE known AND lang = 'de'
  UNION ALL SELECT doc_id, 'missing-date', 'defect' FROM n WHERE known AND doc_id % 17 = 0
  UNION ALL SELECT doc_id, 'missing-tags', 'hygiene' FROM n WHERE known AND doc_id % 29 = 0
  UNION ALL SELECT doc_id, 'too-many-tags', 'hygiene' FROM n WHERE known AND doc_id % 29 <> 0 AND doc_id % 31 = 0
  UNION ALL SELECT doc_id, 'invalid-tag', 'hygiene' FROM n WHERE known AND doc_id % 29 <> 0 AND doc_id % 31 <> 0 AND (doc_id % 37 = 0 OR NOT regexp_full_match(source, '[a-z0-9]+(-[a-z0-9]+)*'))
  UNION ALL SELECT doc_id, 'unclosed-fence', 'defect' FROM n WHERE doc_id % 41 = 0
  UNION ALL SELECT doc_id, 'unresolved-template-placeholder', 'defect' FROM n WHERE doc_id % 43 = 0
  UNION ALL SELECT doc_id, 'empty-template-note', 'defect' FROM n WHERE chars = 0
  UNION ALL SELECT doc_id, 'web-clip-captured-nothing', 'defect' FROM n WHERE known AND lang = 'fr' AND chars < 400
  UNION ALL SELECT doc_id, 'web-clip-missing-source', 'hygiene' FROM n WHERE known AND lang = 'fr' AND doc_id % 7 = 0
  UNION ALL SELECT doc_id, 'web-clip-missing-author', 'hygiene' FROM n WHERE known AND lang = 'fr' AND doc_id % 11 = 0
  UNION ALL SELECT doc_id, 'web-clip-missing-published', 'hygiene' FROM n WHERE known AND lang = 'fr' AND doc_id % 13 = 0
  UNION ALL SELECT doc_id, 'web-clip-invalid-capture-depth', 'defect' FROM n WHERE known AND lang = 'fr' AND doc_id % 47 = 0
  UNION ALL SELECT doc_id, 'duplicate-title', 'hygiene' FROM (SELECT doc_id, count(*) OVER (PARTITION BY lower(trim(title))) AS c FROM n) WHERE c > 1)
"""
SQL["audit_findings"] = _AUDIT + "SELECT code, severity, count(*) AS findings, count(DISTINCT doc_id) AS notes FROM f GROUP BY ALL"
SQL["table_audit_worst"] = _AUDIT + "SELECT doc_id, code, severity FROM f ORDER BY CASE severity WHEN 'defect' THEN 0 WHEN 'hygiene' THEN 1 ELSE 2 END, doc_id, code LIMIT 40"


_CASES = """
WITH r AS (SELECT l_orderkey AS id, l_partkey AS path, row_number() OVER (PARTITION BY l_orderkey ORDER BY max(l_extendedprice) DESC, l_partkey) AS rank FROM lineitem GROUP BY l_orderkey, l_partkey),
held AS (SELECT * FROM r WHERE rank <= 3)"""
SQL["case_metrics"] = _CASES + """,
e AS (SELECT l_orderkey AS id, min(rank) AS rank FROM lineitem JOIN held ON id = l_orderkey AND path = l_partkey WHERE l_linenumber = 1 GROUP BY l_orderkey),
n AS (SELECT id, count(*) AS returned FROM held GROUP BY id),
m AS (SELECT id, count(*) AS missing FROM (SELECT DISTINCT l_orderkey AS id, l_partkey AS path FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT id, path FROM held) GROUP BY id),
h AS (SELECT id, count(*) AS hits FROM (SELECT DISTINCT l_orderkey AS id, l_partkey AS path FROM lineitem WHERE l_quantity > 45 INTERSECT SELECT id, path FROM held) GROUP BY id),
c AS (SELECT CASE WHEN o_orderpriority LIKE '5%' THEN 'no-answer' ELSE o_orderpriority END AS grp, e.rank, coalesce(returned, 0) AS returned, coalesce(missing, 0) AS missing, coalesce(hits, 0) AS hits
  FROM orders o LEFT JOIN e ON e.id = o_orderkey LEFT JOIN n ON n.id = o_orderkey LEFT JOIN m ON m.id = o_orderkey LEFT JOIN h ON h.id = o_orderkey)
SELECT coalesce(grp, 'all') AS "group", count(*) AS cases, round(avg(CASE WHEN rank IS NOT NULL THEN 1.0 ELSE 0.0 END) FILTER (grp0 <> 'no-answer'), 3) AS recall,
  round(avg(coalesce(1.0 / rank, 0.0)) FILTER (grp0 <> 'no-answer'), 3) AS mrr, CAST(sum(missing) AS BIGINT) AS must_see_misses, CAST(sum(hits) AS BIGINT) AS hard_negative_hits,
  round(avg(CASE WHEN returned > 0 THEN 1.0 ELSE 0.0 END) FILTER (grp0 = 'no-answer'), 3) AS false_positive_rate, count(*) FILTER (missing > 0 OR hits > 0) AS limited
FROM (SELECT *, grp AS grp0 FROM c) GROUP BY ROLLUP (grp)"""
SQL["family_occupancy"] = _CASES + "SELECT id AS o_orderkey, p_brand AS family, count(*) AS places FROM held JOIN part ON p_partkey = path GROUP BY ALL"
SQL["duplicate_project_notes"] = """
WITH u AS (SELECT o_orderkey, o_orderstatus, o_custkey, count(*) OVER w AS n, row_number() OVER (PARTITION BY o_orderstatus, o_custkey ORDER BY o_orderkey) AS place
  FROM orders WHERE o_orderpriority LIKE '1%' WINDOW w AS (PARTITION BY o_orderstatus, o_custkey))
SELECT 'duplicate-project-note' AS code, 'defect' AS severity, o_orderstatus || '/' || o_custkey AS path, any_value(n) || ' notes: ' || string_agg(CAST(o_orderkey AS VARCHAR), ', ' ORDER BY o_orderkey) AS message
FROM u WHERE n > 1 AND place <= 20 GROUP BY o_orderstatus, o_custkey"""
SQL["vault_summary"] = """
SELECT 'all' AS facet, '' AS name, count(*) AS notes FROM documents
UNION ALL SELECT 'type', coalesce(lang, ''), count(*) FROM documents GROUP BY ALL
UNION ALL (SELECT 'folder', source, count(*) FROM documents GROUP BY source HAVING count(*) >= 20 ORDER BY count(*) DESC, source LIMIT 20)
UNION ALL (SELECT 'tag', tag, count(*) FROM (SELECT doc_id, unnest(list_distinct([lang, source])) AS tag FROM documents) GROUP BY tag ORDER BY count(*) DESC, tag LIMIT 40)"""
_GENERAL = "('guide', 'tutorial', 'overview', 'introduction', 'intro', 'practice', 'explained', 'article', 'note', 'notes', 'post', 'summary')"
SQL["candidate_folders"] = f"""
WITH n AS (SELECT 'p/' || p_type || '/' || p_partkey AS path, 'p/' || p_type AS own, regexp_extract_all(lower(p_name || ' ' || p_brand), '[a-z0-9]+') AS t FROM part),
w AS (SELECT DISTINCT path, own, unnest(t) AS token FROM n),
f AS (SELECT DISTINCT 'p/' || name AS folder, unnest(regexp_extract_all(lower(name), '[a-z0-9]+')) AS token FROM (SELECT p_name AS name FROM part UNION SELECT p_type FROM part)),
near AS (SELECT DISTINCT path, folder FROM w JOIN f USING (token) WHERE folder <> own AND length(token) >= 2 AND NOT regexp_full_match(token, '[0-9]+') AND token NOT IN {_GENERAL})
SELECT path, own AS folder, 0 AS place FROM n
UNION ALL SELECT * FROM (SELECT path, folder, CAST(row_number() OVER (PARTITION BY path ORDER BY folder) AS INT) AS place FROM near) WHERE place <= 2"""


def queries() -> dict:
    found = (
        page_links, page_backlinks, page_neighbourhood, page_edges, page_orphans, page_visible_chars, name_exact_boost, name_fuzzy_boost, tag_normalise_groups, duplicate_titles, similar_titles, suggest_links, tag_vocabulary,
        crowded_folders, subject_clusters, project_queue, project_reasons, project_issues, project_summary, open_loops, open_loop_summary, cold_captures, capture_revisit_rates, view_window, resume_sources_union, resume_project_members, resume_packs, retention_keep_n, cache_prune_budget,
        board_fold, board_spoken_sections, board_log, board_stream, staged_content, folder_graph_findings, folder_graph_reach, character_chains, receipt_refusals, json_props, inbox_routes, required_kinds_missing, declared_outcome, evidence_containment, evidence_occurrences, metric_spans, metric_span_uncovered, eval_metrics, nearest_rank_percentile,
        audit_findings, table_audit_worst, note_dates, case_metrics, family_occupancy, duplicate_project_notes, vault_summary, candidate_folders,
    )
    return {f.__name__: f for f in found}

"""Scans, parsing and structure of Markdown notes, on a small vault."""

from __future__ import annotations

import json

import pytest
from notelens.functions import markdown as M
from notelens.functions import text as X
from notelens.operators import audit, links
from notelens.sources import config, vault
from pyspark.sql import functions as F

from tests.fixtures.vault import NOTES, write


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    return vault.read_files(spark, write(tmp_path_factory.mktemp("vault"))).cache()


@pytest.fixture(scope="module")
def notes(files):
    return M.notes_of(vault.search_scan(files)).cache()


def paths(df):
    return {r.path for r in df.select("path").collect()}


def test_scans_have_their_own_rules(files):
    everything = set(NOTES) - {".obsidian/x.md"} | {"10-Work/crlf.md"}  # Spark itself passes over hidden folders
    assert paths(files) == everything
    assert paths(vault.search_scan(files)) == everything - {"Templates/T.md"}
    assert paths(vault.audit_scan(files)) == everything - {"docs/superpowers/y.md"}
    assert paths(vault.capture_scan(files)) == everything - {"Templates/T.md"}
    assert paths(vault.linkable_scan(files, exempt=("README.MD",))) == everything - {"README.MD"}
    assert paths(vault.inbox_scan(files, "20-Learning")) == {n for n in everything if n.startswith("20-Learning/")}
    assert {r.folder: r.notes for r in vault.scope_stats(files).collect()} == {"10-Work": 4, "20-Learning": 6, "docs": 1, ".": 1}


def test_errors_are_rows(files):
    good, issues = vault.load_notes(vault.search_scan(files))
    assert {(r.path, r.code) for r in issues.collect()} == {("20-Learning/broken.md", "invalid-frontmatter"), ("20-Learning/open.md", "unclosed-frontmatter"), ("20-Learning/list.md", "frontmatter-not-mapping")}
    counts = vault.scan_counts(vault.search_scan(files), good).first()
    assert (counts.files, counts.indexed, counts.skipped) == (12, 9, 3)


def test_typed_columns(notes):
    rows = {r.path: r for r in notes.collect()}
    plan = rows["10-Work/Cache plan.md"]
    assert (plan.title, plan.type, plan.status, str(plan.date), str(plan.updated)) == ("Cache plan", "project-note", "active", "2024-01-02", "2024-02-01")
    assert (plan.tags, plan.aliases, plan.related) == (["cache", "spring-boot"], ["Caching"], ["[[Index]]", "[[Index]]", "plain"])
    assert rows["20-Learning/Dup.md"].date is None  # no such day
    assert rows["10-Work/crlf.md"].title == "CR" and rows["10-Work/crlf.md"].body_start_line == 5
    assert rows["20-Learning/2024-03-01 Talk.md"].title == "2024-03-01 Talk"
    assert rows["20-Learning/bare.md"].unclosed_fence and not rows["20-Learning/bare.md"].has_meta


def test_lines_tasks_links_sections(notes):
    lines = M.note_lines(notes).cache()
    tasks = {(r.text, r.checked, r.in_next_actions, r.heading) for r in M.tasks_of(lines, ("Next Actions",)).collect()}
    assert tasks == {("write the limiter", False, True, "Next Actions"), ("read the paper", True, True, "Next Actions"), ("later", False, False, "Notes")}
    found = {(r.source, r.name) for r in M.links_of(lines).collect()}
    assert ("10-Work/Cache plan.md", "index") in found and not any(n == "nowhere" for _, n in found)
    sections = {r.section: r.text for r in M.sections_of(lines, ("Notes",)).collect()}
    assert sections["Notes"].startswith("See [[Index|the index]]")
    passages = [(r.heading, r.start_line, r.end_line) for r in M.passages_of(notes).filter("path = '10-Work/Cache plan.md'").orderBy("passage_no").collect()]
    assert passages == [("Cache plan", 0, 3), ("Next Actions", 3, 10), ("Notes", 10, 13)]


def test_link_states(notes):
    keys = links.link_keys(notes)
    edges = M.links_of(M.note_lines(notes))
    resolved = links.resolve(edges, keys)
    got = {(r.source.split("/")[-1], r.name): (r.state, r.target) for r in resolved.collect()}
    assert got["Index.md", "cache plan"] == ("resolved", "10-Work/Cache plan.md")
    assert got["Index.md", "dup"] == ("ambiguous", None) and got["Index.md", "missing"] == ("unresolved", None)
    alone = {r.path for r in links.orphans(notes.select("path"), resolved, notes.filter("type = 'moc'").select("path")).collect()}
    assert "10-Work/Dup.md" in alone and "10-Work/Cache plan.md" not in alone
    assert [r.neighbour for r in links.neighbourhood(resolved, "10-Work/Index.md").collect()] == ["10-Work/Cache plan.md"]
    talk = resolved.filter("state = 'unresolved'").limit(0).unionByName(resolved.sparkSession.createDataFrame([("a.md", 1, "talk", "body", "unresolved", None, 0)], "source string, line int, name string, origin string, state string, target string, n_targets long"))
    assert [r.path for r in links.undated_matches(talk, notes).collect()] == ["20-Learning/2024-03-01 Talk.md"]


def test_audit_of_the_vault(notes):
    types = ("project-note", "moc", "learning-note", "web-clip", "insight-note")
    ready = notes.withColumn("content_chars", X.content_chars(F.col("body")))
    found = audit.findings(ready, audit.metadata_rules(types))
    codes = {(r.path.split("/", 1)[-1], r.code) for r in found.collect()}
    assert {("broken.md", "invalid-frontmatter"), ("bare.md", "missing-frontmatter"), ("bare.md", "unclosed-fence"), ("Dup.md", "web-clip-captured-nothing"), ("Dup.md", "too-many-tags"), ("Dup.md", "invalid-tag"), ("Dup.md", "missing-date"), ("Dup.md", "web-clip-missing-source")} <= codes
    assert ("Index.md", "missing-date") not in codes and ("Index.md", "missing-tags") in codes
    assert {r.severity for r in audit.by_severity(found).collect()} <= {"defect", "hygiene"}
    related = notes.select("path", F.posexplode("related").alias("position", "entry")).withColumn("is_list", F.lit(True))
    assert {(r.code, r.message) for r in audit.related_rules(related).collect()} == {("duplicate-related-entry", "[[Index]]"), ("invalid-related-entry", "plain")}
    resolved = links.resolve(M.links_of(M.note_lines(notes)), links.link_keys(notes))
    history = notes.sparkSession.createDataFrame([("gone",)], "name string")
    broken = {(r.message, r.code) for r in audit.wikilink_findings(resolved, links.undated_matches(resolved, notes), history).filter("path like '%Index.md'").collect()}
    assert broken == {("dup", "ambiguous-wikilink")}  # same line: nothing after it by name but missing and gone
    free = resolved.filter("name <> 'dup'")
    later = {(r.message, r.code) for r in audit.wikilink_findings(free, links.undated_matches(free, notes), history).filter("path like '%Index.md'").collect()}
    assert later == {("missing", "link-to-unwritten-note"), ("gone", "broken-wikilink")}


def test_ordered_headings(spark):
    df = spark.createDataFrame([(["a", "x", "b", "c"],), (["b", "a", "c"],), ([],)], "h array<string>")
    assert [r[0] for r in df.select(audit.ordered_headings(F.col("h"), ["a", "b", "c"])).collect()] == [True, False, False]


def test_tokens(spark):
    cases = {"Hello, World-42": ["hello", "world", "42"], "知识库检索": ["知识", "识库", "库检", "检索"], "知 ab知": ["知", "ab", "知"], "éte": ["te"], "": [], None: []}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.k for r in df.select("t", X.tokenize(F.col("t")).alias("k")).collect()} == cases


def test_small_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert [one(X.tag_key(F.lit(t))) for t in ("Spring-Boots", "front_end", "css", "s")] == ["springboot", "frontend", "cs", "s"]
    assert one(X.link_target(F.lit("A b#c|d"))) == "A b" and one(X.link_label(F.lit("A#b|see"))) == "see"
    assert one(X.undated(F.lit("2024-01-02 Talk"))) == "Talk" and one(X.safe_filename(F.lit('..a/b:c?.'))) == "a_b_c_"
    assert one(X.title_tokens(F.lit("The Cache 42 notes x 知识库"))) == ["the", "cache", "知识", "识库"]
    assert one(M.without_comments(F.lit("a<!-- x\ny -->b<!-- open\n"))) == "a\nb\n"
    assert one(X.holds_fact(F.lit("It is, 42 % more!"), F.lit("is 42%"))) is True
    assert one(X.has_cjk(F.lit("a知"))) is True
    assert one(X.content_chars(F.lit("# h\na b\n\n c"))) == 3


def test_config_contracts():
    good = json.dumps({"schema_version": 1, "concepts": [{"id": "a", "terms": ["cache stampede", "缓存击穿"]}, {"id": "b", "terms": ["limit", "cache stampede"]}]})
    concepts = config.load_lexicon(good)
    assert config.duplicate_terms(concepts) == {"cache stampede": ["a", "b"]}
    for bad in ("{", "{}", json.dumps({"schema_version": 1, "concepts": [{"id": "A", "terms": ["x1", "y1"]}]}), json.dumps({"schema_version": 1, "concepts": [{"id": "a", "terms": ["one"]}]})):
        with pytest.raises(config.ConfigError):
            config.load_lexicon(bad)
    views = config.load_views(json.dumps({"schema_version": 1, "views": [{"id": "v", "query": "q", "types": ["moc"], "date_field": "date", "window_days": 30}]}))
    filters = views["v"].filters("2024-03-01")
    assert (filters.after, filters.before) == ("2024-02-01", "2024-03-01")
    for bad in ([{"id": "v", "query": " "}], [{"id": "v", "query": "q", "odd": 1}], [{"id": "v", "query": "q"}] * 2, [{"id": "v", "query": "q", "window_days": 3}]):
        with pytest.raises(config.ConfigError):
            config.load_views(json.dumps({"schema_version": 1, "views": bad}))


def test_code_blocks_and_masks(spark):
    body = "a\n```sh\none\n```\n```\ntwo\n\nthree\n```\nb\n~~~\nopen"
    notes = spark.createDataFrame([("n", body)], "path string, body string").withColumn("lines", M.lines_of("body"))
    blocks = M.code_blocks(M.note_lines(notes)).orderBy("from").collect()
    assert [(r["from"], r["to"], r["text"]) for r in blocks] == [(2, 4, "one"), (5, 9, "two\n\nthree"), (11, 12, "open")]
    masked = notes.select(M.mask_code("body")).first()[0]
    assert len(masked) == len(body) and masked.split() == ["a", "b"]


def test_template_contracts(spark):
    rows = [
        ("ok", "digest", "2024-06-01", ["A", "x", "B"], {"Card": "Goal: win\n- **Next:** go"}, []),
        ("bad", "digest", None, ["B", "A"], {"Card": "Goal:\n" + "l\n" * 13}, ["Write clear success criteria, then delete this"]),
        ("old", "digest", "2023-01-01", [], None, []),
    ]
    notes = spark.createDataFrame(rows, "path string, type string, date string, headings array<string>, sections map<string,string>, comments array<string>").withColumn("date", F.to_date("date"))
    rules = audit.template_rules({"digest": ["A", "B"]}, {"digest": "2024-01-01"}, ("Goal", "Next"), "Card")
    assert {(r.path, r.code, r.message if "field" in r.code else "") for r in audit.findings(notes, rules).collect()} == {
        ("bad", "missing-template-heading", ""), ("bad", "residual-template-instruction", ""), ("bad", "conversation-digest-resume-card-too-long", ""),
        ("bad", "conversation-digest-missing-resume-field", "Goal"), ("bad", "conversation-digest-missing-resume-field", "Next"),
    }

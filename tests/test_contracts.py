"""Template contracts by locale and date, cards of digests, queue issues, quoted paths, edges of a note."""

from __future__ import annotations

import datetime

import pytest
from notelens.operators import audit, contracts, links, resume, reviews
from notelens.sources import history
from pyspark.sql import functions as F

NOTES = "path string, type string, date date, headings array<string>, sections map<string,string>"
EN, ZH = (list(c[4]) for c in (contracts.CONTRACTS[1], contracts.CONTRACTS[0]))
DIGEST_ZH, DIGEST_EN = (list(c[4]) for c in contracts.CONTRACTS[2:])
CARD_EN = "".join(f"- **{name}**: x\n" for name in contracts.CARD_LABELS["en"])
CARD_ZH = "".join(f"* **{name}**： 是\n" for name in contracts.CARD_LABELS["zh-CN"])
NEW, OLD = datetime.date(2026, 8, 1), datetime.date(2026, 7, 28)


def codes(df):
    return sorted((r.path, r.code) for r in df.collect())


@pytest.fixture(scope="module")
def table(spark):
    return contracts.contract_table(spark)


@pytest.mark.parametrize("locale", ["en", "zh-CN"])
def test_headings_of_notes_by_locale_and_date(spark, table, locale):
    capture, digest = (EN, DIGEST_EN) if locale == "en" else (ZH, DIGEST_ZH)
    rows = [
        ("whole", "web-clip", NEW, ["Extra", *capture[:3], "More", *capture[3:]], None), ("lacking", "web-clip", NEW, capture[1:], None), ("turned", "web-clip", NEW, capture[::-1], None), ("none", "web-clip", None, [], None),
        ("early", "web-clip", datetime.date(2026, 7, 26), [], None), ("Templates/x.md", "web-clip", NEW, [], None), ("other", "log", NEW, [], None),
        ("d-whole", "conversation-digest", NEW, digest, None), ("d-lacking", "conversation-digest", NEW, digest[:-1], None), ("d-early", "conversation-digest", OLD, [], None), ("mixed", "conversation-digest", NEW, [*DIGEST_EN[:2], *DIGEST_ZH[2:]], None),
    ]
    got = codes(contracts.heading_findings(spark.createDataFrame(rows, NOTES).repartition(3), table))
    assert got == [("d-lacking", "missing-conversation-digest-heading"), ("lacking", "missing-deep-capture-heading"), ("mixed", "missing-conversation-digest-heading"), ("none", "missing-deep-capture-heading"), ("turned", "missing-deep-capture-heading")]


def test_cards_of_digests(spark, table):
    note = lambda path, headings, card, day=NEW: (path, "conversation-digest", day, headings, {headings[0]: card})
    rows = [
        note("good", DIGEST_EN, CARD_EN + "<!-- - **Goal**: y\n" + "\n" * 20 + "-->"), note("gut", DIGEST_ZH, CARD_ZH), note("long", DIGEST_EN, CARD_EN + "a\n\n" * 8), note("empty", DIGEST_EN, CARD_EN.replace("**Goal**: x", "**goal** :  ").replace("- **State**: x\n", "State: x\n")),
        note("commented", DIGEST_EN, "<!-- " + CARD_EN + "-->"), note("early", DIGEST_EN, "", OLD), note("other", DIGEST_EN[1:], ""),
    ]
    found = contracts.card_findings(spark.createDataFrame(rows, NOTES), table).collect()
    assert sorted((r.path, r.code, r.message) for r in found) == [
        ("commented", "conversation-digest-missing-resume-field", ", ".join(contracts.CARD_LABELS["en"])), ("empty", "conversation-digest-missing-resume-field", "Goal, State"), ("long", "conversation-digest-resume-card-too-long", "13"),
    ]


def test_templates_out_of_date(spark, table):
    blank = CARD_EN.replace(" x", "")
    rows = [("Templates/Web Clip.md", EN[:4], {}), ("Templates/Digest Note.md", DIGEST_EN, {DIGEST_EN[0]: blank}), ("Templates/Log.md", [], {})]
    kind = "path string, headings array<string>, sections map<string,string>"
    found = contracts.template_findings(spark.createDataFrame(rows, kind), table).collect()
    assert [(r.path, r.code, r.severity) for r in found] == [("Templates/Web Clip.md", "outdated-deep-capture-template", "defect")]
    rows[1] = ("Templates/Digest Note.md", DIGEST_EN, {DIGEST_EN[0]: blank.replace("Key artifacts", "Artifacts")})
    found = contracts.template_findings(spark.createDataFrame(rows[1:], kind), table).collect()
    assert [(r.code, r.message) for r in found] == [("outdated-conversation-digest-template", "Key artifacts")]


def test_instructions_left_by_a_template(spark):
    rules = audit.template_rules({}, {})
    rows = [("a", ["Write  Clear\nsuccess criteria here"]), ("b", ["an instruction to myself"]), ("c", []), ("d", ["x", "写清成功标准。"])]
    assert codes(audit.findings(spark.createDataFrame(rows, "path string, comments array<string>"), rules)) == [("a", "residual-template-instruction"), ("d", "residual-template-instruction")]


def test_queue_passes_over_future_projects_and_templates(spark):
    day = datetime.date
    rows = [("blocked", " Blocked ", day(2024, 5, 30), "project"), ("late", "active", day(2024, 6, 2), "project"), ("form", "Template", None, "project"), ("none", None, None, "project"), ("done", "Done", day(2020, 1, 1), "project"), ("log", "blocked", None, "log"), ("fresh", "active", day(2024, 5, 31), "project")]
    projects = spark.createDataFrame([(p, s, u, None, t) for p, s, u, t in rows], "path string, status string, updated date, date date, type string")
    tasks = spark.createDataFrame([], "path string, line int, text string, checked boolean, in_next_actions boolean")
    queue = reviews.project_queue(projects, tasks, "2024-06-01")
    assert {(r.path, r.status, r.priority) for r in queue.collect()} == {("blocked", "blocked", 0), ("none", "unknown", 1)}
    assert codes(reviews.project_issues(projects, "2024-06-01")) == [("late", "future-activity-date")]
    assert tuple(reviews.queue_summary(projects, queue, "2024-06-01").first()) == (5, 1, 1, 2)


def test_quoted_paths_have_one_reading(spark, tmp_path):
    cases = {r'"a\347\237\245 \"b\".md"': 'a知 "b".md', "plain.md": "plain.md", r'"tab\tbell\a\\x.md"': "tab\tbell\x07\\x.md", '"': '"', '""': "", r'"\303\050.md"': "�(.md", None: None}
    got = {r.q: r.p for r in spark.createDataFrame([(c,) for c in cases], "q string").select("q", resume.git_path(F.col("q")).alias("p")).collect()}
    assert got == cases
    names = "\n".join(["2024-01-02", "", r'"a\347\237\245.md"', "b.md"])
    (tmp_path / "log").write_text(f"\0{names}\n\0002024-02-03\n\nb.md\n\0002024-03-04\n")
    assert {(r.path, str(r.revised)) for r in history.read_log(spark, f"file://{tmp_path}/log").collect()} == {("a知.md", "2024-01-02"), ("b.md", "2024-01-02"), ("b.md", "2024-02-03")}


def test_edges_of_a_note_hold_what_does_not_resolve(spark):
    kind = "source string, line int, name string, origin string, state string, target string, n_targets long"
    rows = [("s", 1, "a", "body", "resolved", "a", 1), ("s", 2, "zz", "body", "unresolved", None, 0), ("s", None, "dup", "related", "ambiguous", None, 2), ("b", 4, "s", "body", "resolved", "s", 1), ("c", 5, "s", "body", "resolved", "s", 1), ("s", 9, "s", "body", "resolved", "s", 1), ("x", 1, "yy", "body", "unresolved", None, 0)]
    resolved = spark.createDataFrame(rows, kind)
    got = [(r.neighbour, r.name, r.direction, r.state) for r in links.neighbourhood_edges(resolved, "s", max_nodes=2).collect()]
    assert got == [("a", "a", "out", "resolved"), ("b", "s", "in", "resolved"), (None, "dup", "out", "ambiguous"), (None, "zz", "out", "unresolved")]
    assert [r.direction for r in links.neighbourhood_edges(resolved, "s", "in").collect()] == ["in", "in"]

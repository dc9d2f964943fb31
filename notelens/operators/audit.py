"""The audit framework: a rule is a code, a severity and a predicate; rules over all notes are plans of their own."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notelens.operators import receipts

# Severities by code; codes not listed are hygiene.
SEVERITY = {
    "defect": (
        "missing-frontmatter", "invalid-frontmatter", "missing-type", "invalid-type", "missing-date", "unclosed-fence", "empty-template-note", "residual-template-instruction", "unresolved-template-placeholder",
        "outdated-deep-capture-template", "outdated-conversation-digest-template", "broken-wikilink", "invalid-related", "invalid-related-entry", "duplicate-project-note", "duplicate-folder-index",
        "duplicate-folder-index-content", "graph-incompatible-index-config", "broken-folder-graph-chain", "web-clip-invalid-capture-depth", "web-clip-captured-nothing",
    ),
    "informational": ("link-to-unwritten-note", "similar-title", "orphan-note", "disconnected-note"),
}
SEVERITY_OF = {code: level for level, codes in SEVERITY.items() for code in codes}
TAG = "^[a-z0-9]+(-[a-z0-9]+)*$"


def severity(code: str) -> str:
    return SEVERITY_OF.get(code, "hygiene")


@dataclass(frozen=True)
class Rule:
    """Each element of ``messages`` (an array of texts, one for each time the note breaks the rule) is a finding."""

    code: str
    messages: Column


def once(code: str, predicate: Column, message: str) -> Rule:
    return Rule(code, F.when(F.coalesce(predicate, F.lit(False)), F.array(F.lit(message))).otherwise(F.array().cast("array<string>")))


def findings(notes: DataFrame, rules: list[Rule]) -> DataFrame:
    """One pass over the notes: code, severity, path, message."""
    return notes.select("path", F.inline(F.concat(*map(_structs, rules)))).select("code", "severity", "path", "message")


def _structs(rule: Rule) -> Column:
    return F.transform(rule.messages, lambda m: F.struct(F.lit(rule.code).alias("code"), F.lit(severity(rule.code)).alias("severity"), m.alias("message")))


def metadata_rules(types: tuple[str, ...], undated_types: tuple[str, ...] = ("moc", "folder-index")) -> list[Rule]:
    """Rules for notes with columns issue, type, date, tags (array or null), unclosed_fence."""
    known, kind = F.col("issue").isNull() & F.col("has_meta"), F.coalesce("type", F.lit(""))
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    return [
        once("missing-frontmatter", F.col("issue").isNull() & ~F.col("has_meta"), "no metadata block"),
        once("invalid-frontmatter", F.col("issue").isNotNull(), "the metadata block cannot be read"),
        once("missing-type", known & (kind == ""), "no type"),
        once("invalid-type", known & (kind != "") & ~kind.isin(*types), "unknown type"),
        once("missing-date", known & F.col("date").isNull() & ~kind.isin(*undated_types), "no date"),
        once("missing-tags", known & (F.size(tags) == 0), "no tags"),
        once("too-many-tags", known & (F.size(tags) > 5), "more than five tags"),
        Rule("invalid-tag", F.when(known, F.filter(tags, lambda t: ~t.rlike(TAG))).otherwise(F.array().cast("array<string>"))),
        once("unclosed-fence", F.col("unclosed_fence"), "a code fence is not closed"),
        once("unresolved-template-placeholder", F.col("visible").rlike(r"\{\{[^{}\n]+\}\}"), "a template placeholder is left"),
        once("empty-template-note", F.col("has_heading") & (F.col("content_chars") == 0) & ~kind.isin(*undated_types), "headings without content"),
        once("web-clip-captured-nothing", (kind == "web-clip") & (F.col("content_chars") < 400) & ~F.array_contains(tags, "incomplete"), "under 400 characters of content"),
        *web_clip_rules(),
    ]


def related_rules(related: DataFrame) -> DataFrame:
    """related(path, position, entry, is_list): invalid-related, invalid-related-entry, duplicate-related-entry."""
    inner = F.regexp_extract(F.trim("entry"), r"^\[\[(.*)\]\]$", 1)
    target = F.lower(F.trim(F.regexp_extract(inner, r"^([^|#^]*)", 1)))
    order = Window.partitionBy("path", "target").orderBy("position")
    listed = related.filter("is_list").withColumn("target", target)
    bad = listed.filter(F.coalesce("target", F.lit("")) == "").select("path", F.lit("invalid-related-entry").alias("code"), F.col("entry").alias("message"))
    again = listed.filter(F.coalesce("target", F.lit("")) != "").withColumn("n", F.row_number().over(order)).filter("n > 1").select("path", F.lit("duplicate-related-entry").alias("code"), F.col("entry").alias("message"))
    whole = related.filter("not is_list").select("path", F.lit("invalid-related").alias("code"), F.lit("related is no list").alias("message"))
    return bad.unionByName(again).unionByName(whole)


def wikilink_findings(resolved: DataFrame, dated: DataFrame, history: DataFrame | None) -> DataFrame:
    """Findings of links: broken, ambiguous or to a note never written. After its first ambiguous link the rest of
    a note goes unchecked. ``history`` (name) holds names that once existed; without it every miss is broken."""
    cutoff = Window.partitionBy("source").orderBy("line", "name")
    first = F.min(F.when(F.col("state") == "ambiguous", F.struct("line", "name"))).over(Window.partitionBy("source"))
    kept = resolved.withColumn("cut", first).filter(F.col("cut").isNull() | (F.struct("line", "name") <= F.col("cut"))).filter("state <> 'resolved'").withColumn("place", F.row_number().over(cutoff))
    seen = kept.join(dated.select("source", "name").distinct().withColumn("dated", F.lit(True)), ["source", "name"], "left")
    once_there = history.select("name").distinct().withColumn("existed", F.lit(True)) if history is not None else None
    seen = seen.join(once_there, "name", "left") if once_there is not None else seen.withColumn("existed", F.lit(True))
    code = F.when(F.col("state") == "ambiguous", "ambiguous-wikilink").when(F.coalesce("dated", F.lit(False)) | F.coalesce("existed", F.lit(False)), "broken-wikilink").otherwise("link-to-unwritten-note")
    return seen.select(F.col("source").alias("path"), code.alias("code"), F.col("name").alias("message"))


def ordered_headings(present: Column, required: list[str]) -> Column:
    """JN-16: whether the required headings occur in order among those present."""
    want = F.array(*map(F.lit, required))
    reached = F.aggregate(present, F.lit(0), lambda i, h: F.when(F.get(want, i) == h, i + 1).otherwise(i))
    return reached == len(required)


def by_severity(found: DataFrame) -> DataFrame:
    """AGG-13."""
    return found.groupBy("severity").agg(F.count(F.lit(1)).alias("findings"))


def duplicate_titles(notes: DataFrame) -> DataFrame:
    """code, severity, path, message: notes(path, title) that share a title with others."""
    key = F.lower(F.trim("title"))
    several = notes.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return notes.withColumn("key", key).join(several, "key").select(F.lit("duplicate-title").alias("code"), F.lit(severity("duplicate-title")).alias("severity"), "path", F.col("key").alias("message"))


def template_rules(required: dict[str, list[str]], contracts: dict[str, str], labels: tuple[str, ...] = (), card: str | None = None, card_lines: int = 12) -> list[Rule]:
    """Rules of template contracts for notes with columns type, date, headings (names in order), sections (map of name
    to visible text) and comments. ``required`` gives the headings of a type; FLT-10: a note dated before its type's
    contract date is exempt, one without a date is not."""
    from notelens.operators.contracts import instruction_left

    rules = []
    for kind, headings in required.items():
        early = F.coalesce(F.col("date") < F.lit(contracts.get(kind, "0001-01-01")).cast("date"), F.lit(False))
        rules.append(once("missing-template-heading", (F.col("type") == kind) & ~early & ~ordered_headings(F.col("headings"), headings), f"headings of {kind} are missing or out of order"))
    rules.append(once("residual-template-instruction", F.exists("comments", instruction_left), "an instruction of the template is left"))
    if card:
        text = F.coalesce(F.element_at("sections", F.lit(card)), F.lit(""))
        shown = F.size(F.filter(F.split(text, "\n", -1), lambda ln: F.trim(ln) != ""))
        rules.append(once("conversation-digest-resume-card-too-long", shown > card_lines, f"more than {card_lines} lines"))
        lacking = F.filter(F.array(*map(F.lit, labels)).cast("array<string>"), lambda n: ~F.exists(F.split(text, "\n", -1), lambda ln: ln.rlike(r"^[-*\s]*\**") & F.ltrim(F.regexp_replace(ln, r"^[-*\s]+", "")).startswith(F.concat(n, F.lit(":"))) & (F.trim(F.regexp_replace(F.split_part(ln, F.lit(":"), F.lit(2)), r"\*", "")) != "")))
        rules.append(Rule("conversation-digest-missing-resume-field", F.when(F.col("sections").isNotNull() & F.array_contains(F.map_keys("sections"), card), lacking).otherwise(F.array().cast("array<string>"))))
    return rules


def duplicate_project_notes(notes: DataFrame, listed: int = 20) -> DataFrame:
    """AGG-12: notes(path, entity_folder, instance) of which several stand in one instance directory: a finding for each
    directory with the first paths. Paths are gathered up to the bound; the count is of all."""
    place = Window.partitionBy("entity_folder", "instance").orderBy("path")
    several = notes.groupBy("entity_folder", "instance").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    first = notes.join(several, ["entity_folder", "instance"]).withColumn("place", F.row_number().over(place)).filter(F.col("place") <= listed)
    named = first.groupBy("entity_folder", "instance", "n").agg(F.array_join(F.transform(F.array_sort(F.collect_list("path")), lambda p: p.cast("string")), ", ").alias("paths"))
    return named.select(F.lit("duplicate-project-note").alias("code"), F.lit(severity("duplicate-project-note")).alias("severity"), F.concat_ws("/", "entity_folder", "instance").alias("path"), F.concat(F.col("n").cast("string"), F.lit(" notes: "), F.col("paths")).alias("message"))


CAPTURE_DEPTHS = ("standard", "verified")


def web_clip_rules() -> list[Rule]:
    """Rules of web clips for notes with columns type, source and meta (a variant): each required field must say something."""
    clip = F.col("type") == "web-clip"
    value = lambda key: F.try_variant_get("meta", f"$.{key}", "string")
    kind = lambda key: F.schema_of_variant(F.try_variant_get("meta", f"$.{key}", "variant"))
    empty = lambda key: receipts.placeholder_metadata(value(key)) | F.coalesce(kind(key) == "BOOLEAN", F.lit(False))
    depth = value("capture_depth")
    return [
        once("web-clip-missing-source", clip & (empty("source") | F.coalesce(kind("source") != "STRING", F.lit(True))), "no source"),
        once("web-clip-missing-author", clip & empty("author"), "no author"),
        once("web-clip-missing-published", clip & empty("published"), "no date of publication"),
        once("web-clip-invalid-capture-depth", clip & depth.isNotNull() & ~depth.isin(*CAPTURE_DEPTHS), "capture_depth is standard or verified"),
    ]

"""All refusals of a receipt of a capture (QRY-26), as ranked rules.

A receipt is JSON beside the note it vouches for. Rules stand in a fixed order; those on the entries of a list come entry by
entry. Each rule that is broken gives (step, entry, place, code) and the least of them is the refusal, so no rule needs to
know of another. Profiles are contracts: which kinds of evidence and of artifact each asks for. Everything a rule needs
lies in the row, so receipts are judged where they stand.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notelens.functions.markdown import parse_meta, prose_text, reader_text, section_texts
from notelens.operators.receipts import rendered_digest, says_nothing, uncovered_metric

MAX_BYTES = 1 << 20
# Profiles with the kinds of evidence and of artifact that they ask for, and what else a kind can be.
PROFILES = {
    "conceptual-opinion": (("causal-claim", "application-method", "boundary", "counterexample"), "application-method"),
    "research-evidence": (("decision-implication", "evidence", "limitation", "measurement-context", "uncertainty"), "decision-method"),
    "resource-survey": (("canonical-link", "compatibility", "limitation", "selection-criteria", "starting-example"), "selection-decision"),
    "tutorial-procedure": (("prerequisite", "procedure", "verification", "failure-mode"), "reproducible-procedure"),
}
OTHER_KINDS = ("assumption", "code", "command", "configuration", "dependency", "parameter", "result", "risk", "version")
KINDS = tuple(sorted({*OTHER_KINDS, *(k for kinds, _ in PROFILES.values() for k in kinds)}))
SURVEY, RESOURCE_KINDS = "resource-survey", ("canonical-link", "compatibility", "limitation")
PROVENANCE = {"primary-source": "primary", "source-self-report": "primary", "supplemental-primary": "supplemental", "calculation": "any"}
INVENTORY = ("resource inventory", "资源清单")
SLUG, HTTP = "^[a-z0-9][a-z0-9-]{0,63}$", r"^https?://[^/?#\s]+"
INVENTORY_URL = r"https?://[^\s<>()\[\]{}\"']+"
SCHEMA = """schema_version int, content_sha256 string, profile string, profiles array<string>, source_access string, primary_sources array<string>, supplemental_sources array<string>,
resources array<struct<id:string,name:string,canonical_url:string>>, unresolved_items array<string>,
material_items array<struct<id:string,kind:string,status:string,source:string,resource_id:string,note_anchor:string>>,
numeric_claims array<struct<note_excerpt:string,provenance:string,source:string,measurement_context:string>>,
inferences array<struct<note_excerpt:string,basis:string,label:string>>, practical_artifact struct<kind:string,note_anchor:string>"""
INVALID = "invalid-capture-receipt"
READ = T.StructType([T.StructField("reader", T.StringType()), T.StructField("prose", T.StringType()), T.StructField("inventories", T.ArrayType(T.StringType()))])


@F.pandas_udf(READ)
def candidate(rendered: pd.Series) -> pd.DataFrame:
    """What a reader sees of a note, its prose alone, and its resource inventories."""
    rows = []
    for text in rendered:
        body = parse_meta(text)[4]
        shown = reader_text(body)
        rows.append((shown, prose_text(body), section_texts(shown, INVENTORY)))
    return pd.DataFrame(rows, columns=READ.names)


def _in(value: Column, words) -> Column:
    return F.coalesce(value.isin(*words), F.lit(False))


def _true(rule: Column) -> Column:
    return F.coalesce(rule, F.lit(False))


def _entries(step: int, items: Column, rules) -> Column:
    """Refusals of the entries of a list: rules(entry, index) gives (broken, code) in order."""
    def of(x: Column, i: Column) -> Column:
        out = F.lit(None).cast("struct<step:int,entry:int,place:int,code:string>")
        for place, (broken, code) in reversed(list(enumerate(rules(x, i)))):
            out = F.when(broken, F.struct(F.lit(step).alias("step"), i.alias("entry"), F.lit(place).alias("place"), F.lit(code).alias("code"))).otherwise(out)
        return out

    return F.array_compact(F.transform(items, of))


def _steps(rules: list[tuple[int, Column, str]]) -> Column:
    each = [F.when(_true(broken), F.struct(F.lit(step).alias("step"), F.lit(0).alias("entry"), F.lit(0).alias("place"), F.lit(code).alias("code"))) for step, broken, code in rules]
    return F.array_compact(F.array(*each))


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def _vague(values: pd.Series) -> pd.Series:
    return pd.Series([None if vs is None else [says_nothing(v) for v in vs] for vs in values])


def refuse(receipts: DataFrame) -> DataFrame:
    """receipts(path, receipt JSON, rendered, depth, source): path, code (null where nothing is refused), step and entry."""
    r = F.col("r")
    field = lambda items, name: F.transform(items, lambda x: x[name])
    empty = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    strings = lambda c: empty(c, "array<string>")
    df = receipts.withColumn("r", F.from_json("receipt", SCHEMA)).withColumn("v", F.try_parse_json("receipt")).withColumn("c", candidate("rendered"))
    kind = F.schema_of_variant("v")
    df = df.withColumns({
        "profiles": F.when(r["profile"].isNotNull(), F.array(r["profile"])).otherwise(strings(r["profiles"])), "primary": strings(r["primary_sources"]), "extra": strings(r["supplemental_sources"]),
        "resources": r["resources"], "items": r["material_items"], "claims": r["numeric_claims"], "inferences": r["inferences"], "reader": F.col("c.reader"), "inventory": F.get("c.inventories", F.lit(0)),
    })
    df = df.withColumns({
        "names_vague": _vague(field(F.col("resources"), "name")), "contexts_vague": _vague(field(F.col("claims"), "measurement_context")),
        "bases_vague": _vague(field(F.col("inferences"), "basis")), "labels_vague": _vague(field(F.col("inferences"), "label")),
        "uncovered": uncovered_metric(F.col("c.prose"), field(F.col("claims"), "note_excerpt")),
        "ids": field(F.col("resources"), "id"), "names": field(F.col("resources"), "name"), "urls": field(F.col("resources"), "canonical_url"),
        "listed": F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce("inventory", F.lit("")), F.lit(INVENTORY_URL), F.lit(0)), lambda u: F.regexp_replace(u, "[.,;:!?，。；：！？]+$", ""))),
    })
    survey = F.array_contains("profiles", SURVEY)
    http = lambda u: _true(u.rlike(HTTP))
    repeated = lambda a: F.size(F.array_distinct(a)) < F.size(a)
    before = lambda a, x, i: F.array_contains(F.slice(a, F.lit(1), F.greatest(i, F.lit(0))), x)
    unanchored = lambda t: [(F.coalesce(F.trim(t) == "", F.lit(True)), INVALID), (~F.contains(F.col("reader"), t), "missing-receipt-anchor")]
    sources = F.concat("primary", "extra")
    kinds = strings(field(F.col("items"), "kind"))
    lacking = F.lit(False)
    for name, (needed, _) in PROFILES.items():
        lacking = lacking | (F.array_contains("profiles", name) & (F.size(F.array_except(F.array(*map(F.lit, needed)), kinds)) > 0))
    evidence = lambda rid: F.array_distinct(F.transform(F.filter("items", lambda m: _true(m["resource_id"] == rid)), lambda m: m["kind"]))
    artifacts = F.array_compact(F.array(*[F.when(F.array_contains("profiles", name), F.lit(a)) for name, (_, a) in PROFILES.items()]))
    practical = r["practical_artifact"]
    steps = _steps([
        (0, F.octet_length("receipt") > MAX_BYTES, "capture-receipt-too-large"), (1, F.col("v").isNull(), "invalid-capture-receipt-json"), (2, ~kind.startswith("OBJECT"), INVALID),
        (3, F.coalesce(F.col("depth") != "verified", F.lit(True)), "capture-receipt-depth-mismatch"), (4, F.coalesce(r["schema_version"] != 1, F.lit(True)), INVALID),
        (5, F.coalesce(r["content_sha256"] != rendered_digest(F.col("rendered")), F.lit(True)), "capture-receipt-content-mismatch"),
        (6, (r["profile"].isNotNull() & r["profiles"].isNotNull()) | (F.size("profiles") == 0) | F.exists("profiles", lambda p: ~_in(p, PROFILES)) | repeated(F.col("profiles")) | (F.col("profiles") != F.array_sort("profiles")), INVALID),
        (7, F.coalesce(r["source_access"] != "complete", F.lit(True)), "incomplete-source-access"),
        (8, (F.size("primary") == 0) | F.exists("primary", lambda u: ~http(u)) | repeated(F.col("primary")), INVALID),
        (9, r["supplemental_sources"].isNull() | F.exists("extra", lambda u: ~http(u)) | repeated(F.col("extra")), INVALID), (10, F.arrays_overlap("primary", "extra"), INVALID),
        (11, ~F.coalesce(F.array_contains("primary", F.col("source")), F.lit(False)), "source-receipt-mismatch"),
        (12, survey & (F.size("c.inventories") > 1), INVALID), (13, survey & (F.size("c.inventories") == 0), "incomplete-resource-evidence"), (14, survey & (F.size(empty(F.col("ids"), "array<string>")) == 0), "incomplete-resource-evidence"),
        (16, survey & ((F.size(F.array_except("listed", "urls")) > 0) | (F.size(F.array_except("urls", "listed")) > 0)), "incomplete-resource-evidence"),
        (17, survey & F.exists("names", lambda n: ~F.contains(F.coalesce("inventory", F.lit("")), n)), "incomplete-resource-evidence"), (18, ~survey & F.try_variant_get("v", "$.resources", "variant").isNotNull() & ~F.is_variant_null(F.try_variant_get("v", "$.resources", "variant")), INVALID),
        (19, r["unresolved_items"].isNull(), INVALID), (20, F.size(strings(r["unresolved_items"])) > 0, "unresolved-material-items"), (21, F.col("items").isNull() | (F.size("items") == 0), INVALID),
        (23, lacking, "incomplete-profile-evidence"),
        (24, survey & F.exists(strings(F.col("ids")), lambda rid: F.size(F.array_except(F.array(*map(F.lit, RESOURCE_KINDS)), evidence(rid))) > 0), "incomplete-resource-evidence"),
        (25, F.col("claims").isNull(), INVALID), (27, F.col("uncovered"), "uncovered-numeric-claim"), (28, F.col("inferences").isNull(), INVALID),
        (30, practical.isNull() | ~F.coalesce(F.array_contains(artifacts, practical["kind"]), F.lit(False)), "missing-practical-artifact"),
        (31, F.coalesce(F.trim(practical["note_anchor"]) == "", F.lit(True)), INVALID), (32, ~F.contains("reader", practical["note_anchor"]), "missing-receipt-anchor"),
    ])
    resources = _entries(15, F.when(survey, F.col("resources")), lambda x, i: [
        (x.isNull(), INVALID), (~_true(x["id"].rlike(SLUG)) | before(F.col("ids"), x["id"], i), INVALID), (F.get("names_vague", i) | before(F.col("names"), x["name"], i), INVALID),
        (~http(x["canonical_url"]) | before(F.col("urls"), x["canonical_url"], i), INVALID), *unanchored(x["canonical_url"]),
    ])
    known = lambda rid: F.coalesce(F.array_contains(strings(F.when(survey, F.col("ids"))), rid), F.lit(False))
    items = _entries(22, F.col("items"), lambda x, i: [
        (x.isNull(), INVALID), (~_true(x["id"].rlike(SLUG)) | before(field(F.col("items"), "id"), x["id"], i), INVALID), (~_in(x["kind"], KINDS), INVALID), (F.coalesce(x["status"] != "resolved", F.lit(True)), "unresolved-material-items"),
        (~F.coalesce(F.array_contains(sources, x["source"]), F.lit(False)), INVALID), (x["resource_id"].isNotNull() & ~known(x["resource_id"]), INVALID),
        (survey & _in(x["kind"], RESOURCE_KINDS) & ~known(x["resource_id"]), "incomplete-resource-evidence"), *unanchored(x["note_anchor"]),
    ])
    origin = F.create_map(*[F.lit(x) for pair in PROVENANCE.items() for x in pair])
    allowed = lambda p: F.when(origin[p] == "primary", F.col("primary")).when(origin[p] == "supplemental", F.col("extra")).otherwise(sources)
    claims = _entries(26, F.col("claims"), lambda x, i: [
        (x.isNull(), INVALID), *unanchored(x["note_excerpt"]), (~_in(x["provenance"], PROVENANCE), "missing-numeric-provenance"),
        (~F.coalesce(F.array_contains(allowed(x["provenance"]), x["source"]), F.lit(False)), "missing-numeric-provenance"), (F.get("contexts_vague", i), "missing-measurement-context"),
    ])
    inferences = _entries(29, F.col("inferences"), lambda x, i: [
        (x.isNull(), INVALID), *unanchored(x["note_excerpt"]), (F.get("bases_vague", i), INVALID), (F.get("labels_vague", i) | ~F.contains(x["note_excerpt"], x["label"]), "unlabeled-inference"),
    ])
    none = "array<struct<step:int,entry:int,place:int,code:string>>"
    first = F.array_min(F.concat(steps, *[empty(e, none) for e in (resources, items, claims, inferences)]))
    return df.withColumn("first", first).select("path", F.col("first.code").alias("code"), F.col("first.step").alias("step"), F.col("first.entry").alias("entry"))

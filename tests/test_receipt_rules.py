"""A case for each refusal of a receipt, their order, and masks that keep every offset."""

from __future__ import annotations

import copy
import hashlib
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from notelens.functions import markdown
from notelens.operators import receipt_rules as R

A, B = "https://a.org/x", "https://b.org/y"
NOTE = f"""---
type: web-clip
---
# Clip
Intro `<!-- shown -->` <!-- hidden 99% -->
It takes 5 minutes, I infer.
## Resource Inventory
- Tool: {A}.
- Other {B}
### Inner
## After
```sh
run 30% <!-- code stays -->
```
See https://c.org/10%2Fz and `7 days`.
"""
KINDS = [k for kinds, _ in R.PROFILES.values() for k in kinds]


def good():
    return {
        "schema_version": 1, "content_sha256": hashlib.sha256(NOTE.encode()).hexdigest(), "profiles": ["resource-survey", "tutorial-procedure"], "source_access": "complete", "primary_sources": [A], "supplemental_sources": [B],
        "resources": [{"id": "tool", "name": "Tool", "canonical_url": A}, {"id": "other", "name": "Other", "canonical_url": B}], "unresolved_items": [],
        "material_items": [{"id": f"m{i}", "kind": k, "status": "resolved", "source": A, "note_anchor": "It takes", **({"resource_id": rid} if rid else {})} for i, (k, rid) in enumerate(
            [(k, r) for k in R.RESOURCE_KINDS for r in ("tool", "other")] + [(k, None) for k in ("selection-criteria", "starting-example", "prerequisite", "procedure", "verification", "failure-mode")])],
        "numeric_claims": [{"note_excerpt": "takes 5 minutes", "provenance": "primary-source", "source": A, "measurement_context": "one run"}],
        "inferences": [{"note_excerpt": "It takes 5 minutes, I infer.", "basis": "the text", "label": "I infer"}], "practical_artifact": {"kind": "selection-decision", "note_anchor": "Tool"},
    }


def changed(path, value):
    out = copy.deepcopy(good())
    at = out
    for key in path[:-1]:
        at = at[key]
    if value is None:
        del at[path[-1]]
    else:
        at[path[-1]] = value
    return out


I = R.INVALID
CASES = [
    ((), None, None), (("schema_version",), 2, I), (("content_sha256",), "0", "capture-receipt-content-mismatch"), (("profiles",), [], I), (("profiles",), ["tutorial-procedure", "resource-survey"], I), (("profiles",), ["resource-survey"] * 2, I),
    (("profiles",), ["poem"], I), (("profile",), "resource-survey", I), (("source_access",), "partial", "incomplete-source-access"), (("primary_sources",), [], I), (("primary_sources",), ["ftp://a"], I), (("primary_sources",), [A, A], I),
    (("supplemental_sources",), [A], I), (("supplemental_sources",), None, I), (("primary_sources",), ["https://z.org"], "source-receipt-mismatch"), (("resources",), [], "incomplete-resource-evidence"), (("resources", 1, "id"), "Tool!", I), (("resources", 1, "id"), "tool", I),
    (("resources", 0, "name"), "TBD", I), (("resources", 1, "name"), "Tool", I), (("resources", 1, "canonical_url"), "b.org", I), (("resources", 1, "canonical_url"), "https://nowhere.org", "missing-receipt-anchor"), (("resources", 1), {"id": "o", "name": "Other", "canonical_url": "https://c.org/10%2Fz"}, "incomplete-resource-evidence"),
    (("resources", 0, "name"), "Hammer", "incomplete-resource-evidence"), (("unresolved_items",), None, I), (("unresolved_items",), ["x"], "unresolved-material-items"), (("material_items",), [], I), (("material_items", 1, "id"), "m0", I), (("material_items", 1, "kind"), "poem", I),
    (("material_items", 2, "status"), "open", "unresolved-material-items"), (("material_items", 2, "source"), "https://z.org", I), (("material_items", 2, "resource_id"), "none", I), (("material_items", 2, "resource_id"), None, "incomplete-resource-evidence"), (("material_items", 2, "note_anchor"), "hidden 99%", "missing-receipt-anchor"),
    (("material_items", 2, "note_anchor"), " ", I), (("material_items", 7), {"id": "m7", "kind": "risk", "status": "resolved", "source": A, "note_anchor": "It takes"}, "incomplete-profile-evidence"), (("material_items", 0, "resource_id"), "other", "incomplete-resource-evidence"),
    (("numeric_claims",), None, I), (("numeric_claims", 0, "note_excerpt"), "takes 6 minutes", "missing-receipt-anchor"), (("numeric_claims", 0, "provenance"), "hearsay", "missing-numeric-provenance"), (("numeric_claims", 0, "source"), B, "missing-numeric-provenance"), (("numeric_claims", 0, "measurement_context"), "n/a", "missing-measurement-context"),
    (("numeric_claims",), [], "uncovered-numeric-claim"), (("inferences",), None, I), (("inferences", 0, "basis"), "unknown", I), (("inferences", 0, "label"), "guess", "unlabeled-inference"), (("inferences", 0, "note_excerpt"), "gone", "missing-receipt-anchor"),
    (("practical_artifact",), None, "missing-practical-artifact"), (("practical_artifact", "kind"), "decision-method", "missing-practical-artifact"), (("practical_artifact", "note_anchor"), "gone", "missing-receipt-anchor"), (("practical_artifact", "note_anchor"), "", I),
]


def judged(spark, rows):
    df = spark.createDataFrame([(str(i), t, n, d, A) for i, (t, n, d) in enumerate(rows)], "path string, receipt string, rendered string, depth string, source string")
    got = {int(r.path): r.code for r in R.refuse(df.repartition(3)).collect()}
    return [got[i] for i in range(len(rows))]


def test_every_refusal(spark):
    rows = [(json.dumps(changed(path, value) if path else good()), NOTE, "verified") for path, value, _ in CASES]
    got = judged(spark, rows)
    assert [(c[0], c[1], g) for c, g in zip(CASES, got, strict=True) if g != c[2]] == []


def test_refusals_of_the_file_and_the_note(spark):
    note = lambda text: (json.dumps(good() | {"content_sha256": hashlib.sha256(text.encode()).hexdigest()}), text, "verified")
    no_survey = {k: v for k, v in good().items() if k != "resources"} | {"profiles": ["tutorial-procedure"], "practical_artifact": {"kind": "reproducible-procedure", "note_anchor": "Clip"}}
    no_survey["material_items"] = [{k: v for k, v in m.items() if k != "resource_id"} for m in no_survey["material_items"]]
    rows = [
        (json.dumps(good()) + " " * (1 << 20), NOTE, "verified"), ("{", NOTE, "verified"), ("[1]", NOTE, "verified"), (json.dumps(good()), NOTE, "standard"), note(NOTE.replace("## Resource Inventory", "## Things")),
        note(NOTE + "## 资源清单\n"), note(NOTE.replace("after", "after 40% more")), note(NOTE + "another 3 days\n"), (json.dumps(no_survey), NOTE, "verified"), (json.dumps(no_survey | {"resources": []}), NOTE, "verified"), (None, NOTE, "verified"),
    ]
    assert judged(spark, rows) == [
        "capture-receipt-too-large", "invalid-capture-receipt-json", I, "capture-receipt-depth-mismatch", "incomplete-resource-evidence", I, None, "uncovered-numeric-claim", None, I, "invalid-capture-receipt-json",
    ]


def test_the_first_refusal_wins(spark):
    both = changed(("material_items", 3, "status"), "open")
    both["material_items"][1]["kind"] = "poem"
    later = changed(("inferences",), None) | {"source_access": "none"}
    assert judged(spark, [(json.dumps(both), NOTE, "verified"), (json.dumps(later), NOTE, "verified")]) == [I, "incomplete-source-access"]


PIECES = ["<!--", "-->", "`", "``", "```", "~~~", "\n", "\r\n", " ", "text 5%", "https://a.org/b)", "é", "  ```sh", "```\n"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=25).map("".join))
def test_masks_keep_every_offset(text):
    for masked in (markdown.reader_text(text), markdown.prose_text(text)):
        assert len(masked) == len(text)
        assert all(m == t or (m == " " and t not in "\r\n") for m, t in zip(masked, text, strict=True))


@pytest.mark.parametrize("text,shown", [("a <!-- b --> c", "a            c"), ("`<!--` d -->", "`<!--` d -->"), ("a <!-- b\nc --> d", "a       \n      d"), ("```\n<!-- x -->\n```\n<!-- y -->", "```\n<!-- x -->\n```\n          "), ("`` a ` <!-- `` <!-- b -->", "`` a ` <!-- ``           ")])
def test_what_a_reader_sees(text, shown):
    assert markdown.reader_text(text) == shown

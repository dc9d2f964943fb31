"""Contracts of templates by locale and date: which headings a kind of note must have, in order, in one of several wordings.

Contracts are rows, a wording of a contract is one of them. A note meets the contracts of its type that were in force on its
date (a range join with a table of a few rows), and holds one if the headings of any wording occur in order among its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notelens.operators.audit import severity

# Wordings of the contracts, the day from which notes must hold them, and the files of their templates.
CAPTURE, DIGEST = "deep-capture", "conversation-digest"
CONTRACTS = (
    (CAPTURE, "web-clip", "2026-07-27", "zh-CN", ("来源与结论", "问题、前提与适用边界", "核心知识与原理", "具体做法与示例", "验证、风险与限制", "理解与启发", "关联笔记")),
    (CAPTURE, "web-clip", "2026-07-27", "en", (
        "Source and Conclusion", "Problem, Prerequisites, and Boundaries", "Core Knowledge and Rationale", "Procedure and Worked Example", "Verification, Risks, and Limitations", "Interpretation and Insights", "Related Notes")),
    (DIGEST, "conversation-digest", "2026-07-29", "zh-CN", ("恢复卡片", "边界与约束", "决策与依据", "证据与产物", "未决事项与下一步")),
    (DIGEST, "conversation-digest", "2026-07-29", "en", ("Resume Card", "Scope and Constraints", "Decisions and Rationale", "Evidence and Artifacts", "Open Questions and Next Actions")),
)
TEMPLATES = {"Templates/Web Clip.md": CAPTURE, "Templates/Digest Note.md": DIGEST}
CARD_LABELS = {"zh-CN": ("目标", "状态", "当前结论", "下一步", "关键产物"), "en": ("Goal", "State", "Current conclusion", "Next step", "Key artifacts")}
CARD_LINES = 12
# Comments that a template leaves for its writer begin or go on like this.
INSTRUCTIONS = (
    "用 2–4 句话", "用 2-4 句话", "区分原文观点与自己的推论", "说明原文解决什么问题", "完整重构原文的关键知识", "技术文章保留足以复现", "写清成功标准", "在完整理解原文后提炼", "只添加 vault 中真实存在",
    "explain the problem, required versions", "reconstruct all material knowledge", "for technical sources, preserve enough", "write clear success criteria", "state success criteria",
    "after reconstructing the source", "add only vault notes that actually exist", "link only to existing vault notes", "用不超过 12 个非空行填写全部字段", "只保留未来续接不能违反的范围", "写决定及必要理由",
    "列出路径、命令及结果", "写开放问题、阻塞项、第一步行动", "fill every field in at most 12 non-empty lines", "keep only scope, non-goals, user requirements", "state decisions and necessary rationale",
    "cite paths, commands and results", "state open questions, blockers, the first action",
)


def contract_table(spark: SparkSession, contracts: tuple = CONTRACTS) -> DataFrame:
    rows = [(name, kind, since, place, locale, list(headings)) for place, (name, kind, since, locale, headings) in enumerate(contracts)]
    return spark.createDataFrame(rows, "contract string, type string, since string, place int, locale string, required array<string>").withColumn("since", F.to_date("since"))


def held_in_order(present: Column, required: Column) -> Column:
    """JN-16: whether the required headings occur in order among those present."""
    return F.aggregate(present, F.lit(0), lambda i, h: F.when(F.get(required, i) == h, i + 1).otherwise(i)) == F.size(required)


def _locales(rows: DataFrame) -> DataFrame:
    """path, contract, headings, locale: the first wording that the headings of a row hold, or null. Rows are notes beside a
    wording each."""
    held = F.when(held_in_order(F.col("headings"), F.col("required")), F.struct("place", "locale"))
    return rows.groupBy("path", "contract").agg(F.first("headings").alias("headings"), F.min(held).alias("held")).select("path", "contract", "headings", F.col("held.locale").alias("locale"))


def note_locales(notes: DataFrame, contracts: DataFrame) -> DataFrame:
    """Each note(path, type, date, headings) with the contracts that bind it: FLT-10, one dated before a contract began is
    exempt, one without a date is not."""
    bound = notes.select("path", "type", "date", "headings").join(F.broadcast(contracts), "type").filter("date IS NULL OR date >= since")
    return _locales(bound.filter(~F.col("path").startswith("Templates/")))


def _found(rows: DataFrame, code: Column, message: Column) -> DataFrame:
    level = F.create_map(*[F.lit(x) for c in ("missing-deep-capture-heading", "missing-conversation-digest-heading", "outdated-deep-capture-template", "outdated-conversation-digest-template", "conversation-digest-resume-card-too-long", "conversation-digest-missing-resume-field") for x in (c, severity(c))])
    return rows.select("path", code.alias("code"), message.alias("message")).withColumn("severity", level[F.col("code")])


def _shown(headings: Column) -> Column:
    return F.coalesce(F.nullif(F.array_join(headings, " -> "), F.lit("")), F.lit("(none)"))


def heading_findings(notes: DataFrame, contracts: DataFrame) -> DataFrame:
    """path, code, message, severity: notes that hold no wording of their contract."""
    return _found(note_locales(notes, contracts).filter("locale IS NULL"), F.concat(F.lit("missing-"), "contract", F.lit("-heading")), _shown(F.col("headings")))


def _card(section: Column) -> Column:
    """The lines that a section shows: comments out, blanks off, empty ones gone."""
    plain = F.regexp_replace(F.coalesce(section, F.lit("")), "(?s)<!--.*?-->", "")
    return F.filter(F.transform(F.split(plain, "\r\n|[\r\n]", -1), lambda ln: F.trim(F.regexp_replace(ln, r"[\t\f]", " "))), lambda ln: ln != "")


def _label_value(lines: Column, label: Column) -> Column:
    """What stands behind a bold label in a list, for each line that has it."""
    rest = F.transform(lines, lambda ln: F.when(ln.rlike(r"^[-*][ ]+\*\*"), F.regexp_replace(ln, r"^[-*][ ]+\*\*", "")))
    held = F.filter(rest, lambda r: F.lower(F.substring_index(r, "**", 1)) == F.lower(label))
    after = F.transform(held, lambda r: F.ltrim(F.substr(r, F.length(F.substring_index(r, "**", 1)) + 3)))
    return F.transform(F.filter(after, lambda a: a.startswith(":") | a.startswith("：")), lambda a: F.trim(F.substr(a, F.lit(2))))


def _labels(locale: Column) -> Column:
    return F.create_map(*[x for name, labels in CARD_LABELS.items() for x in (F.lit(name), F.array(*map(F.lit, labels)))])[locale]


def card_findings(notes: DataFrame, contracts: DataFrame) -> DataFrame:
    """Digests that hold a wording, judged by the card under its first heading: notes(path, type, date, headings, sections)."""
    first = F.broadcast(contracts.select("contract", "locale", F.col("required")[0].alias("card")))
    held = note_locales(notes, contracts).filter(F.col("contract") == DIGEST).join(first, ["contract", "locale"]).join(notes.select("path", "sections"), "path")
    lines = _card(F.col("sections")[F.col("card")])
    lacking = F.filter(_labels(F.col("locale")), lambda label: ~F.coalesce(F.get(_label_value(F.col("lines"), label), F.lit(0)) != "", F.lit(False)))
    judged = held.withColumn("lines", lines).withColumn("lacking", lacking)
    long = _found(judged.filter(F.size("lines") > CARD_LINES), F.lit("conversation-digest-resume-card-too-long"), F.size("lines").cast("string"))
    return long.unionByName(_found(judged.filter(F.size("lacking") > 0), F.lit("conversation-digest-missing-resume-field"), F.array_join("lacking", ", ")))


def template_findings(templates: DataFrame, contracts: DataFrame) -> DataFrame:
    """Templates(path, headings, sections) that make notes out of contract: no wording, or a digest's card without a label."""
    name = F.create_map(*[F.lit(x) for pair in TEMPLATES.items() for x in pair])[F.col("path")]
    known = templates.withColumn("contract", name).filter("contract IS NOT NULL")
    found = _locales(known.select("path", "contract", "headings").join(F.broadcast(contracts.drop("type")), "contract"))
    code = F.concat(F.lit("outdated-"), "contract", F.lit("-template"))
    unheld = _found(found.filter("locale IS NULL"), code, _shown(F.col("headings")))
    first = F.broadcast(contracts.select("contract", "locale", F.col("required")[0].alias("card")))
    cards = found.filter(F.col("contract") == DIGEST).join(first, ["contract", "locale"]).join(templates.select("path", "sections"), "path").withColumn("lines", _card(F.col("sections")[F.col("card")]))
    lacking = F.filter(_labels(F.col("locale")), lambda label: F.size(_label_value(F.col("lines"), label)) == 0)
    return unheld.unionByName(_found(cards.withColumn("lacking", lacking).filter(F.size("lacking") > 0), code, F.array_join("lacking", ", ")))


def instruction_left(comment: Column) -> Column:
    """Whether a comment is an instruction of a template."""
    plain = F.trim(F.regexp_replace(F.lower(comment), r"(?U)\s+", " "))
    out = F.lit(False)
    for marker in INSTRUCTIONS:
        out = out | F.contains(plain, F.lit(marker))
    return out

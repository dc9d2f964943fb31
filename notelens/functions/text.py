"""Text functions as Column expressions (TXT, FLT and RNK rows of the inventory)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = "㐀-䶿一-鿿"
# Title tokens too general to mean relatedness.
GENERIC_TITLE_TOKENS = (
    "详解", "指南", "实践", "教程", "攻略", "入门", "解析", "介绍", "总结", "分享", "文章", "笔记", "记录", "整理", "汇总", "合集", "系列",
    "guide", "tutorial", "overview", "introduction", "intro", "practice", "explained", "article", "note", "notes", "post", "summary",
)


def tokenize(text: Column) -> Column:
    """TXT-1: Latin runs in lower case, CJK runs as overlapping pairs; every other script breaks runs."""
    text = F.coalesce(text, F.lit(""))
    runs = F.regexp_extract_all(text, F.lit(f"[A-Za-z0-9]+|[{CJK}]+"), F.lit(0))

    def parts(run: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(run) - 1, F.lit(1))), lambda i: F.substr(run, i, F.lit(2)))
        return F.when(run.rlike("^[A-Za-z0-9]"), F.array(F.lower(run))).otherwise(pairs)

    # most texts have no CJK run, nor one of the two signs whose lower case is a Latin letter: no row of theirs meets a lambda
    plain = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    return F.when(text.rlike(f"[{CJK}\u0130\u212a]"), F.flatten(F.transform(runs, parts))).otherwise(plain)


def has_cjk(text: Column) -> Column:
    """TXT-2."""
    return text.rlike(f"[{CJK}]")


def normal_name(text: Column) -> Column:
    """RNK-9: tokens joined by spaces."""
    return F.array_join(tokenize(text), " ")


def tag_key(tag: Column) -> Column:
    """FLT-3: lower case, without separators, and without one plural s."""
    key = F.regexp_replace(F.lower(tag), "[_\\- ]", "")
    return F.when((F.length(key) > 1) & key.endswith("s"), F.substr(key, F.lit(1), F.length(key) - 1)).otherwise(key)


def title_tokens(title: Column) -> Column:
    """TXT-27: distinct tokens of two characters or more that are no numbers, without general ones."""
    latin = F.filter(F.regexp_extract_all(F.lower(F.coalesce(title, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: (F.length(t) >= 2) & ~t.rlike("^[0-9]+$"))
    cjk = F.flatten(F.transform(F.regexp_extract_all(F.coalesce(title, F.lit("")), F.lit(f"[{CJK}]{{2,}}"), F.lit(0)), lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substr(r, i, F.lit(2)))))
    return F.array_except(F.array_distinct(F.concat(latin, cjk)), F.array(*map(F.lit, GENERIC_TITLE_TOKENS)))


def undated(stem: Column) -> Column:
    """TXT-29: without a leading date and space."""
    return F.regexp_replace(stem, r"^\d{4}-\d{2}-\d{2} ", "")


def normal_text(text: Column) -> Column:
    """SRC-8: no byte-order mark, line feeds only."""
    return F.regexp_replace(F.regexp_replace(text, "^﻿", ""), "\r\n?", "\n")


def link_target(link: Column) -> Column:
    """TXT-16: what stands before label, heading and block marks, trimmed."""
    return F.trim(F.split_part(F.split_part(F.split_part(link, F.lit("|"), F.lit(1)), F.lit("#"), F.lit(1)), F.lit("^"), F.lit(1)))


def link_label(link: Column) -> Column:
    """TXT-15: the label, or else the target with its marks as spaces."""
    return F.trim(F.when(F.contains(link, F.lit("|")), F.element_at(F.split(link, r"\|"), -1)).otherwise(F.regexp_replace(link, "[#^]", " ")))


def wikilinks(text: Column) -> Column:
    """TXT-17: inner texts of wiki links, in order."""
    return F.regexp_extract_all(text, F.lit(r"\[\[([^\[\]]+)\]\]"), F.lit(1))


def safe_filename(name: Column) -> Column:
    """MSC-1."""
    return F.trim(F.regexp_replace(F.regexp_replace(name, r'[/\\:*?"<>|]', "_"), r"^[. ]+|[. ]+$", ""))


def note_date(value: Column) -> Column:
    """A real calendar date at the start of the text, or null."""
    return F.when(F.trim(value).rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_date(F.substring(F.trim(value), 1, 10), "yyyy-MM-dd"))


def fact_key(text: Column) -> Column:
    """MSC-16: letters and digits only, in lower case."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")


def holds_fact(text: Column, fact: Column) -> Column:
    return F.contains(fact_key(text), fact_key(fact))


def content_chars(text: Column) -> Column:
    """TXT-24: characters that are no space, outside lines that begin with #."""
    lines = F.filter(F.split(text, "\n", -1), lambda ln: ~F.ltrim(ln).startswith("#"))
    return F.length(F.regexp_replace(F.array_join(lines, ""), r"\s", ""))

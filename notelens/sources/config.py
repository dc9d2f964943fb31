"""Configuration files, read and checked on the driver: lexicon and saved views (SRC-19, SRC-20, RNK-20, RNK-21)."""

from __future__ import annotations

import datetime
import json
import re
from dataclasses import dataclass

from notelens.operators.search import Concept, Filters, query_tokens

MAX_LEXICON, MAX_VIEWS, MAX_VIEW_COUNT = 64 * 1024, 32 * 1024, 50


class ConfigError(ValueError):
    """A configuration that breaks its contract; the whole file is refused."""


def _document(text: str, limit: int) -> dict:
    if len(text.encode()) > limit:
        raise ConfigError(f"larger than {limit} bytes")
    try:
        value = json.loads(text)
    except json.JSONDecodeError as error:
        raise ConfigError(f"not JSON at line {error.lineno}") from error
    if not isinstance(value, dict) or value.get("schema_version") != 1:
        raise ConfigError("schema_version must be 1")
    return value


def load_lexicon(text: str, stop_words: frozenset[str] = frozenset()) -> list[Concept]:
    found: list[Concept] = []
    for raw in _document(text, MAX_LEXICON).get("concepts", []):
        name, terms = raw.get("id"), raw.get("terms")
        if not isinstance(name, str) or not re.fullmatch(r"[a-z0-9][a-z0-9-]{0,63}", name) or name in {c.id for c in found}:
            raise ConfigError(f"bad or repeated id {name!r}")
        if not isinstance(terms, list) or not 2 <= len(terms) <= 12 or len(set(terms)) != len(terms):
            raise ConfigError(f"{name}: two to twelve different terms")
        for t in terms:
            if not isinstance(t, str) or not 2 <= len(t) <= 40 or t.lower() in stop_words or not query_tokens(t):
                raise ConfigError(f"{name}: bad term {t!r}")
        found.append(Concept(name, tuple(terms)))
    return found


def duplicate_terms(concepts: list[Concept]) -> dict[str, list[str]]:
    by: dict[str, list[str]] = {}
    for c in concepts:
        for t in c.terms:
            by.setdefault(t.lower(), []).append(c.id)
    return {t: ids for t, ids in sorted(by.items()) if len(ids) > 1}


@dataclass(frozen=True)
class View:
    id: str
    query: str
    types: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()
    scope: str = "."
    top_k: int = 5
    date_field: str | None = None
    window_days: int | None = None

    def filters(self, as_of: str) -> Filters:
        """The window of days that ends on as_of, both ends included."""
        low = high = None
        if self.window_days:
            end = datetime.date.fromisoformat(as_of)
            low, high = (end - datetime.timedelta(days=self.window_days - 1)).isoformat(), as_of
        if self.date_field == "updated":
            return Filters(self.types, self.tags, updated_after=low, updated_before=high)
        return Filters(self.types, self.tags, after=low, before=high)


def load_views(text: str) -> dict[str, View]:
    out: dict[str, View] = {}
    raw_views = _document(text, MAX_VIEWS).get("views", [])
    if not isinstance(raw_views, list) or len(raw_views) > MAX_VIEW_COUNT:
        raise ConfigError(f"at most {MAX_VIEW_COUNT} views")
    for raw in raw_views:
        if not isinstance(raw, dict) or (unknown := set(raw) - set(View.__dataclass_fields__)):
            raise ConfigError(f"unknown fields {sorted(unknown) if isinstance(raw, dict) else raw!r}")
        view = View(**{k: tuple(v) if isinstance(v, list) else v for k, v in raw.items()})
        if not view.id or view.id in out:
            raise ConfigError(f"bad or repeated id {view.id!r}")
        check_query(view.query, view.top_k)
        if (view.date_field is None) != (view.window_days is None) or view.date_field not in (None, "date", "updated"):
            raise ConfigError(f"{view.id}: date_field and window_days belong together")
        out[view.id] = view
    return out


def check_query(query: str, top_k: int, after: str | None = None, before: str | None = None) -> None:
    """FLT-15."""
    if not query.strip() or len(query) > 500:
        raise ConfigError("invalid-query")
    if not 1 <= top_k <= 20:
        raise ConfigError("invalid-top-k")
    try:
        dates = [datetime.date.fromisoformat(d) for d in (after, before) if d]
    except ValueError as error:
        raise ConfigError("invalid-date") from error
    if after and before and dates[0] > dates[1]:
        raise ConfigError("invalid-date-range")

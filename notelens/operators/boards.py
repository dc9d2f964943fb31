"""Board files (SRC-23, MSC-5, QRY-14 to QRY-17): a strict grammar of five sections, parsed, changed and rendered.

A board is one small file; boards are many, so a table of boards is parsed in Arrow batches.
"""

from __future__ import annotations

import datetime
import re
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The section names and marks of a board file.
SECTIONS = ("今天", "之后", "没定日子", "备忘", "已完成")
OPEN = SECTIONS[:3]
TITLE, DUE, TICKED, CANCELLED = "# 待办", "📅", "勾掉", "取消"

_DATE = r"(\d{4}-\d{2}-\d{2})"
_GRAMMAR = {
    SECTIONS[0]: re.compile(rf"- \[ \] (?P<text>.*) {DUE} (?P<due>{_DATE[1:-1]})"),
    SECTIONS[1]: re.compile(rf"- \[ \] (?P<text>.*) {DUE} (?P<due>{_DATE[1:-1]})"),
    SECTIONS[2]: re.compile(r"- \[ \] (?P<text>.*)"),
    SECTIONS[3]: re.compile(rf"- (?P<at>{_DATE[1:-1]} (?:[01]\d|2[0-3]):[0-5]\d) (?P<text>.*)"),
    SECTIONS[4]: re.compile(rf"- (?P<due>{_DATE[1:-1]}) (?P<mark>{TICKED}|{CANCELLED})：(?P<text>.*)"),
}


class BoardError(ValueError):
    """A file that is no board, or a change that is refused; the code is the message."""


@dataclass(frozen=True)
class Row:
    section: str
    text: str
    due: str | None = None
    at: str | None = None
    mark: str | None = None
    line: int = 0

    def render(self) -> str:
        if self.section == SECTIONS[3]:
            return f"- {self.at} {self.text}"
        if self.section == SECTIONS[4]:
            return f"- {self.due} {self.mark}：{self.text}"
        return f"- [ ] {self.text}" + (f" {DUE} {self.due}" if self.due else "")


@dataclass
class Board:
    head: str
    rows: list[Row] = field(default_factory=list)

    def render(self) -> str:
        parts = [self.head + "\n" + TITLE + "\n\n"]
        for name in SECTIONS:
            parts.append(f"## {name}\n\n" + "".join(r.render() + "\n" for r in self.rows if r.section == name))
        return "".join(parts)


def _real(day: str | None) -> bool:
    try:
        return day is None or bool(datetime.date.fromisoformat(day[:10]))
    except ValueError:
        return False


def parse(text: str) -> Board:
    """A board, or BoardError with frontmatter, fence, heading or pattern."""
    m = re.match(r"---\n(.*?)\n---\n", text, re.S)
    if not m or not re.search(r"(?m)^type: todo-board$", m[1]):
        raise BoardError("frontmatter")
    board, place, titled = Board(m[0]), -1, False
    for number, line in enumerate(text[m.end() :].split("\n"), m[0].count("\n") + 1):
        if not line.strip():
            continue
        if line.startswith(("```", "~~~")):
            raise BoardError("fence")
        if line == TITLE and not titled:
            titled = True
        elif re.match(r"#{1,6}(\s|$)", line):
            place += 1
            if not titled or place >= len(SECTIONS) or line != f"## {SECTIONS[place]}":
                raise BoardError("heading")
        elif not titled or place < 0:
            raise BoardError("heading")
        else:
            section = SECTIONS[place]
            row = _GRAMMAR[section].fullmatch(line)
            got = row.groupdict() if row else {}
            if not row or not got["text"].strip() or not _real(got.get("due")) or not _real(got.get("at")) or (section == SECTIONS[2] and re.search(rf" {DUE} {_DATE}$", line)):
                raise BoardError("pattern")
            board.rows.append(Row(section, got["text"], got.get("due"), got.get("at"), got.get("mark"), number))
    if not titled or place != len(SECTIONS) - 1:
        raise BoardError("heading")
    return board


def spoken(due: str | None, today: str) -> str:
    """QRY-15."""
    return SECTIONS[2] if due is None else SECTIONS[0] if due <= today else SECTIONS[1]


def change(board: Board, action: str, text: str, today: str, due: str | None = None, at: str | None = None) -> Board:
    """QRY-16: capture, memo, tick, cancel or reschedule. JN-18: a change names one open row by its exact text;
    none is board-no-match, several board-ambiguous, and capturing an open text again board-duplicate. Open rows
    move to the section their date belongs to."""
    opened = [r for r in board.rows if r.section in OPEN and r.text.strip() == text]
    if action == "memo":
        same = [r for r in board.rows if r.section == SECTIONS[3] and r.text.strip() == text and r.at == f"{today} {at}"]
        new, gone = Row(SECTIONS[3], text, at=f"{today} {at}"), None
    elif action == "capture":
        same, new, gone = opened, Row(spoken(due, today), text, due), None
    else:
        if not opened:
            raise BoardError("board-no-match")
        if len(opened) > 1:
            raise BoardError("board-ambiguous")
        same, gone = [], opened[0]
        new = Row(spoken(due, today), text, due) if action == "reschedule" else Row(SECTIONS[4], text, today, mark=TICKED if action == "tick" else CANCELLED)
    if same:
        raise BoardError("board-duplicate" if len(same) == 1 else "board-ambiguous")
    rows = [replace(r, section=spoken(r.due, today)) if r.section in OPEN else r for r in board.rows if r is not gone]
    out = Board(board.head, [*rows, new])
    if parse(out.render()).render() != out.render():
        raise BoardError("round-trip")
    return out


ROWS = T.StructType([T.StructField("code", T.StringType()), T.StructField("rows", T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("section", "text", "due", "at", "mark")] + [T.StructField("line", T.IntegerType())])))])


@F.pandas_udf(ROWS)
def _parsed(text: pd.Series) -> pd.DataFrame:
    out = []
    for t in text:
        try:
            out.append((None, [vars(r) for r in parse(t).rows] if t is not None else []))
        except BoardError as error:
            out.append((str(error), []))
    return pd.DataFrame(out, columns=["code", "rows"])


def board_rows(boards: DataFrame) -> tuple[DataFrame, DataFrame]:
    """boards(path, text): (rows with path, malformed boards with their code)."""
    judged = boards.select("path", _parsed("text").alias("p")).select("path", "p.code", "p.rows")
    return judged.select("path", F.inline("rows")), judged.filter("code is not null").select("path", "code")

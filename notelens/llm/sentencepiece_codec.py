"""SentencePiece encoding and decoding.

An Aho-Corasick automaton over the pieces reads a text once. At each position the output links of the
state give every piece that ends there, and each relaxes the best score of that position (Viterbi).
Where no piece of one character ends, the character itself is spelt in byte pieces at a penalty.

Pieces hold the space mark only in front, so a text falls apart before each run of spaces (and at line
feeds, if no piece holds one) without changing the best path; the paths of such parts are kept in a
bounded memo. If a vocabulary has pieces that cross such places, whole texts are parts.

Decoding joins pieces and bytes and drops the mark put in front, so it gives each text back exactly; a
space mark that is part of a text is spelt in bytes for that.

Defined cases: null and empty texts have no ids and decode to the empty text; ties go to the longer
last piece; rows are independent, so repeated rows repeat; other columns are kept by ``encode``.
"""

from __future__ import annotations

import re
import uuid
from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from notelens.llm.workers import built, small_batches

MARK = "▁"
PENALTY = 10.0


def load_pieces(model_file: str) -> tuple[list[str], list[float], list[str]]:
    """Piece, score and kind (normal, byte, none) by id, from a SentencePiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    ids = range(model.get_piece_size())
    kinds = ["byte" if model.is_byte(i) else "none" if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) else "normal" for i in ids]
    return [model.id_to_piece(i) for i in ids], [model.get_score(i) for i in ids], kinds


class Codec:
    """The automaton and its memo. One is built in each Python worker and kept there."""

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[str], memo_parts: int = 200_000, max_ways: int = 500_000) -> None:
        self.goto: list[dict[str, int]] = [{}]
        self.piece: list[tuple[int, float, int] | None] = [None]  # (length, score, id) of the piece that a state spells
        normal = [i for i, k in enumerate(kinds) if k == "normal" and pieces[i]]
        for i in normal:
            state = 0
            for c in pieces[i]:
                after = self.goto[state].get(c)
                if after is None:
                    after = self.goto[state][c] = len(self.goto)
                    self.goto.append({})
                    self.piece.append(None)
                state = after
            self.piece[state] = (len(pieces[i]), scores[i], i)
        n = len(self.goto)
        self.fail, self.output_link = [0] * n, [0] * n
        queue = deque(self.goto[0].values())
        while queue:
            state = queue.popleft()
            for c, after in self.goto[state].items():
                back = self.fail[state]
                while back and c not in self.goto[back]:
                    back = self.fail[back]
                self.fail[after] = self.goto[back].get(c, 0) if state else 0
                to = self.fail[after]
                self.output_link[after] = to if self.piece[to] else self.output_link[to]
                queue.append(after)
        self.max_ways = max_ways
        self._forget_ways()
        byte_ids = [i for i, k in enumerate(kinds) if k == "byte"]
        self.byte = {int(pieces[i][1:-1], 16): i for i in byte_ids}
        if len(self.byte) != 256:
            raise ValueError("the vocabulary has no piece for each byte, so not every text can be decoded")
        self.unknown = min((scores[i] for i in normal), default=0.0) - PENALTY
        self.surface = [bytes([int(p[1:-1], 16)]) if k == "byte" else p.replace(MARK, " ").encode() if k == "normal" else b"" for p, k in zip(pieces, kinds, strict=True)]
        if any(MARK in pieces[i].lstrip(MARK) for i in normal):
            self.parts = re.compile(r".+", re.S)
        elif any("\n" in pieces[i] for i in normal):
            self.parts = re.compile(r" +[^ ]*|[^ ]+")
        else:
            self.parts = re.compile(r"\n|[^ \n]+| +[^ \n]*")
        self.memo_parts, self.memo = memo_parts, {}

    def _forget_ways(self) -> None:
        self.ways: list[dict[str, tuple]] = [{} for _ in self.goto]
        self.n_ways = 0

    def _ending(self, state: int) -> tuple[tuple[int, float, int], ...]:
        """Pieces that end where the automaton is in this state, longest first: its own, then along the output links."""
        found = [self.piece[state]] if self.piece[state] else []
        while state := self.output_link[state]:
            found.append(self.piece[state])
        return tuple(found)

    def _step(self, state: int, char: str) -> tuple:
        """Where a character leads, by the fail links: the state, its pieces, and whether the character alone is one.
        Kept with the state while there is room, so that most ways are searched once."""
        c = MARK if char == " " else None if char == MARK else char  # a mark in the text is no space
        at = state
        while at and c not in self.goto[at]:
            at = self.fail[at]
        at = self.goto[at].get(c, 0)
        ending = self._ending(at)
        way = (at, ending, any(x[0] == 1 for x in ending))
        if self.n_ways < self.max_ways:
            self.ways[state][char] = way
            self.n_ways += 1
        return way

    def best_path(self, part: str) -> list[int]:
        """Ids of the best segmentation of one part, in which spaces stand for marks."""
        ways, unknown = self.ways, self.unknown
        best, back, state, end, prior = [0.0], [None], 0, 0, 0.0
        for char in part:
            end += 1
            state, ending, single = ways[state].get(char) or self._step(state, char)
            score, source = float("-inf"), None
            for entry in ending:
                if (s := best[end - entry[0]] + entry[1]) > score:
                    score, source = s, entry
            if not single and (s := prior + unknown) > score:
                score = s
                source = None
            prior = score
            best.append(score)
            back.append(source)
        out: list[int] = []
        while end:
            if source := back[end]:
                out.append(source[2])
                end -= source[0]
            else:
                end -= 1
                out += [self.byte[b] for b in reversed(part[end].encode("utf-8", "surrogatepass"))]
        return out[::-1]

    def encode_packed(self, text: str) -> bytes:
        """Ids as packed 32-bit integers."""
        if not text:
            return b""
        memo = self.memo
        parts = self.parts.findall(" " + text)
        try:
            return b"".join([memo[p] for p in parts])
        except KeyError:
            if len(memo) > self.memo_parts:
                memo.clear()
            if self.n_ways >= self.max_ways:
                self._forget_ways()
            out, pack = [], lambda ids: array("i", ids).tobytes()
            for p in parts:
                ids = memo.get(p)
                if ids is None:
                    ids = pack(self.best_path(p))
                    if len(p) <= 64:
                        memo[p] = ids
                out.append(ids)
            return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), np.int32).tolist()

    def decode(self, ids: list[int]) -> str:
        surface = self.surface
        return b"".join([surface[i] for i in ids]).decode("utf-8", "replace")[1:]


def _codec(broadcast, token: str) -> Codec:
    return built(("codec", token), lambda: Codec(*broadcast.value))


def encode(spark: SparkSession, docs: DataFrame, model_file: str, text_col: str = "text", decoded: bool = False) -> DataFrame:
    """Adds ids (array of int), n_tokens, and with ``decoded`` the text that the ids give back.

    The vocabulary is broadcast: its size is that of the model file, whatever the input.
    """
    small_batches(spark)
    vocabulary, token = spark.sparkContext.broadcast(load_pieces(model_file)), uuid.uuid4().hex
    added = ["ids", "n_tokens"] + ["decoded"] * decoded
    kept = [f for f in docs.schema.fields if f.name not in added]
    schema = T.StructType([*kept, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType())] + [T.StructField("decoded", T.StringType())] * decoded)
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(vocabulary, token)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                packed = [codec.encode_packed(t or "") for t in batch.column(text_col).to_pylist()]
                counts = np.fromiter((len(p) // 4 for p in packed), np.int64, len(packed))
                flat = np.frombuffer(b"".join(packed), np.int32)
                ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                columns = [batch.column(n) for n in names] + [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(counts)]
                if decoded:
                    columns.append(pa.array([codec.decode(np.frombuffer(p, np.int32).tolist()) for p in packed], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, [*names, *added])

    return docs.mapInArrow(run, schema)


def decode(spark: SparkSession, encoded: DataFrame, model_file: str, ids_col: str = "ids") -> DataFrame:
    """Adds decoded: the text of each row's ids; null ids give the empty text."""
    small_batches(spark)
    vocabulary, token = spark.sparkContext.broadcast(load_pieces(model_file)), uuid.uuid4().hex
    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(vocabulary, token)
        for batch in batches:
            texts = pa.array([codec.decode(ids or []) for ids in batch.column(ids_col).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], [*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, schema)

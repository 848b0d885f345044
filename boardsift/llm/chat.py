"""Chat formatting at the level of tokens.

Every segment of a turn (role, text) is encoded by itself and the reserved ids that mark a turn are spliced in, so no
text can form a mark.  The marks' strings are also escaped inside texts, so the formatted text can be read as well.
Where a turn starts in its conversation, and which tokens the loss counts, are prefix sums over segment lengths.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boardsift.llm import byte_bpe
from boardsift.llm.common import arrow_batches, text_slices
from boardsift.llm.ragged import gather, offsets

#: Reserved ids above the vocabulary, and how they are shown.
SYSTEM, USER, ASSISTANT, OTHER, COLON, END = range(50257, 50263)
SHOWN = {SYSTEM: "### System: ", USER: "### User: ", ASSISTANT: "### Assistant: ", OTHER: "### ", COLON: ": ", END: "</turn>\n"}
ROLES = {"system": SYSTEM, "user": USER, "assistant": ASSISTANT}
#: What may not stand in a text, and its escape.
ESCAPES = {"\\": "\\\\", "###": "\\h", "</turn>": "\\t"}
_BACK = {escape[1]: plain for plain, escape in ESCAPES.items()}
_CONTROL = regex.compile("|".join(regex.escape(x) for x in ESCAPES))
_ESCAPED = regex.compile(r"\\(.)", regex.S)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: ESCAPES[m[0]], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _BACK[m[1]], text)


_TURNS = "conv_id long, turn long, role string, text string, ids array<int>, n_ids long, loss_from long, loss_to long"


def _format(path: str, pattern: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe.load(path, pattern)
        for batch in text_slices(batches, limit=2 << 20):
            roles, texts = ([x or "" for x in batch.column(c).to_pylist()] for c in ("role", "text"))
            n = len(roles)
            mark = np.array([ROLES.get(x, OTHER) for x in roles])
            other = mark == OTHER
            named, named_count = bpe.encode_column(pa.array([escape(r) if o else "" for r, o in zip(roles, other, strict=True)]))
            said, said_count = bpe.encode_column(pa.array([escape(x) for x in texts]))
            # segments of a turn: mark, other role's name, colon, text, end
            length = np.stack([np.ones(n, np.int64), named_count, other.astype(np.int64), said_count, np.ones(n, np.int64)], 1)
            pool = np.concatenate([mark, named, [COLON, END], said]).astype(np.int32)
            at_names, at_colon, at_texts = n, n + len(named), n + len(named) + 2
            start = np.stack([np.arange(n), at_names + offsets(named_count)[:-1], np.full(n, at_colon), at_texts + offsets(said_count)[:-1], np.full(n, at_colon + 1)], 1)
            ids = gather(pool, start.ravel(), length.ravel())
            upto = length.cumsum(1)
            loss = mark == ASSISTANT
            lists = pa.ListArray.from_arrays(pa.array(offsets(upto[:, -1]).astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turn"), pa.array(roles), pa.array(texts), lists, pa.array(upto[:, -1]), pa.array(np.where(loss, upto[:, 2], 0)), pa.array(np.where(loss, upto[:, 3], 0))], names=[x.split()[0] for x in _TURNS.split(", ")])

    return work


def format_turns(conversations: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Format conversations (conv_id, turn, role, text, ...).

    Returns one row per turn, sorted within its conversation: conv_id, place (from 0), start (tokens of the
    conversation before it), ids, loss_from and loss_to (the tokens of the conversation that the loss counts; equal
    if none).  Null roles and texts count as empty; rows are ordered by turn (null first), then role, then text, so
    repeated rows are repeated turns; rows without conv_id form a conversation; texts are read whole, however long;
    other columns are ignored, and an empty table gives an empty result.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    plain = arrow_batches(conversations).select(*(conversations[x].cast(t).alias(x) for x, t in (("conv_id", "long"), ("turn", "long"), ("role", "string"), ("text", "string"))))
    turns = plain.mapInArrow(_format(path, pattern), _TURNS)
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    placed = turns.withColumn("place", (F.row_number().over(order) - 1).cast("long")).withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    return placed.select("conv_id", "place", "start", "ids", (F.col("start") + F.col("loss_from")).alias("loss_from"), (F.col("start") + F.col("loss_to")).alias("loss_to"))


class _Reader:
    """Reads one conversation back from its tokens, a turn at a time, and keeps running digests only."""

    def __init__(self, bpe: byte_bpe.ByteBpe, conv_id: int | None):
        self.bpe, self.conv_id = bpe, conv_id
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = self.tokens = 0

    def _text(self, ids: np.ndarray) -> str:
        return self.bpe.decode(ids).tobytes().decode()

    def add(self, start: int, ids: np.ndarray, loss_from: int, loss_to: int) -> None:
        if start != self.tokens:
            raise ValueError(f"conversation {self.conv_id}: a turn starts at {start}, {self.tokens} tokens stand before it")
        self.tokens += len(ids)
        marks = np.flatnonzero(ids >= SYSTEM)
        opened = int(ids[0])
        if opened == OTHER:
            role, said = unescape(self._text(ids[1 : marks[1]])), ids[marks[1] + 1 : -1]
        else:
            role, said = next(k for k, v in ROLES.items() if v == opened), ids[1:-1]
        if int(ids[-1]) != END or len(marks) != (3 if opened == OTHER else 2):
            raise ValueError(f"conversation {self.conv_id}: a turn isn't closed")
        shown = self._text(said)
        self.turns.update(f"{role}\n{unescape(shown)}\n".encode())
        counted = unescape(self._text(ids[loss_from - start : loss_to - start]))
        self.loss.update(counted.encode())
        self.loss_chars += len(counted)
        name = self._text(ids[1 : marks[1]]) if opened == OTHER else ""
        self.chars += sum(len(SHOWN[int(ids[m])]) for m in marks) + len(name) + len(shown)
        self.n_turns += 1

    def row(self) -> tuple:
        return self.conv_id, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


_READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read(path: str, pattern: str):
    def rows(found: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names=[x.split()[0] for x in _READ.split(", ")])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe.load(path, pattern)
        reader: _Reader | None = None
        for batch in batches:
            done = []
            lists = batch.column("ids")
            flat, edge = lists.values.to_numpy(), lists.offsets.to_numpy()
            other = [batch.column(x).to_pylist() for x in ("conv_id", "place", "start", "loss_from", "loss_to")]
            for i, (conv_id, place, start, loss_from, loss_to) in enumerate(zip(*other, strict=True)):
                if place == 0:
                    if reader:
                        done.append(reader.row())
                    reader = _Reader(bpe, conv_id)
                reader.add(start, flat[edge[i] : edge[i + 1]], loss_from, loss_to)
            if done:
                yield rows(done)
        if reader:
            yield rows([reader.row()])

    return work


def read_back(formatted: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Read conversations back from the rows of :func:`format_turns`: a conversation is streamed turn by turn, so
    however long it is a task holds one turn and running digests."""
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    return formatted.sortWithinPartitions(F.col("conv_id"), "place").mapInArrow(_read(path, pattern), _READ)

"""Packing token sequences online, with a fixed number of open windows.

Every partition keeps ``OPEN`` windows of ``WIDTH`` tokens. A document longer than a window gives whole
windows and a rest; a rest goes to the open window in which it leaves the least room. Where none has room
and all are open, the fullest is emitted: as it is, or, if it lacks ``CUT`` tokens or more, filled up with
the head of the piece, whose tail is then placed anew. So a partition's memory is its open windows and one
document, and an emitted window lacks fewer than ``CUT`` tokens.

The windows still open at the end of the partitions are merged in rounds: ``FAN`` partitions at a time their
pieces, longest first, are placed by best fit, the fullest windows are closed and ``OPEN`` go on to the next
round, until one group is left and all are closed. Only lengths travel in the rounds.

A document is its ids and the end id 1. A null text is empty and has that id alone; empty texts likewise.
Rows without an id and repeated rows are documents of their own. Texts are encoded whole, whatever their
length. Columns other than id and text are left behind. An empty table has no sequences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightframe.llm import common
from nightframe.llm.pieces import encoder

END = 1
WIDTH, OPEN, CUT, FAN = 2048, 64, 32, 16
#: A sequence's id: round, group within the round, window within the group.
ROUND_BITS, GROUP_BITS = 50, 26
#: Bytes of ids that are sent back at a time.
BATCH_BYTES = 4 << 20


class Windows:
    """Windows by the room they have left; a bit mask of rooms finds the best fit."""

    def __init__(self, width: int):
        self.width, self.mask = width, 0
        self.by_room: dict[int, list[list]] = {}
        self.count = 0

    def put(self, window: list, room: int) -> None:
        self.by_room.setdefault(room, []).append(window)
        self.mask |= 1 << room
        self.count += 1

    def take(self, least: int) -> tuple[list, int] | None:
        """The window with the least room, but this much; with 0 the fullest."""
        fits = self.mask >> least
        if not fits:
            return None
        room = least + (fits & -fits).bit_length() - 1
        held = self.by_room[room]
        window = held.pop(0)
        if not held:
            self.mask &= ~(1 << room)
        self.count -= 1
        return window, room

    def drain(self) -> Iterator[tuple[list, int]]:
        """All windows, fullest first."""
        while (got := self.take(0)) is not None:
            yield got


def placed_online(windows: Windows, piece: tuple, length: int, most_open: int, cut: int) -> Iterator[list]:
    """Places ``piece`` (document, start) and yields the windows that it drives out; windows are lists of (piece, start, length)."""
    doc, start = piece
    while True:
        got = windows.take(length)
        if got is None and windows.count < most_open:
            got = [], windows.width
        if got is not None:
            window, room = got
            window.append((doc, start, length))
            if room == length:
                yield window
            else:
                windows.put(window, room - length)
            return
        window, room = windows.take(0)
        if room >= cut:
            window.append((doc, start, room))
            start, length = start + room, length - room
        yield window


def packed_parts(docs: DataFrame, tokenizer: str, width: int = WIDTH, most_open: int = OPEN, cut: int = CUT) -> DataFrame:
    """Pieces of each partition: doc_id, start, length, ids, doc_tokens, part, window, offset, closed."""
    schema = "doc_id long, start long, length long, ids binary, doc_tokens long, part long, window long, offset long, closed boolean"
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 4, pa.bool_()]
    end = np.uint32(END).tobytes()

    def run(batches):
        part, number, size = TaskContext.get().partitionId(), 0, 0
        coder, windows, out = encoder(tokenizer), Windows(width), []

        def emit(window: list, closed: bool) -> None:
            nonlocal number, size
            offset = 0
            for (doc_id, ids), start, length in window:
                own = ids[4 * start : 4 * (start + length)]
                out.append((doc_id, start, length, own, len(ids) // 4, part, number, offset, closed))
                offset += length
                size += len(own)
            number += 1

        def batch():
            nonlocal out, size
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
            out, size = [], 0
            return made

        for rows in batches:
            for doc_id, text in zip(rows.column("doc_id").to_pylist(), rows.column("text").to_pylist(), strict=True):
                ids = coder.ids(text or "") + end
                n = len(ids) // 4
                doc, whole = (doc_id, ids), n - n % width
                for start in range(0, whole, width):
                    emit([(doc, start, width)], True)
                if whole < n:
                    # what stays open holds no more than its own ids
                    rest = (doc_id, ids) if not whole else (doc_id, _Tail(ids, whole))
                    for window in placed_online(windows, (rest, whole), n - whole, most_open, cut):
                        emit(window, True)
                if size > BATCH_BYTES:
                    yield batch()
        for window, _room in windows.drain():
            emit(window, False)
        if out:
            yield batch()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return common.short_batches(rows).mapInArrow(run, schema)


class _Tail:
    """The end of a long document's ids, sliced by places in the whole."""

    __slots__ = ("size", "skipped", "held")

    def __init__(self, ids: bytes, skipped: int):
        self.size, self.skipped, self.held = len(ids), 4 * skipped, ids[4 * skipped :]

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, span: slice) -> bytes:
        return self.held[span.start - self.skipped : span.stop - self.skipped]


KEY = ["part", "window", "offset"]
ROUND_SCHEMA = "part long, window long, offset long, length long, in_group long, in_window long, at long, closed boolean"


def merged_round(open_pieces: DataFrame, width: int, most_open: int, last: bool) -> DataFrame:
    """One round: pieces (key, length, group) placed anew within their group by best fit, longest first."""

    def combine(pieces: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.sort_values(["length", *KEY], ascending=[False, True, True, True])
        windows = Windows(width)
        for i, length in enumerate(pieces["length"].tolist()):
            window, room = windows.take(length) or ([], width)
            window.append(i)
            windows.put(window, room - length)
        total, lengths = windows.count, pieces["length"].to_numpy()
        n = len(pieces)
        in_window, at, closed = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
        for number, (window, room) in enumerate(windows.drain()):
            own = lengths[window]
            in_window[window] = number
            at[window] = np.cumsum(own) - own
            closed[window] = last or room == 0 or number < total - most_open
        return pd.DataFrame({**{k: pieces[k] for k in KEY}, "length": pieces["length"], "in_group": pieces["in_group"], "in_window": in_window, "at": at, "closed": closed})

    return open_pieces.groupBy("in_group").applyInPandas(combine, ROUND_SCHEMA)


def packed(docs: DataFrame, tokenizer: str, width: int = WIDTH, most_open: int = OPEN, cut: int = CUT, fan: int = FAN) -> DataFrame:
    """The packed sequences' pieces: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""

    def sequence(level: int, group: str, window: str):
        return (F.lit(level).cast("long") * (1 << ROUND_BITS) + F.col(group) * (1 << GROUP_BITS) + F.col(window)).alias("sequence_id")

    pieces = common.staged(packed_parts(docs, tokenizer, width, most_open, cut), "pieces")
    left = pieces.filter(~F.col("closed")).select(*KEY, "length", F.col("part").alias("in_group"))
    groups = (left.agg(F.max("in_group")).first()[0] or 0) + 1
    level, done = 0, None
    while level == 0 or groups > 1:
        groups, level = -(-groups // fan), level + 1
        dealt = left.select(*KEY, "length", F.floor(F.col("in_group") / fan).alias("in_group"))
        merged = common.staged(merged_round(dealt, width, most_open, groups == 1), f"merged{level}")
        closed = merged.filter("closed").select(*KEY, sequence(level, "in_group", "in_window"), "at")
        done = closed if done is None else done.unionByName(closed)
        left = merged.filter(~F.col("closed")).select(*KEY, "length", "in_group")
    fields = ["doc_id", "start", "length", "ids", "doc_tokens"]
    own = pieces.filter("closed").select(*fields, sequence(0, "part", "window"), "offset")
    moved = pieces.filter(~F.col("closed")).join(done, KEY).select(*fields, "sequence_id", F.col("at").alias("offset"))
    return own.unionByName(moved)


def report(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece."""
    return packed(docs, tokenizer).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")

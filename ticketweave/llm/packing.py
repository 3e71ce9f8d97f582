"""Packing token sequences with bounded space: a fixed number of open windows per partition.

Each partition places its pieces online: best fit among the open windows; when none fits and all are in use, the fullest is
emitted. Windows still open at a partition's end are gathered, a bounded number in a task, and merged: there a piece is cut
where it passes a window's edge, so one open window a task is left, and so on until there is one.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketweave.llm.common import settle, small_batches

WINDOW, OPEN_WINDOWS, END_ID = 4096, 128, 2
_COLUMNS = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "left", "crc32", "ids"]
_PIECE = "doc_id {id}, start long, length long, doc_tokens long, sequence_id long, offset long, left boolean, crc32 long, ids array<int>"
#: Open windows packed again by one task.
MERGE_WINDOWS = 4096


class OpenWindows:
    """At most ``most`` open windows of ``size`` tokens, ordered by the room left."""

    def __init__(self, size: int, most: int):
        self.size, self.most, self.serial = size, most, 0
        self.rooms: list[tuple[int, int]] = []
        self.held: dict[int, list] = {}

    def place(self, piece, length: int) -> list[list]:
        """Put a piece of at most ``size`` tokens away; returns the windows (lists of pieces) that are emitted for it."""
        at, out = bisect_left(self.rooms, (length, -1)), []
        if at < len(self.rooms):
            room, window = self.rooms.pop(at)
        else:
            if len(self.rooms) >= self.most:
                out.append(self.held.pop(self.rooms.pop(0)[1]))
            room, window = self.size, self.serial
            self.serial += 1
            self.held[window] = []
        self.held[window].append(piece)
        if room > length:
            insort(self.rooms, (room - length, window))
        else:
            out.append(self.held.pop(window))
        return out

    def rest(self) -> list[list]:
        return list(self.held.values())


def _crc32(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4"))


def _batch(windows: list[tuple[int, bool, list]], kind: pa.DataType) -> pa.RecordBatch:
    """Rows of (sequence, still open, pieces); a piece is (doc_id, start, doc_tokens, ids)."""
    docs, starts, lengths, totals, sequences, offsets, open_, ids = [], [], [], [], [], [], [], []
    for sequence, left, pieces in windows:
        offset = 0
        for doc, start, total, part in pieces:
            docs.append(doc)
            starts.append(start)
            lengths.append(len(part))
            totals.append(total)
            sequences.append(sequence)
            offsets.append(offset)
            open_.append(left)
            ids.append(part)
            offset += len(part)
    bounds = np.concatenate([[0], np.cumsum(lengths)]).astype("int32")
    lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(ids).astype("int32")))
    longs = [pa.array(x, pa.int64()) for x in (starts, lengths, totals, sequences, offsets)]
    return pa.RecordBatch.from_arrays([pa.array(docs, kind), *longs, pa.array(open_), pa.array([_crc32(x) for x in ids], pa.int64()), lists], names=_COLUMNS)


def _sequence_base(level: int) -> int:
    """Numbers of one task: its level and partition above, a count below; a task that runs again gives the same ones."""
    return (level << 58) | (TaskContext.get().partitionId() << 36)


def _pack_documents(path: str, window: int, most: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ticketweave.llm.tokens import encoder

        encode, base, n, open_windows, kind = encoder(path).encode_batch, _sequence_base(0), 0, OpenWindows(window, most), None
        for batch in batches:
            done, kind = [], batch.schema.field(0).type
            encoded, bounds = encode(batch.column(1), end_id)
            for doc, low, high in zip(batch.column(0).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                ids = encoded[low:high]
                for start in range(0, len(ids), window):
                    part = ids[start:start + window]
                    for pieces in open_windows.place((doc, start, len(ids), part), len(part)):
                        done.append((base + n, False, pieces))
                        n += 1
            if done:
                yield _batch(done, kind)
        left = [(base + n + i, True, pieces) for i, pieces in enumerate(open_windows.rest())]
        if left:
            yield _batch(left, kind)

    return run


def _merge_open(window: int, level: int):
    """Fill windows one after the other; the piece that passes an edge is cut there."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, n, part, used, kind = _sequence_base(level), 0, [], 0, None
        for batch in batches:
            done, kind = [], batch.schema.field(0).type
            docs, starts, totals, lists = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "start", "doc_tokens", "ids"))
            for i, (doc, start, total) in enumerate(zip(docs.to_pylist(), starts.to_pylist(), totals.to_pylist())):
                ids = lists[i].values.to_numpy(zero_copy_only=False)
                while len(ids):
                    take = ids[:window - used]
                    part.append((doc, start, total, take))
                    used, start, ids = used + len(take), start + len(take), ids[len(take):]
                    if used == window:
                        done.append((base + n, False, part))
                        n, part, used = n + 1, [], 0
            if done:
                yield _batch(done, kind)
        if part:
            yield _batch([(base + n, True, part)], kind)

    return run


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", window: int = WINDOW, open_windows: int = OPEN_WINDOWS, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, crc32 (of the ids as little-endian 32-bit integers), ids.

    A document is its token ids and ``end_id``; null and empty texts are ``end_id`` alone. Documents longer than a window are
    cut into full windows and a rest. Every id lies in exactly one piece; offsets inside a sequence have no gaps. Rows that
    repeat are packed each. ``sequence_id`` is unique, not dense. An empty table gives no row.
    """
    small_batches(docs.sparkSession)
    schema = _PIECE.format(id=docs.schema[key].dataType.simpleString())
    src = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    pieces = settle(src.mapInArrow(_pack_documents(tokenizer, window, open_windows, end_id), schema), "pieces")
    out, level = pieces.filter("not left"), 1
    while True:
        left = pieces.filter("left")
        count = left.select("sequence_id").distinct().count()
        if count <= 1:
            return out.unionByName(left).drop("left")
        tasks = -(-count // MERGE_WINDOWS)
        task = F.pmod(F.xxhash64("sequence_id"), F.lit(tasks)).cast("int")
        ordered = left.repartition(tasks, task).sortWithinPartitions("sequence_id", "offset")
        pieces = settle(ordered.mapInArrow(_merge_open(window, level), schema), f"merged-{level}")
        out, level = out.unionByName(pieces.filter("not left")), level + 1

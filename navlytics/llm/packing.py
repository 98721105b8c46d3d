"""Packing of documents into sequences of a fixed length by bounded-space online best-fit.

A task packs its rows as they come: it holds a fixed number of open bins, kept in a bitset with one bit per amount of free
space. A piece goes to the open bin with the least free space that takes it; if none does and all places are taken, the fullest bin closes.
The bins that are still open when a task ends are few; their pieces are packed again over groups of tasks.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from navlytics.llm.bpe import END_ID, GPT_JSON, ID, codec, slices
from navlytics.llm.shared import keep

CAPACITY = 1024
#: Open bins of a task. A bin holds at most CAPACITY ids, so a task buffers at most OPEN * CAPACITY of them.
OPEN = 256
#: Tasks whose open bins are packed together at the end: at most TASKS * OPEN bins in one group.
TASKS = 64


class Bins:
    """Open bins by free space; ``place`` returns the bin that takes a piece and the bins that closed for it."""

    def __init__(self, capacity: int, most: int | None):
        self.capacity, self.most, self.n, self.next = capacity, most, 0, 0
        self.free = 0  # bit f is set while an open bin has f free places
        self.by: dict[int, list[int]] = defaultdict(list)

    def _take(self, space: int) -> int:
        bins = self.by[space]
        got = bins.pop()
        if not bins:
            self.free &= ~(1 << space)
        self.n -= 1
        return got

    def place(self, length: int) -> tuple[int, int | None]:
        closed, fit = None, self.free >> length
        if fit:
            space = length + (fit & -fit).bit_length() - 1
            got = self._take(space)
        else:
            if self.most is not None and self.n >= self.most:
                closed = self._take((self.free & -self.free).bit_length() - 1)
            space, got = self.capacity, self.next
            self.next += 1
        self.by[space - length].append(got)
        self.free |= 1 << (space - length)
        self.n += 1
        return got, closed


def cut(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones, but for the first."""
    first = length % capacity or min(length, capacity)
    return [(0, first), *((s, capacity) for s in range(first, length, capacity))] if length else []


_FIELDS = "piece int, start long, length long, ids_crc32 long, ids binary, sequence_id long, offset long"


def pack(docs: DataFrame, path: str = GPT_JSON, capacity: int = CAPACITY, open_bins: int = OPEN, id_col: str = "doc_id", text_col: str = "text",
         with_ids: bool = True) -> DataFrame:
    """(id, piece, start, length, ids_crc32, ids, sequence_id, offset), a row per piece.

    Every row of ``docs`` is one document, whose ids end with END_ID; a null or empty text is that id alone. A null id and
    repeated rows are documents like others; other columns are not read. Without ``with_ids`` the ids are left out (null).
    Bins of equal free space are taken newest first. An empty table gives an empty one.
    """
    kind = dict(docs.dtypes)[id_col]
    end = np.array([END_ID], ID).tobytes()
    schema = f"`{id_col}` {kind}, {_FIELDS}, __task int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, task = codec(path), TaskContext.get().partitionId()
        bins, held, done = Bins(capacity, open_bins), defaultdict(list), []
        arrow = None

        def out(still: int | None) -> pa.RecordBatch:
            rows, done[:] = list(zip(*done)), []
            cols = [pa.array(rows[0], arrow), *(pa.array(v, t) for v, t in zip(rows[1:], (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())))]
            return pa.RecordBatch.from_arrays([*cols, pa.array([still] * len(rows[0]), pa.int32())],
                                              [id_col, "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset", "__task"])

        def close(k: int) -> None:
            at = 0
            for row in held.pop(k):
                done.append((*row, (task << 32) | k, at))
                at += row[3]

        for whole in batches:
            arrow = whole.schema.field(0).type
            for b in slices(whole, 1):
                for doc, ids in zip(b.column(0).to_pylist(), c.encode(b.column(1))):
                    ids += end
                    for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                        part = ids[4 * start:4 * (start + length)]
                        got, closed = bins.place(length)
                        held[got].append((doc, k, start, length, zlib.crc32(part), part if with_ids else None))
                        if closed is not None:
                            close(closed)
                if done:
                    yield out(None)
        for k in list(held):
            close(k)
        if done:
            yield out(task)

    first = keep(docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text")).mapInArrow(run, schema), "pieces")

    def again(t: pa.Table) -> pa.Table:
        bins, used = Bins(capacity, None), defaultdict(int)
        length = t.column("length").to_numpy()
        seq, off = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        group = (1 << 62) | int(t.column("__task")[0].as_py()) // TASKS << 32
        for i in np.lexsort((t.column("piece").to_numpy(), -length)).tolist():
            k, _ = bins.place(int(length[i]))
            seq[i], off[i] = group | k, used[k]
            used[k] += int(length[i])
        t = t.set_column(t.column_names.index("sequence_id"), "sequence_id", pa.array(seq))
        return t.set_column(t.column_names.index("offset"), "offset", pa.array(off))

    last = first.where("__task is not null").groupBy((F.col("__task") / TASKS).cast("int")).applyInArrow(again, first.schema)
    return first.where("__task is null").unionByName(last).drop("__task")

"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

A file is MAGIC and then blocks. A block holds whole documents, at most about BLOCK_IDS ids unless one document is longer
(such a document is spread over several blocks). Its layout, little-endian:

    head     5 unsigned 32-bit numbers: entries, ids, distinct ids, control bytes, data bytes
    entries  document id int64 each, its ids in this block uint32 each, flags uint8 each (1: null id, 2: continues the document before)
    table    the distinct ids uint32, most frequent first, ties by smaller id
    control  two bits per id, four to a byte, lowest first: bytes of its rank less one
    data     the ranks, 1 to 4 bytes each

A block carries its own table, so files are written in one pass, and each can be read from any block on.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from navlytics.llm.bpe import END_ID, GPT_JSON, ID, codec, slices
from navlytics.llm.shared import create, keep, new_folder, read

MAGIC = b"NVTOKEN1"
BLOCK_IDS = 1 << 20
_LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.int64) + 1  # of the four ranks under a control byte


def encode_ids(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(table, control bytes, data bytes) of a block's ids."""
    if len(ids) and ids.max() < 1 << 22:
        counts = np.bincount(ids)
        table = np.flatnonzero(counts)
        order = np.lexsort((table, -counts[table]))
        rank = np.empty(len(counts), ID)
        rank[table[order]] = np.arange(len(table), dtype=ID)
        v = rank[ids]
    else:  # a vocabulary too wide to count by place
        table, inverse, counts = np.unique(ids, return_inverse=True, return_counts=True)
        order = np.lexsort((table, -counts))
        rank = np.empty(len(table), ID)
        rank[order] = np.arange(len(table), dtype=ID)
        v = rank[inverse]
    code = (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    padded = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    padded[:len(v)] = code
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1).astype(np.uint8)
    width = 2 if len(table) <= 1 << 16 else 4
    data = v.astype(f"<u{width}").view(np.uint8).reshape(-1, width)[np.arange(width) <= code[:, None]]
    return table[order].astype(ID), control, data


def decode_ids(n: int, table: np.ndarray, control: np.ndarray, data: np.ndarray) -> np.ndarray:
    """The ids of a block by table lookup of its control bytes."""
    lengths = _LENGTHS[control].reshape(-1)[:n]
    at = np.cumsum(lengths) - lengths
    v = data[at].astype(ID)
    for k in (1, 2, 3):
        if len(more := np.flatnonzero(lengths > k)):
            v[more] |= data[at[more] + k].astype(ID) << ID.type(8 * k)
    return table[v]


def write_block(f, entries: list[tuple[int | None, int, int]], ids: np.ndarray) -> None:
    table, control, data = encode_ids(ids)
    f.write(np.array([len(entries), len(ids), len(table), len(control), len(data)], ID).tobytes())
    f.write(np.array([d or 0 for d, _, _ in entries], "<i8").tobytes())
    f.write(np.array([n for _, n, _ in entries], ID).tobytes())
    f.write(np.array([flag | (d is None) for d, _, flag in entries], np.uint8).tobytes())
    for part in (table, control, data):
        f.write(part.tobytes())


def read_blocks(f) -> Iterator[tuple[list[tuple[int | None, int, int]], np.ndarray]]:
    if f.read(len(MAGIC)) != MAGIC:
        raise ValueError("not a token file")

    def take(n: int, kind: str) -> np.ndarray:
        raw = f.read(n * np.dtype(kind).itemsize)
        if len(raw) < n * np.dtype(kind).itemsize:
            raise ValueError("token file ends within a block")
        return np.frombuffer(raw, kind)

    while head := f.read(20):
        n, n_ids, n_table, n_control, n_data = np.frombuffer(head, ID).tolist()
        docs, sizes, flags = take(n, "<i8"), take(n, "<u4"), take(n, "u1")
        table, control, data = take(n_table, "<u4"), take(n_control, "u1"), take(n_data, "u1")
        entries = [(None if g & 1 else d, s, g & 2) for d, s, g in zip(docs.tolist(), sizes.tolist(), flags.tolist())]
        yield entries, decode_ids(n_ids, table, control, data)


def write(docs: DataFrame, folder: str | None = None, path: str = GPT_JSON, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files in ascending id order; return their manifest (shard, path, first id of the whole, n_docs, n_ids).

    Every row is one document whose ids end with END_ID; null texts count as empty. Null ids come first; rows with equal ids are
    ordered by a hash of their text. Documents are dealt out by ranges of both, so no id's rows are gathered. A task writes one file under
    a name of its attempt; the manifest, kept as a table, names the files that count.
    """
    folder = folder or new_folder(docs.sparkSession, "tokens")
    end = np.array([END_ID], ID).tobytes()
    src = docs.select(F.col(id_col).cast("long").alias("__id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    src = src.repartitionByRange("__id", F.xxhash64("__text")).sortWithinPartitions("__id", F.xxhash64("__text"), "__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, shard, f = codec(path), TaskContext.get().partitionId(), None
        name = f"{folder}/part-{shard:06d}-{uuid.uuid4().hex}.tokens"
        entries, parts, held, n_docs, n_ids = [], [], 0, 0, 0
        for whole in batches:
            if f is None:
                f = create(name)
                f.write(MAGIC)
            for b in slices(whole, 1):
                for doc, ids in zip(b.column(0).to_pylist(), c.encode(b.column(1))):
                    ids = np.frombuffer(ids + end, ID)
                    n_docs, n_ids = n_docs + 1, n_ids + len(ids)
                    for k in range(0, len(ids), BLOCK_IDS):
                        part = ids[k:k + BLOCK_IDS]
                        if held and held + len(part) > BLOCK_IDS:
                            write_block(f, entries, np.concatenate(parts))
                            entries, parts, held = [], [], 0
                        entries.append((doc, len(part), 2 * (k > 0)))
                        parts.append(part)
                        held += len(part)
        if f is not None:
            if entries:
                write_block(f, entries, np.concatenate(parts))
            f.close()
            yield pa.RecordBatch.from_pylist([{"shard": shard, "path": name, "n_docs": n_docs, "n_ids": n_ids}],
                                             pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    files = keep(src.mapInArrow(run, "shard int, path string, n_docs long, n_ids long"), "token-manifest")
    before = F.coalesce(F.sum("n_ids").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row per file
    return files.withColumn("first", before)


def scan(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files of a manifest; a task reads whole files, block by block."""
    n = manifest.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows: list[list] = []
                with read(name) as f:
                    for entries, ids in read_blocks(f):
                        at = 0
                        for doc, size, more in entries:
                            part = ids[at:at + size].tobytes()
                            at += size
                            if more:
                                rows[-1][2:] = [rows[-1][2] + size, zlib.crc32(part, rows[-1][3])]
                            else:
                                rows.append([doc, start, size, zlib.crc32(part)])
                            start += size
                        if len(rows) > 10_000:
                            yield table(rows[:-1])
                            rows = rows[-1:]
                if rows:
                    yield table(rows)

    def table(rows: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return manifest.select("path", "first").repartition(max(1, n)).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")

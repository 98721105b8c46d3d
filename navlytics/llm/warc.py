"""WARC archives of pages, and their capture index by external merge.

Write: a task appends one gzip member per record to archives of bounded size. Equal payloads become revisits of the
record with the smallest id. Index: a task reads archives record by record and emits locally sorted runs of captures.
Runs are cut by key ranges; within a range a loser tree merges the runs' slices by (URL key, timestamp, id), which
gives the capture histories in global order.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from itertools import pairwise
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from navlytics.llm.shared import create, keep, new_folder, read

#: Payloads below this size are always stored in full.
LEAST_REVISIT = 100
#: Bytes after which a task begins its next archive.
ARCHIVE_BYTES = 1 << 30
#: Captures of a locally sorted run, and of a key range that one task merges.
RUN_ROWS, RANGE_ROWS = 20_000, 200_000
#: Payload digests with more rows than this share, and over HOT_ROWS, are looked up by broadcast: at most 1/HOT_SHARE of them.
HOT_SHARE, HOT_ROWS = 1 / 1000, 1000
#: Capture time of pages without one: the epoch below plus the id in seconds.
EPOCH = datetime(2020, 1, 1, tzinfo=timezone.utc)
LATEST = int((datetime(9999, 12, 31, tzinfo=timezone.utc) - EPOCH).total_seconds())

CAPTURE = pa.schema([
    ("url_key", pa.string()), ("captured", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("archive", pa.string()),
    ("record_at", pa.int64()), ("record_bytes", pa.int64())])
_DDL = ("url_key string, captured string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, "
        "refers_to long, archive string, record_at long, record_bytes long")


def url_key(url: str) -> str:
    """Host labels in reverse, then path and query, lower-cased; scheme, port, ``www.`` and fragment don't count."""
    try:
        parts = urlsplit(url)
        host = (parts.hostname or "").removeprefix("www.")
    except ValueError:
        return url.lower()
    return ",".join(reversed(host.split("."))) + ")" + (parts.path or "/").lower() + ("?" + parts.query.lower() if parts.query else "")


def decisions(pages: DataFrame, id_col: str = "page_id", body_col: str = "html") -> DataFrame:
    """(id, first): the pages whose payload, of LEAST_REVISIT bytes at least, a smaller id has too."""
    body = F.coalesce(F.col(body_col).cast("string"), F.lit(""))
    rows = keep(pages.where(F.octet_length(body) >= LEAST_REVISIT).select(
        F.col(id_col).alias("__id"), F.unhex(F.sha2(body.cast("binary"), 256)).alias("__d")), "payloads")
    firsts = keep(rows.groupBy("__d").agg(F.min("__id").alias("first"), F.count(F.lit(1)).alias("__n")).where("__n > 1"), "payload-firsts")
    total = firsts.agg(F.sum("__n")).first()[0] or 0
    hot = firsts.where(F.col("__n") > max(HOT_ROWS, int(total * HOT_SHARE)))
    light = rows.join(F.broadcast(hot.select("__d")), "__d", "left_anti").join(firsts, "__d")
    found = light.unionByName(rows.join(F.broadcast(hot), "__d"))
    return found.where("__id > first").select(F.col("__id").alias("__id"), "first").distinct()


def _record(kind: str, page: int | None, url: str, when: str, body: bytes, digest: str, first: int | None) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body)
    block = http if kind == "revisit" else http + body
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page)}", f"WARC-Date: {when}", f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(first)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", time_col: str | None = None) -> DataFrame:
    """Write every row as a record; return the manifest (archive, records) of the archives that count.

    A null body is empty, a null URL is written as empty; control characters in URLs are percent-encoded. Rows with a null id are responses
    with an empty record name, and nothing refers to them unless all copies lack an id. Rows that share the smallest id of a payload are
    all responses. Only pages that have copies pass a join with their decision, by id; AQE may split it. Other columns are not read.
    """
    folder = folder or new_folder(pages.sparkSession, "warc")
    when = F.unix_seconds(F.col(time_col)) if time_col else F.lit(None).cast("long")
    src = pages.select(F.col(id_col).cast("long").alias("__id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("__url"),
                       F.coalesce(F.col(body_col).cast("string"), F.lit("")).alias("__body"), when.alias("__when"))
    src = src.join(keep(decisions(pages, id_col, body_col), "revisits"), "__id", "left")
    # a page that shares its id with another one is a revisit only if its payload can be
    src = src.withColumn("first", F.when(F.octet_length("__body") >= LEAST_REVISIT, F.col("first")))
    unsafe = re.compile(r"[\x00-\x20\x7f]")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, f, name, n, size = TaskContext.get().partitionId(), None, "", 0, 0
        done: list[dict] = []
        for b in batches:
            for page, url, body, at, first in zip(*(c.to_pylist() for c in b.columns)):
                if f is None:
                    name = f"{folder}/task-{task:06d}-{uuid.uuid4().hex}.warc.gz"
                    f, n, size = create(name), 0, 0
                data = body.encode()
                at = min(max(page or 0, 0), LATEST) if at is None else int(at - EPOCH.timestamp())
                date = (EPOCH + timedelta(seconds=at)).strftime("%Y-%m-%dT%H:%M:%SZ")
                safe = unsafe.sub(lambda m: f"%{ord(m[0]):02X}", url)
                raw = _record("response" if first is None else "revisit", page, safe, date, data, hashlib.sha256(data).hexdigest(), first)
                pack = zlib.compressobj(1, zlib.DEFLATED, 31)
                raw = pack.compress(raw) + pack.flush()
                f.write(raw)
                n, size = n + 1, size + len(raw)
                if size >= ARCHIVE_BYTES:
                    f.close()
                    done.append({"archive": name, "records": n})
                    f = None
        if f is not None:
            f.close()
            done.append({"archive": name, "records": n})
        if done:
            yield pa.RecordBatch.from_pylist(done, pa.schema([("archive", pa.string()), ("records", pa.int64())]))

    return keep(src.select("__id", "__url", "__body", "__when", "first").mapInArrow(run, "archive string, records long"), "warc-manifest")


def members(f, step: int = 1 << 20) -> Iterator[tuple[int, int, bytes]]:
    """(position, size, content) of each gzip member of a stream."""
    at, rest = 0, b""
    while rest or (rest := f.read(step)):
        unpack, parts, used = zlib.decompressobj(31), [], 0
        while not unpack.eof:
            if not rest and not (rest := f.read(step)):
                raise ValueError("archive ends within a record")
            parts.append(unpack.decompress(rest))
            used += len(rest) - len(unpack.unused_data)
            rest = unpack.unused_data
        yield at, used, b"".join(parts)
        at += used


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """WARC headers and payload (HTTP headers removed) of one record."""
    head, _, block = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    block = block[:int(fields["Content-Length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    size = re.search(rb"(?mi)^Content-Length: (\d+)", http)
    return fields | {"http-length": size[1].decode() if size else str(len(body))}, body


def captures(manifest: DataFrame) -> DataFrame:
    """The captures in the archives of a manifest as locally sorted runs: capture columns, run (any number) and place in the run.

    Payload size and digest of a response are taken from the payload itself, those of a revisit from its headers.
    """
    n = manifest.count()
    schema = pa.schema([*CAPTURE, ("run", pa.int64()), ("place", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        rows: list[tuple] = []
        for b in batches:
            for name in b.column(0).to_pylist():
                with read(name) as f:
                    for at, size, raw in members(f):
                        h, body = parse(raw)
                        page, first = ((int(m[1]) if (m := re.match(r"<urn:page:(-?\d+)>", h.get(k, ""))) else None) for k in ("WARC-Record-ID", "WARC-Refers-To"))
                        told = h["WARC-Payload-Digest"].removeprefix("sha256:")
                        kind = h["WARC-Type"]
                        if kind == "response" and hashlib.sha256(body).hexdigest() != told:
                            raise ValueError(f"damaged payload in {name} at {at}")
                        rows.append((url_key(h["WARC-Target-URI"]), h["WARC-Date"], page, h["WARC-Target-URI"], kind,
                                     int(h["http-length"]) if kind == "revisit" else len(body), told, first, name, at, size))
                        if len(rows) >= RUN_ROWS:
                            yield local(rows, number)
                            rows, number = [], number + 1
        if rows:
            yield local(rows, number)

    def local(rows: list[tuple], number: int) -> pa.RecordBatch:
        rows.sort(key=_order)
        cols = [*zip(*rows), [number] * len(rows), range(len(rows))]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types)], schema=schema)

    return manifest.select("archive").repartition(max(1, n)).mapInArrow(run, _DDL + ", run long, place int")


def _order(row: tuple) -> tuple:
    return row[0], row[1], row[2] is not None, row[2] or 0, row[8], row[9]


class LoserTree:
    """Merges sorted lists: inner nodes hold the loser of their match, so a step replays one path from leaf to root."""

    def __init__(self, runs: list[list], key):
        self.runs, self.key, self.at = runs, key, [0] * len(runs)
        self.k = len(runs)
        self.heads = [key(r[0]) if r else None for r in runs]
        self.tree = [-1] * max(1, self.k)  # tree[0]: the winner
        for leaf in range(self.k):
            self._play(leaf)

    def _beats(self, a: int, b: int) -> bool:
        """A spent run loses to every other; equal heads go by run number."""
        x, y = self.heads[a], self.heads[b]
        return y is None and (x is not None or a < b) or x is not None and y is not None and (x, a) < (y, b)

    def _play(self, leaf: int) -> None:
        winner, node = leaf, (leaf + self.k) // 2
        while node:
            if self.tree[node] < 0:  # while the tree is built the first to come waits for its opponent
                self.tree[node] = winner
                return
            if self._beats(self.tree[node], winner):
                self.tree[node], winner = winner, self.tree[node]
            node //= 2
        self.tree[0] = winner

    def __iter__(self):
        while self.k and self.heads[w := self.tree[0]] is not None:
            run = self.runs[w]
            yield run[self.at[w]]
            self.at[w] += 1
            self.heads[w] = self.key(run[self.at[w]]) if self.at[w] < len(run) else None
            self._play(w)


def index(runs: DataFrame) -> DataFrame:
    """All captures in global order of (URL key, timestamp, id), with range_no and place_in_range giving that order.

    Ranges are cut by the full key, so a URL with any share of the captures spreads over ranges; the runs' slices of one range meet in one task.
    """
    runs = keep(runs, "capture-runs")
    ranges = max(1, -(-runs.count() // RANGE_ROWS))
    dealt = runs.repartitionByRange(ranges, "url_key", "captured", "page_id", "archive", "record_at").sortWithinPartitions("run", "place")
    schema = pa.schema([*CAPTURE, ("range_no", pa.int32()), ("place_in_range", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId(), list(batches)
        if not held:
            return
        t = pa.Table.from_batches(held)
        edges = [0, *(np.flatnonzero(np.diff(t.column("run").to_numpy())) + 1).tolist(), t.num_rows]
        keys = list(zip(*(t.column(c).to_pylist() for c in CAPTURE.names)))
        # a run's slice is a list of row numbers; they are merged, and the rows taken in that order
        order = np.fromiter(LoserTree([range(a, b) for a, b in pairwise(edges)], lambda i: _order(keys[i])), np.int64, t.num_rows)
        merged = t.select(CAPTURE.names).take(pa.array(order)).append_column("range_no", pa.array([number] * t.num_rows, pa.int32()))
        yield from merged.append_column("place_in_range", pa.array(np.arange(t.num_rows))).cast(schema).combine_chunks().to_batches()

    return dealt.mapInArrow(run, _DDL + ", range_no int, place_in_range long")

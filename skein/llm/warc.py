"""WARC archives: writing with revisits, reading back, and an index merged out of sorted runs.

write_archives puts one record per capture into gzip-compressed WARC 1.1 files in a shared folder: a response, or a
revisit of the capture that keeps the payload. read_archives parses the files, checks every digest, and leaves for each
file a run: its captures sorted by URL key, timestamp and id. An archive ends after so many written bytes or captures, so that
a run is sorted in bounded memory. merge_runs merges the runs externally: each task takes one range of places in that order
(one URL with very many captures is cut like any other stretch), seeks to it in every run through the run's sparse index, and
merges the parts with a tree of losers, so that the ranges in a row are all captures in global order. More runs than one merge
may hold open are first merged in passes.

Payload groups are found with partial aggregates over digests; payloads move once, to meet the marks of revisits.

Null payloads count as empty and null URLs as empty URLs. Rows with a null or the same id are records of their own; the
response of equal payloads is the one with the largest id (of repeated rows each has the record type of its id). Empty
tables give empty results; columns other than id, url and payload are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import json
import struct
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from datetime import UTC, datetime, timedelta
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.storage import each_alone, materialise, new_path

#: Written bytes and captures after which an archive file ends, captures between entries of a run's sparse index, runs in a merge.
ARCHIVE_BYTES, ARCHIVE_CAPTURES, SPARSE, FAN_IN = 256 << 20, 100_000, 256, 64
#: Time of the capture with id 0; each id is a second later. Used where the input has no time of its own.
EPOCH = datetime(2024, 1, 1, tzinfo=UTC)
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url: str) -> str:
    """The key that sorts captures by site: host reversed, scheme and www dropped, lower case, no fragment."""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return url.strip().lower()
    host = host.removeprefix("www.")
    default = {"http": 80, "https": 443}.get(parts.scheme.lower())
    tail = "/" + quote(unquote(parts.path.lstrip("/")), safe="/%:@!$&'()*+,;=~") + (f"?{parts.query}" if parts.query else "")
    return ",".join(reversed(host.split("."))) + (f":{port}" if port and port != default else "") + ")" + tail.lower()


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def record(kind: str, record_id: str, url: str, date: str, digest: str, payload: bytes, refers: tuple[str, str] | None, capture: str) -> bytes:
    """One WARC record: an HTTP head, then the payload; a revisit has the head alone."""
    url = url.replace("\r", "%0D").replace("\n", "%0A")
    head = [
        ("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Capture-ID", capture),
    ]
    if refers:
        head += [("WARC-Refers-To", refers[0]), ("X-Refers-To-Capture", refers[1]), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Payload-Length", str(len(payload)))]
        payload = b""
    payload = HTTP_HEAD + payload
    head += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(payload)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n").encode() + payload + b"\r\n\r\n"


def _record_id(capture: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, 'capture:' + capture)}>"


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the archives; returns their paths. Payloads of at least `least` bytes are deduplicated."""
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), payload.alias("payload"))
    keyed = rows.select("id", F.octet_length("payload").alias("n"), F.sha1("payload").alias("sha")).where(F.col("n") >= least)
    original = keyed.groupBy("sha").agg(F.max("id").alias("original"), F.count("*").alias("copies"))
    # Only groups with copies go to the writers, and of those only the revisits.
    revisits = keyed.join(original.where("copies > 1").select("sha", "original"), "sha").where("id < original or (id is null and original is not null)").select(F.col("id").alias("r_id"), F.col("sha").alias("r_sha"), F.col("original")).distinct()
    marked = rows.withColumn("sha", F.sha1("payload")).join(revisits, F.col("id").eqNullSafe(F.col("r_id")) & (F.col("sha") == F.col("r_sha")), "left").select("id", "url", "payload", "original")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        system, root = _open(folder)
        system.create_dir(root, recursive=True)
        part, out, size, held, path, done = 0, None, 0, 0, "", []

        def finish() -> None:
            out.close()
            system.move(path, path.rsplit(".", 1)[0])
            done.append(f"{folder}/{path.rsplit('/', 1)[1].rsplit('.', 1)[0]}")

        for batch in batches:
            for id_, url, payload, original in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if out is None:
                    # Another attempt at this task writes files of its own; only returned paths are read.
                    path = f"{root}/capture-{context.partitionId():06d}-{context.taskAttemptId()}-{part:04d}.warc.gz.open"
                    out, size, held, part = system.open_output_stream(path, compression=None), 0, 0, part + 1
                    out.write(_member(_info(path)))
                date = (EPOCH + timedelta(seconds=min(max(id_ or 0, 0), 10**10))).strftime("%Y-%m-%dT%H:%M:%SZ")
                capture = "" if id_ is None else str(id_)
                refers = None if original is None else (_record_id(str(original)), str(original))
                member = _member(record("response" if refers is None else "revisit", _record_id(capture), url, date, sha1_base32(payload), payload, refers, capture))
                out.write(member)
                size, held = size + len(member), held + 1
                if size >= archive_bytes or held >= ARCHIVE_CAPTURES:
                    finish()
                    out = None
        if out is not None:
            finish()
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], ["path"])

    return materialise(marked.mapInArrow(write, "path string"), "archives")


def _info(path: str) -> bytes:
    body = b"software: skein\r\nformat: WARC File Format 1.1\r\n"
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: {_record_id('info:' + path)}\r\nWARC-Date: {EPOCH:%Y-%m-%dT%H:%M:%SZ}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    """A gzip member of one record."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def members(stream, block: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """Offset and content of each gzip member; one member is in memory at a time."""
    at, data = 0, b""
    while True:
        if not data and not (data := stream.read(block)):
            return
        unpacker, start, parts = zlib.decompressobj(31), at, []
        while not unpacker.eof:
            if not data and not (data := stream.read(block)):
                raise ValueError(f"the archive ends within the member at {start}")
            parts.append(unpacker.decompress(data))
            at += len(data) - len(unpacker.unused_data)
            data = unpacker.unused_data
        yield start, b"".join(parts)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError(f"not a WARC record: {lines[0][:40]}")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    n = int(fields["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's length is not what it says")
    return fields, rest[:n]


CAPTURE = "key string, time string, id long, n long, digest string, kind string, refers long, url string, path string, offset long"
FIELDS = [x.split()[0] for x in CAPTURE.split(", ")]


def captures_of(path: str) -> list[dict]:
    """The captures of an archive; each payload's digest is checked."""
    system, where = _open(path)
    out = []
    with system.open_input_stream(where, compression=None) as stream:
        for offset, data in members(stream):
            fields, body = parse_record(data)
            if fields["warc-type"] == "warcinfo":
                continue
            digest, revisit = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"] == "revisit"
            body = body.partition(b"\r\n\r\n")[2]
            if not revisit and sha1_base32(body) != digest:
                raise ValueError(f"the payload at {offset} of {path} is damaged")
            url, number = fields["warc-target-uri"], fields["x-capture-id"]
            out.append({
                "key": url_key(url), "time": fields["warc-date"], "id": int(number) if number else None, "n": int(fields["x-payload-length"]) if revisit else len(body), "digest": digest, "kind": fields["warc-type"],
                "refers": int(fields["x-refers-to-capture"]) if revisit else None, "url": url, "path": path, "offset": offset,
            })
    return out


def _place(capture: dict) -> tuple[str, str, int]:
    """What ranges are cut by."""
    return (capture["key"], capture["time"], -1 if capture["id"] is None else capture["id"])


def _order(capture: dict) -> tuple:
    return (*_place(capture), capture["path"], capture["offset"])


def write_run(path: str, captures: Iterator[dict]) -> None:
    """A run: blocks of sorted captures, each compressed, then the sparse index of their first places and where it stands."""
    system, where = _open(path)
    index, firsts, block, at = [], [], [], 0
    with system.open_output_stream(where, compression=None) as out:

        def flush() -> None:
            nonlocal at, block
            data = zlib.compress("\n".join(block).encode(), 6)
            index.append(at)
            out.write(struct.pack("<I", len(data)) + data)
            at += 4 + len(data)
            block = []

        for c in captures:
            if not block:
                firsts.append(_place(c))
            block.append(json.dumps([c[k] for k in FIELDS]))
            if len(block) == SPARSE:
                flush()
        if block:
            flush()
        tail = zlib.compress(json.dumps([firsts, index]).encode())
        out.write(tail + struct.pack("<QI", at, len(tail)))


class RunReader:
    """Captures of a run with low <= place < high; a block at a time is in memory."""

    def __init__(self, path: str):
        system, where = _open(path)
        self.file = system.open_input_file(where)
        size = self.file.size()
        self.file.seek(size - 12)
        at, n = struct.unpack("<QI", self.file.read(12))
        self.file.seek(at)
        firsts, self.offsets = json.loads(zlib.decompress(self.file.read(n)))
        self.firsts = [tuple(x) for x in firsts]

    def between(self, low: tuple[str, str, int] | None, high: tuple[str, str, int] | None) -> Iterator[dict]:
        first = 0 if low is None else max(0, bisect_left(self.firsts, low) - 1)
        last = len(self.firsts) if high is None else bisect_right(self.firsts, high)
        for k in range(first, last):
            self.file.seek(self.offsets[k])
            (n,) = struct.unpack("<I", self.file.read(4))
            for line in zlib.decompress(self.file.read(n)).decode().split("\n"):
                c = dict(zip(FIELDS, json.loads(line), strict=True))
                if (low is None or _place(c) >= low) and (high is None or _place(c) < high):
                    yield c


class LoserTree:
    """Merges sorted iterators: each inner node keeps the loser of the match played there, the winner goes up."""

    def __init__(self, runs: list[Iterator], key: Callable):
        self.runs, self.key, self.k = runs, key, len(runs)
        self.heads = [next(r, None) for r in runs]
        self.ranks = [None if h is None else key(h) for h in self.heads]
        self.losers = [-1] * max(1, self.k)
        for i in range(self.k):
            self._play(i, filling=True)

    def _beats(self, a: int, b: int) -> bool:
        """Whether run a comes before run b; exhausted runs come last, equal heads in the order of the runs."""
        if self.ranks[a] is None or self.ranks[b] is None:
            return self.ranks[b] is None and (self.ranks[a] is not None or a < b)
        return (self.ranks[a], a) < (self.ranks[b], b)

    def _play(self, run: int, filling: bool = False) -> None:
        node = (run + self.k) // 2
        while node > 0:
            if self.losers[node] < 0 and filling:
                self.losers[node] = run
                return
            if self._beats(self.losers[node], run):
                run, self.losers[node] = self.losers[node], run
            node //= 2
        self.losers[0] = run

    def __iter__(self) -> Iterator:
        if not self.k:
            return
        while self.ranks[winner := self.losers[0]] is not None:
            yield self.heads[winner]
            self.heads[winner] = head = next(self.runs[winner], None)
            self.ranks[winner] = None if head is None else self.key(head)
            self._play(winner)


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Read each archive whole and write its run; returns path, number of captures and evenly spaced places of each run."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(folder)
        system.create_dir(root, recursive=True)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                captures = sorted(captures_of(path), key=_order)
                run = f"{folder}/{path.rsplit('/', 1)[1]}-{TaskContext.get().taskAttemptId()}.run"
                write_run(run, iter(captures))
                places = [dict(zip(("key", "time", "id"), _place(c))) for c in captures[:: max(1, len(captures) // 16)]]
                yield pa.RecordBatch.from_arrays([pa.array([run]), pa.array([len(captures)], pa.int64()), pa.array([places], _PLACES)], ["path", "n", "places"])

    spread = each_alone(archives.sparkSession, [(r.path,) for r in archives.toLocalIterator()], "path string")
    return materialise(spread.mapInArrow(read, RUN), "runs")


RUN = "path string, n long, places array<struct<key: string, time: string, id: long>>"
_PLACES = pa.list_(pa.struct([("key", pa.string()), ("time", pa.string()), ("id", pa.int64())]))


def merge_runs(spark: SparkSession, runs: DataFrame, folder: str, fan_in: int = FAN_IN) -> DataFrame:
    """All captures of the runs in global order: position counts from 0, range numbers the ranges of places.

    Ranges are cut at quantiles of the runs' evenly spaced places. The driver holds the runs' paths, a few numbers for
    each range, and no capture.
    """
    found = [(r.path, r.n) for r in runs.select("path", "n").toLocalIterator()]
    passes = 0
    while len(found) > fan_in:  # merge in passes until one merge can hold all runs open
        groups = [(f"{folder}/pass-{passes}-{k:06d}.run", [p for p, _ in found[k : k + fan_in]]) for k in range(0, len(found), fan_in)]
        totals = {k: sum(n for _, n in found[k * fan_in : (k + 1) * fan_in]) for k in range(len(groups))}

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for target, paths in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    own = f"{target}-{TaskContext.get().taskAttemptId()}"
                    write_run(own, iter(LoserTree([RunReader(p).between(None, None) for p in paths], _order)))
                    yield pa.RecordBatch.from_arrays([pa.array([target]), pa.array([own])], ["target", "path"])

        merged = materialise(each_alone(spark, groups, "target string, paths array<string>").mapInArrow(merge, "target string, path string"), "pass")
        names = {r.target: r.path for r in merged.toLocalIterator()}
        found = [(names[t], totals[k]) for k, (t, _) in enumerate(groups)]
        passes += 1
    paths = [p for p, n in found if n]
    # Range bounds by a bounded sketch of the runs' places, found on the executors.
    at = runs.select(F.explode("places").alias("at")).select("at.key", "at.time", "at.id")
    tasks = max(1, spark.sparkContext.defaultParallelism)
    firsts = at.repartitionByRange(tasks, "key", "time", "id").groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct("key", "time", "id")).alias("at"))
    bounds = sorted({tuple(r["at"]) for r in firsts.toLocalIterator()})[1:]
    cuts = [(i, *low, *high) for i, (low, high) in enumerate(zip([_OPEN, *bounds], [*bounds, _OPEN]))]

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("range", pa.int64()), ("place", pa.int64()), ("key", pa.string()), ("time", pa.string()), ("id", pa.int64()), ("n", pa.int64()), ("digest", pa.string()), ("kind", pa.string()), ("refers", pa.int64()), ("path", pa.string()), ("offset", pa.int64())])
        for batch in batches:
            for number, *ends in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                low, high = (None if x[0] is None else tuple(x) for x in (ends[:3], ends[3:]))
                rows = []
                for place, c in enumerate(LoserTree([RunReader(p).between(low, high) for p in paths], _order)):
                    rows.append(c | {"range": number, "place": place})
                    if len(rows) == 4096:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    todo = each_alone(spark, cuts, "range long, low_key string, low_time string, low_id long, high_key string, high_time string, high_id long")
    merged = materialise(todo.mapInArrow(ranges, "range long, place long, key string, time string, id long, n long, digest string, kind string, refers long, path string, offset long"), "merged")
    sizes = {r["range"]: r["n"] for r in merged.groupBy("range").agg(F.count("*").alias("n")).toLocalIterator()}
    before = list(itertools.accumulate((sizes.get(k, 0) for k in range(len(cuts))), initial=0))
    starts = spark.createDataFrame(list(enumerate(before[:-1])), "range long, before long")  # a row for each of `tasks` ranges
    return merged.join(F.broadcast(starts), "range").select("range", (F.col("before") + F.col("place")).alias("position"), "key", "time", "id", "n", "digest", "kind", "refers", "path", "offset")


#: No bound.
_OPEN = (None, None, None)


def archive_round_trip(pages: DataFrame, least: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write archives, read them back, merge the index: one row per capture with its place in the global order."""
    spark = pages.sparkSession
    folder = new_path(spark, "warc")
    archives = write_archives(pages, f"{folder}/archives", id_col, url_col, payload_col, least)
    return merge_runs(spark, read_archives(archives, f"{folder}/runs"), f"{folder}/runs")

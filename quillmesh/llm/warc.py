"""WARC archives with a two-level capture index.

Records are gzip members of their own, in files that tasks write to a folder all executors share;
each file begins with a warcinfo record.  Of equal payloads one record is the response, the others
revisit it and name its record, date and URI.  A record's id comes from its page, URL, payload and
how many equal rows came before it, so it is its own and the same in every run.  The index sorts
captures by reversed-host URL key (then page_id, null first) into compressed blocks; a sparse directory has the first key,
file, place and length of each block.  It is in parts, one for each task that wrote a part of the
index, and the list of the parts is as long as there were tasks.  A look-up searches the parts
and then a part's blocks by bisection, reads the block's range, and then the record's range.

Files get their names from the task attempt and are listed by what the tasks return, so a task
that ran twice leaves a spare file but no second record.  Folders are ``file:`` paths, or any
that ``pyarrow.fs`` opens on the executors.

A null payload is an empty one; null URLs and ids are kept as such, URLs that are no valid URI beside
an encoded form; payloads of any length are one record; repeated rows are a record each; no rows
make no records and an empty index.  Only page_id, url and html are read, so other columns cannot clash.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import join_counted, stage

FILE_BYTES, BLOCK_LINES = 32 << 20, 300
#: Captures whose index one task writes, and bytes of records that one reads back.
CAPTURES_A_TASK, READ_BYTES = 500_000, 8 << 20
_WHEN = "2024-01-01T00:00:00Z"  # pages have no capture time

CAPTURES = "page_id long, url string, urlkey string, file string, offset long, length long"
PARTS = "first array<string>, last array<string>, file string, offset long, length long, n long"


def place(folder: str) -> tuple[fs.FileSystem, str]:
    if "://" not in folder and ":" not in folder.split("/")[0]:
        folder = f"file://{folder}"
    if folder.startswith("file:"):
        return fs.LocalFileSystem(), "/" + folder[5:].lstrip("/")
    return fs.FileSystem.from_uri(folder)


def url_key(url: str | None) -> str:
    """Host reversed by its labels, then ``)`` and the path and query; scheme, www, port and fragment go."""
    try:
        parts = urlsplit((url or "").strip())
        host = (parts.hostname or "").rstrip(".")
    except ValueError:
        return (url or "").lower()
    host = host.removeprefix("www.")
    path = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return ",".join(reversed(host.split("."))) + ")" + path.lower()


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, url: str | None, digest: str, turn: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, json.dumps([page_id, url, digest, turn]))}>"


def uri(url: str | None) -> str:
    """The URL with what no header or URI may hold percent-encoded."""
    return quote(url or "", safe="%/:?#[]@!$&'()*+,;=-._~")


def packed(lines: list[str], body: bytes) -> bytes:
    head = "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(body)}"]).encode()
    return gzip.compress(head + b"\r\n\r\n" + body + b"\r\n\r\n", 5, mtime=0)


def info(name: str) -> bytes:
    """The record that describes a file."""
    kind = ["WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>", f"WARC-Date: {_WHEN}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields"]
    return packed(kind, b"software: quillmesh\r\nformat: WARC File Format 1.1\r\n")


def record(page_id: int | None, url: str | None, payload: bytes, turn: int = 1, refers: tuple[int | None, str | None] | None = None) -> bytes:
    """One record.  A revisit has the response's head, which tells the payload's length, and no payload."""
    digest = digest_of(payload)
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    lines = [
        f"WARC-Type: {'revisit' if refers else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, url, digest, turn)}",
        f"WARC-Target-URI: {uri(url)}",
        f"WARC-Date: {_WHEN}",
        f"WARC-Page-ID: {'' if page_id is None else page_id}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if url is None or uri(url) != url:
        lines.append(f"WARC-Page-URL: {json.dumps(url)}")
    if refers:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_id(*refers, digest, 1)}",
            f"WARC-Refers-To-Target-URI: {uri(refers[1])}",
            f"WARC-Refers-To-Date: {_WHEN}",
            f"WARC-Refers-To-Page-ID: {'' if refers[0] is None else refers[0]}",
        ]
    return packed([*lines, "Content-Type: application/http; msgtype=response"], head if refers else head + payload)


def read_record(member: bytes) -> dict:
    """A record's fields, from its gzip member; raises if lengths or digest don't hold."""
    raw = gzip.decompress(member)
    top, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = top.decode().split("\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    size = int(fields["Content-Length"])
    if not version.startswith("WARC/") or rest[size:] != b"\r\n\r\n":
        raise ValueError("broken record")
    head, _, payload = rest[:size].partition(b"\r\n\r\n")
    declared = int(next(x for x in head.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != declared or digest_of(payload) != digest):
        raise ValueError("payload does not match its length or digest")
    number = lambda s: int(s) if s else None
    return {
        "page_id": number(fields["WARC-Page-ID"]), "url": json.loads(fields["WARC-Page-URL"]) if "WARC-Page-URL" in fields else fields["WARC-Target-URI"], "record_type": fields["WARC-Type"],
        "record_id": fields["WARC-Record-ID"], "refers_to_record": fields.get("WARC-Refers-To"),
        "payload": payload if fields["WARC-Type"] == "response" else None, "payload_bytes": declared, "payload_digest": digest,
        "refers_to": number(fields.get("WARC-Refers-To-Page-ID", "")),
    }


def with_roles(pages: DataFrame, least: int = 0) -> DataFrame:
    """pages(page_id, url, html) -> page_id, url, html, turn (among equal rows), refers (null for a response; else page_id and url).

    The response is the largest page_id of its payload (null the smallest), then the largest url.
    Rows that repeat both are one response and revisits.  Payloads of fewer bytes than ``least``
    are all responses.  Payloads that many rows share are combined before they are shuffled, and
    what is told of the most frequent goes to all executors.
    """
    html = F.coalesce("html", F.lit(""))
    own = F.sha1(F.to_json(F.struct("page_id", "url", F.sha1(html).alias("d"))))
    key = F.struct(F.col("page_id").isNotNull().alias("k"), "page_id", F.col("url").isNotNull().alias("u"), "url", "own")
    small = stage(pages.select("page_id", "url", own.alias("own"), F.sha1(html).alias("digest"), F.octet_length(html).alias("size")).where(F.col("size") >= least), "payloads")
    best = stage(small.groupBy("digest").agg(F.max(key).alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1"), "best")
    late = join_counted(small.select("own", "digest"), best, "digest", best.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]).select(F.col("own").alias("_own"), "best").distinct()
    turn = F.row_number().over(Window.partitionBy("own").orderBy(F.lit(1)))
    full = pages.select("page_id", "url", html.alias("html"), own.alias("own")).withColumn("turn", turn)
    joined = full.join(late, F.col("own") == F.col("_own"), "left")
    other = F.col("best").isNotNull() & ((F.col("own") != F.col("best.own")) | (F.col("turn") > 1))
    return joined.select("page_id", "url", "html", "turn", F.when(other, F.struct("best.page_id", "best.url")).alias("refers"))


class _Writer:
    """Appends packed records to files of a bounded size, each new and in place only when whole."""

    def __init__(self, folder: str, kind: str):
        self.files, self.root = place(folder)
        self.kind, self.out, self.at = kind, None, 0

    def add(self, packed: bytes) -> tuple[str, int, int]:
        if self.out is None:
            self.files.create_dir(self.root, recursive=True)
            self.name, self.at = f"{self.kind}-{uuid.uuid4().hex}", 0
            self.out = self.files.open_output_stream(f"{self.root}/{self.name}")
            if "warc" in self.kind:
                opening = info(self.name)
                self.out.write(opening)
                self.at = len(opening)
        self.out.write(packed)
        got = (self.name, self.at, len(packed))
        self.at += len(packed)
        if self.at >= FILE_BYTES:
            self.close()
        return got

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


class _Reader:
    """Reads ranges of the files of a folder, keeping a few open."""

    def __init__(self, folder: str):
        self.files, self.root = place(folder)
        self.open: dict[str, pa.NativeFile] = {}

    def range(self, name: str, offset: int, length: int) -> bytes:
        if name not in self.open:
            if len(self.open) >= 64:
                self.open.pop(next(iter(self.open))).close()
            self.open[name] = self.files.open_input_file(f"{self.root}/{name}")
        return self.open[name].read_at(length, offset)


def write_archive(roles: DataFrame, folder: str) -> DataFrame:
    """Writes every row of ``with_roles``; returns the captures, lazily: an action writes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Writer(folder, "records.warc.gz")
        names = ["page_id", "url", "urlkey", "file", "offset", "length"]
        try:
            for b in batches:
                got = []
                for page, url, html, turn, refers in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "turn", "refers")), strict=True):
                    to = (refers["page_id"], refers["url"]) if refers else None
                    got.append((page, url, url_key(url), *out.add(record(page, url, html.encode(), turn, to))))
                if got:
                    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*got, strict=True), kinds, strict=True)], names=names)
        finally:
            out.close()

    return roles.select("page_id", "url", "html", "turn", "refers").mapInArrow(run, CAPTURES)


def write_index(captures: DataFrame, folder: str) -> DataFrame:
    """Sorts captures into compressed blocks; returns the directory's parts, a row a task, lazily: an action writes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, block, blocks = _Writer(folder, "index.cdx.gz"), [], []

        def flush() -> None:
            lines = "\n".join(json.dumps(x) for x in block).encode()
            blocks.append((block[0][:3], block[-1][:3], *out.add(zlib.compress(lines, 6)), len(block)))
            block.clear()

        try:
            for b in batches:
                for row in zip(*(b.column(c).to_pylist() for c in ("urlkey", "known", "id", "file", "offset", "length")), strict=True):
                    block.append(row)
                    if len(block) >= BLOCK_LINES:
                        flush()
            if block:
                flush()
        finally:
            out.close()
        if blocks:
            directory = _Writer(folder, "directory.gz")
            at = directory.add(zlib.compress("\n".join(json.dumps(x) for x in blocks).encode(), 6))
            directory.close()
            ends = [list(map(str, key)) for key in (blocks[0][0], blocks[-1][1])]
            columns = [[ends[0]], [ends[1]], [at[0]], [at[1]], [at[2]], [len(blocks)]]
            kinds = [pa.list_(pa.string())] * 2 + [pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["first", "last", "file", "offset", "length", "n"])

    known = F.col("page_id").isNotNull().cast("int")
    rows = captures.select("urlkey", known.alias("known"), F.coalesce("page_id", F.lit(0)).alias("id"), "file", "offset", "length")
    keys, tasks = ["urlkey", "known", "id"], 1 + captures.count() // CAPTURES_A_TASK
    return rows.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys).mapInArrow(run, PARTS)


class Index:
    """The parts of the directory, and look-ups through them; the last part and block read are kept."""

    def __init__(self, folder: str, parts: list[tuple]):
        key = lambda k: [k[0], int(k[1]), int(k[2])]
        self.parts = sorted((key(first), key(last), *at) for first, last, *at in parts)
        self.reader = _Reader(folder)
        self.kept: dict[str, tuple] = {}

    def _lines(self, level: str, entry: tuple | list) -> list[list]:
        where = tuple(entry[2:5])
        if self.kept.get(level, (None,))[0] != where:
            lines = zlib.decompress(self.reader.range(*where)).decode().split("\n")
            self.kept[level] = (where, [json.loads(x) for x in lines])
        return self.kept[level][1]

    @staticmethod
    def _over(entries: list, low: list, high: list) -> Iterator:
        """Those of entries, sorted by their first keys, that overlap low to high."""
        at = bisect_left(entries, low, key=lambda e: e[1])
        while at < len(entries) and entries[at][0] <= high:
            yield entries[at]
            at += 1

    def find(self, urlkey: str, page_id: int | None = -1, every: bool = False) -> Iterator[list]:
        """Captures of a URL key and page, or of every page of the key."""
        own = [urlkey, int(page_id is not None), page_id or 0]
        low, high = ([urlkey, 0, 0], [urlkey, 2, 0]) if every else (own, own)
        for part in self._over(self.parts, low, high):
            for entry in self._over(self._lines("part", part), low, high):
                block = self._lines("block", entry)
                at = bisect_left(block, low, key=lambda c: c[:3])
                while at < len(block) and block[at][:3] <= high:
                    yield block[at]
                    at += 1

    def read(self, capture: list) -> dict:
        return read_record(self.reader.range(*capture[3:6]))


READ = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long"


def read_back(wanted: DataFrame, parts: DataFrame, folder: str) -> DataFrame:
    """The record of each capture of ``wanted`` (urlkey, page_id, length; repeats count once), by way of the index.

    What is wanted is sorted and dealt by number into tasks of about READ_BYTES of records, so a
    task reads few blocks, each once.  Only the list of the
    directory's parts, a row for each task that wrote the index, goes to all executors.
    """
    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    sent = wanted.sparkSession.sparkContext.broadcast([tuple(r) for r in parts.collect()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(folder, sent.value)
        for b in batches:
            got = []
            for key, page in zip(b.column("urlkey").to_pylist(), b.column("page_id").to_pylist(), strict=True):
                for capture in index.find(key, page):
                    r = index.read(capture)
                    got.append([r[n] for n in names])
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*got, strict=True), kinds, strict=True)], names=names)

    own = wanted.groupBy("urlkey", "page_id").agg(F.sum("length").alias("length"))
    tasks = 1 + (wanted.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0] // READ_BYTES)
    return own.select("urlkey", "page_id").repartitionByRange(tasks, "urlkey", "page_id").sortWithinPartitions("urlkey", "page_id").mapInArrow(run, READ)


def archive(pages: DataFrame, folder: str, least: int = 0) -> tuple[DataFrame, DataFrame]:
    """Writes archives and index of pages(page_id, url, html); returns captures and directory parts."""
    captures = stage(write_archive(with_roles(pages, least), folder), "captures")
    return captures, stage(write_index(captures, folder), "parts")

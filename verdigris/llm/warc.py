"""WARC archives as a PySpark Python data source, `format("warc")`.

Reading: any WARC 1.x file, plain or gzip, one member a record or not, made here or
elsewhere; `path` is a folder, or one file. File partitions are planned on the
driver: small files together, files that were written here cut at member borders
which the writer noted; others are one partition each. A record's head is read
first; record types and header predicates that Spark pushed down are tested on it,
and only wanted records have their payload decoded (none with option `payload` =
false). Members that carry their packed length (`sl`, as those written here do) are
jumped over without being read. A file that ends inside a record raises an error
that names it; with option `truncated` = stop, its whole records are returned.

Writing: each task writes gzip members of one record each to files of about `FILE`
bytes. Files become visible by a list that the driver writes after all tasks have
ended; a lost or repeated task leaves no rows.

Both go through pyarrow's file systems, so the folder can be on any store that
those reach. Nulls: a null payload counts as empty, null headers are left out
and read as null. Very long payloads are one row's work. Rows that repeat are
records of their own. An empty table gives an archive without files.
"""

from __future__ import annotations

import base64
import binascii
import datetime
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, StringStartsWith, WriterCommitMessage

from verdigris.llm.common import written

SCHEMA = "warc_type string, record_id string, warc_date string, target_uri string, refers_to string, payload_digest string, payload_length long, payload binary"
#: Header of each column that a predicate can be pushed down to.
HEADERS = {"warc_type": "warc-type", "record_id": "warc-record-id", "warc_date": "warc-date", "target_uri": "warc-target-uri", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest"}
LISTED = "_records.json"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: Fixed value of the standard for revisits of equal payloads.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of archive files that one read task gets, and about how large a file gets.
SPLIT, FILE, CHUNK = 64 << 20, 1 << 30, 1 << 16


def _place(path: str):
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:/") else (pafs.LocalFileSystem(), path)


def _safe(value: str) -> str:
    """No control characters in a header line."""
    return "".join(quote(c) if ord(c) < 32 or ord(c) == 127 else c for c in value)


def pack(head: list[tuple[str, str | None]], block: bytes) -> bytes:
    """One record as a gzip member, with its lengths in the extra field if they fit there."""
    lines = [f"{k}: {_safe(v)}" for k, v in head if v is not None]
    plain = ("WARC/1.1\r\n" + "\r\n".join([*lines, f"Content-Length: {len(block)}"]) + "\r\n\r\n").encode() + block + b"\r\n\r\n"
    press = zlib.compressobj(4, zlib.DEFLATED, -15)
    body = press.compress(plain) + press.flush()
    size, end = 10 + 2 + 12 + len(body) + 8, struct.pack("<II", zlib.crc32(plain), len(plain) & 0xFFFFFFFF)
    if max(size, len(plain)) >> 32:
        return b"\x1f\x8b\x08\x00\0\0\0\0\0\xff" + body + end
    extra = b"sl" + struct.pack("<HII", 8, size, len(plain))
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + end


class _Bytes:
    """The decoded bytes of a plain or gzip file from one member border to another."""

    def __init__(self, file, start: int, end: int | None):
        self.file, self.end = file, end
        file.seek(start)
        self.raw, self.raw_at = file.read(CHUNK), start
        self.gzip = self.raw[:2] == b"\x1f\x8b"
        self.inflate = None
        self.plain, self.base = bytearray(), 0  # decoded and not yet used; how much has been used before it
        self.member_at, self.member_size, self.member_base = start, None, 0

    def _more_raw(self, least: int = 1) -> bool:
        while len(self.raw) < least:
            more = self.file.read(CHUNK)
            if not more:
                return False
            self.raw += more
        return True

    def _told_sizes(self) -> tuple[int, int] | None:
        """The member's packed and plain length as its `sl` field tells them."""
        if not self._more_raw(12) or not self.raw[3] & 4:
            return None
        n = struct.unpack_from("<H", self.raw, 10)[0]
        if not self._more_raw(12 + n):
            return None
        at = 12
        while at + 4 <= 12 + n:
            size = struct.unpack_from("<H", self.raw, at + 2)[0]
            if self.raw[at : at + 2] == b"sl" and size == 8:
                return struct.unpack_from("<II", self.raw, at + 4)
            at += 4 + size
        return None

    def _fill(self) -> bool:
        """Decode some more; False at the end of the range or file."""
        if not self.gzip:
            if self.end is not None and not self.plain and self.raw_at >= self.end:
                return False
            if not self._more_raw():
                return False
            self.plain += self.raw
            self.raw_at, self.raw = self.raw_at + len(self.raw), b""
            return True
        if self.inflate is None:
            if (self.end is not None and self.raw_at >= self.end) or not self._more_raw():
                return False
            self.member_at, self.member_base, self.member_size = self.raw_at, self.base + len(self.plain), self._told_sizes()
            self.inflate = zlib.decompressobj(31)
        if not self._more_raw():
            raise EOFError("ends inside a gzip member")
        had = len(self.raw)
        try:
            self.plain += self.inflate.decompress(self.raw, CHUNK)
        except zlib.error as e:
            raise ValueError(f"is no valid gzip at byte {self.member_at}: {e}") from e
        self.raw = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
        self.raw_at += had - len(self.raw)
        if self.inflate.eof:
            self.inflate = None
        return True

    def peek(self, n: int) -> bytes:
        """Up to n bytes, fewer only at the end."""
        while len(self.plain) < n and self._fill():
            pass
        return bytes(self.plain[:n])

    def until(self, mark: bytes, most: int = 16 << 20) -> bytes:
        """All up to the mark, which is used up, too."""
        seen = 0
        while (at := self.plain.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.plain)
            if seen > most or not self._fill():
                raise EOFError("ends inside a record's head")
        out = bytes(self.plain[:at])
        self._drop(at + len(mark))
        return out

    def take(self, n: int) -> bytes:
        out = self.peek(n)
        if len(out) < n:
            raise EOFError("ends inside a record")
        self._drop(n)
        return out

    def _drop(self, n: int) -> None:
        del self.plain[:n]
        self.base += n

    def skip(self, n: int, at_border: int) -> None:
        """Pass over n bytes; jump if the record that began at `at_border` fills a member of known length."""
        packed, plain = self.member_size or (0, 0)
        if self.inflate is not None and self.member_base == at_border and plain == self.base - at_border + n + 4:
            to = self.member_at + packed
            ahead = to - self.raw_at
            if to > self.file.size():
                raise EOFError("ends inside a gzip member")
            if 0 <= ahead <= len(self.raw):
                self.raw = self.raw[ahead:]
            else:
                self.file.seek(to)
                self.raw = b""
            self.raw_at, self.inflate = to, None
            self.base += len(self.plain)
            self.plain.clear()
            return
        if not self.gzip and n > len(self.plain):
            to = self.raw_at + n - len(self.plain)
            if to > self.file.size():
                raise EOFError("ends inside a record")
            self.file.seek(to)
            self.raw_at, self.raw = to, b""
            self.base += n
            self.plain.clear()
            return
        while n:
            some = min(n, CHUNK)
            self.take(some)
            n -= some


def header_lines(head: bytes) -> dict[str, str]:
    """Names in lower case; a line that starts with white space goes on with the one before."""
    out: dict[str, str] = {}
    last = None
    for line in head.decode("utf-8", "replace").splitlines()[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        last = name.strip().lower() if colon else None
        if last:
            if last in out:
                last = last + "\0"  # of repeated headers the first counts
            out[last] = value.strip()
    return out


def digest_hex(value: str | None) -> str | None:
    """A labelled SHA-1 in base 32 as hex; other forms as they are, without the label of SHA-1."""
    if not value or not value.lower().startswith("sha1:"):
        return value
    bare = value[5:]
    try:
        return base64.b32decode(bare.upper()).hex() if len(bare) == 32 else bare.lower()
    except binascii.Error:
        return bare.lower()


def entity(block: bytes) -> bytes:
    """The payload of an HTTP response: what follows its head, without chunk borders."""
    head, mark, body = block.partition(b"\r\n\r\n")
    if not mark:
        return b""
    if b"chunked" not in header_lines(head).get("transfer-encoding", "").lower().encode():
        return body
    out, at = [], 0
    while (line := body.find(b"\r\n", at)) >= 0:
        try:
            n = int(body[at:line].split(b";")[0], 16)
        except ValueError:
            return body  # was stored without chunk borders
        if not n:
            break
        out.append(body[line + 2 : line + 2 + n])
        at = line + 2 + n + 2
    return b"".join(out)


@dataclass
class _Parts(InputPartition):
    """(file, start, end or None) of each part."""

    parts: list

    def __init__(self, parts):
        self.parts = parts


@dataclass
class _Done(WriterCommitMessage):
    """[name, size, borders] of each file."""

    files: list


def _listed(store, root: str) -> list | None:
    """What writers have listed in the folder, or None if there is no list."""
    if store.get_file_info(f"{root}/{LISTED}").type != pafs.FileType.File:
        return None
    with store.open_input_stream(f"{root}/{LISTED}") as f:
        return json.loads(f.read())


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.payload = options["path"], options.get("payload", "true").lower() != "false"
        self.stop = options.get("truncated", "fail").lower() == "stop"
        self.tests: list[tuple[str, str, tuple]] = []

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in HEADERS and isinstance(f, EqualTo) and isinstance(f.value, str):
                self.tests.append((name, "in", (f.value,)))
            elif name in HEADERS and isinstance(f, In):
                self.tests.append((name, "in", tuple(f.value)))
            elif name in HEADERS and isinstance(f, StringStartsWith):
                self.tests.append((name, "prefix", (f.value,)))
            else:
                yield f

    def partitions(self):
        store, root = _place(self.path)
        if store.get_file_info(root).type == pafs.FileType.File:
            return [_Parts([(root, 0, None)])]
        listed = _listed(store, root)
        if listed is None:
            found = store.get_file_info(pafs.FileSelector(root, recursive=True))
            listed = sorted([f.path.removeprefix(root).lstrip("/"), f.size, []] for f in found if f.type == pafs.FileType.File and f.base_name.lower().endswith((".warc", ".warc.gz")) and f.base_name[0] not in "._")
        out, size = [], 0
        for name, n, borders in listed:
            cuts = [0, *borders, None]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                more = (n if b is None else b) - a
                if not out or size + more > SPLIT:
                    out.append(_Parts([]))
                    size = 0
                out[-1].parts.append((f"{root}/{name}", a, b))
                size += more
        return out or [_Parts([])]

    def _wanted(self, row: dict) -> bool:
        for name, kind, values in self.tests:
            got = row[name]
            if got is None or not (got in values if kind == "in" else got.startswith(values)):
                return False
        return True

    def _records(self, data: _Bytes) -> Iterator[dict]:
        while True:
            while (start := data.peek(2)) and start in (b"\r\n", b"\n\n") or start[:1] == b"\n":
                data.take(2 if start == b"\r\n" else 1)  # the lines between records
            if not start:
                return
            border = data.base
            if data.peek(5) != b"WARC/":
                raise ValueError(f"has no record at byte {data.member_at if data.gzip else border}")
            head = header_lines(data.until(b"\r\n\r\n"))
            row: dict = {c: head.get(h) for c, h in HEADERS.items()}
            row["payload_digest"] = digest_hex(row["payload_digest"])
            row["payload_length"] = int(head["x-payload-length"]) if "x-payload-length" in head else None
            row["payload"] = None
            if not head.get("content-length", "").isdecimal():
                raise ValueError(f"has a record without a Content-Length at byte {data.member_at if data.gzip else border}")
            length = int(head["content-length"])
            if not self._wanted(row):
                data.skip(length, border)
                continue
            if self.payload and row["warc_type"] != "revisit":
                block = data.take(length)
                row["payload"] = entity(block) if head.get("content-type", "").lower().startswith("application/http") else block
                row["payload_length"] = len(row["payload"])
            else:
                data.skip(length, border)
            yield row

    def read(self, partition):
        columns = [c.split() for c in SCHEMA.split(", ")]
        kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds[k]) for c, k in columns], names=[c for c, _ in columns])
        store, _ = _place(self.path)
        for name, start, end in partition.parts:
            rows, size = [], 0
            with store.open_input_file(name) as f:
                try:
                    for r in self._records(_Bytes(f, start, end)):
                        rows.append(r)
                        size += len(r["payload"] or b"") + 300
                        if size > 4 << 20:
                            yield made(rows)
                            rows, size = [], 0
                except EOFError as e:
                    if not self.stop:
                        raise ValueError(f"WARC file {name} {e}") from e
                except ValueError as e:
                    raise ValueError(f"WARC file {name} {e}") from e
            if rows:
                yield made(rows)


class WarcWriter(DataSourceWriter):
    """Rows: warc_type, record_id, target_uri, refers_to, payload_digest (hex), payload_length, payload (binary) and, if any, warc_date."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.date = datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def _record(self, row: dict) -> bytes:
        digest, revisit = row["payload_digest"], row["warc_type"] == "revisit"
        head = [("WARC-Type", row["warc_type"]), ("WARC-Record-ID", row["record_id"]), ("WARC-Date", row.get("warc_date") or self.date)]
        head += [("WARC-Target-URI", row["target_uri"]), ("WARC-Refers-To", row["refers_to"]), ("WARC-Profile", PROFILE if revisit else None)]
        head.append(("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode() if digest else None))
        head += [("Content-Type", "application/http;msgtype=response"), ("X-Payload-Length", str(row["payload_length"]))]
        return pack(head, HTTP if revisit else HTTP + bytes(row["payload"] or b""))

    def write(self, iterator):
        store, root = _place(self.path)
        files, out = [], None
        try:
            for row in iterator:
                if out is None or files[-1][1] >= FILE:
                    if out is not None:
                        out.close()
                    files.append([f"part-{uuid.uuid4().hex}.warc.gz", 0, []])
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(f"{root}/{files[-1][0]}", compression=None)
                _, size, borders = files[-1]
                if size - (borders[-1] if borders else 0) >= SPLIT:
                    borders.append(size)
                record = self._record(row.asDict())
                out.write(record)
                files[-1][1] += len(record)
        finally:
            if out is not None:
                out.close()
        return _Done(files)

    def commit(self, messages):
        store, root = _place(self.path)
        store.create_dir(root, recursive=True)
        held = [] if self.overwrite else _listed(store, root) or []
        held += sorted(f for m in messages if m is not None for f in m.files)
        with store.open_output_stream(f"{root}/{LISTED}") as f:
            f.write(json.dumps(held).encode())

    def abort(self, messages):
        store, root = _place(self.path)
        for m in messages:
            for name, _, _ in m.files if m is not None else []:
                store.delete_file(f"{root}/{name}")


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options, overwrite)


def load(spark, path: str, payload: bool = True) -> DataFrame:
    """The records under `path`; filters on headers reach the reader."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def archive(pages: DataFrame, path: str, least: int = 1000) -> None:
    """Write `pages` (page_id, url, html) to `path`.

    Of equal payloads of at least `least` bytes the largest page_id is the
    response and the others revisit it; rows that repeat that page_id too are
    responses. The decision needs only digests: those that occur more than once
    are written as a table, whose size Spark then knows. Where it is small enough
    to be broadcast, payloads go straight from the table to the archive; beyond
    that they meet it in a join by digest whose hot keys Spark splits.
    """
    spark = pages.sparkSession
    spark.dataSource.register(WarcSource)
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("payload_digest", F.sha1("payload"))
    digests = rows.filter(F.octet_length("payload") >= least).select("page_id", F.unhex("payload_digest").alias("key"))
    groups = written(digests.groupBy("key").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "warc-groups")
    shared = rows.withColumn("key", F.when(F.octet_length("payload") >= least, F.unhex("payload_digest"))).join(groups, "key", "left")
    revisit = F.col("first").isNotNull() & F.coalesce(F.col("page_id") < F.col("first"), F.lit(True))
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    out = shared.select(
        F.when(revisit, "revisit").otherwise("response").alias("warc_type"),
        urn(F.col("page_id")).alias("record_id"),
        F.col("url").cast("string").alias("target_uri"),
        F.when(revisit, urn(F.col("first"))).alias("refers_to"),
        "payload_digest",
        F.octet_length("payload").cast("long").alias("payload_length"),
        F.when(revisit, F.lit(None).cast("binary")).otherwise(F.col("payload")).alias("payload"),
    )
    out.write.format("warc").mode("append").save(path)


def page_number(column: str):
    return F.regexp_extract(column, r"(-?\d+)>$", 1).cast("long")


def summary(spark, path: str) -> DataFrame:
    """Per record: the page, its whole payload's size and digest, and what it refers to.

    Responses are read with their payloads, which are measured and hashed anew;
    revisits by their heads alone. Both predicates are pushed down, so either scan
    jumps over the other's records.
    """
    page = page_number("record_id").alias("page_id")
    full = load(spark, path).filter("warc_type = 'response'")
    again = load(spark, path, payload=False).filter("warc_type = 'revisit'")
    none = F.lit(None).cast("long").alias("refers_to")
    measured = full.select(page, F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), F.col("warc_type").alias("record_type"), none)
    return measured.unionByName(again.select(page, F.col("payload_length").alias("payload_bytes"), "payload_digest", F.col("warc_type").alias("record_type"), page_number("refers_to").alias("refers_to")))

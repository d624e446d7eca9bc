"""WARC archives as a PySpark data source, and records of equal payloads written once.

Reading: whole files are packed into partitions of a target size. In a file each record's header is parsed first; records that
the pushed predicates rule out are never decoded: a plain file is sought past them by their length, a compressed one (a gzip
member for each record) by the member's length where the writer noted it, else what follows the header is inflated and thrown
away. Files are opened with Arrow's file systems, so any store it knows will do.

Writing: each task writes files of its own, begun anew at `file_bytes`, under names that only the commit makes final; a
task that runs again leaves nothing behind.
"""

from __future__ import annotations

import contextlib
import io
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import functions as F

from glosswork.llm.shared import place, small, written

# Names and forms of the WARC 1.1 standard.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FIELDS = {
    "record_type": "WARC-Type", "record_id": "WARC-Record-ID", "date": "WARC-Date", "target_uri": "WARC-Target-URI",
    "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To", "content_type": "Content-Type",
}
SCHEMA = ", ".join([*[f"{c} string" for c in FIELDS], "payload_bytes long, headers map<string,string>, payload binary, file string, offset long"])
DATE = "2000-01-01T00:00:00Z"
HEAD = 8 << 10  # bytes read or inflated at a time while a header is looked for
BATCH_BYTES, BATCH_ROWS = 4 << 20, 2000
LEAST = 100
HEAVY = 1000

_HTTP = "application/http;msgtype=response"
_SKIP = b"sl"  # the gzip subfield with a member's compressed and plain length


def _clean(value: str) -> str:
    """A header's value: control characters, which would end it, are percent codes."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in value.strip())


def record(row: dict) -> bytes:
    """A record. A revisit has the HTTP header of the response but not its payload, whose length and digest it names."""
    payload = row.get("payload") or b""
    visit = row.get("record_type") == "revisit"
    size = row.get("payload_bytes") if row.get("payload_bytes") is not None else len(payload)
    kind = row.get("content_type") or "text/html; charset=utf-8"
    block = f"HTTP/1.1 200 OK\r\nContent-Type: {_clean(kind)}\r\nContent-Length: {size}\r\n\r\n".encode()
    if not visit:
        block += payload
    lines = [VERSION]
    for column, name in FIELDS.items():
        value = {"content_type": _HTTP, "date": row.get("date") or DATE}.get(column, row.get(column))
        if value is not None:
            lines.append(f"{name}: {_clean(value)}")
    if visit:
        lines.append(f"WARC-Profile: {PROFILE}")
    lines += [f"Content-Length: {len(block)}", "", ""]
    return b"".join(("\r\n".join(lines).encode(), block, b"\r\n\r\n"))


def member(body: bytes, level: int) -> bytes:
    """The bytes as one gzip member that names its own length where 32 bits hold it."""
    squeeze = zlib.compressobj(level, zlib.DEFLATED, -15)
    data = squeeze.compress(body) + squeeze.flush()
    tail = struct.pack("<II", zlib.crc32(body), len(body) & 0xFFFFFFFF)
    size = 10 + 2 + 12 + len(data) + 8
    if max(size, len(body)) >> 32:
        return b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff" + data + tail
    extra = struct.pack("<H2sHII", 12, _SKIP, 8, size, len(body))
    return b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff" + extra + data + tail


def _named(head: bytes) -> dict[str, str]:
    """Names (lower case) and values of header lines; a line that begins with a blank goes on with the one before."""
    out, last = {}, None
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += f" {line.strip()}"
        elif ":" in line:
            name, _, value = line.partition(":")
            last = name.strip().lower()
            out[last] = value.strip()
    return out


class _Plain:
    """A record's bytes in an uncompressed file."""

    def __init__(self, file: io.BufferedReader):
        self.file, self.start = file, file.tell()

    def more(self) -> bytes:
        return self.file.read(HEAD)

    def end(self, total: int) -> None:
        """Goes to the record's end, which is `total` bytes after its start."""
        self.file.seek(self.start + total)


class _Member:
    """A record's bytes in a gzip member; knows how many compressed bytes it has taken."""

    def __init__(self, file: io.BufferedReader):
        self.file, self.start = file, file.tell()
        head = file.read(10)
        if head[:3] != b"\x1f\x8b\x08":
            raise ValueError(f"no gzip member at {self.start}")
        flags, self.size = head[3], None
        if flags & 4:
            extra = file.read(struct.unpack("<H", file.read(2))[0])
            at = 0
            while at + 4 <= len(extra):
                name, n = extra[at : at + 2], struct.unpack_from("<H", extra, at + 2)[0]
                if name == _SKIP and n == 8:
                    self.size = struct.unpack_from("<I", extra, at + 4)[0]
                at += 4 + n
        for flag in (8, 16):  # a name and a comment
            while flags & flag and file.read(1) not in (b"\0", b""):
                pass
        if flags & 2:
            file.read(2)
        self.inflate, self.rest = zlib.decompressobj(-15), b""

    def more(self, most: int = HEAD) -> bytes:
        while not self.inflate.eof:
            data = self.rest or self.file.read(HEAD)
            if not data:
                raise ValueError(f"the gzip member at {self.start} has no end")
            out = self.inflate.decompress(data, most)
            self.rest = self.inflate.unconsumed_tail
            if out:
                return out
        return b""

    def end(self, total: int) -> None:
        if self.size is None:
            while self.more(1 << 20):
                pass
            self.size = self.file.tell() - len(self.inflate.unused_data) + 8 - self.start
        self.file.seek(self.start + self.size)


def _until(source: _Plain | _Member, have: bytes, mark: bytes, most: int | None = None) -> int:
    """Where the mark ends in have, as bytes read so far and more of them; -1 if it isn't in the first `most`. Grows have."""
    at = 0
    while True:
        found = have.find(mark, at)
        if found >= 0:
            return found + len(mark)
        at = max(0, len(have) - len(mark) + 1)
        more = source.more() if most is None or len(have) < most else b""
        if not more:
            return -1
        have += more


def records(file: io.BufferedReader, name: str, wants, payload: bool) -> Iterator[dict]:
    """The records of a file for which wants(columns, known) is true; it is asked with the WARC header's columns, and again when
    the payload's length is known too."""
    while True:
        start = file.tell()
        first = file.peek(2)[:2]
        if not first:
            return
        if first[:1] in b"\r\n":  # blank lines between records
            file.read(1)
            continue
        source = _Member(file) if first == b"\x1f\x8b" else _Plain(file)
        have = bytearray()
        head = _until(source, have, b"\r\n\r\n")
        if head < 0 or have[:5] != b"WARC/":
            raise ValueError(f"{name} has no record at {start}")
        named = _named(bytes(have[: head - 4]))
        size = int(named.get("content-length", 0))
        row = {c: named.get(x.lower()) for c, x in FIELDS.items()}
        total = head + size
        if wants(row, False):
            body = head
            inner: dict[str, str] = {}
            if (row["content_type"] or "").replace(" ", "").startswith("application/http"):
                body = _until(source, have, b"\r\n\r\n", total) if have[head:total].find(b"\r\n\r\n") < 0 else have.index(b"\r\n\r\n", head) + 4
                body = total if body < 0 or body > total else body
                inner = _named(bytes(have[head:body]))
                row["content_type"] = inner.get("content-type")
            length = inner.get("content-length", "")
            row["payload_bytes"] = int(length) if length.isdigit() else total - body
            if wants(row, True):
                if payload:
                    while len(have) < total and (more := source.more()):
                        have += more
                    if len(have) < total:
                        raise ValueError(f"the record of {name} at {start} has no end")
                row |= {"headers": list(named.items()), "payload": bytes(have[body:total]) if payload and row["record_type"] != "revisit" else None, "file": name, "offset": start}
                yield row
        source.end(total)


_TESTS = {
    D.EqualTo: lambda v, x: v is not None and v == x, D.EqualNullSafe: lambda v, x: v == x, D.In: lambda v, x: v is not None and v in x,
    D.GreaterThan: lambda v, x: v is not None and v > x, D.GreaterThanOrEqual: lambda v, x: v is not None and v >= x,
    D.LessThan: lambda v, x: v is not None and v < x, D.LessThanOrEqual: lambda v, x: v is not None and v <= x,
    D.StringStartsWith: lambda v, x: v is not None and v.startswith(x), D.StringEndsWith: lambda v, x: v is not None and v.endswith(x), D.StringContains: lambda v, x: v is not None and x in v,
    D.IsNotNull: lambda v, _: v is not None, D.IsNull: lambda v, _: v is None,
}


@dataclass
class Files(D.InputPartition):
    names: list[str] = field(default_factory=list)


class WarcReader(D.DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() == "true"
        self.split = int(options.get("partitionbytes", 128 << 20))
        self.pushed: list[tuple[str, type, object]] = []

    def pushFilters(self, filters: list[D.Filter]) -> Iterator[D.Filter]:
        """Predicates on headers are all tested here; others (on the payload, say) stay with Spark."""
        for f in filters:
            kind, column = type(f), f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if kind in _TESTS and column in (*FIELDS, "payload_bytes"):
                self.pushed.append((column, kind, getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> list[Files]:
        """Files in order of size, each added to the emptiest partition: a file is never cut, so writers bound its size."""
        store, root = fs.FileSystem.from_uri(self.path)
        found = store.get_file_info(fs.FileSelector(root, recursive=True))
        files = sorted((-x.size, x.path) for x in found if x.is_file and x.path.endswith((".warc", ".warc.gz")) and "/_" not in x.path[len(root) :])
        most = -(-sum(-s for s, _ in files) // self.split)
        plans = [Files() for _ in range(min(len(files), max(1, most)))]
        for i, (_, path) in enumerate(files):
            turn, at = divmod(i, len(plans))
            plans[at if turn % 2 == 0 else -1 - at].names.append(path)
        return plans

    def read(self, partition: Files | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no file, no partition
            return
        store, _ = fs.FileSystem.from_uri(self.path)
        # the tests on the WARC header come before those that need the HTTP header
        outer = [(c, _TESTS[k], x) for c, k, x in self.pushed if c not in ("payload_bytes", "content_type")]
        inner = [(c, _TESTS[k], x) for c, k, x in self.pushed if c in ("payload_bytes", "content_type")]

        def wants(row: dict, known: bool) -> bool:
            return all(test(row[c], x) for c, test, x in (inner if known else outer))

        rows, held = [], 0
        for name in partition.names:
            with store.open_input_file(name) as raw, io.BufferedReader(raw, 1 << 20) as file:
                for row in records(file, name, wants, self.payload):
                    rows.append(row)
                    held += len(row["payload"] or b"") + 500
                    if held >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                        yield self._batch(rows)
                        rows, held = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[dict]) -> pa.RecordBatch:
        text = pa.string()
        kinds = dict.fromkeys(FIELDS, text) | {"payload_bytes": pa.int64(), "headers": pa.map_(text, text), "payload": pa.binary(), "file": text, "offset": pa.int64()}
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in kinds.items()], list(kinds))


@dataclass
class Written(D.WriterCommitMessage):
    names: list[str]


class WarcWriter(D.DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.run = options["path"], uuid.uuid4().hex
        self.level = int(options.get("level", 6)) if options.get("compression", "gzip") == "gzip" else None
        self.most = int(options.get("filebytes", 1 << 30))
        if overwrite:
            raise ValueError("archives are appended to, never overwritten")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = fs.FileSystem.from_uri(self.path)
        at, end = f"{root}/_{self.run}", ".warc" if self.level is None else ".warc.gz"
        store.create_dir(at, recursive=True)
        names, out, size = [], None, 0
        try:
            for batch in iterator:
                for row in (r for i in range(0, batch.num_rows, 64) for r in batch.slice(i, 64).to_pylist()):
                    body = record(row) if self.level is None else member(record(row), self.level)
                    if out is None or size + len(body) > self.most:
                        if out is not None:
                            out.close()
                        names.append(f"{uuid.uuid4().hex}{end}")
                        out, size = store.open_output_stream(f"{at}/{names[-1]}", compression=None), 0  # Arrow would compress by the name
                    out.write(body)
                    size += len(body)
        finally:
            if out is not None:
                out.close()
        return Written(names)

    def commit(self, messages: list[Written]) -> None:
        store, root = fs.FileSystem.from_uri(self.path)
        for name in (n for m in messages if m for n in m.names):
            store.move(f"{root}/_{self.run}/{name}", f"{root}/{name}")
        self.abort([])

    def abort(self, messages: list[Written]) -> None:
        store, root = fs.FileSystem.from_uri(self.path)
        with contextlib.suppress(FileNotFoundError):
            store.delete_dir(f"{root}/_{self.run}")


class Warc(D.DataSource):
    """Options: path; when reading `payload` (true: the payloads too) and `partitionBytes`; when writing `compression` (gzip or
    none), `level` and `fileBytes`."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of all .warc and .warc.gz files under a path, with the columns of SCHEMA: payload_digest and payload_bytes are
    what the headers say of the whole payload, also of a revisit, which has no payload itself; payload is what follows the HTTP
    header. Predicates on the headers' columns are pushed into the reader (the session's setting for that is turned on). A file
    that breaks off, or holds what is no record, is an error that names the place."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Warc)
    return spark.read.format("warc").option("path", path).option("payload", str(payload).lower()).load()


def write(rows: DataFrame, path: str, **options) -> None:
    """Writes records. rows: those columns of SCHEMA that are there (record_type and record_id at least; others, such as headers,
    are left out)."""
    rows.sparkSession.dataSource.register(Warc)
    names = [c for c in (*FIELDS, "payload_bytes", "payload") if c in rows.columns]
    writer = rows.select(*names).write.format("warc").mode("append").option("path", path)
    writer.options(**options).save()


def record_id(number):
    """A record's URI of a row's id; a null is an empty one."""
    return F.concat(F.lit("<urn:page:"), F.url_encode(F.coalesce(number.cast("string"), F.lit(""))), F.lit(">"))


def number(uri, kind: str):
    return F.nullif(F.url_decode(F.regexp_extract(uri, r"^<urn:page:(.*)>$", 1)), F.lit("")).cast(kind)


def deduplicated(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST) -> DataFrame:
    """Records of pages: of those with equal payloads of `least` bytes or more the one with the least id is a response, others
    are revisits that name it.

    Digests that over one in HEAVY of the pages share are at most HEAVY, so they are broadcast; others are joined by shuffle, or
    broadcast where a count shows that they are few. Defined cases: a null page is empty; rows of the least id are responses,
    all of them if it repeats; a null id is no response's where another has the payload; no rows give no rows.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("target_uri"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "digest": F.sha2("payload", 256)})
    shared = rows.where(F.col("payload_bytes") >= least).groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 AND first IS NOT NULL")
    shared = written(shared, "payloads")
    total = rows.agg(F.count(F.lit(1))).first()[0]
    heavy = shared.where(F.col("n") * HEAVY > total).select("digest", "first")
    light = small(shared.where(F.col("n") * HEAVY <= total).select("digest", F.col("first").alias("other")))
    rows = rows.join(F.broadcast(heavy), "digest", "left").join(light, "digest", "left").withColumn("first", F.coalesce("first", "other"))
    again = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    return rows.select(
        F.when(again, "revisit").otherwise("response").alias("record_type"), record_id(F.col("id")).alias("record_id"), "target_uri",
        F.concat(F.lit("sha256:"), "digest").alias("payload_digest"), F.when(again, record_id(F.col("first"))).alias("refers_to"), "payload_bytes", F.when(~again, F.col("payload")).alias("payload"),
    )


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Writes the pages' archives to the shared folder and reads them back: page_id, payload_bytes, payload_digest (of a
    response from its payload, of a revisit from its headers, whose reading never comes to a payload), record_type, refers_to."""
    spark, kind = pages.sparkSession, pages.schema["page_id"].dataType.simpleString()
    path = place(spark, "warc")
    write(deduplicated(pages), path, **options)
    full = read(spark, path).where("record_type = 'response'").select("*", F.octet_length("payload").cast("long").alias("n"), F.sha2("payload", 256).alias("digest"))
    again = read(spark, path, payload=False).where("record_type = 'revisit'").select("*", F.col("payload_bytes").alias("n"), F.regexp_replace("payload_digest", "^sha256:", "").alias("digest"))
    out = full.unionByName(again)
    return out.select(number(F.col("record_id"), kind).alias("page_id"), F.col("n").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", number(F.col("refers_to"), kind).alias("refers_to"))

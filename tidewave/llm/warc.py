"""WARC archives as a PySpark Python data source, and the archiving of crawled pages."""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from tidewave.llm.common import new_path, table, written

#: What a record's columns are read from.
HEADERS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "target_uri": "WARC-Target-URI",
    "warc_date": "WARC-Date",
    "payload_digest": "WARC-Payload-Digest",
    "refers_to": "WARC-Refers-To",
    "content_type": "Content-Type",
}
SCHEMA = ", ".join(f"{c} string" for c in HEADERS) + ", headers map<string,string>, payload binary"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Files are rolled at about so many bytes, so that one file is a fair piece of work.
ROLL = 64 << 20
#: What is inflated first, to see a record's headers.
PEEK = 8 << 10


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or address and the path within it."""
    if path.startswith("file:"):
        path = re.sub(r"^file:/+", "/", path)
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def member(record: bytes, level: int = 6) -> bytes:
    """A record as one gzip member, whose extra field "sl" holds the member's and the record's length: a reader
    can skip the member without inflating it."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(record) + deflate.flush()
    whole = 24 + len(body) + 8
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, whole & 0xFFFFFFFF, len(record) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def record(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = [f"{k}: {one_line(v)}" for k, v in headers if v is not None]
    return ("WARC/1.1\r\n" + "\r\n".join([*lines, f"Content-Length: {len(block)}"]) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def one_line(value: str) -> str:
    """Control characters would end a header: they are percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def http_block(payload: bytes, content_type: str) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: {content_type}\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload


def parse_headers(head: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out[name.strip()] = value.strip()
    return out


@dataclass
class Files(InputPartition):
    paths: list[str] = field(default_factory=list)

    def __init__(self, paths: list[str]):
        super().__init__(0)
        self.paths = paths


@dataclass
class Wrote(WriterCommitMessage):
    paths: list[str]


def matches(f: Filter, value: str | None) -> bool:
    if isinstance(f, IsNull):
        return value is None
    if isinstance(f, IsNotNull):
        return value is not None
    if isinstance(f, EqualNullSafe):
        return value == f.value
    if value is None:
        return False
    if isinstance(f, StringStartsWith):
        return value.startswith(f.value)
    return value in f.value if isinstance(f, In) else value == f.value


class WarcReader(DataSourceReader):
    """Packs files into partitions; tests pushed predicates on a record's headers before its payload is inflated."""

    def __init__(self, options: dict, schema: StructType):
        self.path, self.schema, self.filters = options["path"], schema, []
        self.pack = int(options.get("pack_bytes", ROLL))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if len(f.attribute) == 1 and f.attribute[0] in HEADERS and isinstance(f, (EqualTo, EqualNullSafe, In, IsNull, IsNotNull, StringStartsWith)):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Files]:
        system, path = file_system(self.path)
        info = system.get_file_info(path)
        found = [info] if info.is_file else system.get_file_info(pafs.FileSelector(path, recursive=True, allow_not_found=True))
        files = sorted((x.path, x.size) for x in found if x.is_file and re.search(r"\.warc(\.gz)?$", x.path))
        packed: list[list[str]] = []
        room = 0
        for name, size in files:
            if not packed or size > room:
                packed, room = [*packed, []], self.pack
            packed[-1].append(name)
            room -= size
        return [Files(p) for p in packed] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.schema)
        names, rows, size = schema.names, [], 0
        system, _ = file_system(self.path)
        for path in partition.paths:
            with system.open_input_file(path) as f:
                for headers, payload in records(f, path.endswith(".gz"), "payload" in names, self.wanted):
                    row = {c: headers.get(h) for c, h in HEADERS.items()} | {"headers": list(headers.items()), "payload": payload}
                    rows.append({n: row.get(n) for n in names})
                    size += len(payload or b"") + 500
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    def wanted(self, headers: dict[str, str]) -> bool:
        return all(matches(f, headers.get(HEADERS[f.attribute[0]])) for f in self.filters)


def records(f, zipped: bool, with_payload: bool, wanted=lambda headers: True) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Headers and payload of the wanted records of an open file. Headers are parsed first; the payload of a record
    that isn't wanted, or of any if with_payload is false, is skipped."""
    size, at = f.size(), 0
    while at < size:
        f.seek(at)
        if zipped:
            start = f.read(24)
            skip = struct.unpack("<I", start[16:20])[0] if start[3:4] == b"\x04" and start[10:16] == b"\x0c\0sl\x08\0" else None
            inflate, data, after = zlib.decompressobj(31), b"", at
            end = -1

            def more(most: int) -> bool:
                nonlocal data, after
                f.seek(after)
                part = f.read(most)
                after += len(part)
                data += inflate.decompress(part)
                return bool(part) and not inflate.eof

            go = True
            while go and end < 0:
                go = more(PEEK)
                end = data.find(b"\r\n\r\n")
            if end < 0:
                raise ValueError(f"a record at byte {at} has no end of headers")
            headers = parse_headers(data[:end])
            keep = wanted(headers)
            if keep and with_payload or skip is None:
                while go:
                    if not keep:
                        data = b""  # only the member's end is looked for
                    go = more(1 << 20)
                at = after - len(inflate.unused_data)
            else:
                at += skip
            block = data[end + 4 : end + 4 + int(headers.get("Content-Length", 0))] if keep and with_payload else None
        else:
            data = f.read(PEEK)
            while (end := data.find(b"\r\n\r\n")) < 0:
                part = f.read(PEEK)
                if not part:
                    raise ValueError(f"a record at byte {at} has no end of headers")
                data += part
            headers = parse_headers(data[:end])
            length = int(headers.get("Content-Length", 0))
            block, keep = None, wanted(headers)
            if keep and with_payload:
                f.seek(at + end + 4)
                block = f.read(length)
            at += end + 4 + length + 4
        if keep:
            if block is not None and headers.get("Content-Type", "").startswith("application/http"):
                block = block[block.find(b"\r\n\r\n") + 4 :]
            yield headers, block


class WarcWriter(DataSourceArrowWriter):
    """Each attempt of a task writes files of its own names; commit gives those of the successful attempts their
    final names, so that lost executors and repeated attempts leave no record twice."""

    def __init__(self, options: dict):
        self.path, self.level, self.roll = options["path"], int(options.get("level", 6)), int(options.get("roll_bytes", ROLL))

    def write(self, batches: Iterator[pa.RecordBatch]) -> Wrote:
        system, path = file_system(self.path)
        system.create_dir(path, recursive=True)
        paths, out, size = [], None, 0
        for batch in batches:
            for row in batch.to_pylist():
                if out is None or size > self.roll:
                    if out is not None:
                        out.close()
                    paths.append(f"{path}/part-{uuid.uuid4().hex}.warc.gz")
                    out, size = system.open_output_stream(paths[-1] + ".tmp", compression=None), 0
                data = member(self.record(row), self.level)
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
        return Wrote(paths)

    @staticmethod
    def record(row: dict) -> bytes:
        headers = [(h, row.get(c)) for c, h in HEADERS.items() if c != "content_type"] + [(k, v) for k, v in row.get("headers") or []]
        if row["record_type"] == "revisit":
            return record([*headers, ("WARC-Profile", REVISIT), ("Content-Type", "application/http; msgtype=response")], b"")
        return record([*headers, ("Content-Type", "application/http; msgtype=response")], http_block(row["payload"] or b"", row.get("content_type") or "text/html; charset=utf-8"))

    def commit(self, messages: list[Wrote | None]) -> None:
        system, _ = file_system(self.path)
        for m in messages:
            for p in m.paths if m else []:
                system.move(p + ".tmp", p)

    def abort(self, messages: list[Wrote | None]) -> None:
        system, _ = file_system(self.path)
        for m in messages:
            for p in m.paths if m else []:
                system.delete_file(p + ".tmp")


class WarcSource(DataSource):
    """spark.read.format("warc").load(folder) and df.write.format("warc").mode("append").save(folder).

    Reading: columns of SCHEMA, or those of them that .schema(...) names; without payload among them, no payload is
    inflated. Equality, membership, prefix and null tests on header columns are made on the headers.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options)


def read_warc(spark: SparkSession, path: str, columns: list[str] | None = None, **options) -> DataFrame:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    schema = StructType.fromDDL(SCHEMA)
    reader = spark.read.format("warc").options(**options)
    if columns:
        reader = reader.schema(StructType([schema[c] for c in columns]))
    return reader.load(path)


def archive(pages: DataFrame, path: str, *, least: int = 100, date: str = "1970-01-01T00:00:00Z", broadcast_rows: int = 50_000, salts: int = 32) -> None:
    """Writes one record for each row of pages (page_id, url, html, ...) to a folder of WARC files.

    Of rows with equal payloads (html in UTF-8; null: empty) of at least `least` bytes, that with the smallest page_id
    is a response and the others are revisits of it, without a payload. Rows that repeat the smallest page_id are
    all responses, as are smaller payloads; a row without page_id is a revisit if the payload's group has some
    page_id. A null url gives no target URI. An empty table gives no files; other columns are ignored.

    Payloads stay where they are unless over broadcast_rows payloads repeat: then rows are joined with the repeated
    digests by digest and a salt, so that one very frequent payload is spread over `salts` tasks.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("bytes", F.octet_length("payload").cast("long"))
    groups = rows.where(F.col("bytes") >= least).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    repeated = written(groups.where("n > 1").select("digest", "first_id"), "warc-digests")
    if repeated.count() <= broadcast_rows:
        rows = rows.join(F.broadcast(repeated), "digest", "left")
    else:
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(salts)).cast("int"))
        repeated = repeated.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        rows = rows.join(repeated, ["digest", "salt"], "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    out = rows.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        urn("page_id").alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit(date).alias("warc_date"),
        F.concat(F.lit("sha256:"), "digest").alias("payload_digest"),
        F.when(revisit, urn("first_id")).alias("refers_to"),
        F.create_map(F.lit("X-Payload-Length"), F.col("bytes").cast("string")).alias("headers"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )
    spark.dataSource.register(WarcSource)
    out.write.format("warc").mode("append").save(path)


def op10_warc(spark, sf_dir: str) -> DataFrame:
    """Archives all pages and reads the archives back: the payloads of responses, the headers alone of revisits."""
    path = new_path(spark, "warc")
    archive(table(spark, sf_dir, "pages"), path)
    page = lambda c: F.nullif(F.regexp_extract(c, "urn:page:(-?[0-9]*)", 1), F.lit("")).cast("long")
    full = read_warc(spark, path, ["record_type", "record_id", "payload"]).where("record_type = 'response'")
    full = full.select(page("record_id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    seen = read_warc(spark, path, ["record_type", "record_id", "payload_digest", "refers_to", "headers"]).where("record_type = 'revisit'")
    seen = seen.select(page("record_id").alias("page_id"), F.col("headers")["X-Payload-Length"].cast("long").alias("payload_bytes"), F.substring_index("payload_digest", ":", -1).alias("payload_digest"), "record_type", page("refers_to").alias("refers_to"))
    return full.unionByName(seen)


OP10_SQL = """
WITH p AS (SELECT page_id, sha256(encode(coalesce(html, ''))) AS payload_digest, octet_length(encode(coalesce(html, ''))) AS payload_bytes FROM pages),
g AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT p.page_id, CAST(p.payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
       CASE WHEN g.first_id <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN g.first_id <> p.page_id THEN g.first_id END AS refers_to
FROM p LEFT JOIN g USING (payload_digest)
"""

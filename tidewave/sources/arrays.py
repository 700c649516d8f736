"""Dense array files as Spark data sources.

"mda": a header of 32-bit integers (type code, bytes an entry, number of dimensions, negative if sizes are 64-bit), the
sizes, and the values with the first dimension running fastest. "rawbin": values alone, of a given type and number of
channels. Both give rows (t, channel, v) of the first two dimensions, channels from 1, and read any range of t
without the rest.
"""

from __future__ import annotations

import os
import re
import shutil
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

#: Type codes of the header.
TYPES = {-2: np.uint8, -3: np.float32, -4: np.int16, -5: np.int32, -6: np.uint16, -7: np.float64, -8: np.uint32}
CODES = {np.dtype(t).name: c for c, t in TYPES.items()}
SCHEMA = "t long, channel int, v double"


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        path = re.sub(r"^file:/+", "/", path)
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


@dataclass
class Header:
    dtype: np.dtype
    sizes: list[int]
    offset: int


def header(code: str | int, sizes: list[int]) -> bytes:
    code = CODES[code] if isinstance(code, str) else code
    wide = any(n > 2_000_000_000 for n in sizes)
    return struct.pack("<iii", code, np.dtype(TYPES[code]).itemsize, -len(sizes) if wide else len(sizes)) + struct.pack("<" + ("q" if wide else "i") * len(sizes), *sizes)


def read_header(f) -> Header:  # type: ignore[no-untyped-def]
    code, _, dims = struct.unpack("<iii", f.read(12))
    if code not in TYPES or not 1 <= abs(dims) <= 6:
        raise ValueError(f"not an array file: type code {code}, {dims} dimensions")
    size, kind = (8, "q") if dims < 0 else (4, "i")
    sizes = list(struct.unpack("<" + kind * abs(dims), f.read(size * abs(dims))))
    return Header(np.dtype(TYPES[code]), sizes, 12 + size * abs(dims))


@dataclass
class Range(InputPartition):
    path: str
    first: int
    end: int
    shift: int

    def __init__(self, path: str, first: int, end: int, shift: int):
        super().__init__((path, first))
        self.path, self.first, self.end, self.shift = path, first, end, shift


class ArrayReader(DataSourceReader):
    """A partition is a range of t of one file. Comparisons of t with a number choose the ranges that are read."""

    def __init__(self, options: dict, schema: StructType, raw: bool):
        self.options, self.schema, self.raw = options, schema, raw
        self.chunk, self.low, self.high = int(options.get("chunk", 250_000)), 0, 1 << 62

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if f.attribute == ("t",) and isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            if f.attribute == ("t",) and isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                self.high = min(self.high, f.value + 1 - isinstance(f, LessThan))
            if not (f.attribute == ("t",) and isinstance(f, (GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, EqualTo))):
                yield f

    def files(self) -> list[str]:
        """One file, all files below a folder by name, or a list of paths in brackets: [a][b]."""
        path = self.options["path"]
        parts = re.findall(r"\[([^\]]*)\]", path) or [path]
        out = []
        for p in parts:
            system, inner = file_system(p)
            info = system.get_file_info(inner)
            if info.is_file:
                out.append(p)
            else:
                found = system.get_file_info(pafs.FileSelector(inner, recursive=True))
                out += sorted(x.path for x in found if x.is_file and (self.raw or x.path.endswith(".mda")))
        return out

    def head(self, f, path: str) -> Header:  # type: ignore[no-untyped-def]
        if not self.raw:
            return read_header(f)
        dtype, channels = np.dtype(self.options.get("dtype", "float32")), int(self.options["num_channels"])
        n, rest = divmod(f.size(), dtype.itemsize * channels)
        if rest:
            raise ValueError(f"{path} doesn't hold whole samples of {channels} channels")
        return Header(dtype, [channels, n], 0)

    def partitions(self) -> list[Range]:
        out, shift = [], 0
        for path in self.files():
            system, inner = file_system(path)
            with system.open_input_file(inner) as f:
                h = self.head(f, path)
            n = int(np.prod(h.sizes[1:])) if len(h.sizes) > 1 else 1
            for first in range(max(0, self.low - shift), min(n, self.high - shift), self.chunk):
                out.append(Range(path, first, min(first + self.chunk, n, self.high - shift), shift))
            shift += n
        return out or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        system, inner = file_system(partition.path)
        with system.open_input_file(inner) as f:
            h = self.head(f, partition.path)
            m, n = h.sizes[0], partition.end - partition.first
            f.seek(h.offset + partition.first * m * h.dtype.itemsize)
            values = np.frombuffer(f.read(n * m * h.dtype.itemsize), h.dtype).astype(np.float64)
        columns = {"t": np.repeat(np.arange(partition.first, partition.end) + partition.shift, m), "channel": np.tile(np.arange(1, m + 1, dtype=np.int32), n), "v": values}
        names = [x.name for x in self.schema.fields]
        yield pa.RecordBatch.from_arrays([pa.array(columns[c]) for c in names], names=names)


@dataclass
class Span(InputPartition):
    """A range of t that may reach over several files, each with the t of its first sample and its number of samples."""

    files: list[tuple[str, int, int]]
    first: int
    end: int

    def __init__(self, files: list[tuple[str, int, int]], first: int, end: int):
        super().__init__((first, end))
        self.files, self.first, self.end = files, first, end


class ChunkReader(ArrayReader):
    """Rows (channel, chunk, samples) with `size` samples each, but fewer in the last chunk. A partition is a number of whole
    chunks, wherever files begin and end, and reads their range of each file at once."""

    def shapes(self) -> list[tuple[str, int, int]]:
        out, shift = [], 0
        for path in self.files():
            system, inner = file_system(path)
            with system.open_input_file(inner) as f:
                h = self.head(f, path)
            n = int(np.prod(h.sizes[1:])) if len(h.sizes) > 1 else 1
            out.append((path, shift, n))
            shift += n
        return out

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        yield from filters

    def partitions(self) -> list[Span]:
        size, files = int(self.options.get("size", 4096)), self.shapes()
        total = files[-1][1] + files[-1][2] if files else 0
        step = max(1, self.chunk // size) * size
        spans = [(first, min(first + step, total)) for first in range(0, total, step)]
        return [Span([f for f in files if f[1] < end and f[1] + f[2] > first], first, end) for first, end in spans] or [Span([], 0, 0)]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        size, parts = int(self.options.get("size", 4096)), []
        for path, shift, n in partition.files:
            system, inner = file_system(path)
            with system.open_input_file(inner) as f:
                h = self.head(f, path)
                first, end, m = max(partition.first - shift, 0), min(partition.end - shift, n), h.sizes[0]
                f.seek(h.offset + first * m * h.dtype.itemsize)
                parts.append(np.frombuffer(f.read((end - first) * m * h.dtype.itemsize), h.dtype).reshape(-1, m))
        names = [x.name for x in self.schema.fields]
        for first in range(0, partition.end - partition.first, size) if parts else ():
            rows = (parts[0] if len(parts) == 1 else np.concatenate(parts))[first : first + size].T.astype(np.float64)
            values = {"channel": pa.array(range(1, len(rows) + 1), pa.int32()), "chunk": pa.array([(partition.first + first) // size] * len(rows), pa.int64()), "samples": pa.array(list(rows), pa.list_(pa.float64()))}
            yield pa.RecordBatch.from_arrays([values[c] for c in names], names=names)


@dataclass
class Part(WriterCommitMessage):
    path: str
    first: int


class ArrayWriter(DataSourceArrowWriter):
    """Each task writes the range of t that it gets as an array file of its own; commit gives the files names in order of
    t, after those that are there, and reads or copies no values. Needs rows (t, channel, v) dealt by ranges of t and
    sorted by t, channel; a task holds its range in the type that is written."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.kind, self.channels, self.overwrite = options["path"], options.get("dtype", "float32"), int(options["num_channels"]), overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> Part:
        system, inner = file_system(self.path)
        first, values = -1, []
        for batch in batches:
            if batch.num_rows and first < 0:
                first = batch.column("t")[0].as_py()
            values.append(batch.column("v").to_numpy(zero_copy_only=False).astype(self.kind).tobytes())
        size = sum(map(len, values)) // np.dtype(self.kind).itemsize
        if size % self.channels:
            raise ValueError(f"{size} values aren't whole samples of {self.channels} channels")
        if not size:
            return Part("", -1)
        system.create_dir(inner, recursive=True)
        name = f"{inner}/{uuid.uuid4().hex}.part"
        with system.open_output_stream(name) as f:
            f.write(header(self.kind, [self.channels, size // self.channels]))
            for v in values:
                f.write(v)
        return Part(name, first)

    def commit(self, messages: list[Part | None]) -> None:
        system, inner = file_system(self.path)
        system.create_dir(inner, recursive=True)
        there = sorted(x.path for x in system.get_file_info(pafs.FileSelector(inner)) if x.path.endswith(".mda"))
        if self.overwrite:
            for path in there:
                system.delete_file(path)
        run = 0 if self.overwrite or not there else int(there[-1].rsplit("/", 1)[-1].split("-")[0]) + 1
        for m in sorted((m for m in messages if m and m.path), key=lambda m: m.first):
            system.move(m.path, f"{inner}/{run:06d}-{m.first:015d}.mda")

    def abort(self, messages: list[Part | None]) -> None:
        system, _ = file_system(self.path)
        for m in messages:
            if m and m.path:
                system.delete_file(m.path)


class RangeWriter(DataSourceArrowWriter):
    """Each task writes its values at their places of one file that is there already in full length. A value's place follows
    from its t and channel, so a task that runs again writes the same bytes to the same places; the file gets its
    name on commit."""

    def __init__(self, options: dict):
        self.part, self.path, self.kind, self.channels, self.length, self.offset = options["part"], options["path"], options["dtype"], int(options["num_channels"]), int(options["length"]), int(options["offset"])

    def write(self, batches: Iterator[pa.RecordBatch]) -> Part:
        size = np.dtype(self.kind).itemsize
        with open(self.part, "r+b", buffering=0) as f:
            for b in batches:
                t, channel = np.asarray(b.column("t")), np.asarray(b.column("channel"))
                if len(t) and (t.min() < 0 or t.max() >= self.length or channel.min() < 1 or channel.max() > self.channels):
                    raise ValueError(f"a value lies outside of {self.channels} channels and {self.length} samples")
                place = t * self.channels + channel - 1
                order = np.argsort(place, kind="stable")
                place, values = place[order], b.column("v").to_numpy(zero_copy_only=False)[order].astype(self.kind)
                for run in np.split(np.arange(len(place)), np.flatnonzero(np.diff(place) != 1) + 1):  # values that lie side by side
                    if len(run):
                        os.pwrite(f.fileno(), values[run].tobytes(), self.offset + int(place[run[0]]) * size)
            os.fsync(f.fileno())
        return Part(self.part, 0)

    def commit(self, messages: list[Part | None]) -> None:
        os.replace(self.part, self.path)

    def abort(self, messages: list[Part | None]) -> None:
        if os.path.exists(self.part):
            os.remove(self.part)


class MdaRanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mdaranges"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema: StructType, overwrite: bool) -> RangeWriter:
        return RangeWriter(self.options)


class MdaSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mda"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ArrayReader:
        return ArrayReader(self.options, schema, False)

    def writer(self, schema: StructType, overwrite: bool) -> ArrayWriter:
        return ArrayWriter(self.options, overwrite)


class RawSource(MdaSource):
    @classmethod
    def name(cls) -> str:
        return "rawbin"

    def reader(self, schema: StructType) -> ArrayReader:
        return ArrayReader(self.options, schema, True)


class MdaChunks(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mdachunks"

    def schema(self) -> str:
        return "channel int, chunk long, samples array<double>"

    def reader(self, schema: StructType) -> ChunkReader:
        return ChunkReader(self.options, schema, False)


class RawChunks(MdaChunks):
    @classmethod
    def name(cls) -> str:
        return "rawchunks"

    def reader(self, schema: StructType) -> ChunkReader:
        return ChunkReader(self.options, schema, True)


def array_length(path: str, **options) -> int:  # type: ignore[no-untyped-def]
    """Samples of a channel in the array files of a path, from their headers."""
    shapes = ChunkReader({"path": path, **options}, StructType(), "num_channels" in options).shapes()
    return shapes[-1][1] + shapes[-1][2] if shapes else 0


def register(spark: SparkSession) -> None:
    for source in (MdaSource, RawSource, MdaChunks, RawChunks, MdaRanges):
        spark.dataSource.register(source)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_array(spark: SparkSession, path: str, **options) -> DataFrame:  # type: ignore[no-untyped-def]
    register(spark)
    return spark.read.format("rawbin" if "num_channels" in options else "mda").options(**options).load(path)


#: Values that one written file holds at most, about.
FILE_VALUES = 8_000_000


def write_array(series: DataFrame, path: str, channels: int, dtype: str = "float32", *, append: bool = False, partitions: int | None = None) -> None:
    """Writes a complete series (channel 1 .. channels at each t) as a folder of array files, one for each range of t,
    which read_array() reads one after another; with append they follow the files that are there. One partition
    gives one file."""
    register(series.sparkSession)
    n = partitions or series.count() // FILE_VALUES + 1
    rows = series.select("t", "channel", "v").repartitionByRange(n, "t").sortWithinPartitions("t", "channel")
    rows.write.format("mda").option("num_channels", channels).option("dtype", dtype).mode("append" if append else "overwrite").save(path)


def write_ranges(rows: DataFrame, path: str, channels: int, length: int, dtype: str = "float32", *, update: bool = False) -> None:
    """Writes rows (t, channel, v) to their places of one array file of the given size. Rows may be any part of the array in any
    order; places that none has are 0, or with update keep the values of the file that is there, which has to have
    the same type and size. The file appears under its name when all is written. path lies in a folder that all
    executors share and that can be written to in place; of rows of one place some one counts.
    """
    register(rows.sparkSession)
    system, inner = file_system(path)
    if not isinstance(system, pafs.LocalFileSystem):
        raise ValueError("writing in place needs a mounted folder; write_array makes a folder of files in any store")
    head = header(dtype, [channels, length])
    part = f"{inner}.{uuid.uuid4().hex}.part"
    os.makedirs(os.path.dirname(inner) or ".", exist_ok=True)
    if update and os.path.exists(inner):
        with open(inner, "rb") as f:
            if f.read(len(head)) != head:
                raise ValueError(f"{path} is of another type or size")
        shutil.copyfile(inner, part)
    else:
        with open(part, "wb") as f:
            f.write(head)
            f.truncate(len(head) + channels * length * np.dtype(dtype).itemsize)
    placed = rows.select(rows["t"].cast("long"), rows["channel"].cast("int"), rows["v"].cast("double"))
    placed = placed.repartitionByRange("t").sortWithinPartitions("t", "channel")  # so that most values lie side by side
    options = {"part": part, "path": inner, "dtype": dtype, "num_channels": channels, "length": length, "offset": len(head)}
    placed.write.format("mdaranges").options(**options).mode("append").save()


def write_csv_array(rows: DataFrame, path: str) -> None:
    """Rows (row, values) as a folder of text, one line each, by row."""
    from pyspark.sql import functions as F

    lines = rows.orderBy("row").select(F.array_join(F.transform("values", lambda x: x.cast("string")), ",").alias("value"))
    lines.write.mode("overwrite").text(path)


def read_csv_array(spark: SparkSession, path: str) -> DataFrame:
    """A text array, one line for each row: row (from 1), and its values as an array; blank lines don't count.

    A file is read in ranges of bytes by many tasks. A line's number is its place among the lines of its range, which are
    read in order, and the number of lines in the ranges before, of which there is one count each; files of a folder
    follow one another by name."""
    from pyspark.sql import functions as F
    from pyspark.sql.window import Window

    from tidewave.plans.storage import checkpointed

    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))
    lines = checkpointed(text.where(F.trim("value") != "").withColumn("id", F.monotonically_increasing_id()))  # ids of a range follow one another
    before = Window.orderBy("file", "at").rowsBetween(Window.unboundedPreceding, -1)
    ranges = lines.groupBy("file", "at").agg(F.min("id").alias("first"), F.count("*").alias("n"))  # one row a range
    ranges = ranges.select("file", "at", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first") + 1).alias("shift"))
    numbered = lines.join(F.broadcast(ranges), ["file", "at"])
    return numbered.select((F.col("id") + F.col("shift")).alias("row"), F.transform(F.split(F.trim("value"), r"[,\s]+"), lambda x: x.cast("double")).alias("values"))


def read_geom(spark: SparkSession, path: str) -> DataFrame:
    """channel, x, y from a text array with a line for each channel; missing coordinates are 0."""
    from pyspark.sql import functions as F

    at = lambda i: F.coalesce(F.try_element_at("values", F.lit(i)), F.lit(0.0))
    return read_csv_array(spark, path).select(F.col("row").cast("int").alias("channel"), at(1).alias("x"), at(2).alias("y"))


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """label, name, value, from a JSON document {"clusters": [{"label", "metrics": {name: value}, "tags"}]}."""
    from pyspark.sql import functions as F

    schema = "clusters array<struct<label:int,metrics:map<string,double>,tags:array<string>>>"
    each = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("clusters").alias("c"))
    return each.select("c.label", F.explode("c.metrics").alias("name", "value"))


def write_metrics(long: DataFrame, path: str, tags: DataFrame | None = None) -> None:
    """label, name, value (and label, tags) as one JSON document of the form that read_metrics() reads."""
    from pyspark.sql import functions as F

    each = long.groupBy("label").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "value")))).alias("metrics"))  # a cluster's metrics
    each = each.join(tags.select("label", "tags"), "label", "left") if tags is not None else each.withColumn("tags", F.array().cast("array<string>"))
    each = each.withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
    document = each.agg(F.to_json(F.struct(F.collect_list(F.struct("label", "metrics", "tags")).alias("clusters"))).alias("value"))  # clusters only
    document.coalesce(1).write.mode("overwrite").text(path)

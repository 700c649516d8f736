"""Removal of long byte strings that occur more than once, within or across documents.

Every string of `length` bytes is anchored (see anchors), and the strings of a text that share an anchor make one
segment. A string can only repeat where its anchor does. Segments that occur more than once as a whole are repeated;
those that don't, but share an anchor with other segments, form small collections, whose Burrows-Wheeler transform
and common prefixes are built column by column (see columnwise): a string repeats if its suffix shares `length`
symbols with a neighbour.

An anchor with many segments is divided before that: by where in them its strings start, and by the bytes that all
strings which start there hold. So a group never outgrows a task, whatever many documents share.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewave.llm.anchors import runs
from tidewave.llm.columnwise import build
from tidewave.llm.common import join_unique, scratch, slices, table, utf8, written

#: Strings are inserted into one collection until it has so many; a group's segments stay together.
COLLECTION = 1536
#: A group with more different segments than this is divided by the starts of its strings, into so many parts.
GROUP, PARTS = 1024, 4
#: About so many segments are compared in one task.
TASK = 20_000


def key_of(text: bytes) -> bytes:
    return hashlib.blake2b(text, digest_size=16).digest()


def facts(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n_bytes, sha256 of every row; a null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [(t.as_py() or "").encode() for t in batch.column("text")]
            arrays = [batch.column("doc_id"), pa.array([key_of(r) for r in raw], pa.binary()), pa.array([len(r) for r in raw], pa.int64()), pa.array([hashlib.sha256(r).hexdigest() for r in raw], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "text_key", "n_bytes", "sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, text_key binary, n_bytes long, sha256 string")


def segments(docs: DataFrame, length: int, anchor: int) -> DataFrame:
    """text_key, anchor, content (hashes), first and last start and place of the anchor of each segment of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                data, at = utf8(batch.column("text"))
                text, first, last, place, h, content = runs(data, at, length, anchor)
                if not len(text):
                    continue
                used, where = np.unique(text, return_inverse=True)
                keys = pa.array([key_of(data[at[i] : at[i + 1]].tobytes()) for i in used], pa.binary()).take(pa.array(where))
                base = at[text]
                arrays = [keys, pa.array(h), pa.array(content), *(pa.array((x - base).astype(np.int32)) for x in (first, last, place))]
                yield pa.RecordBatch.from_arrays(arrays, names=["text_key", "anchor", "content", "first", "last", "at"])

    return docs.select("text").mapInArrow(run, "text_key binary, anchor long, content long, first int, last int, at int")


def wanted_texts(docs: DataFrame, keys: DataFrame, bits: int) -> DataFrame:
    """text_key and the deflated text of each of keys (text_key, first_doc). Only a row with that doc_id is read for a text,
    so that copies don't come to one task. A bitmap of 2**bits bits, made by Spark's bitmap functions, keeps most
    other rows from being shuffled; its size doesn't depend on the data, and what passes it by chance is dropped by the
    join."""
    place = F.crc32(F.concat("text_key", F.coalesce(F.col("first_doc").cast("string"), F.lit("")).cast("binary"))) % (1 << bits)
    maps = keys.select(place.alias("k")).groupBy(F.expr("bitmap_bucket_number(k)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(k))").alias("bits"))
    have = np.zeros((1 << bits) // 8 + 4096, np.uint8)
    for r in maps.collect():  # buckets count from 1 and hold 4096 bytes each; number 0 lies in bucket 0 or 1
        have[max(r["bucket"] - 1, 0) * 4096 : max(r["bucket"] - 1, 0) * 4096 + 4096] |= np.frombuffer(bytes(r["bits"]), np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(have)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = shared.value
        for batch in batches:
            out: dict[tuple, bytes] = {}
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                raw = (t.as_py() or "").encode()
                key = key_of(raw)
                k = zlib.crc32(key + ("" if i is None else str(i)).encode()) % (1 << bits)
                # bucket_number is (k - 1) // 32768 + 1 and bit_position (k - 1) % 32768 for k > 0
                b = max(k - 1, 0)
                if k == 0 or seen[b >> 3] >> (b & 7) & 1:
                    out[i, key] = raw
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in out], pa.int64()), pa.array([k for _, k in out], pa.binary()), pa.array([zlib.compress(r, 1) for r in out.values()], pa.binary())], names=["doc_id", "text_key", "deflated"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, text_key binary, deflated binary")
    wanted = keys.select(F.col("text_key").alias("k"), "first_doc")
    found = found.join(wanted, (F.col("text_key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("first_doc")))
    return found.groupBy("text_key").agg(F.first("deflated").alias("deflated"))


def shared(a: bytes, b: bytes) -> int:
    """Bytes that a and b begin with alike."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return int(np.argmax(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)))


def longest_shared(parts: list[bytes]) -> list[int]:
    """For each part the longest beginning that some other has too: a neighbour in sorted order has it."""
    order = sorted(range(len(parts)), key=parts.__getitem__)
    out = [0] * len(parts)
    for i, j in zip(order, order[1:], strict=False):
        n = shared(parts[i], parts[j])
        out[i], out[j] = max(out[i], n), max(out[j], n)
    return out


def trimmed(group: list[dict], length: int, anchor: int) -> list[dict]:
    """The segments of one anchor without the starts that can't repeat: a repeated string lies, before its anchor and
    after it, within what some other segment has there as well. Segments without such a start are left out."""
    at = [r["at"] - r["first"] for r in group]
    left = longest_shared([r["bytes"][:a][::-1] for r, a in zip(group, at, strict=True)])
    right = longest_shared([r["bytes"][a + anchor :] for r, a in zip(group, at, strict=True)])
    out = []
    for r, a, before, after in zip(group, at, left, right, strict=True):
        first, last = max(0, a - before), min(r["last"] - r["first"], a + anchor + after - length)
        if first <= last:
            out.append(r | {"first": r["first"] + first, "last": r["first"] + last, "bytes": r["bytes"][first : last + length]})
    return out


#: A segment with its bytes: low and high are how far from the anchor's place its strings may start.
CUT = pa.schema([("text_key", pa.binary()), ("grouped", pa.int64()), ("content", pa.int64()), ("n", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("at", pa.int32()), ("low", pa.int32()), ("high", pa.int32()), ("bytes", pa.binary())])
CUT_SQL = "text_key binary, grouped long, content long, n long, first int, last int, at int, low int, high int, bytes binary"


def cuts_of(rows: DataFrame, texts: DataFrame, length: int, anchor: int) -> DataFrame:
    """The bytes of rows (anchor, content, n, text_key, first, last, at), as CUT, grouped by anchor."""
    own = rows.groupBy("text_key").agg(F.collect_list(F.struct(F.col("anchor").alias("grouped"), "content", "n", "first", "last", "at")).alias("parts"))  # a text's own segments

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, parts, z in zip(*(batch.column(c) for c in ("text_key", "parts", "deflated")), strict=True):
                raw = zlib.decompress(z.as_py())
                for p in parts.as_py():
                    out.append({"text_key": key.as_py(), **p, "low": anchor - length, "high": 0, "bytes": raw[p["first"] : p["last"] + length]})
                    if len(out) > 5000:
                        yield pa.RecordBatch.from_pylist(out, CUT)
                        out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, CUT)

    return own.join(texts, "text_key").select("text_key", "parts", "deflated").mapInArrow(run, CUT_SQL)


def divide(row: dict, length: int) -> Iterator[dict]:
    """A segment in parts by where its strings start, as seen from the anchor. What every string that starts in a part's
    range holds, whatever the segment, tells the part's group: equal strings come to the same group."""
    width = row["high"] - row["low"] + 1
    step, base = -(-width // PARTS), row["first"]
    hashed = lambda *x: int.from_bytes(hashlib.blake2b(b"|".join(x), digest_size=8).digest(), "big", signed=True)
    for low in range(row["low"], row["high"] + 1, step):
        high = min(row["high"], low + step - 1)
        first, last = max(row["first"], row["at"] + low), min(row["last"], row["at"] + high)
        if first <= last:
            part = row["bytes"][first - base : last + length - base]
            common = row["bytes"][row["at"] + high - base : row["at"] + low + length - base]
            yield row | {"grouped": hashed(b"%d" % low, common), "content": hashed(b"%d" % (first - row["at"]), part), "first": first, "last": last, "low": low, "high": high, "bytes": part}


def divided(cuts: DataFrame, length: int, most: int) -> tuple[DataFrame, DataFrame]:
    """(cuts in groups of at most `most` different segments, text_key, first and last of repeated starts found on the way).

    Each round divides the groups that are too large. Parts that are equal are one row with their count from then on, and those
    that occurred once before are repeated. The last round's parts hold one string each and all of a group are equal, so
    that nothing is left to divide."""
    done, spans = [], []
    while True:
        sizes = written(cuts.groupBy("grouped").agg(F.count("*").alias("_n")), "substring-sizes")
        large = sizes.where(F.col("_n") > most)
        if not large.limit(1).count():
            break
        flagged = written(join_unique(cuts, sizes.select("grouped", (F.col("_n") > most).alias("large")), ["grouped"], counts=sizes), "substring-flagged")
        done.append(flagged.where("NOT large").drop("large"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for row in batch.to_pylist():
                    out += divide(row, length)
                    if len(out) > 5000:
                        yield pa.RecordBatch.from_pylist(out, CUT)
                        out = []
                if out:
                    yield pa.RecordBatch.from_pylist(out, CUT)

        parts = written(flagged.where("large").drop("large").mapInArrow(run, CUT_SQL), "substring-parts")
        rest = [c for c in CUT.names if c not in ("grouped", "content", "n")]
        each = parts.groupBy("grouped", "content").agg(F.count("*").alias("_n"), F.sum("n").alias("n"), F.min(F.struct(*rest)).alias("one"))
        each = written(each.select("grouped", "content", "_n", "n", "one.*"), "substring-parts")
        again = join_unique(parts.where("n = 1").drop("n"), each.where("n > 1").select("grouped", "content"), ["grouped", "content"], "left_semi", counts=each.select("grouped", "content", "_n"))
        spans.append(again.select("text_key", "first", "last"))
        groups = written(each.groupBy("grouped").agg(F.count("*").alias("_n"), F.sum((F.col("n") == 1).cast("int")).alias("lone")), "substring-sizes")
        open_ = groups.where("lone > 0 AND _n > 1").select("grouped")
        cuts = written(join_unique(each.drop("_n"), open_, ["grouped"], "left_semi", counts=groups.select("grouped", "_n")).select(CUT.names), "substring-parts")
    for more in done:
        cuts = cuts.unionByName(more)
    found = spans[0] if spans else cuts.limit(0).select("text_key", "first", "last")
    for more in spans[1:]:
        found = found.unionByName(more)
    return cuts, found


def repeats_in_collections(cuts: DataFrame, length: int, anchor: int) -> DataFrame:
    """text_key, first, last: repeated starts of those segments that occur once. cuts: as CUT, with each different segment
    of a group once, and no group that outgrows a task. Tasks get like numbers of segments."""

    def starts(key: bytes, first: int, flags: np.ndarray) -> Iterator[tuple[bytes, int, int]]:
        edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
        for a, b in zip(edges[::2], edges[1::2], strict=True):
            yield key, first + int(a), first + int(b) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        group: list[dict] = []  # the one that is being read

        def done(rows: list[dict]) -> pa.RecordBatch:
            flags = build([r["bytes"] for r in rows], watch=length)[2]
            found = [x for r, f in zip(rows, flags, strict=True) if r["n"] == 1 for x in starts(r["text_key"], r["first"], f)]
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.binary()), *(pa.array([x[i] for x in found], pa.int32()) for i in (1, 2))], names=["text_key", "first", "last"])

        for batch in batches:
            for row in batch.to_pylist():
                if group and row["grouped"] != group[0]["grouped"]:
                    held += trimmed(group, length, anchor)
                    group = []
                    if len(held) >= COLLECTION:
                        yield done(held)
                        held = []
                group.append(row)
        held += trimmed(group, length, anchor)
        if held:
            yield done(held)

    n = max(int(cuts.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(50_000, cuts.count() // TASK + 1))
    return cuts.repartition(n, "grouped").sortWithinPartitions("grouped").mapInArrow(run, "text_key binary, first int, last int")


def without_repeats(docs: DataFrame, length: int = 400, *, anchor: int | None = None, most_group: int = GROUP, bits: int = 24) -> DataFrame:
    """For every row of docs (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256, where each byte is removed
    that lies in a string of `length` bytes which also starts elsewhere, in the same text or another.

    Texts are taken as UTF-8; a null text is empty, a text shorter than length loses nothing, and what is kept of a
    text need not be whole characters. Rows that repeat a text lose all of it if it is long enough. A very long text is
    read in parts, and only its own segments and spans are gathered. An empty table gives no rows; other columns are
    ignored. most_group bounds the different segments that are compared at once; it doesn't change the result.
    """
    rows = written(facts(docs), "substring-rows", keep=True)
    with scratch(docs.sparkSession):
        made = losses(docs, rows, length, anchor or length // 2, most_group, bits)
    return join_unique(rows, made, ["text_key"], "left").select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept_sha256", "sha256").alias("kept_sha256"))


def losses(docs: DataFrame, rows: DataFrame, length: int, anchor: int, most_group: int, bits: int) -> DataFrame:
    """text_key, n_removed, n_spans, kept_sha256 of the texts that lose something. rows: facts of docs."""
    parts = written(segments(docs, length, anchor), "substring-runs")
    twice = parts.groupBy("anchor").agg(F.count("*").alias("_n"), F.min("content").alias("c0"), F.max("content").alias("c1")).where("_n > 1")
    twice = written(twice.select("anchor", "_n", (F.col("c0") == F.col("c1")).alias("alike")), "substring-anchors")
    parts = written(join_unique(parts, twice.select("anchor", "alike"), ["anchor"], counts=twice.select("anchor", "_n")), "substring-runs")
    each = parts.where("NOT alike").groupBy("anchor", "content").agg(F.count("*").alias("n"), F.min(F.struct("text_key", "first", "last", "at")).alias("one"))
    each = written(each.select("anchor", "content", "n", "one.*"), "substring-distinct")
    groups = written(each.groupBy("anchor").agg(F.count("*").alias("_n"), F.sum((F.col("n") == 1).cast("int")).alias("lone")), "substring-anchors")
    open_ = join_unique(each, groups.where("lone > 0").select("anchor"), ["anchor"], "left_semi", counts=groups.select("anchor", "_n"))
    open_ = written(open_, "substring-open")  # anchors with some segment that occurs once
    several = each.where("n > 1").select("anchor", "content", F.col("n").alias("_n"))
    again = join_unique(parts.where("NOT alike"), several.drop("_n"), ["anchor", "content"], "left_semi", counts=several)
    whole = parts.where("alike").unionByName(again.select(parts.columns))
    whole = written(whole.select("text_key", "first", "last").distinct(), "substring-whole")

    keys = open_.select("text_key").unionByName(whole.select("text_key")).distinct()
    keys = keys.join(rows.groupBy("text_key").agg(F.min("doc_id").alias("first_doc")), "text_key")
    texts = written(wanted_texts(docs, written(keys, "substring-keys"), bits), "substring-texts")
    cuts, divided_spans = divided(written(cuts_of(open_, texts, length, anchor), "substring-segments"), length, most_group)
    spans = whole.unionByName(divided_spans).unionByName(repeats_in_collections(cuts, length, anchor))
    of_text = spans.distinct().groupBy("text_key").agg(F.collect_list(F.struct("first", "last")).alias("spans"))  # a text's own spans

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"n_removed": [], "n_spans": [], "kept_sha256": []}
            for z, found in zip(batch.column("deflated"), batch.column("spans"), strict=True):
                raw, kept, removed, upto, n = zlib.decompress(z.as_py()), hashlib.sha256(), 0, 0, 0
                for s in sorted((s["first"], s["last"] + length) for s in found.as_py()):
                    if s[0] > upto or not n:
                        kept.update(raw[upto : s[0]])
                        n += 1
                        removed += s[1] - s[0]
                        upto = s[1]
                    elif s[1] > upto:
                        removed += s[1] - upto
                        upto = s[1]
                kept.update(raw[upto:])
                for k, v in zip(out, (removed, n, kept.hexdigest()), strict=True):
                    out[k].append(v)
            yield pa.RecordBatch.from_arrays([batch.column("text_key"), pa.array(out["n_removed"], pa.int64()), pa.array(out["n_spans"], pa.int64()), pa.array(out["kept_sha256"], pa.string())], names=["text_key", *out])

    made = texts.join(of_text, "text_key").select("text_key", "deflated", "spans").mapInArrow(cut, "text_key binary, n_removed long, n_spans long, kept_sha256 string")
    return written(made, "substring-made", keep=True)


def op9_substrings(spark, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"))

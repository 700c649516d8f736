"""Importance resampling towards a target: hashed word runs counted by a byte automaton, and Gumbel top-k draws."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewave.llm.common import LOWER, slices, table, utf8, written

#: Bytes of a lower-cased text that belong to words: digits, a-z and all bytes of characters beyond ASCII.
WORD_BYTES = np.isin(np.arange(256), [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
LOWERED = np.frombuffer(LOWER, np.uint8)
#: Longer words are cut into blocks of so many bytes, whose registers are made side by side and then combined.
BLOCK = 64


def crc_table() -> np.ndarray:
    """The register after each byte from 0, for the reflected polynomial 0xEDB88320."""
    r = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        r = np.where(r & 1, (r >> 1) ^ np.uint32(0xEDB88320), r >> 1)
    return r


STEP = crc_table()


def shifted(tables: np.ndarray, r: np.ndarray) -> np.ndarray:
    """A linear map of registers, given by the images of each byte at each of the four places."""
    return tables[0][r & 255] ^ tables[1][(r >> 8) & 255] ^ tables[2][(r >> 16) & 255] ^ tables[3][r >> 24]


def shift_tables(n: int) -> list[np.ndarray]:
    """The maps that advance a register over BLOCK, 2 BLOCK, 4 BLOCK ... zero bytes, up to n bytes in all."""
    one = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    for _ in range(BLOCK):
        one = STEP[one & 255] ^ (one >> 8)
    maps = [one]
    while BLOCK << len(maps) < n:
        maps.append(shifted(maps[-1], maps[-1]))
    return maps


def advance(register: np.ndarray, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC registers moved over data[start : start + length], all starts a byte at a time together.

    Starts are taken by length, so that those still running are a beginning of the list. A stretch over BLOCK bytes is
    cut into blocks that run as starts of their own from register 0; zero bytes before the first block leave 0 as it
    is, and what the register held goes into the first four bytes. Registers of neighbouring blocks are combined by
    the map for as many zero bytes as the right one has, in as many rounds as the number of blocks has binary digits.
    """
    out = register.copy()
    short = np.flatnonzero(length <= BLOCK)
    short = short[np.argsort(-length[short], kind="stable")]
    r, at, n = out[short], start[short], length[short]
    running = len(short) - np.searchsorted(n[::-1], np.arange(BLOCK), "right")  # how many are longer than k
    for k in range(BLOCK):
        m = running[k]
        if not m:
            break
        r[:m] = STEP[(r[:m] ^ data[at[:m] + k]) & 255] ^ (r[:m] >> 8)
    out[short] = r
    for i in np.flatnonzero(length > BLOCK):
        n = int(length[i])
        piece = data[start[i] : start[i] + n].copy()
        piece[:4] ^= np.frombuffer(out[i].astype("<u4").tobytes(), np.uint8)
        blocks = np.zeros(-(-n // BLOCK) * BLOCK, np.uint8)
        blocks[len(blocks) - n :] = piece
        columns, r = blocks.reshape(-1, BLOCK), np.zeros(len(blocks) // BLOCK, np.uint32)
        for k in range(BLOCK):
            r = STEP[(r ^ columns[:, k]) & 255] ^ (r >> 8)
        for step in shift_tables(len(blocks)):
            if len(r) == 1:
                break
            if len(r) % 2:
                r = np.concatenate([np.zeros(1, np.uint32), r])
            r = shifted(step, r[::2]) ^ r[1::2]
        out[i] = r[0]
    return out


def word_bounds(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the words in the lower-cased bytes of texts one after another, of which text i is
    begins[i] .. begins[i + 1]: where the class of a byte differs from that of the one before, and where texts meet."""
    inside = WORD_BYTES[data].view(np.int8)
    change = np.diff(inside, prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    cuts = np.unique(begins[1:-1])
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    cuts = cuts[(inside[cuts - 1] == 1) & (inside[cuts] == 1)]
    if len(cuts):
        starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
    return starts, ends


def feature_buckets(batch: pa.RecordBatch, column: str, longest: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of 1, 2 .. longest words: (row of each run, its bucket). A run's register goes on from that of the run with
    one word less, over a space and the next word."""
    data, begins = utf8(batch.column(column))
    data = LOWERED[data]
    starts, ends = word_bounds(data, begins)
    rows = np.searchsorted(begins, starts, "right") - 1
    register = advance(np.full(len(starts), 0xFFFFFFFF, np.uint32), data, starts, ends - starts)
    for n in range(1, longest + 1):
        if n > 1:
            here = np.flatnonzero(rows[: len(rows) - n + 1] == rows[n - 1 :]) if len(rows) >= n else np.zeros(0, np.int64)
            before = np.full(len(starts), -1, np.int64)
            before[first] = np.arange(len(first))  # noqa: F821
            r = register[before[here]]
            r = STEP[(r ^ np.uint32(0x20)) & 255] ^ (r >> 8)
            register = advance(r, data, starts[here + n - 1], (ends - starts)[here + n - 1])
        else:
            here = np.arange(len(starts))
        first = here
        yield rows[here], ((register ^ np.uint32(0xFFFFFFFF)) % np.uint32(buckets)).astype(np.int64)


def bucket_counts(docs: DataFrame, *, longest: int = 1, buckets: int = 10_000) -> DataFrame:
    """bucket, n: how many runs of 1 to `longest` words of all texts are in each bucket (buckets without any are left out).
    Each task adds up its own counts, so what is shuffled is one row for each task and bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for whole in batches:
            for batch in slices(whole, "text"):
                for _, bucket in feature_buckets(batch, "text", longest, buckets):
                    total += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], names=["bucket", "n"])

    return docs.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, *, longest: int = 1, buckets: int = 10_000, unit: int = 1000) -> np.ndarray:
    """The gain of each bucket: floor(unit * ln of the ratio of its smoothed shares in target and docs). `buckets` rows of
    each side come to the driver, however large the tables are."""
    seen, wanted = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for counts, rows in ((seen, docs), (wanted, target)):
        for r in bucket_counts(rows, longest=longest, buckets=buckets).collect():  # `buckets` rows at most
            counts[r["bucket"]] = r["n"]
    ratio = (wanted + 1.0) * float(seen.sum() + buckets) / ((seen + 1.0) * float(wanted.sum() + buckets))
    return np.floor(unit * np.log(ratio)).astype(np.int64)


def weighted(docs: DataFrame, gains: np.ndarray, *, longest: int = 1) -> DataFrame:
    """doc_id, n_words, n_features, weight (floored mean of the gains of a text's features; none: 0)."""
    shared, buckets = docs.sparkSession.sparkContext.broadcast(gains), len(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for whole in batches:
            for batch in slices(whole, "text"):
                n, total, words = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64), None
                for rows, bucket in feature_buckets(batch, "text", longest, buckets):
                    many = np.bincount(rows, minlength=batch.num_rows)
                    ends = np.cumsum(many)
                    sums = np.concatenate([[0], np.cumsum(gain[bucket])])
                    n, total, words = n + many, total + sums[ends] - sums[ends - many], many if words is None else words
                arrays = [batch.column("doc_id"), pa.array(words, pa.int64()), pa.array(n), pa.array(total // np.maximum(n, 1))]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def gumbel(doc_id: str, seed: int, unit: int = 1000) -> Column:
    """floor(-unit * ln(-ln(u))) for a u in (0, 1) that the seed and the id decide."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(float(-unit)) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def resample(docs: DataFrame, target: DataFrame, *, percent: int = 10, longest: int = 1, buckets: int = 10_000, least_words: int = 20, seed: int = 2024, partitions: int | None = None) -> DataFrame:
    """Weighs each row of docs (doc_id, text, ...) by how much its words are those of target (text), and draws `percent` of
    the rows with at least least_words words, without replacement, with chances by weight: a row's score is its
    weight with Gumbel noise, and the highest scores are drawn.

    Words are runs of digits, a-z (after A-Z is lower-cased) and characters beyond ASCII. The tables are read twice:
    once for counts by bucket, once for weights; texts aren't shuffled. Ranks come from ranges of the order of
    scores and the number of rows in the ranges before, so no task sees more than a range.

    A null text has no words and weight 0. A null doc_id has noise of its own (that of an empty id) and comes after other
    ids with its score. Rows that repeat are rows of their own, ranked one after another; rows with one score and id are
    ranked by features and weight. A text of any length is read as one; a word of any length is one word. An empty
    table of docs gives no rows; an empty target gives a ratio to nothing but smoothing. Other columns are ignored.

    Returns doc_id, n_features, weight, score, rank (1 .. for the rows drawn, else null).
    """
    gains = bucket_gains(docs, target, longest=longest, buckets=buckets)
    scored = weighted(docs, gains, longest=longest).withColumn("score", F.col("weight") + gumbel("doc_id", seed))
    scored = written(scored, "importance-scores")
    able = scored.where(F.col("n_words") >= least_words)
    drawn = percent * able.count() // 100
    n = partitions or max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("n_features")]
    dealt = able.withColumn("tie", F.monotonically_increasing_id())  # only spreads rows that are equal otherwise
    dealt = written(dealt.repartitionByRange(n, *order, "tie").withColumn("part", F.spark_partition_id()).drop("tie"), "importance-order")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("part").agg(F.count("*").alias("rows")).select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("shift"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order)) + F.col("shift")
    ranked = dealt.join(F.broadcast(totals), "part").withColumn("place", place.cast("long"))  # one row a partition
    result = ["doc_id", "n_features", "weight", "score"]
    rank = F.when(F.col("place") <= drawn, F.col("place")).alias("rank")
    return ranked.select(*result, rank).unionByName(scored.where(F.col("n_words") < least_words).select(*result, F.lit(None).cast("long").alias("rank")))


def op11_resampling(spark, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: The same with a regular expression for the words and a table-driven crc32 for each distinct word.
OP11_SQL = r"""
WITH tab AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) ORDER BY i) AS t FROM range(256) r(i)),
d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
e AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
dw AS (SELECT row, unnest(ws) AS w FROM d), ew AS (SELECT unnest(ws) AS w FROM e),
u AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM dw UNION SELECT w FROM ew)),
b AS (SELECT w, list_transform(range(0, len(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)) AS bytes FROM u),
x AS (SELECT w, xor(4294967295, list_reduce(bytes, lambda c, y: xor(c // 256, t[CAST(xor(c % 256, y) AS INT) + 1]), 4294967295::BIGINT)) % 10000 AS bucket FROM b, tab),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN x USING (w) GROUP BY 1), t AS (SELECT bucket, count(*) AS t FROM ew JOIN x USING (w) GROUP BY 1),
n AS (SELECT (SELECT count(*) FROM dw) AS ss, (SELECT count(*) FROM ew) AS tt),
g AS (SELECT b AS bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (ss + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * (tt + 10000)::DOUBLE))) AS BIGINT) AS gain
      FROM range(10000) r(b) LEFT JOIN s ON s.bucket = b LEFT JOIN t ON t.bucket = b, n),
m AS (SELECT row, CAST(sum(gain) AS BIGINT) AS total FROM dw JOIN x USING (w) JOIN g USING (bucket) GROUP BY 1),
k AS (SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_features, CASE WHEN len(ws) = 0 THEN 0 ELSE (total - ((total % len(ws)) + len(ws)) % len(ws)) // len(ws) END AS weight,
      ('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT AS h FROM d LEFT JOIN m USING (row)),
q AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM k),
o AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features DESC) END AS place FROM q)
SELECT doc_id, n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score, CASE WHEN place <= 10 * (SELECT count(*) FROM q WHERE n_features >= 20) // 100 THEN place END AS rank FROM o
"""

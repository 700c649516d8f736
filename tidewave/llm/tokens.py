"""Token ids of a corpus in files that each hold a wavelet matrix, in the order of document ids."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewave.llm.bpe import matches
from tidewave.llm.common import new_path, slices, table, utf8, written
from tidewave.llm.warc import file_system
from tidewave.llm.wavelet import WaveletFile, build

#: Classes of bytes for the splitting of texts: white space, letters, digits, other printable ASCII; 0 is anything else.
SPACE, LETTER, DIGIT, MARK = 1, 2, 3, 4
CLASSES = np.zeros(256, np.uint8)
CLASSES[[9, 10, 11, 12, 13, 32]] = SPACE
CLASSES[33:127] = MARK
CLASSES[48:58] = DIGIT
CLASSES[65:91] = CLASSES[97:123] = LETTER
#: Characters of two bytes that are letters whatever follows the first byte: U+0100 to U+017F and U+0400 to U+047F.
LETTER_LEADS = np.isin(np.arange(256), [0xC4, 0xC5, 0xD0, 0xD1])
#: Second bytes of letters after 0xC3: all but the signs of multiplication and division.
AFTER_C3 = np.isin(np.arange(256), [b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)])
#: A piece that the split pattern takes as one match.
ONE_MATCH = re.compile(rb" ?(?:(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xc4\xc5\xd0\xd1][\x80-\xbf])+|[0-9]+|[!-/:-@\[-`{-~]+)")
#: Pieces of up to so many bytes are kept by their bytes in two integers.
KEPT = 16


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in the vocabulary: itself where it is printable, others from U+0100 on."""
    out, more = {}, 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            out[b] = chr(b)
        else:
            out[b], more = chr(256 + more), more + 1
    return out


def piece_starts(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where texts (one after another in data, text i from begins[i]) can be cut without any effect on their ids.

    The byte-level split pattern takes white space only before other characters or alone, and otherwise runs of letters,
    of digits or of other characters. So a match ends before white space that follows none, and where the class
    changes, but for letters after an apostrophe, which may belong to it, and after white space of one character
    other than a space, which the next match may take. Cuts are made next to characters of known class only.
    """
    cls = CLASSES[data]
    pairs = np.flatnonzero(LETTER_LEADS[data[:-1]] | ((data[:-1] == 0xC3) & AFTER_C3[data[1:]])) if len(data) else np.zeros(0, np.int64)
    cls[pairs] = cls[pairs + 1] = LETTER
    a, b = cls[:-1], cls[1:]
    cut = np.concatenate([[False], (a > SPACE) & (b >= SPACE) & (a != b) & ((data[:-1] != 0x27) | (b != LETTER))]) if len(data) else np.zeros(0, bool)
    cut[2:] |= (cls[:-2] > SPACE) & (cls[1:-1] == SPACE) & (data[1:-1] != 0x20) & (cls[2:] > SPACE)
    cut[begins[:-1][begins[:-1] < len(data)]] = True
    return np.flatnonzero(cut)


class Encoder:
    """The tokenizers library's ids of whole texts, for a byte-level vocabulary.

    Texts are cut into pieces, about words, and the library encodes a piece that isn't known yet. Known pieces are kept
    in a table of fixed size, in which a piece has one place, and found for a whole batch at once. Strings that look
    like special tokens are text like any other.
    """

    def __init__(self, path: str, slots: int = 1 << 19):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.model, self.letters = self.library.model, byte_letters()
        self.small = np.dtype(np.uint16 if self.library.get_vocab_size() <= 1 << 16 else np.uint32)
        self.bits = slots.bit_length() - 1
        # a row: the piece's bytes in two integers, its length and number of ids in a third, then the ids
        self.table = np.zeros((slots, 4 + KEPT * self.small.itemsize // 8), np.uint64)
        self.long: dict[bytes, list[int]] = {}

    def piece(self, piece: bytes) -> list[int]:
        """The ids of one piece. One with very long white space is cut further (see bpe.matches)."""
        if len(piece) < 4096:
            if ONE_MATCH.fullmatch(piece):
                return self.one_match(piece)
            return self.library.encode(piece.decode(), add_special_tokens=False).ids
        parts = [self.one_match(part.encode()) if whole else self.library.encode(part, add_special_tokens=False).ids for part, whole in matches(piece.decode())]
        return [i for ids in parts for i in ids]

    def one_match(self, piece: bytes) -> list[int]:
        if piece.isascii() and piece.isalnum():
            return [t.id for t in self.model.tokenize(piece.decode())]
        return [t.id for t in self.model.tokenize(piece.decode("latin-1").translate(self.letters))]

    def longer(self, piece: bytes) -> list[int]:
        known = self.long.get(piece)
        if known is None:
            known = self.piece(piece)
            if len(piece) <= 256:
                if len(self.long) >= 20_000:
                    self.long.clear()
                self.long[piece] = known
        return known

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, how many each text has); a null text has none."""
        data, begins = utf8(texts)
        at = piece_starts(data, begins)
        if not len(at):
            return np.zeros(0, self.small), np.zeros(len(texts), np.int64)
        length = np.diff(at, append=len(data))
        padded = np.concatenate([data, np.zeros(KEPT, np.uint8)])
        eight = np.lib.stride_tricks.as_strided(padded[:8].view(np.uint64), (len(padded) - 7,), (1,))
        mask = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
        one, two = eight[at] & mask[np.minimum(length, 8)], np.zeros(len(at), np.uint64)
        over = np.flatnonzero(length > 8)
        two[over] = eight[at[over] + 8] & mask[np.minimum(length[over] - 8, 8)]
        mixed = ((one * np.uint64(0x9E3779B97F4A7C15)) ^ ((two + length.astype(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F))) * np.uint64(0xD6E8FEB86659FD93)
        slot = (mixed >> np.uint64(64 - self.bits)).astype(np.int64)
        row = self.table[slot]
        hit = (row[:, 0] == one) & (row[:, 1] == two) & (row[:, 2] >> np.uint64(8) == length.astype(np.uint64))  # no piece is empty
        many = np.where(hit, row[:, 2] & np.uint64(255), np.uint64(0)).astype(np.int64)
        rest = np.flatnonzero(~hit)
        flat: list[int] = []
        firsts = which = base = sizes = np.zeros(0, np.int64)
        if len(rest):  # each piece that isn't known once
            # pieces that are kept are equal if their integers are; others have a name each
            name = np.where(length[rest] <= KEPT, mixed[rest] ^ (mixed[rest] >> np.uint64(32)), rest.astype(np.uint64) << np.uint64(40))
            order = np.lexsort((two[rest], one[rest], length[rest], name))
            r = rest[order]
            fresh = np.concatenate([[True], (length[r[1:]] != length[r[:-1]]) | (one[r[1:]] != one[r[:-1]]) | (two[r[1:]] != two[r[:-1]]) | (length[r[1:]] > KEPT)])
            firsts = r[fresh]
            which = np.empty(len(rest), np.int64)
            which[order] = np.cumsum(fresh) - 1
            raw, counted = data.tobytes(), []
            for s, n in zip(at[firsts].tolist(), length[firsts].tolist(), strict=True):
                ids = self.piece(raw[s : s + n]) if n <= KEPT else self.longer(raw[s : s + n])
                counted.append(len(ids))
                flat += ids
            sizes = np.array(counted, np.int64)
            base = np.cumsum(sizes) - sizes
            many[rest] = sizes[which]
        ends = np.cumsum(many)
        out = np.empty(int(ends[-1]), self.small)
        known, width = np.flatnonzero(hit), self.table.shape[1] * 8 // self.small.itemsize
        spread(out, ends[known] - many[known], row.view(self.small).reshape(-1), known * width + 32 // self.small.itemsize, many[known])
        if len(rest):
            made = np.array(flat, self.small)
            spread(out, ends[rest] - many[rest], made, base[which], many[rest])
            kept = np.flatnonzero(length[firsts] <= KEPT)
            new, i, s = np.zeros((len(kept), self.table.shape[1]), np.uint64), firsts[kept], sizes[kept]
            new[:, 0], new[:, 1], new[:, 2] = one[i], two[i], (length[i] << 8 | s).astype(np.uint64)
            spread(new.view(self.small).reshape(-1), np.arange(len(kept)) * width + 32 // self.small.itemsize, made, base[kept], s)
            self.table[slot[i]] = new
        upto = np.concatenate([[0], ends])[np.searchsorted(at, begins)]
        return out, np.diff(upto)


def spread(out: np.ndarray, to: np.ndarray, source: np.ndarray, start: np.ndarray, many: np.ndarray) -> None:
    """Copies many[i] values from source[start[i]] on to out[to[i]] on, for all i together."""
    step = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    out[np.repeat(to, many) + step] = source[np.repeat(start, many) + step]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each Python worker."""
    return Encoder(path)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, *, end_id: int = 0, tokens_per_file: int = 2 << 20, partitions: int | None = None) -> DataFrame:
    """Encodes every text of docs (doc_id, text, ...), ends each with end_id, and writes all ids in ascending order of
    doc_id to files of wavelet matrices in a folder that all executors share.

    Rows are dealt by ranges of the order and sorted; a task encodes its range and closes a file when it has
    tokens_per_file ids, so that it holds one file's ids, or one text's where that has more. A file is written under a
    name of its own and then renamed, so that a repeated task leaves whole files only.

    A null text is an empty one: its end_id alone. Null doc_ids come first. Rows with one doc_id are ordered by
    crc32, size and text, and a doc_id with very many rows is spread over several ranges. An empty table gives no files.
    Other columns are ignored.

    Returns the files: part, seq (order within the part), path, tokens, documents, start (ids in all files before).
    """
    spark = docs.sparkSession
    n = partitions or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    key = ["doc_id", "crc", "size", "text"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumns({"crc": F.crc32(F.col("text").cast("binary")), "size": F.octet_length("text")})
    # the last key only spreads rows that are equal in all others
    dealt = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(n, *key[:3], "tie").sortWithinPartitions(*key).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        system, where = file_system(folder)
        system.create_dir(where, recursive=True)
        found, ids, doc_ids, lengths, held = [], [], [], [], 0

        def close() -> None:
            nonlocal ids, doc_ids, lengths, held
            name = f"{where}/{task.partitionId():06d}-{len(found):06d}.twm"
            own = f"{name}.{task.taskAttemptId()}.part"
            with system.open_output_stream(own) as f:
                f.write(build(np.concatenate(ids), doc_ids, lengths))
            system.move(own, name)
            found.append({"part": task.partitionId(), "seq": len(found), "path": name, "tokens": held, "documents": len(doc_ids)})
            ids, doc_ids, lengths, held = [], [], [], 0

        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                made, many = encoder(tokenizer).encode(batch.column("text"))
                ended = np.insert(made, np.cumsum(many), end_id)  # after each text's last id
                upto, first, names = np.cumsum(many + 1), 0, batch.column("doc_id").to_pylist()
                while first < len(names):  # as many documents as the open file has room for
                    before = int(upto[first - 1]) if first else 0
                    last = max(int(np.searchsorted(upto, before + tokens_per_file - held, "right")), first + (held == 0))
                    if last > first:
                        ids.append(ended[before : upto[last - 1]])
                        doc_ids += names[first:last]
                        lengths += (many[first:last] + 1).tolist()
                        held += int(upto[last - 1]) - before
                    if last < len(names) or held >= tokens_per_file:
                        close()
                    first = last
        if held:
            close()
        if found:
            yield pa.RecordBatch.from_pylist(found, pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("tokens", pa.int64()), ("documents", pa.int64())]))

    files = written(dealt.mapInArrow(run, "part int, seq int, path string, tokens long, documents long"), "token-files", keep=True)
    parts = files.groupBy("part").agg(F.sum("tokens").alias("all"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("all").over(before(Window.orderBy("part"))), F.lit(0)).alias("shift"))  # one row a partition
    inside = F.coalesce(F.sum("tokens").over(before(Window.partitionBy("part").orderBy("seq"))), F.lit(0))
    return files.join(F.broadcast(parts), "part").withColumn("start", inside + F.col("shift")).drop("shift")


def over_files(files: DataFrame, folder: str, schema: str, read) -> DataFrame:  # type: ignore[no-untyped-def]
    """Rows that read(file, start) gives as record batches for each file, files spread over tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(folder)
        for batch in batches:
            for r in batch.to_pylist():
                with system.open_input_file(r["path"]) as f:
                    yield from read(WaveletFile(f), r["start"])

    tasks = max(1, files.count())
    return files.select("path", "start").repartition(min(tasks, 100_000)).mapInArrow(run, schema)


def read_documents(files: DataFrame, folder: str, *, keep_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit
    integers), and ids if keep_ids, read from the files of write_token_files."""
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * keep_ids

    def read(f: WaveletFile, start: int) -> Iterator[pa.RecordBatch]:
        ids = f.tokens().astype("<u4", copy=False)
        ends = np.cumsum(f.lengths)
        raw = memoryview(ids).cast("B")
        for k in range(0, len(ends), 1024):
            part = range(k, min(k + 1024, len(ends)))
            first = [int(ends[i] - f.lengths[i]) for i in part]
            crc = [zlib.crc32(raw[4 * a : 4 * int(ends[i])]) for i, a in zip(part, first, strict=True)]
            arrays = [pa.array([f.doc_ids[i] for i in part], pa.int64()), pa.array([start + a for a in first], pa.int64()), pa.array(f.lengths[part.start : part.stop]), pa.array(crc, pa.int64())]
            if keep_ids:
                arrays.append(pa.array([ids[a : int(ends[i])].astype(np.int32) for i, a in zip(part, first, strict=True)], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return over_files(files, folder, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * keep_ids, read)


def count_tokens(files: DataFrame, folder: str, tokens: list[int]) -> DataFrame:
    """token, n: how often each of some ids occurs, from two ranks a plane and file."""

    def read(f: WaveletFile, start: int) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.int64()), pa.array([f.count(t) for t in tokens], pa.int64())], names=["token", "n"])

    return over_files(files, folder, "token long, n long", read).groupBy("token").agg(F.sum("n").alias("n"))


def locate_tokens(files: DataFrame, folder: str, tokens: list[int]) -> DataFrame:
    """token, doc_id, place (within the document's ids) of each occurrence of some ids, by selects in the planes."""

    def read(f: WaveletFile, start: int) -> Iterator[pa.RecordBatch]:
        ends = np.cumsum(f.lengths)
        for t in tokens:
            at = f.places(t)
            doc = np.searchsorted(ends, at, "right")
            arrays = [pa.array(np.full(len(at), t), pa.int64()), pa.array([f.doc_ids[i] for i in doc], pa.int64()), pa.array(at - (ends - f.lengths)[doc], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["token", "doc_id", "place"])

    return over_files(files, folder, "token long, doc_id long, place long", read)


def op12_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = new_path(spark, "tokens")
    files = write_token_files(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return read_documents(files, folder, keep_ids=False)

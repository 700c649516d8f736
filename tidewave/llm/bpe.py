"""Byte-level BPE with the tiktoken library and a local rank file."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewave.llm.common import free_name, slices, table

#: A text is encoded in pieces of about so many characters.
PIECE = 20_000
#: Between these two characters a match of the split pattern always ends: white space never follows another
#: character within a match, and no lookahead reaches back over the boundary. Only ASCII is used, on whose classes
#: all regex engines agree.
SAFE = re.compile(r"[A-Za-z0-9.,;:!?](?=[ \n\t])")
#: The characters that Unicode calls white space, as the library's regex engine takes them.
WHITE = "\t\n\v\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A run of white space this long is not left to the regex, whose stack grows with it.
LONG_RUN = re.compile(f"[{WHITE}]{{4096,}}")


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """Cuts a text at safe boundaries, so that the pieces' ids one after another are the text's ids.
    A piece is longer than size where no boundary comes; the library's merges are not slowed by that."""
    start = 0
    while len(text) - start > size:
        m = SAFE.search(text, start + size - 1)
        if m is None:
            break
        yield text[start : m.end()]
        start = m.end()
    yield text[start:]


@lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str):
    """One encoder for each Python worker."""
    import tiktoken

    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def matches(text: str) -> Iterator[tuple[str, bool]]:
    """(part, whether it is one match of the split pattern): a long run of white space is one match, but for its last
    character where another character follows, which the next match may take; the parts between are cut further."""
    upto = 0
    for run in LONG_RUN.finditer(text):
        end = run.end() - (run.end() < len(text))
        yield from ((p, False) for p in pieces(text[upto : run.start()]))
        yield text[run.start() : end], True
        upto = end
    yield from ((p, False) for p in pieces(text[upto:]))


def encode(text: str | None, rank_file: str, pattern: str) -> list[int]:
    """The library's ids of a text, however long it is. The pattern is one whose matches hold white space only before
    other characters or alone, as public_tokenizers.PATTERN."""
    enc, ids = encoding(rank_file, pattern), []
    for part, whole in matches(text or ""):
        ids += enc._encode_single_piece(part) if whole else enc.encode_ordinary(part)
    return ids


def decode(ids: list[int], rank_file: str, pattern: str) -> bytes:
    """The raw bytes; they need not be whole characters where the ids are cut from a longer list."""
    return encoding(rank_file, pattern).decode_bytes(ids)


def encode_documents(docs: DataFrame, rank_file: str, pattern: str, *, carry: list[str] = ["doc_id"], keep_ids: bool = True, digests: bool = False) -> DataFrame:  # noqa: B006
    """Encodes docs.text of every row and decodes the ids again.

    rank_file lies at the same path on every executor, as an installed package's data do. Returns the columns
    in carry, n_tokens, and ids and decoded (binary) if keep_ids, or ids_sha256 and decoded_sha256 if digests.
    A null text is an empty one: no ids. Rows that repeat give rows that repeat; an empty table gives no rows;
    columns not carried are ignored. A very long text is encoded in parts, of which the ids are joined: what a task
    holds grows with its longest text and not with a batch. The work is one pass over the rows, without a shuffle.
    """
    fields = [f for f in docs.schema.fields if f.name in carry]
    source = free_name(carry, "text")
    made = "n_tokens long" + ", ids array<int>, decoded binary" * keep_ids + ", ids_sha256 string, decoded_sha256 string" * digests
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), made])
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word = [str(i) for i in range(encoding(rank_file, pattern).n_vocab)]
        types = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "decoded": pa.binary(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
        wanted = ["n_tokens"] + ["ids", "decoded"] * keep_ids + ["ids_sha256", "decoded_sha256"] * digests
        for whole in batches:
            for batch in slices(whole, source, 1 << 20):  # a text has some thirty times its bytes in ids
                out: dict[str, list] = {k: [] for k in wanted}
                for text in batch.column(source):
                    ids = encode(text.as_py(), rank_file, pattern)
                    back = decode(ids, rank_file, pattern)
                    made = {"n_tokens": len(ids)}
                    if keep_ids:
                        made |= {"ids": np.array(ids, np.int32), "decoded": back}
                    if digests:
                        made |= {"ids_sha256": hashlib.sha256(",".join([word[i] for i in ids]).encode()).hexdigest(), "decoded_sha256": hashlib.sha256(back).hexdigest()}
                    for k, v in made.items():
                        out[k].append(v)
                arrays = [pa.array(out[k], types[k]) for k in wanted]
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *arrays], names=[*names, *wanted])

    return docs.select(*[f"`{n}`" for n in names], docs["text"].alias(source)).mapInArrow(run, schema)


def op5_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=False, digests=True)

"""Wavelet matrices, the piecewise encoder, CRC registers and runs of words against plain definitions."""

import io
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tidewave.llm import importance, periodic, tokens
from tidewave.llm.common import LOWER
from tidewave.llm.wavelet import WaveletFile, build


def test_registers_of_word_runs():
    texts = ["Hello wörld 12-ab", "", None, "x" * 1000 + " y", "abc", "def ghi", "漢" * 5000 + " z A.B", "a" * 64, "b" * 65, "c" * 128 + "d", "é" * 40, "-", "a  b"]
    batch = pa.record_batch({"text": pa.array(texts)})
    for longest in (1, 2, 3):
        got: list[list[int]] = [[] for _ in texts]
        for rows, bucket in importance.feature_buckets(batch, "text", longest, 10_000):
            for r, b in zip(rows, bucket, strict=True):
                got[r].append(int(b))
        for t, g in zip(texts, got, strict=True):
            w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").encode().translate(LOWER).decode())
            assert sorted(g) == sorted(zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in range(1, longest + 1) for i in range(len(w) - n + 1))


def test_draws_follow_the_target(spark):
    rng = random.Random(1)
    words = lambda kind: " ".join(f"{kind}{rng.randrange(50)}" for _ in range(40))
    docs = spark.createDataFrame([(k, words("good" if k % 10 == 0 else "other")) for k in range(1000)], "doc_id long, text string")
    target = spark.createDataFrame([(words("good"),) for _ in range(50)], "text string")
    drawn = [r["doc_id"] for r in importance.resample(docs, target, percent=5, buckets=100).where("rank IS NOT NULL").collect()]
    assert len(drawn) == 50 and sum(i % 10 == 0 for i in drawn) > 20  # 5 without weights


@pytest.mark.parametrize(("n", "kinds"), [(1, 1), (70_000, 5), (200_001, 300), (5_000, 100_000)])
def test_wavelet_places(n, kinds):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, n) % kinds).astype(np.uint32)
    f = WaveletFile(io.BytesIO(build(ids, [None, 7], [n - n // 2, n // 2])))
    assert (f.tokens() == ids).all() and f.doc_ids == [None, 7] and f.lengths.tolist() == [n - n // 2, n // 2]
    for i in rng.integers(0, n, 30).tolist():
        assert f.access(i) == ids[i]
    for t in [*np.unique(ids)[:15].tolist(), kinds + 1]:
        at = np.flatnonzero(ids == t)
        assert f.count(t) == len(at) and (f.places(t) == at).all()
        assert len(at) == 0 or f.places(t, np.array([len(at) - 1])) == at[-1:]
        for j in rng.integers(0, n + 1, 3).tolist():
            assert f.rank(t, j) == (ids[:j] == t).sum()
    with pytest.raises(ValueError, match="not a file"):
        WaveletFile(io.BytesIO(b"x" * 100))


def test_one_place_reads_a_block_of_each_plane():
    ids = np.random.default_rng(1).integers(0, 1000, 1_000_000).astype(np.uint32)
    f = WaveletFile(io.BytesIO(build(ids, [1], [len(ids)])))
    assert f.access(777_777) == ids[777_777]
    assert f.block.cache_info().misses == f.width  # of 16 blocks in each plane


BITS = ["don't", "I'll", "'s", "''s", "a'b", "  ", "\n", "\n\n ", "\t", "x1y2", "é", "naïve", "ÀÉ×÷", "漢字", "　", " ", " ", "\x1c", "\x00", "😀", "12.5%", "<|endoftext|>", "Ġ", "word", "The", "ſ", "Жук", "á", "́", "!!!", "\x85", "--", "'", " '", "re", "ll", " n't", "ñ", "١٢", "½", "_"]


@pytest.mark.parametrize("slots", [1 << 4, 1 << 16])
def test_pieces_have_the_ids_of_the_whole(slots):
    P = pytest.importorskip("public_tokenizers")
    encoder = tokens.Encoder(P.path("byte_bpe_50k.json"), slots)
    want = lambda ts: [e.ids for e in encoder.library.encode_batch([t or "" for t in ts], add_special_tokens=False)]

    def got(ts):
        ids, n = encoder.encode(pa.array(ts, pa.string()))
        return [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]

    rng = random.Random(3)
    for _ in range(60):
        texts = ["".join(rng.choice(BITS) * rng.choice([1, 1, 1, 2]) for _ in range(rng.randint(0, 40))) if rng.random() > 0.05 else None for _ in range(20)]
        assert got(texts) == want(texts)
    assert got([None, "", None]) == [[], [], []] and got([None]) == [[]]
    for text in ("漢" * 50_000, "ab" * 40_000, "a b " * 30_000, "-=" * 20_000, " " * 3000 + "x"):
        assert got([text, "next"]) == want([text, "next"])
    # longer white space than the library's regex should be given is the one match that the pattern makes of it
    assert sum(got(["a" + " " * 200_000 + "b"]), []) == [*encoder.library.encode("a").ids, *encoder.one_match(b" " * 199_999), *encoder.library.encode(" b").ids]


def test_token_files_of_many_sizes(spark, tmp_path):
    P = pytest.importorskip("public_tokenizers")
    path = P.path("byte_bpe_50k.json")
    library = tokens.encoder(path).library
    rng = random.Random(5)
    docs = [(k, " ".join(rng.choice(["alpha", "beta", "gamma!", "the", "of"]) for _ in range(rng.choice([0, 3, 50, 900])))) for k in range(150)]
    want = {k: [*library.encode(t).ids, 0] for k, t in docs}
    df = spark.createDataFrame(docs[::-1], "doc_id long, text string")
    for folder, size in ((f"{tmp_path}/a", 500), (f"file://{tmp_path}/b", 1 << 20)):
        files = tokens.write_token_files(df, folder, path, tokens_per_file=size, partitions=3)
        assert files.agg({"documents": "sum"}).first()[0] == 150
        if size == 500:
            assert all(r["tokens"] <= size or r["documents"] == 1 for r in files.collect())
        back = {r["doc_id"]: r for r in tokens.read_documents(files, folder).collect()}
        start = 0
        for k, ids in want.items():
            assert list(back[k]["ids"]) == ids and back[k]["start"] == start
            start += len(ids)
        the = library.encode(" the").ids[0]
        assert {r["token"]: r["n"] for r in tokens.count_tokens(files, folder, [the, 0, 99]).collect()} == {t: sum(ids.count(t) for ids in want.values()) for t in (the, 0, 99)}
        assert sorted((r["doc_id"], r["place"]) for r in tokens.locate_tokens(files, folder, [the]).collect()) == [(k, i) for k, ids in want.items() for i, t in enumerate(ids) if t == the]
        assert not list(tmp_path.glob("*/*.part"))


def plain_runs(w, least, times):
    n, out = len(w), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(least, times * q) and not any(all(w[i + k] == w[i + k + d] for k in range(size - d)) for d in range(1, q)):
                out.append((i, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_all_runs_of_short_lists():
    for n in range(10):
        for w in itertools.product((0, 1), repeat=n):
            for least, times in ((6, 4), (5, 3), (4, 2)):
                assert periodic.runs(np.array(w, np.int64), least, times) == plain_runs(w, least, times)


def test_runs_of_random_lists():
    rng = random.Random(1)
    for _ in range(1500):
        n, k = rng.randint(0, 60), rng.choice([1, 2, 2, 3, 4, 8])
        w = [rng.randrange(k) for _ in range(n)]
        if n and rng.random() < 0.6:
            a, p = rng.randrange(n), rng.randint(1, 8)
            w = [w[min(i if i < a else a + (i - a) % p, n - 1)] for i in range(n)]
        for least, times in ((6, 4), (5, 3), (4, 2)):
            assert periodic.runs(np.array(w, np.int64), least, times) == plain_runs(w, least, times)


def test_runs_of_very_long_texts():
    assert periodic.runs(np.zeros(300_000, np.int64)) == [(0, 300_000, 1)]
    assert periodic.runs(np.tile(np.arange(1000), 200)) == [(0, 200_000, 1000)]
    rng = np.random.default_rng(2)
    assert periodic.runs(np.concatenate([rng.integers(0, 9000, 50_000)] * 3)) == []


def test_runs_keep_their_text(spark):
    docs = spark.createDataFrame([(1, "keep go go go go go go on", "z"), (2, None, "y")], "doc_id long, text string, start string")
    out = {r["doc_id"]: r for r in periodic.periodic_runs(docs, keep_text=True).collect()}
    assert out[1]["collapsed"] == "keep go on" and [tuple(r) for r in out[1]["runs"]] == [(1, 6, 1)]
    assert out[2]["collapsed"] == "" and out[2]["n_runs"] == 0 and out[2]["start"] is None

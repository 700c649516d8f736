"""Quality rules: lines marked content or boilerplate by a linear-chain conditional random field."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewave.llm.common import SPACES, free_name, labelled_sample, slices, table, utf8

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
#: Words of notices, whose lines are seldom content.
NOTICES = re.compile(r"(?i)\b(?:copyright|licen[sc]ed?|rights|reserved|cookies?|subscribe|click|terms|privacy)\b|©")
N_FEATURES = 32


def line_features(line: str, words: list[str], seen: bool) -> int:
    """What the field sees of a line with words, as bits."""
    n, chars = len(words), sum(map(len, words))
    bits = 1  # always set
    bits |= 1 << (1 if n <= 2 else 2 if n <= 5 else 3 if n <= 15 else 4)
    marks = sum(line.count(c) for c in "#*$%&<>") / chars
    bits |= 1 << (5 if marks == 0 else 6 if marks < 0.03 else 7 if marks < 0.12 else 8)
    pipes = words.count("|") / n
    bits |= 1 << (9 if pipes == 0 else 10 if pipes < 0.2 else 11)
    letters = sum(map(str.isalpha, line))
    upper = sum(map(str.isupper, line)) / max(1, letters)
    bits |= 1 << (12 if upper < 0.15 else 13 if upper < 0.6 else 14)
    shouts = line.count("!!") / n
    bits |= 1 << (15 if shouts == 0 else 16 if shouts < 0.3 else 17)
    bits |= 1 << (18 if words[-1][-1] in ".!?…\"'”" else 19)
    digits = sum(map(str.isdigit, line)) / chars
    bits |= 1 << (20 if digits == 0 else 21 if digits < 0.15 else 22)
    kinds = len(set(words)) / n
    bits |= 1 << (23 if kinds > 0.8 else 24 if kinds > 0.5 else 25)
    pairs = sum(a == b for a, b in zip(words, words[1:], strict=False)) / n
    bits |= 1 << (26 if pairs < 0.05 else 27)
    mean = chars / n
    bits |= 1 << (28 if mean < 3 else 29 if mean < 11 else 30)
    if seen:
        bits |= 1 << 31
    if n <= 15 and NOTICES.search(line):
        bits |= 1 << 32
    return bits


def lines_of(text: str) -> list[tuple[int, int]]:
    """(features, characters in words) of each line that has a word, in order."""
    out, seen = [], set()
    for line in text.split("\n"):
        words = [w for w in re.split("[\x20\x09-\x0d]+", line) if w]
        if words:
            out.append((line_features(line, words, line in seen), sum(map(len, words))))
            seen.add(line)
    return out


@dataclass
class Field:
    """Scores of a chain of lines: emit[f] for a content line with feature f, move[a][b] for a line labelled a before
    one labelled b, start[a] for the first line; 1 is content, 0 boilerplate."""

    emit: np.ndarray
    move: np.ndarray
    start: np.ndarray

    @classmethod
    def empty(cls) -> Field:
        """Everything is content."""
        emit = np.zeros(N_FEATURES + 1)
        emit[0] = 1.0
        return cls(emit, np.zeros((2, 2)), np.zeros(2))

    def viterbi(self, bits: list[int]) -> list[int]:
        """The likeliest labels of a chain; of equally likely ones, content."""
        if not bits:
            return []
        (m00, m01), (m10, m11) = self.move.tolist()
        emit, back = self.score, []
        s0, s1 = float(self.start[0]), float(self.start[1]) + emit(bits[0])
        for b in bits[1:]:
            from0, from1 = s1 + m10 >= s0 + m00, s1 + m11 >= s0 + m01
            back.append((from0, from1))
            s0, s1 = (s1 + m10 if from0 else s0 + m00), (s1 + m11 if from1 else s0 + m01) + emit(b)
        label = int(s1 >= s0)
        out = [label]
        for pair in reversed(back):
            label = int(pair[label])
            out.append(label)
        return out[::-1]

    def score(self, bits: int) -> float:
        cache = self.__dict__.setdefault("_cache", {})
        if (s := cache.get(bits)) is None:
            s = cache[bits] = float(sum(self.emit[f] for f in range(N_FEATURES + 1) if bits >> f & 1))
        return s


def marginals(e: np.ndarray, start: np.ndarray, trans: np.ndarray, w: np.ndarray, at: np.ndarray, alive: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(likelihood of each label of each line, expected moves over all chains, each counting w) by the forward and
    backward recursion; chains are sorted by length, begin at `at`, and alive[t] of them are longer than t."""
    alpha, beta, scale, pairs = np.zeros_like(e), np.ones_like(e), np.ones(len(e)), np.zeros((2, 2))
    for t, going in enumerate(alive):
        i = at[:going] + t
        a = (start[None] if t == 0 else alpha[i - 1] @ trans) * e[i]
        scale[i] = a.sum(1)
        alpha[i] = a / scale[i][:, None]
    for t in range(len(alive) - 2, -1, -1):
        i = at[: alive[t + 1]] + t
        eb = e[i + 1] * beta[i + 1] / scale[i + 1][:, None]
        beta[i] = eb @ trans.T
        pairs += trans * ((alpha[i] * w[: len(i), None]).T @ eb)
    return alpha * beta, pairs


def fit(chains: list[tuple[list[int], list[int]]], weight: list[float] | None = None, *, rounds: int = 150, rate: float = 0.15, ridge: float = 2.0, begin: Field | None = None, moves: bool = True) -> Field:
    """Maximum likelihood with a ridge penalty: chains of (feature bits of the lines, their labels), and how much each
    chain counts; without moves a line's label depends on the line alone. Without lines of both labels every line is
    content."""
    weight = [1.0] * len(chains) if weight is None else weight
    kept = sorted((i for i, c in enumerate(chains) if c[0]), key=lambda i: -len(chains[i][0]))
    if len({y for i in kept for y in chains[i][1]}) < 2:
        return Field.empty()
    length = np.array([len(chains[i][0]) for i in kept])
    n, most = len(kept), int(length[0])
    at = np.concatenate([[0], np.cumsum(length)])
    bits = np.array([b for i in kept for b in chains[i][0]], np.int64)
    x = (bits[:, None] >> np.arange(N_FEATURES + 1) & 1).astype(np.float64)
    y = np.array([v for i in kept for v in chains[i][1]])
    w = np.array([weight[i] for i in kept], np.float64)
    per_line = np.repeat(w, length)
    alive = [int(np.searchsorted(-length, -t, "left")) for t in range(most)]  # chains longer than t: the first ones
    inner = np.ones(len(y), bool)  # lines with one before them
    inner[at[:-1]] = False
    seen, first_seen = np.zeros((2, 2)), np.zeros(2)
    np.add.at(seen, (y[np.flatnonzero(inner) - 1], y[inner]), per_line[inner])
    np.add.at(first_seen, y[at[:-1]], w)
    p = np.zeros(N_FEATURES + 1 + 6) if begin is None else np.concatenate([begin.emit, begin.move.ravel(), begin.start])
    first, second = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, rounds + 1):
        emit, move, start = p[: N_FEATURES + 1], p[N_FEATURES + 1 : N_FEATURES + 5].reshape(2, 2), p[N_FEATURES + 5 :]
        e = np.stack([np.zeros(len(x)), x @ emit], 1)
        top = e.max(1, keepdims=True)
        e, trans = np.exp(e - top), np.exp(move)
        if moves:
            gamma, pairs = marginals(e, np.exp(start), trans, w, at, alive)
        else:
            gamma = e / e.sum(1, keepdims=True)
        grad = np.zeros_like(p)
        grad[: N_FEATURES + 1] = x.T @ ((y - gamma[:, 1]) * per_line)
        if moves:
            grad[N_FEATURES + 1 : N_FEATURES + 5] = (seen - pairs).ravel()
            grad[N_FEATURES + 5 :] = first_seen - w @ gamma[at[:n]]
        grad = (grad - ridge * p) / n
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        p = p + rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Field(p[: N_FEATURES + 1].copy(), p[N_FEATURES + 1 : N_FEATURES + 5].reshape(2, 2).copy(), p[N_FEATURES + 5 :].copy())


#: The feature bit that marks a line of a good document as boilerplate before anything is learned: a notice.
SEEDS = 1 << 32


def content_share(labels: list[int], chars: list[int]) -> float:
    """The share of characters in words that lie in content lines; 1 without lines."""
    total = sum(chars)
    return sum(c for c, y in zip(chars, labels, strict=True) if y) / total if total else 1.0


def fit_documents(documents: list[tuple[list[int], list[int], int]], *, least_content: float = 0.5, passes: int = 3) -> Field:
    """Learns line labels from documents of (feature bits of the lines, characters in words of each, quality 0 or 1).

    Which lines are boilerplate isn't known, only how good the document is. At first a good document's lines are
    content but for those that SEEDS mark, a bad one's are all boilerplate. Then, in passes, a field is fitted, first
    without moves, so that a line is seen as such and not as one of its document, and every document is decoded by it. The
    decoded labels are learned from next, where they agree with what is known: at least least_content of a good
    document and less of a bad one is content. Others keep their first labels. So bad documents keep their plain lines, good
    ones lose their junk, and moves between the two kinds are learned.
    """
    seeds = [([0 if b & SEEDS else 1 for b in bits] if quality else [0] * len(bits)) for bits, _, quality in documents]
    for i, (_, chars, quality) in enumerate(documents):
        if quality and content_share(seeds[i], chars) < least_content:
            seeds[i] = [1] * len(chars)
    good = sum(q for *_, q in documents)
    weight = [1.0 if q else good / max(1, len(documents) - good) for *_, q in documents]  # both qualities count alike
    model, labels = Field.empty(), seeds
    for k in range(passes):
        model = fit([(bits, y) for (bits, *_), y in zip(documents, labels, strict=True)], weight, rounds=60 if k else 100, begin=model if k else None, moves=k > 0)
        decoded = [model.viterbi(bits) for bits, *_ in documents]
        labels = [y if (content_share(y, chars) >= least_content) == bool(quality) else s for y, s, (_, chars, quality) in zip(decoded, seeds, documents, strict=True)]
    return model


def train(docs: DataFrame, labels: DataFrame, most: int = 3000, *, least_content: float = 0.5) -> Field:
    """Fits the field on a bounded sample: at most `most` labelled documents of each quality. Without labelled documents
    of both kinds every line is content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [lines_of(t or "") for t in batch.column("text").to_pylist()]
            arrays = [pa.array([[x[k] for x in lines] for lines in found], pa.list_(pa.int64())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*arrays, batch.column("label")], names=["bits", "chars", "label"])

    rows = labelled_sample(docs, labels, "quality", {0: most, 1: most}).mapInArrow(run, "bits array<long>, chars array<long>, label int").collect()
    documents = sorted((list(r["bits"]), list(r["chars"]), r["label"]) for r in rows)
    return fit_documents(documents, least_content=least_content) if len({q for *_, q in documents}) > 1 else Field.empty()


def repeated_words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text of utf8(): words, and words in 8-word windows that the text has twice or more."""
    n = len(at) - 1
    if not len(data):
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    text = data.tobytes()
    counts, ids, index = np.zeros(n, np.int64), [], {}
    for i in range(n):
        words = text[at[i] : at[i + 1]].split()  # by SPACES
        counts[i] = len(words)
        ids += [index.setdefault(w, len(index)) for w in words]
    word = np.array(ids, np.uint64) + np.uint64(1)
    doc = np.repeat(np.arange(n), counts)
    repeats = np.zeros(n, np.int64)
    m = len(word) - WINDOW + 1
    if m > 0:
        key = np.zeros(m, np.uint64)
        for k in range(WINDOW):
            key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + word[k : k + m]
        key ^= doc[:m].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        inside = np.flatnonzero(doc[:m] == doc[WINDOW - 1 :])
        order = inside[np.argsort(key[inside], kind="stable")]
        same = np.zeros(len(order), bool)
        same[1:] = key[order[1:]] == key[order[:-1]]
        same[:-1] |= same[1:]
        cover = np.zeros(len(word) + 1, np.int64)
        np.add.at(cover, order[same], 1)
        np.add.at(cover, order[same] + WINDOW, -1)
        repeats = np.bincount(doc[np.cumsum(cover[:-1]) > 0], minlength=n)
    return counts, repeats


def judge(docs: DataFrame, model: Field, *, least_content: float = 0.5, carry: list[str] = ["doc_id"], marks: bool = False) -> DataFrame:  # noqa: B006
    """Counts and a verdict for every row of docs (doc_id, text).

    Returns the columns in carry, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and
    content_share (the share of characters in words that lie in content lines; 1 without lines), and with marks
    content_lines (0 or 1 for each line with a word). kept is false where base_failed, else true if content_share is
    at least least_content. A null text is empty: no words, base_failed. Rows that repeat give rows that
    repeat; an empty table gives no rows; columns not carried are ignored. One pass over the rows, no shuffle.
    """
    fields = [f for f in docs.schema.fields if f.name in carry]
    source = free_name(carry, "text")
    names = [f.name for f in fields]
    made = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "base_failed": "boolean", "kept": "boolean", "content_share": "double"}
    types = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), *(f"{k} {v}" for k, v in made.items()), *["content_lines array<int>"] * marks])
    emit, move, start = model.emit.tolist(), model.move.tolist(), model.start.tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = Field(np.array(emit), np.array(move), np.array(start))
        for whole in batches:
            for batch in slices(whole, source):
                counts, repeats = repeated_words(*utf8(batch.column(source)))
                out: dict[str, list] = {k: [] for k in made}
                labels_out = []
                for i, text in enumerate(batch.column(source).to_pylist()):
                    text = text or ""
                    raw = text.encode()
                    lines = [x for x in text.split("\n") if x.encode().strip(SPACES)]
                    of_lines = lines_of(text)
                    labels = chain.viterbi([b for b, _ in of_lines])
                    chars = [c for _, c in of_lines]
                    total, share = sum(chars), content_share(labels, chars)
                    n, r = int(counts[i]), int(repeats[i])
                    failed = n < 20 or 100 * r > 30 * n
                    values = (n, total, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), r, failed, not failed and share >= least_content, share)
                    for k, v in zip(made, values, strict=True):
                        out[k].append(v)
                    labels_out.append(labels)
                arrays = [pa.array(out[k], types[v]) for k, v in made.items()] + [pa.array(labels_out, pa.list_(pa.int32()))] * marks
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *arrays], names=[*names, *made, *["content_lines"] * marks])

    return docs.select(*[f"`{n}`" for n in names], docs["text"].alias(source)).mapInArrow(run, schema)


def op3_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return judge(docs, model).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share")

"""A hidden Markov language model: Baum-Welch counts summed over partitions, exact likelihoods by scaled recursion.

A token is a word or the end of its text. The most frequent words and the end are symbols of their own; each other
word, known or not, belongs to one of a fixed number of word classes by its crc32, and a class is one symbol. The
likelihood of a text is that of its symbols under the hidden Markov model, times that of each word within its class,
which comes from corpus counts. So the model has a bounded size, and the counts of rare words, which grow with the
corpus, stay in a table that texts are joined with.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewave.llm.common import LOWER, fold, free_name, slices, table, written

END = 0  # the symbol of a text's end
ALPHA = 0.1  # what is added to each count


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(LOWER).split()


@dataclass
class Shape:
    """states; own: words that are symbols of their own, at most; classes: of all other words; head: words whose
    counts every task holds, at most."""

    states: int = 8
    own: int = 3000
    classes: int = 1000
    head: int = 200_000

    @property
    def symbols(self) -> int:
        return 1 + self.own + self.classes


@dataclass
class Vocabulary:
    shape: Shape
    tokens: int  # N: training tokens
    kinds: int  # V: distinct training tokens
    ends: int  # count of the end
    own_counts: np.ndarray  # of words that are symbols of their own
    class_tokens: np.ndarray  # by class: training tokens and distinct words
    class_kinds: np.ndarray
    counts: DataFrame  # word, c: all training words
    head: object  # broadcast: place of a word, and by place its symbol and the log10 of its count plus ALPHA

    @property
    def below(self) -> float:
        return self.tokens + ALPHA * (self.kinds + 1)


@dataclass
class Model:
    start: np.ndarray  # by state
    move: np.ndarray  # by state and next state
    emit: np.ndarray  # by state and symbol


def count_words(rows: DataFrame) -> DataFrame:
    """word, c over all texts of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([k.decode() for k in found], pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])
            found.clear()
            return batch

        for batch in batches:
            for text in batch.column("text"):
                found.update(words_of(text.as_py()))
                if len(found) > 300_000:
                    yield out()
        if found:
            yield out()

    return rows.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("c"))


class Sequences:
    """The symbol sequences of some texts, in the order in which the recursion reads them: first symbols of all texts,
    the longest text first, then second symbols, and so on."""

    def __init__(self, sequences: list[np.ndarray]):
        length = np.array([len(s) for s in sequences], np.int64)
        self.order = np.argsort(-length, kind="stable")  # texts by rank
        length = length[self.order]
        self.most = int(length[0]) if len(length) else 0
        self.alive = np.searchsorted(-length, -np.arange(self.most), "left")  # texts longer than t
        self.base = np.concatenate([[0], np.cumsum(self.alive)])
        flat = np.concatenate([sequences[i] for i in self.order]) if len(sequences) else np.zeros(0, np.int64)
        t = np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)
        self.rank = np.repeat(np.arange(len(length)), length)
        self.place = self.base[t] + self.rank if len(flat) else flat
        self.symbols = np.empty(len(flat), np.int64)
        self.symbols[self.place] = flat

    def forward(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(emission of each place, scaled forward likelihoods, scales); the product of a text's scales is its likelihood."""
        e = emit.T[self.symbols]
        alpha, scale, base = e.copy(), np.empty(len(e), e.dtype), self.base
        for t in range(self.most):
            a = alpha[base[t] : base[t + 1]]
            a *= start if t == 0 else alpha[base[t - 1] : base[t - 1] + len(a)] @ move
            s = a.sum(1)
            a /= s[:, None]
            scale[base[t] : base[t + 1]] = s
        return e, alpha, scale

    def log10(self, scale: np.ndarray) -> np.ndarray:
        """By text, as first given."""
        out = np.zeros(len(self.order))
        out[self.order] = np.bincount(self.rank, np.log10(scale)[self.place], minlength=len(self.order)) if len(scale) else 0.0
        return out

    def expected(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Baum-Welch counts: of first states, of moves, of symbols by state."""
        k, base = len(start), self.base
        e, alpha, scale = self.forward(start, move, emit)
        moves = np.zeros((k, k))
        gamma, beta = alpha.copy(), np.ones((0, k), e.dtype)
        for t in range(self.most - 1, -1, -1):
            n = base[t + 1] - base[t]
            if t + 1 < self.most:
                after = slice(base[t + 1], base[t + 2])
                eb = e[after] * beta / scale[after, None]
                a = alpha[base[t] : base[t] + len(eb)]
                moves += a.T @ eb
                beta = np.concatenate([eb @ move.T, np.ones((n - len(eb), k), e.dtype)])
            else:
                beta = np.ones((n, k), e.dtype)
            gamma[base[t] : base[t + 1]] *= beta
        symbols = np.stack([np.bincount(self.symbols, gamma[:, s], minlength=emit.shape[1]) for s in range(k)])
        return gamma[: base[1]].sum(0) if self.most else np.zeros(k), moves * move, symbols


#: A longer sequence is read in blocks of so many symbols.
BLOCK = 400_000


def long_log10(symbols: np.ndarray, start: np.ndarray, move: np.ndarray, emit: np.ndarray, block: int = BLOCK) -> float:
    """log10 likelihood of one sequence; memory holds a block."""
    state, total = start, 0.0
    for b in range(0, len(symbols), block):
        _, alpha, scale = Sequences([symbols[b : b + block]]).forward(state, move, emit)
        total += float(np.log10(scale).sum())
        state = alpha[-1] @ move
    return total


def long_expected(symbols: np.ndarray, start: np.ndarray, move: np.ndarray, emit: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Baum-Welch counts of one sequence, as Sequences.expected(): a first pass keeps what each block begins with, a second
    one takes the blocks from the last to the first."""
    k, begins, state = len(start), range(0, len(symbols), block), start
    states = []
    for b in begins:
        states.append(state)
        state = Sequences([symbols[b : b + block]]).forward(state, move, emit)[1][-1] @ move
    first, moves, counts, eb = np.zeros(k), np.zeros((k, k)), np.zeros((k, emit.shape[1])), None
    for b, state in zip(reversed(begins), reversed(states), strict=True):
        part = symbols[b : b + block]
        e, alpha, scale = Sequences([part]).forward(state, move, emit)
        gamma = alpha.copy()
        for t in range(len(part) - 1, -1, -1):
            if eb is not None:
                moves += np.outer(alpha[t], eb)
                gamma[t] *= move @ eb
                eb = e[t] * (move @ eb) / scale[t]
            else:
                eb = e[t] / scale[t]
        counts += np.stack([np.bincount(part, gamma[:, s], minlength=emit.shape[1]) for s in range(k)])
        first = gamma[0]
    return first, moves * move, counts


def symbol_of(shape: Shape, word: bytes) -> int:
    """The symbol of a word that isn't one of its own."""
    return 1 + shape.own + zlib.crc32(word) % shape.classes


def learn_words(docs: DataFrame, shape: Shape = Shape()) -> Vocabulary:  # noqa: B008
    """Counts the words of all rows of docs."""
    spark = docs.sparkSession
    counts = written(count_words(docs), "lm-counts")
    ends = docs.count()
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    # the most frequent words, down to a count above which there are shape.head at most
    size = F.floor(16 * F.log2("c")).cast("int")
    least, room = 1 << 20, shape.head
    for r in sorted(counts.groupBy(size.alias("b")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["b"]):
        if (room := room - r["n"]) < 0:
            break
        least = r["b"]
    top = sorted(counts.where(size >= least).collect(), key=lambda r: (-r["c"], r["word"]))
    words = [r["word"].encode() for r in top]
    c = np.array([r["c"] for r in top], np.float64)
    symbols = np.array([i + 1 if i < shape.own else symbol_of(shape, w) for i, w in enumerate(words)], np.uint16)
    head = spark.sparkContext.broadcast(({w: i for i, w in enumerate(words)}, symbols, np.log10(c + ALPHA)))
    class_tokens, class_kinds = np.zeros(shape.classes), np.zeros(shape.classes)
    own = spark.createDataFrame([(r["word"],) for r in top[: shape.own]], "word string")
    others = counts.join(F.broadcast(own), "word", "left_anti").groupBy((F.crc32(F.col("word").cast("binary")) % shape.classes).cast("int").alias("k"))
    for r in others.agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():
        class_tokens[r["k"]], class_kinds[r["k"]] = r["c"], r["v"]
    return Vocabulary(shape, total["n"] + ends, total["v"] + (1 if ends else 0), ends, c[: shape.own], class_tokens, class_kinds, counts, head)


def prepare(docs: DataFrame, words: Vocabulary, carry: list[str]) -> DataFrame:
    """The columns in carry and, for each row of docs, its symbols (two bytes each), n_tokens, head_known (tokens with a
    count that tasks hold), head_log (sum of their log10 counts plus ALPHA), class_log (what of it is of words
    in classes, less the log10 size of the class of each such token) and tail (the other words)."""
    shape, shared, ends = words.shape, words.head, words.ends
    class_below = words.class_tokens + ALPHA * (words.class_kinds + 1)
    fields = [f for f in docs.schema.fields if f.name in carry]
    source = free_name(carry, "text")
    names = [f.name for f in fields]
    made = "symbols binary, n_tokens long, head_known long, head_log double, class_log double, tail array<struct<word:string,n:int>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, symbol, log = shared.value
        symbol, log = np.append(symbol, np.uint16(0)), np.append(log, 0.0)  # the last place: not held
        missing, get, class_log = len(places), places.get, np.log10(class_below)
        tail_type = pa.list_(pa.struct([("word", pa.string()), ("n", pa.int32())]))
        for whole in batches:
            for batch in slices(whole, source, 3 << 20):
                texts = [words_of(t.as_py()) for t in batch.column(source)]
                n = len(texts)
                flat = [w for t in texts for w in t]
                count = np.array([len(t) for t in texts])
                at = np.fromiter((get(w, missing) for w in flat), np.int64, len(flat))
                doc = np.repeat(np.arange(n), count)
                sym, known = symbol[at], at < missing
                rest = np.flatnonzero(~known)
                sym[rest] = [symbol_of(shape, flat[i]) for i in rest]
                classed = sym > shape.own
                head_log = np.bincount(doc, log[at], minlength=n) + math.log10(ends + ALPHA)
                in_class = np.bincount(doc[classed], log[at[classed]] - class_log[sym[classed].astype(np.int64) - 1 - shape.own], minlength=n)
                tails: list[Counter] = [Counter() for _ in range(n)]
                for i, d in zip(rest.tolist(), doc[rest].tolist(), strict=True):
                    tails[d][flat[i]] += 1
                edge = np.concatenate([[0], np.cumsum(count)])
                end = np.zeros(1, np.uint16).tobytes()
                arrays = [
                    pa.array([sym[edge[i] : edge[i + 1]].tobytes() + end for i in range(n)], pa.binary()),
                    pa.array(count + 1, pa.int64()),
                    pa.array(np.bincount(doc[known], minlength=n) + (ends > 0), pa.int64()),
                    pa.array(head_log, pa.float64()),
                    pa.array(in_class.astype(np.float64)),
                    pa.array([[{"word": w.decode(), "n": c} for w, c in t.items()] for t in tails], tail_type),
                ]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *arrays], names=[*names, "symbols", "n_tokens", "head_known", "head_log", "class_log", "tail"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), made])
    return docs.select(*[f"`{c}`" for c in names], docs["text"].alias(source)).mapInArrow(run, schema)


def alike(items: Iterator[tuple[object, np.ndarray]], most: int = 400_000) -> Iterator[list[tuple[object, np.ndarray]]]:
    """Groups (key, sequence) pairs so that the lengths in a group are alike, for a step of the recursion costs as much
    for one text as for many; a group has about `most` symbols, or is one longer sequence."""
    held: dict[int, list] = {}
    size: Counter = Counter()
    for item in items:
        if len(item[1]) > BLOCK:
            yield [item]
            continue
        k = len(item[1]).bit_length() if len(item[1]) > 255 else 8
        held.setdefault(k, []).append(item)
        size[k] += len(item[1])
        if size[k] > most:
            yield held.pop(k)
            size[k] = 0
    yield from held.values()


def train(rows: DataFrame, words: Vocabulary, rounds: int = 4, stay: float = 0.9, seed: int = 7) -> Model:
    """Baum-Welch over all of rows, as of prepare(). In each round every partition sends its counts of first states,
    moves and symbols by state, a table of a size that doesn't depend on the data; Spark sums them."""
    shape = words.shape
    k, m = shape.states, shape.symbols
    unigram = np.full(m, ALPHA)
    unigram[END] += words.ends
    unigram[1 : 1 + len(words.own_counts)] += words.own_counts
    unigram[1 + shape.own :] += words.class_tokens
    unigram /= unigram.sum()
    rng = np.random.default_rng(seed)
    emit = unigram * rng.gamma(2.0, size=(k, m))
    emit /= emit.sum(1, keepdims=True)
    move = np.full((k, k), (1 - stay) / k) + stay * np.eye(k)  # long stays let a few rounds tell the states apart
    start = np.full(k, 1 / k)
    for _ in range(rounds):
        params = tuple(x.astype(np.float32) for x in (start, move, emit))

        def expect(batches: Iterator[pa.RecordBatch], params=params) -> Iterator[pa.RecordBatch]:
            first, moves, symbols = np.zeros(k), np.zeros((k, k)), np.zeros((k, m))
            texts = ((None, np.frombuffer(s.as_py(), np.uint16)) for b in batches for s in b.column("symbols"))
            for group in alike(texts):
                found = long_expected(group[0][1], *params) if len(group[0][1]) > BLOCK else Sequences([s for _, s in group]).expected(*params)
                first, moves, symbols = first + found[0], moves + found[1], symbols + found[2]
            stacked = np.concatenate([first[:, None], moves.T, symbols], 1)  # by state: start, moves into it, symbols
            used = np.flatnonzero(stacked.any(0))
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *(pa.array(stacked[s, used]) for s in range(k))], names=["at", *(f"s{s}" for s in range(k))])

        summed = rows.select("symbols").mapInArrow(expect, "at int, " + ", ".join(f"s{s} double" for s in range(k)))
        summed = summed.groupBy("at").agg(*[F.sum(f"s{s}").alias(f"s{s}") for s in range(k)])
        got = np.zeros((k, 1 + k + m))
        for r in summed.collect():  # one row a symbol
            got[:, r["at"]] = [r[f"s{s}"] for s in range(k)]
        start = (got[:, 0] + ALPHA) / (got[:, 0] + ALPHA).sum()
        move = got[:, 1 : 1 + k].T + ALPHA
        move /= move.sum(1, keepdims=True)
        emit = got[:, 1 + k :] + m * ALPHA * unigram  # each symbol stays possible in each state
        emit /= emit.sum(1, keepdims=True)
    return Model(start, move, emit)


def score_documents(docs: DataFrame, training: Column, *, carry: list[str] = ["doc_id"], shape: Shape = Shape(), rounds: int = 4) -> DataFrame:  # noqa: B006, B008
    """Learns from the rows of docs where `training` holds and scores the whole text of every row.

    Returns the columns in carry, n_tokens, n_known (tokens that training had), train_tokens, base_score (log10
    probability by single tokens) and score (that by the model). A null text is an empty one, which has one
    token, the end. Rows that repeat count and are scored each for itself; without training rows every token is as
    likely as the next; an empty table gives no rows; columns not carried are ignored. Words whose counts
    tasks don't hold are counted by text and joined with the corpus counts. A very long text is read in blocks, so that a
    task holds its symbols and one block's numbers.
    """
    row, chosen = free_name(carry, "_row"), free_name([*carry, *docs.columns], "_training")
    words = learn_words(docs.where(training).select("text"), shape)
    rows = prepare(docs.withColumn(chosen, training), words, [*carry, chosen])
    rows = written(rows.withColumn(row, F.monotonically_increasing_id()), "lm-texts")
    model = train(rows.where(F.col(chosen)), words, rounds)
    params = model.start, model.move, model.emit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = ((r.as_py(), np.frombuffer(s.as_py(), np.uint16)) for b in batches for r, s in zip(b.column(row), b.column("symbols"), strict=True))
        for group in alike(texts):
            if len(group[0][1]) > BLOCK:
                logs = np.array([long_log10(s, *params) for _, s in group])
            else:
                found = Sequences([s for _, s in group])
                logs = found.log10(found.forward(*params)[2])
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in group], pa.int64()), pa.array(logs)], names=[row, "chain"])

    chain = rows.select(row, "symbols").mapInArrow(run, f"`{row}` long, chain double")
    # a rare word's factor is the same in both scores: its count plus ALPHA, over what is already taken off
    tail = rows.select(row, F.explode("tail").alias("t")).select(row, "t.word", "t.n").join(words.counts, "word", "left")
    c = F.coalesce("c", F.lit(0))
    tail = tail.groupBy(row).agg(F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("tail_known"), F.sum(F.col("n") * F.log10(c + F.lit(ALPHA))).alias("tail_log"))
    more = lambda x: F.coalesce(x, F.lit(0))
    return rows.drop("symbols", "tail").join(chain, row).join(tail, row, "left").select(
        *[f"`{n}`" for n in carry],
        "n_tokens",
        (F.col("head_known") + more("tail_known")).cast("long").alias("n_known"),
        F.lit(words.tokens).cast("long").alias("train_tokens"),
        (F.col("head_log") + more("tail_log") - F.col("n_tokens") * F.lit(math.log10(words.below))).alias("base_score"),
        (F.col("chain") + F.col("class_log") + more("tail_log")).alias("score"),
    )


def op8_lm(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold("doc_id", 10) == 0
    out = score_documents(docs.select("doc_id", "text", held_out.alias("held_out")), ~F.col("held_out"), carry=["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")

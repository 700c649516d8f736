"""Toxicity: a sparse linear classifier whose scores may not depend on which group a sentence names.

Labelled documents give the loss. Labelled sentences that name a group are also written with every other term of the
same kind in its place; the squared change of the score between the two is added to the loss, so that a neutral
mention of a group can't raise a score, whatever the labelled rows happen to say about that group.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewave.llm.common import fold, free_name, labelled_sample, table, written

#: Terms for groups of people, by kind; each can stand in another's place within its kind.
IDENTITY_TERMS = {
    "belief": "christian christians muslim muslims jewish jews hindu hindus buddhist buddhists atheist atheists catholic catholics protestant protestants",
    "origin": "african africans american americans arab arabs asian asians european europeans mexican mexicans chinese indian indians immigrant immigrants refugee refugees foreigner foreigners",
    "colour": "black white brown",
    "gender": "woman women man men girl girls boy boys female male transgender",
    "orientation": "gay lesbian bisexual straight heterosexual homosexual queer",
    "age": "old young elderly teenage",
    "ability": "disabled blind deaf autistic",
    "fr": "chrétiens musulmans juifs athées femmes hommes noirs blancs arabes africains immigrés réfugiés étrangers",
    "de": "christen muslime juden atheisten frauen männer schwarze weiße araber afrikaner einwanderer flüchtlinge ausländer",
    "es": "cristianos musulmanes judíos ateos mujeres hombres negros blancos árabes africanos inmigrantes refugiados extranjeros",
}
WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[^.!?\n]+")
#: A word is seen whole and by its beginnings of these lengths, since one stem takes many endings.
STEMS = (3, 4, 5, 6)


def kinds(terms: dict[str, str] = IDENTITY_TERMS) -> dict[str, list[str]]:
    """The terms that can replace each term."""
    return {t: [o for o in group.split() if o != t] for group in terms.values() for t in group.split()}


def features(words: set[str]) -> set[str]:
    out = set(words)
    for k in STEMS:
        out |= {w[:k] + "*" for w in words if len(w) > k}
    return out


def swaps(text: str, replace: dict[str, list[str]]) -> list[tuple[set[str], set[str]]]:
    """For each sentence of a text that has an identity term and each other term of its kind, the words that the
    sentence has, and those that it has after the swap."""
    out = []
    for sentence in SENTENCE.findall(text.lower()):
        words = set(WORD.findall(sentence))
        for term in sorted(words & replace.keys()):
            out += [(words, words - {term} | {other}) for other in replace[term]]
    return out


@dataclass
class Classifier:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0

    def __post_init__(self) -> None:
        self.whole = {f: w for f, w in self.weights.items() if not f.endswith("*")}
        self.stems = [(k, {f[:-1]: w for f, w in self.weights.items() if f.endswith("*") and len(f) == k + 1}) for k in STEMS]

    def score(self, text: str | None) -> float:
        """Likelihood of label 1, from which words a text has, however long it is."""
        words = set(WORD.findall((text or "").lower()))
        z = self.bias + sum(map(self.whole.__getitem__, words & self.whole.keys()))
        for k, table_ in self.stems:
            if table_:
                z += sum(map(table_.__getitem__, {w[:k] for w in words if len(w) > k} & table_.keys()))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def fit(x: np.ndarray, y: np.ndarray, pairs: np.ndarray, *, lasso: float = 0.0005, counterfactual: float = 1.0, rounds: int = 500) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the mean log loss, both labels counting alike, plus lasso times the absolute
    weights plus `counterfactual` times the mean squared score change over the rows of pairs (what a swap adds less
    what it takes), by accelerated proximal gradient steps."""
    m = x.shape[1]
    x, pairs = x.astype(np.float32, copy=False), pairs.astype(np.float32, copy=False)
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    w, b = np.zeros(m, np.float32), 0.0
    v, c, t = w.copy(), b, 1.0
    largest = 0.25 * (share * (x.sum(1) + 1)).sum() + (2 * counterfactual * (pairs**2).sum(1).mean() if len(pairs) else 0)
    rate = 4 / max(largest, 1e-9)
    last = np.inf
    for _ in range(rounds):
        z = x @ v + c
        g = share * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        grad = x.T @ g.astype(np.float32)
        if len(pairs):
            grad = grad + 2 * counterfactual * (pairs.T @ (pairs @ v)) / len(pairs)
        new = (v - rate * grad).astype(np.float32)
        new = np.sign(new) * np.maximum(np.abs(new) - np.float32(rate * lasso), 0)
        new_b = c - rate * g.sum()
        z = x @ new + new_b
        loss = (share * (np.logaddexp(0, z) - y * z)).sum() + lasso * np.abs(new).sum() + (counterfactual * ((pairs @ new) ** 2).mean() if len(pairs) else 0)
        if loss > last:  # the step was too long: back to the last weights
            rate, t, v, c = rate / 2, 1.0, w.copy(), b
            if rate < 1e-9:
                break
            continue
        after = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, c = new + np.float32((t - 1) / after) * (new - w), new_b + (t - 1) / after * (new_b - b)
        w, b, t, last = new, new_b, after, loss
    return w, b


def train(docs: DataFrame, labels: DataFrame, *, most: int = 3000, n_features: int = 1000, least_docs: int = 4, fold_out: int = 5, counterfactual: float = 10.0, terms: dict[str, str] = IDENTITY_TERMS) -> Classifier:
    """Fits the classifier on a bounded sample: at most `most` labelled documents of each label, none of which is in
    fold 0 of fold_out. Of the features that least_docs of them or more have, the n_features whose counts differ
    most between the labels (chi square), and all identity terms, are weighed. Without both labels in the sample the
    classifier is even-handed: it scores everything 0.
    """
    rows = labelled_sample(docs, labels, "toxic", {1: most, 0: most}, fold("doc_id", fold_out) != 0)
    rows = written(rows.dropDuplicates(["text", "label"]).select("text", "label"), "toxicity-sample")
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return Classifier(bias=-40.0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: tuple[Counter, Counter] = (Counter(), Counter())
            for text, y in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                found[y].update(features(set(WORD.findall(text.lower()))))
            keys = list(found[0].keys() | found[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([found[0][k] for k in keys], pa.int64()), pa.array([found[1][k] for k in keys], pa.int64())], names=["feature", "n0", "n1"])

    counts = rows.mapInArrow(count, "feature string, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    share = (F.col("n0") + F.col("n1")) / F.lit(n0 + n1)
    chi = F.pow(F.col("n1") - n1 * share, 2) / (n1 * share) + F.pow(F.col("n0") - n0 * share, 2) / (n0 * share)
    replace = kinds(terms)
    best = counts.where(F.col("n0") + F.col("n1") >= least_docs).orderBy(chi.desc(), "feature").limit(n_features)
    names = sorted({r["feature"] for r in best.select("feature").collect()} | features(set(replace)))
    place = {f: i for i, f in enumerate(names)}

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"label": [], "has": [], "gains": [], "loses": []}
            for text, y in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                here = features(set(WORD.findall(text.lower())))
                both = {(tuple(sorted(features(b) - features(a))), tuple(sorted(features(a) - features(b)))) for a, b in swaps(text, replace)}
                for label, has, gains, loses in [(y, here, (), ())] + [(None, (), g, s) for g, s in sorted(both)]:
                    for k, v in (("has", has), ("gains", gains), ("loses", loses)):
                        out[k].append(sorted(place[f] for f in v if f in place))
                    out["label"].append(label)
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(out["label"], pa.int32()), *(pa.array(out[k], kind) for k in ("has", "gains", "loses"))], names=list(out))

    made = rows.mapInArrow(indexed, "label int, has array<int>, gains array<int>, loses array<int>").dropDuplicates().collect()
    said = sorted((r["label"], r["has"]) for r in made if r["label"] is not None)
    x = np.zeros((len(said), len(names)), np.float32)
    for i, (_, has) in enumerate(said):
        x[i, has] = 1
    swapped = sorted((r["gains"], r["loses"]) for r in made if r["label"] is None)
    pairs = np.zeros((len(swapped), len(names)), np.float32)
    for i, (gains, loses) in enumerate(swapped):
        pairs[i, gains], pairs[i, loses] = 1, -1
    w, b = fit(x, np.array([y for y, _ in said], float), pairs, counterfactual=counterfactual)
    return Classifier({f: float(w[i]) for f, i in place.items() if w[i]}, float(b))


def score(docs: DataFrame, model: Classifier, *, carry: list[str] = ["doc_id"], threshold: float = 0.5) -> DataFrame:  # noqa: B006
    """Scores the whole text of every row of docs; a score sees nothing but the text.

    Returns the columns in carry, score (0 to 1, higher: label 1 is likelier) and predicted (1 if score >= threshold). A null or
    empty text has the score of no words. Rows that repeat give rows that repeat; an empty table gives no
    rows; columns not carried are ignored. One pass over the rows, no shuffle.
    """
    fields = [f for f in docs.schema.fields if f.name in carry]
    names = [f.name for f in fields]
    source = "text" if "text" in names else free_name(carry, "text")  # a text that is carried is sent to the task once
    weights, bias = model.weights, model.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = Classifier(weights, bias)
        for batch in batches:
            scores = [here.score(t.as_py()) for t in batch.column(source)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], names=[*names, "score", "predicted"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "score double, predicted int"])
    read = docs.select(*[f"`{n}`" for n in names], *([] if source in names else [docs["text"].alias(source)]))
    return read.mapInArrow(run, schema)


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")

"""The corpus operators' parts against plain definitions."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewave.llm import columnwise, decontaminate, hmm, minhash, quality, secrets, substrings, toxicity, warc
from tidewave.llm.anchors import runs
from tidewave.llm.common import LOWER, join_unique, utf8
from tidewave.llm.components import connected
from tidewave.llm.shingles import shingles


def test_shingle_sets_have_the_right_sizes_and_intersections():
    texts = ["a b c d e f", "A b c d E f g", "x", "", None, "a\tb\nc d  e f", "é ß " * 30, "b c d e f"]
    _, sets = shingles(*utf8(pa.array(texts, pa.string())))
    plain = []
    for t in texts:
        w = (t or "").encode().translate(LOWER).split()
        plain.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    for (a, p), (b, q) in itertools.product(zip(sets, plain, strict=True), repeat=2):
        assert len(np.intersect1d(a, b)) == len(p & q)


def test_runs_share_an_anchor_only_if_strings_can_be_equal():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 60))) for _ in range(30)]
    data, at = utf8(pa.array(texts))
    text, first, last, place, anchor, content = runs(data, at, 12, 6)
    of, whole = {}, {}
    for t, a, b, x, h, c in zip(text, first, last, place, anchor, content, strict=True):
        assert b <= x <= a + 6 and whole.setdefault(bytes(data[a : b + 12]), c) == c
        for p in range(a, b + 1):
            assert p - at[t] + 12 <= len(texts[t])
            assert of.setdefault(bytes(data[p : p + 12]), h) == h
    assert sum(b - a + 1 for a, b in zip(first, last, strict=True)) == sum(max(0, len(t) - 11) for t in texts)


@pytest.mark.parametrize("files", [False, True])
def test_columnwise_construction_is_the_sorted_list_of_suffixes(tmp_path, files):
    rng = random.Random(2)
    for trial in range(40):
        s = [bytes(rng.choice(b"ab\xff") for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 6))]
        s.append(s[0])
        suffixes = sorted((list(x[k:]) + [i - 1000], i, k) for i, x in enumerate(s) for k in range(len(x) + 1))
        common = [0] + [next((n for n, (p, q) in enumerate(zip(a[0], b[0], strict=False)) if p != q), min(len(a[0]), len(b[0]))) for a, b in itertools.pairwise(suffixes)]
        symbols, lcp, repeated = columnwise.build(s, columnwise.Columns(str(tmp_path)) if files else None, 3)
        assert symbols.tolist() == [s[i][k - 1] + 1 if k else 0 for _, i, k in suffixes]
        assert lcp.tolist() == common
        parts = [x[k : k + 3] for x in s for k in range(len(x) - 2)]
        assert [r.tolist() for r in repeated] == [[parts.count(x[k : k + 3]) > 1 for k in range(len(x) - 2)] for x in s], trial


@pytest.mark.parametrize("files", [False, True])
@pytest.mark.parametrize("rounds", [1, 2, 5, 100])
def test_columnwise_construction_is_the_same_however_many_rounds_are_merged(tmp_path, files, rounds):
    rng = random.Random(3)
    for letters in (b"a", b"ab", b"ab\xff", bytes(range(256))) * 5:
        s = [bytes(rng.choices(letters, k=rng.randint(0, 30))) for _ in range(rng.randint(1, 8))]
        s += [s[0], s[0][3:], s[-1] + s[0]]
        suffixes = sorted((list(x[k:]) + [i - 1000], i, k) for i, x in enumerate(s) for k in range(len(x) + 1))
        common = [0] + [next(n for n, (p, q) in enumerate(zip(a[0], b[0], strict=False)) if p != q) for a, b in itertools.pairwise(suffixes)]
        symbols, lcp, repeated = columnwise.build(s, columnwise.Columns(str(tmp_path)) if files else None, 4, rounds)
        assert symbols.tolist() == [s[i][k - 1] + 1 if k else 0 for _, i, k in suffixes]
        assert lcp.tolist() == common
        parts = [x[k : k + 4] for x in s for k in range(len(x) - 3)]
        assert [r.tolist() for r in repeated] == [[parts.count(x[k : k + 4]) > 1 for k in range(len(x) - 3)] for x in s]


def test_columnwise_construction_does_not_write_its_columns_in_each_round():
    written = []

    class Counted(columnwise.Columns):
        def write(self, name, values):
            written.append(len(values))
            super().write(name, values)

    rng = random.Random(4)
    s = [bytes(rng.choices(b"abcd", k=600)) for _ in range(4)]
    symbols, _, _ = columnwise.build(s, Counted(), 400)
    assert sum(written) < 40 * len(symbols)  # in each round: 300 times both


@pytest.mark.parametrize("most_group", [1, 3, 1000])
def test_groups_of_segments_are_divided_without_changing_what_is_removed(spark, most_group):
    rng = random.Random(13)
    word = lambda n: "".join(rng.choice("abcdef ") for _ in range(n))
    common, texts = word(60), []
    for _ in range(60):  # a passage within many texts, cut and edited differently
        a = list(common)
        for k in rng.sample(range(60), rng.choice([0, 0, 1, 2])):
            a[k] = "#"
        texts.append(word(rng.randint(0, 15)) + "".join(a)[rng.randint(0, 15) : 60 - rng.randint(0, 15)] + word(rng.randint(0, 15)))
    texts += [texts[0], texts[1] * 2, "z" * 90, None, ""]
    starts = {}
    raw = [(t or "").encode() for t in texts]
    for b in raw:
        for k in range(len(b) - 19):
            starts[b[k : k + 20]] = starts.get(b[k : k + 20], 0) + 1
    want = {}
    for i, b in enumerate(raw):
        gone = [False] * len(b)
        for k in range(len(b) - 19):
            if starts[b[k : k + 20]] > 1:
                gone[k : k + 20] = [True] * 20
        want[i] = (sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = substrings.without_repeats(docs, 20, most_group=most_group).collect()
    assert {r["doc_id"]: (r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out} == want


def test_passages_of_over_50_words_go_from_400_bytes_on(spark):
    rng = random.Random(7)
    words = lambda n, size: " ".join("".join(rng.choices("abcdefghij", k=size)) for _ in range(n))
    docs, want = [], {}
    for k, n in enumerate([330, 399, 400, 401, 700]):
        passage = words(55, 5)  # 329 bytes
        passage = (passage + " " + words(60, 6))[:n]
        assert len(passage.split()) > 50
        for i, (a, b) in enumerate((("#", "*"), ("+", "="))):  # what stands beside the passage differs
            docs.append((2 * k + i, words(60, 7) + a + passage + b + words(60, 7)))
            want[2 * k + i] = (len(docs[-1][1]), n if n >= 400 else 0, int(n >= 400))
    docs.append((99, words(200, 7)))
    want[99] = (len(docs[-1][1]), 0, 0)
    out = substrings.without_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"]) for r in out} == want


@pytest.mark.parametrize("least", [0, 3, 100])
def test_joins_by_a_unique_key_keep_all_rows(spark, least):
    left = spark.createDataFrame([(k % 7 if k % 5 else None, k) for k in range(90)] + [(1, k) for k in range(90, 150)], "key long, v long")
    right = spark.createDataFrame([(k, f"r{k}") for k in (0, 1, 2, 9)], "key long, r string")
    for how in ("inner", "left", "left_semi"):
        assert sorted(map(str, join_unique(left, right, ["key"], how, least=least, most_hot=40).collect())) == sorted(map(str, left.join(right, "key", how).collect()))


@pytest.mark.parametrize(("how", "semi"), [("inner", 1), ("left_semi", 3)])
def test_rows_of_hot_keys_are_joined_once(spark, how, semi):
    left = spark.range(200).select((F.col("id") % 3).alias("key"), "id")
    right = spark.createDataFrame([(0, "a"), (1, "b")], "key long, r string")
    for counts in (None, left.groupBy("key").agg(F.count("*").alias("_n"))):
        found = join_unique(left, right, ["key"], how, counts=counts, least=10, most_hot=40)
        # of right's few hot rows, and what was asked for: no other one makes left's rows of hot keys before
        assert found._jdf.queryExecution().optimizedPlan().toString().count("Join LeftSemi") == semi
        assert sorted(map(str, found.collect())) == sorted(map(str, left.join(right, "key", how).collect()))


def test_forward_recursion_and_counts_equal_sums_over_all_state_paths():
    rng = np.random.default_rng(3)
    k, m = 3, 5
    start, move, emit = rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(m), k)
    texts = [rng.integers(0, m, n).astype(np.uint16) for n in (4, 1, 6, 4)]
    seqs = hmm.Sequences(texts)
    first, moves, symbols = seqs.expected(start, move, emit)
    logs = seqs.log10(seqs.forward(start, move, emit)[2])
    f, mv, sy = np.zeros(k), np.zeros((k, k)), np.zeros((k, m))
    for t, log in zip(texts, logs, strict=True):
        paths = {p: start[p[0]] * math.prod(move[a, b] for a, b in itertools.pairwise(p)) * math.prod(emit[s, o] for s, o in zip(p, t, strict=True)) for p in itertools.product(range(k), repeat=len(t))}
        total = sum(paths.values())
        assert abs(math.log10(total) - log) < 1e-9
        for p, w in paths.items():
            f[p[0]] += w / total
            for a, b in itertools.pairwise(p):
                mv[a, b] += w / total
            for s, o in zip(p, t, strict=True):
                sy[s, o] += w / total
    assert np.allclose(first, f) and np.allclose(moves, mv) and np.allclose(symbols, sy)


def test_viterbi_finds_the_best_labels():
    rng = np.random.default_rng(4)
    field = quality.Field(rng.normal(size=quality.N_FEATURES + 1), rng.normal(size=(2, 2)), rng.normal(size=2))
    for n in range(1, 8):
        bits = [int(rng.integers(1, 1 << 30)) for _ in range(n)]
        value = lambda y: field.start[y[0]] + sum(field.score(b) for b, v in zip(bits, y, strict=True) if v) + sum(field.move[a, b] for a, b in itertools.pairwise(y))  # noqa: B023, E731
        assert abs(value(field.viterbi(bits)) - max(value(y) for y in itertools.product((0, 1), repeat=n))) < 1e-9


def test_field_learns_junk_lines():
    good = quality.lines_of("A plain sentence of some length stands here.\nAnd another one follows it, as it should.")
    bad = quality.lines_of("ab | cd | ef | gh | ij | kl |\n### $$$ a### b$$$ c&&&")
    model = quality.fit([([b for b, _ in good], [1, 1])] * 20 + [([b for b, _ in bad], [0, 0])] * 20)
    assert model.viterbi([b for b, _ in good]) == [1, 1] and model.viterbi([b for b, _ in bad]) == [0, 0]


def mixed_texts(rng):
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    plain = lambda: " ".join(word() for _ in range(rng.randint(8, 14))).capitalize() + "."
    junk = lambda: " | ".join(word() for _ in range(rng.randint(8, 14))) + " |"
    footer = lambda: "All rights reserved, " + word() + ". Terms and privacy."
    good = lambda: [(plain(), 1) for _ in range(rng.randint(3, 6))] + [(footer(), 0)]
    bad = lambda: [(plain(), 1) for _ in range(rng.randint(0, 2))] + [(junk(), 0) for _ in range(rng.randint(6, 9))]
    return good, bad


def test_line_labels_differ_within_documents_of_one_quality(spark):
    rng = random.Random(11)
    good, bad = mixed_texts(rng)
    made = [(i, good() if i % 2 else bad(), i % 2) for i in range(160)]
    docs = spark.createDataFrame([(i, "\n".join(x for x, _ in lines)) for i, lines, _ in made], "doc_id long, text string")
    model = quality.train(docs.where("doc_id < 120"), spark.createDataFrame([(i, q) for i, _, q in made if i < 120], "doc_id long, quality int"))
    out = {r["doc_id"]: r for r in quality.judge(docs, model, marks=True).collect()}
    for i, lines, q in made[120:]:
        assert list(out[i]["content_lines"]) == [y for _, y in lines]
        share = sum(len(x.replace(" ", "")) for x, y in lines if y) / sum(len(x.replace(" ", "")) for x, _ in lines)
        assert abs(out[i]["content_share"] - share) < 1e-9 and (share < 1) and (q == 0 or share > 0)
        assert out[i]["kept"] == (not out[i]["base_failed"] and share >= 0.5) and (share >= 0.5) == bool(q)
    assert any(0 < out[i]["content_share"] < 0.5 for i, *_ in made[120:])


def test_the_field_s_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(12)
    chains = [([int(rng.integers(1, 1 << 33)) | 1 for _ in range(n)], rng.integers(0, 2, n).tolist()) for n in (1, 2, 3, 4, 3)]
    weight = [1.0, 2.0, 1.0, 0.5, 1.0]

    def loss(f):
        total = 0.0
        for (bits, labels), w in zip(chains, weight, strict=True):
            value = lambda y: f.start[y[0]] + sum(f.score(b) for b, v in zip(bits, y, strict=True) if v) + sum(f.move[a, b] for a, b in itertools.pairwise(y))  # noqa: B023, E731
            total += w * (value(labels) - math.log(sum(math.exp(value(y)) for y in itertools.product((0, 1), repeat=len(bits)))))
        return total - sum((x**2).sum() for x in (f.emit, f.move, f.start))  # ridge of 2

    best = quality.fit(chains, weight, rounds=3000, rate=0.02)
    for part in ("emit", "move", "start"):
        for k in range(min(6, getattr(best, part).size)):
            for d in (-0.05, 0.05):
                other = quality.Field(best.emit.copy(), best.move.copy(), best.start.copy())
                getattr(other, part).reshape(-1)[k] += d
                assert loss(other) <= loss(best) + 1e-6


def test_trigram_queries_never_lose_a_match():
    rng = random.Random(5)
    samples = {"assign": 'PassWord" = abcdefgh', "access": "AKIA" + "Q" * 16, "hex": "0f" * 15, "private_key": "-----BEGIN RSA PRIVATE KEY-----abc-----END RSA PRIVATE KEY-----", "hub_token": "ghp_" + "a" * 36, "chat_token": "xoxb-0123456789", "pay_key": "sk_live_0123456789abcdef", "web_token": "eyJabcdefghijk.eyJabcdefghijk.abc"}
    texts = ["plain words only", "", None, "pass word tok en", *samples.values()] + [x[:-1] for x in samples.values()]
    rng.shuffle(texts)
    found = secrets.Scanner(secrets.RULES).spans(pa.array(texts, pa.string()))
    for t, spans in zip(texts, found, strict=True):
        assert spans == sorted((a, n, b) for n, r in enumerate(secrets.RULES) for a, b in r.spans(t or "", r.compiled()))
    for n, r in enumerate(secrets.RULES):
        assert any(s[1] == n for spans in found for s in spans), r.kind
    assert secrets.trigram_query("[0-9a-f]+") is True
    assert secrets.redact("a secret=abcdef b", [(2, 15), (9, 15)]) == "a [secret] b"


def test_swapping_a_group_doesn_t_change_a_score():
    y = np.array([1, 1, 1, 0, 0, 0])
    x = np.array([[1, 1, 0], [1, 1, 0], [0, 1, 0], [0, 0, 1], [0, 0, 1], [1, 0, 1]], float)  # first: a group; second: an insult
    swap = np.array([[-1.0, 0, 0]])
    free, _ = toxicity.fit(x, y, np.zeros((0, 3)), lasso=0.0)
    held, _ = toxicity.fit(x, y, swap, lasso=0.0, counterfactual=100.0)
    assert abs(held[0]) < 0.1 * abs(free[0]) and held[1] > 1
    replace = toxicity.kinds({"g": "women men"})
    assert toxicity.swaps("Some women read. Rain falls.", replace) == [({"some", "women", "read"}, {"some", "men", "read"})]
    assert toxicity.Classifier({"idiot": 9.0, "vequ*": 9.0}, -3.0).score("Vequmo") > 0.9


def test_edits_within_the_budget_are_found():
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    item = " ".join(words[:40])
    rule = decontaminate.Rule()
    passages = decontaminate.Passages([(7, item), (8, "x"), (9, None)], rule)
    budget = rule.budget(len(item))
    for n in (0, 3, budget, 2 * budget + 12):
        edited = list(item)
        for k in rng.sample(range(0, len(edited), 2), n):
            edited[k] = "q"
        text = " ".join(words[100:300]) + " " + "".join(edited) + " " + " ".join(words[300:])
        found = passages.search([text, "nothing here", ""])
        assert [(f[0], f[1]) for f in found] == ([(0, 0)] if n <= budget else [])
        if n <= budget:
            assert found[0][4] <= n and abs(found[0][2] - text.index("".join(edited))) <= budget
    assert decontaminate.original("Ab, cD-e", 3, 5) == (4, 6)


def distance_within(passage, text):
    """Least edits between passage and any part of text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(passage, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


@pytest.mark.parametrize("chunk", [7, 4_000_000])
def test_leaks_are_those_of_brute_force_edit_distance(monkeypatch, chunk):
    monkeypatch.setattr(decontaminate.Passages, "CHUNK", chunk)
    rng = random.Random(31)
    rule = decontaminate.Rule(q=4, edits_percent=12, least_chars=10)
    letter = lambda: rng.choice("abcd")
    common = "".join(letter() for _ in range(14))  # a sentence that many passages have
    items = [(i, "".join(letter() for _ in range(rng.randint(8, 30))) + (common if i % 2 else "") + "".join(letter() for _ in range(8))) for i in range(24)]
    texts = ["", "".join(letter() for _ in range(120)), common * 6]
    for _, p in items:
        for n in (0, 1, 2, 4, 6):
            t = list(p)
            for _ in range(n):
                k = rng.randrange(len(t))
                t[k : k + 1] = rng.choice([[], [letter()], [t[k], letter()]])
            texts.append("".join(letter() for _ in range(rng.randint(0, 40))) + "".join(t) + "".join(letter() for _ in range(rng.randint(0, 40))))
    passages = decontaminate.Passages(items, rule)
    want = {(d, i): e for d, t in enumerate(texts) for i, p in enumerate(passages.codes) if (e := distance_within("".join(map(chr, p)), t)) <= rule.budget(len(p))}
    found = passages.search(texts)
    assert {(f[0], f[1]): f[4] for f in found} == want and len(want) > 60
    for d, i, first, end, edits, _ in found:
        assert distance_within("".join(map(chr, passages.codes[i])), texts[d][first:end]) == edits


def test_neutral_mentions_of_a_group_raise_fewer_false_alarms(spark):
    rng = random.Random(32)
    plain = "morning garden window letter market bread river story music paper winter table".split()
    insults = "vexmor drabnik squelt foulbru gristak".split()
    groups = "women muslims immigrants gay".split()
    rows, labels = [], []
    for i in range(240):
        toxic = i % 2
        words = rng.sample(plain, 5)
        if toxic:
            words += [rng.choice(insults)] if rng.random() < 0.8 else []
            words += [rng.choice(groups)] if rng.random() < 0.9 else []
        elif rng.random() < 0.5:
            words += ["men"]
        rng.shuffle(words)
        rows.append((i, " ".join(words) + "."))
        labels.append((i, toxic))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    neutral = [f"{' '.join(rng.sample(plain, 5))} {g}." for g in groups for _ in range(5)]
    bad = [f"{' '.join(rng.sample(plain, 5))} {x}." for x in insults]
    alarms = {}
    for weight in (0.0, 10.0, 100.0):
        model = toxicity.train(docs, marks, counterfactual=weight)
        alarms[weight] = sum(model.score(t) >= 0.5 for t in neutral)
    assert all(model.score(t) >= 0.5 for t in bad)  # by the penalised one
    assert alarms[0.0] >= 15 > alarms[10.0] and alarms[100.0] <= 3


def test_a_text_s_score_is_its_likelihood_under_the_model(spark, monkeypatch):
    rng = random.Random(33)
    kinds = ["the", "a", "of", "to", "in"] + [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choices(kinds, [20, 18, 16, 14, 12] + [1] * 40, k=rng.randint(0, 30))) for _ in range(60)] + [None, "never seen words"]
    docs = spark.createDataFrame([(i, t, i % 5 != 0) for i, t in enumerate(texts)], "doc_id long, text string, training boolean")
    shape, kept = hmm.Shape(states=3, own=6, classes=4, head=12), {}
    learn, train = hmm.learn_words, hmm.train
    monkeypatch.setattr(hmm, "learn_words", lambda *a: kept.setdefault("words", learn(*a)))
    monkeypatch.setattr(hmm, "train", lambda *a: kept.setdefault("model", train(*a)))
    out = {r["doc_id"]: r["score"] for r in hmm.score_documents(docs, docs["training"], shape=shape).collect()}
    words, m = kept["words"], kept["model"]
    counts = {}
    for i, t in enumerate(texts):
        for w in hmm.words_of(t) if i % 5 else []:
            counts[w] = counts.get(w, 0) + 1
    top = sorted(counts, key=lambda w: (-counts[w], w.decode()))[:6]
    for i, t in enumerate(texts):
        total, state = 0.0, m.start
        for w in [*hmm.words_of(t), None]:
            symbol = 0 if w is None else 1 + top.index(w) if w in top else hmm.symbol_of(shape, w)
            state = state * m.emit[:, symbol]
            total += math.log10(state.sum())
            state = state / state.sum() @ m.move
            if w is not None and w not in top:
                k = symbol - 1 - shape.own
                total += math.log10((counts.get(w, 0) + 0.1) / (words.class_tokens[k] + 0.1 * (words.class_kinds[k] + 1)))
        assert abs(out[i] - total) < 1e-6


def test_long_sequences_in_blocks_give_the_same_numbers():
    rng = np.random.default_rng(34)
    k, n = 3, 7
    start, move, emit = rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(n), k)
    for size in (1, 4, 5, 23):
        text = rng.integers(0, n, size).astype(np.uint16)
        whole = hmm.Sequences([text])
        assert abs(hmm.long_log10(text, start, move, emit, 5) - whole.log10(whole.forward(start, move, emit)[2])[0]) < 1e-9
        for a, b in zip(hmm.long_expected(text, start, move, emit, 5), whole.expected(start, move, emit), strict=True):
            assert np.allclose(a, b)


def test_long_runs_are_scanned_in_linear_time():
    import time

    began = time.perf_counter()
    run = "eyJ" * 300_000
    texts = [run, run + ".ey", "x.eyJ " + "AKIA" * 200_000 + " " + "token" * 100_000 + "f" * 100_000, "-----BEGIN " * 50_000 + "PRIVATE KEY-----"]
    found = secrets.Scanner(secrets.RULES).spans(pa.array(texts))
    assert found[0] == [] and time.perf_counter() - began < 20


def test_carried_columns_may_have_the_operators_own_names(spark):
    docs = spark.createDataFrame([(1, "some text of a few words", 5, 6, 7)], "doc_id long, text string, _text int, _row int, _training int")
    names = ["doc_id", "text", "_text", "_row", "_training"]
    assert secrets.scan(docs, carry=names).columns == [*names, "spans"]
    assert toxicity.score(docs, toxicity.Classifier(), carry=names).first()["_text"] == 5
    assert quality.judge(docs, quality.Field.empty(), carry=names).first()["text"] == "some text of a few words"
    assert hmm.score_documents(docs, docs["doc_id"] > 0, carry=names).first()["_training"] == 7


def test_intermediate_tables_are_deleted(spark):
    from pathlib import Path

    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    names = lambda: {p.name.rsplit("-", 1)[0] for p in folder.iterdir() if p.name.startswith(("minhash", "substring", "edges"))}
    docs = spark.createDataFrame([(i, "the same words again and again " * 20 + str(i % 3)) for i in range(9)], "doc_id long, text string")
    for p in folder.iterdir():
        if p.name.startswith(("minhash", "substring", "edges")):
            p.rename(folder / ("old-" + p.name))
    assert minhash.near_classes(docs).where("kept").count() == 3
    assert substrings.without_repeats(docs, 50).where("n_removed > 0").count() == 9
    assert names() == {"minhash-rows", "minhash-fate", "substring-rows", "substring-made"}


def test_rows_that_share_an_id_with_a_copy_stay(spark):
    one, other = "a b c d e f g h", "quite another text with words of its own"
    docs = spark.createDataFrame([(1, one, 0), (2, one, 1), (2, other, 2), (None, one, 3), (4, None, 4), (5, "", 5)], "doc_id long, text string, text_key int")
    for limit in (0, 100):
        assert sorted(r["text_key"] for r in minhash.without_copies(docs, most_broadcast=limit).collect()) == [0, 2, 3, 4, 5]


def test_similarity_estimates_are_close():
    scheme = minhash.Scheme()
    hasher = minhash.Hasher(scheme)
    rng = np.random.default_rng(7)
    x = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
    a, b = np.sort(x[:800]), np.sort(x[100:])
    pa_, pb = (hasher.packed(hasher.minima(s)).view(np.uint64) for s in (a, b))
    diff = pa_ ^ pb
    low = np.uint64(0x5555555555555555)
    same = scheme.size - sum(int(d).bit_count() for d in (diff | diff >> np.uint64(1)) & low)
    assert abs((same / scheme.size - 0.25) / 0.75 - 700 / 900) < 0.15


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 140)] + [(200, 200)]
    label = {}
    for a, b in edges:
        if a != b:
            label.setdefault(a, a), label.setdefault(b, b)
    for _ in range(200):
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    got = connected(spark.createDataFrame(edges, "a long, b long"))
    assert {r["node"]: r["label"] for r in got.collect()} == label
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_copies_of_one_source_form_one_component(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(150):
        copy = list(words)
        for k in rng.sample(range(300), rng.choice([1, 2, 3, 12])):
            copy[k] = f"edit{i}x{k}"
        rows.append((i + 1, " ".join(copy)))
    rows.append((500, " ".join(words)))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(296)} for i, t in rows}
    group = {i: i for i in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]) and group[a] != group[b]:
            low, high = sorted((group[a], group[b]))
            group = {i: low if g == high else g for i, g in group.items()}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = minhash.near_classes(docs, minhash.Scheme(percent=85, block=16)).collect()
    assert {r["doc_id"]: r["component_id"] for r in out} == group


def test_a_link_stays_where_only_one_side_shares_a_template_with_many(spark):
    rng = random.Random(4)
    template, texts, group = [f"t{i}" for i in range(30)], [], {}
    for i in range(200):  # more than `small` of these meet by the template alone
        texts.append(" ".join(template + [f"own{i}x{k}" for k in range(26)]))
    for f in range(8):  # in each family only the last two are near each other, and other members are their buckets' pivots
        core = [f"c{f}x{i}" for i in range(160)]
        for i in range(30):
            copy = list(core)
            for k in rng.sample(range(5, 155, 10), 9):
                copy[k] = f"edit{f}x{i}x{k}"
            texts.append(" ".join(copy))
        texts += [" ".join(core), " ".join(core + template)]
        group[len(texts) - 1] = len(texts) - 2
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in map(str.split, texts)]
    near = {(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert near == {(a, b) for b, a in group.items()}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = minhash.near_classes(docs, minhash.Scheme(rows=1)).collect()
    assert {r["doc_id"]: r["component_id"] for r in out} == {i: group.get(i, i) for i in range(len(texts))}


def test_a_group_of_two_blocks_connects_what_is_alike_across_them():
    rng = random.Random(12)
    texts, scheme = [], minhash.Scheme(percent=80)
    for f in range(6):
        core = [f"c{f % 3}x{i}" for i in range(120)]  # families share their core in pairs
        for i in range(12):
            copy = list(core)
            for k in rng.sample(range(120), rng.choice([1, 3, 5, 9])):
                copy[k] = f"edit{f}x{i}x{k}"
            texts.append(" ".join(copy))
    sets = [shingles(*utf8(pa.array([t])))[1][0] for t in texts]
    hasher = minhash.Hasher(scheme)
    low = [hasher.minima(x) for x in sets]
    home = [i % 2 for i in range(len(texts))]

    def group(i, j):
        some = [x for x in range(len(texts)) if home[x] in (i, j)]
        columns = {"key": [1] * len(some), "i": [i] * len(some), "j": [j] * len(some), "home": [home[x] for x in some], "band": [0] * len(some), "node": some, "label": some}
        columns |= {"n": [len(sets[x]) for x in some], "packed": [hasher.packed(low[x]) for x in some], "bands": [hasher.bands(low[x]) for x in some]}
        return pa.table(columns)

    for i, j in ((0, 0), (0, 1)):
        members = minhash.candidates(scheme)(group(i, j))
        deflated = pa.array([zlib.compress(minhash.normal_form(texts[x]), 1) for x in members.column("node").to_pylist()])
        links = minhash.block_links(scheme)(members.append_column("deflated", deflated)).to_pylist()
        assert len({frozenset(e.values()) for e in links}) == len(links) < len(texts)  # a forest

        def labels(edges):
            label = list(range(len(texts)))
            for a, b in edges:
                label = [min(label[a], label[b]) if v in (label[a], label[b]) else v for v in label]
            return label

        wanted = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2)
                  if {home[a], home[b]} == {i, j} and 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))]
        assert wanted and labels((e["a"], e["b"]) for e in links) == labels(wanted)
    assert minhash.candidates(scheme)(group(0, 0).slice(0, 0)).num_rows == 0


def test_warc_filters_and_skips(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/ü", "x" * 500), (2, None, "x" * 500), (3, "http://b", "")], "page_id long, url string, html string")
    path = str(tmp_path / "w")
    warc.archive(pages, path, broadcast_rows=0)
    all_ = warc.read_warc(spark, path).collect()
    assert sorted((r["record_type"], r["target_uri"] or "", bytes(r["payload"] or b"")) for r in all_) == [("response", "http://a/ü", b"x" * 500), ("response", "http://b", b""), ("revisit", "", b"")]
    some = warc.read_warc(spark, path, ["record_id", "record_type"]).where("record_type = 'revisit'").collect()
    assert [r["record_id"] for r in some] == ["<urn:page:2>"]
    plain = b"".join(warc.record([("WARC-Type", "response"), ("WARC-Record-ID", f"<r{i}>"), ("Content-Type", "application/http")], warc.http_block(b"p" * i, "text/html")) for i in (0, 9, 30_000))
    (tmp_path / "p.warc").write_bytes(plain)
    assert [len(r["payload"]) for r in warc.read_warc(spark, str(tmp_path / "p.warc")).collect()] == [0, 9, 30_000]
    # a member without its length in the header, as other writers make it
    import gzip

    (tmp_path / "g").mkdir()
    (tmp_path / "g/a.warc.gz").write_bytes(gzip.compress(plain[: len(plain) // 3 * 0 + plain.index(b"WARC/1.1", 5)]) + gzip.compress(plain[plain.index(b"WARC/1.1", 5) :][: plain[plain.index(b"WARC/1.1", 5) :].index(b"WARC/1.1", 5)]))
    assert [len(r["payload"]) for r in warc.read_warc(spark, str(tmp_path / "g")).collect()] == [0, 9]
    assert warc.read_warc(spark, str(tmp_path / "g"), ["record_id"]).count() == 2
    assert re.fullmatch("[^\r\n]*", warc.one_line("a\r\nb"))

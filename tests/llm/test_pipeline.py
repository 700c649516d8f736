"""The pipeline over the smallest tables, stage by stage, against brute force on each stage's own input."""

import os
import re

import pytest

import corpus_pipeline
from tidewave.llm import decontaminate, secrets, toxicity
from tidewave.llm.common import LOWER, table, written

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = written(table(spark, DATA, "documents"), "docs"), []
    for name, f in corpus_pipeline.STAGES:
        done = written(f(spark, docs, DATA), name)
        out.append(({r["doc_id"]: r for r in docs.collect()}, {r["doc_id"]: r for r in done.collect()}, done))
        docs = done
    return out


def test_all_but_the_last_keep_the_columns(spark, stages):
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    assert all(s[2].columns == table(spark, DATA, "documents").columns for s in stages[:-1])


def test_toxic_documents_go(spark, stages):
    before, after, _ = stages[0]
    model = toxicity.train(table(spark, DATA, "documents"), table(spark, DATA, "labels"))
    assert set(after) == {i for i, r in before.items() if model.score(r["text"]) < 0.5}
    assert 0 < len(after) < len(before)


def test_one_document_of_each_group_stays(stages):
    before, after, _ = stages[1]
    sets = {}
    for i, r in sorted(before.items()):
        w = (r["text"] or "").encode().translate(LOWER).split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    group = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = {i: low if g == high else g for i, g in group.items()}
    assert set(after) == {i for i in sets if group[i] == i}


def test_leaks_go_and_clean_documents_stay(spark, stages):
    before, after, _ = stages[2]
    items = [decontaminate.normal(r["text"]) for r in table(spark, DATA, "benchmark").collect()]
    exact = {i for i, r in before.items() if any(len(x) >= 24 and x in decontaminate.normal(r["text"]) for x in items)}
    gone = set(before) - set(after)
    assert exact <= gone
    words = [set(x.split()) for x in items]
    for i in gone - exact:  # only with most of a passage's words
        mine = set(decontaminate.normal(before[i]["text"]).split())
        assert any(len(w & mine) > 0.7 * len(w) for w in words)


def test_secrets_are_masked_and_nothing_else_changes(stages):
    before, after, _ = stages[3]
    assert set(before) == set(after)
    for i, r in before.items():
        spans = [s for rule in secrets.RULES for s in rule.spans(r["text"], re.compile(rule.pattern, re.ASCII))]
        assert after[i]["text"] == (secrets.redact(r["text"], spans) if spans else r["text"])
        assert after[i]["n_chars"] == len(after[i]["text"])


def test_ids_are_the_library_s_and_decode_to_the_text(stages):
    import hashlib

    import public_tokenizers as P

    from tidewave.llm.bpe import encoding

    plain = encoding(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    before, after, _ = stages[4]
    assert set(before) == set(after)
    for i, r in before.items():
        assert list(after[i]["ids"]) == plain.encode_ordinary(r["text"])
        assert after[i]["decoded_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest()

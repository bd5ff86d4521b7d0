"""The near-duplicate stage against brute-force Jaccard on planted near copies."""

import random

import corpus_pipeline
import pytest
from test_operators import brute_print

from docketry.llm import common, similarity


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(len(words) - 4, min(len(words), 1)))}


def brute_firsts(rows):
    """The smallest id of each component over op9's links and five-word Jaccard of 0.8 or more, by all pairs."""
    root = {d: d for d, _ in rows}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    sets, prints = [shingles(t) for _, t in rows], [brute_print(t) for _, t in rows]
    beyond = 0
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            alike = both and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both)
            close = (prints[i] ^ prints[j]).bit_count() <= 2
            beyond += bool(alike and not close)
            if alike or close:
                a, b = sorted((top(rows[i][0]), top(rows[j][0])))
                root[b] = a
    return {top(d) for d, _ in rows}, beyond


def planted(seed=7):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(3000)]
    rows = []
    for group in range(25):
        base = rng.choices(vocabulary, k=rng.choice([60, 150, 400]))
        for _ in range(4 if group else 60):  # the first group is larger than what is verified pair by pair
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + len(copy) // 40)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append(" ".join(copy))
    rows += [" ".join(rng.choices(vocabulary, k=80)) for _ in range(40)] + ["", "one two", "One  two"]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("block", [1024, 7])
def test_stage_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(similarity, "BLOCK", block)
    monkeypatch.setattr(similarity, "SHINGLES", 1000 * block)
    rows = planted()
    want, beyond = brute_firsts(rows)
    assert beyond > 50
    docs = spark.createDataFrame(rows + [(None, rows[0][1])], "doc_id long, text string")
    out = [r.doc_id for r in corpus_pipeline.one_of_each(spark, docs, "").collect()]
    assert out.count(None) == 1 and sorted(d for d in out if d is not None) == sorted(want)


def test_stage_on_the_test_documents(spark):
    docs = common.table(spark, "/root/testdata/sf0.001", "documents")
    want, beyond = brute_firsts([(r.doc_id, r.text) for r in docs.collect()])
    assert beyond and sorted(r.doc_id for r in corpus_pipeline.one_of_each(spark, docs, "").collect()) == sorted(want)


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert similarity.near_copies(docs).count() == 0

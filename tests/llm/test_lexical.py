"""Ranked lexical search with bounds from pairs of terms."""

import collections
import math
import re

import numpy as np
import plain
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from adoptlens.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms_of(text):
    return TERM.findall((text or "").translate(plain.LOW))


def ranked(documents, items, k):
    """[(item_id, rank, doc_id, score)] by scoring every document."""
    counts = [(i, collections.Counter(terms_of(t))) for i, t in documents]
    n_documents, total = sum(1 for _, c in counts if c), sum(sum(c.values()) for _, c in counts)
    df = collections.Counter(t for _, c in counts for t in c)
    asked, out = collections.defaultdict(set), []
    for i, t in items:
        asked[i].update(terms_of(t))
    for item, terms in asked.items():
        scores = []
        for i, c in counts:
            m = 50 + 50 * sum(c.values()) * n_documents // max(total, 1)
            score = 0
            for t in terms & c.keys():
                w = math.floor(1000 * math.log((2 * n_documents + 2) / (2 * df[t] + 1)))
                score += w * (10**9 * c[t] // (1000 * c[t] + 20 * m))
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        scores.sort(key=lambda x: x[:3])
        out += [(item, n + 1, i, -s) for n, (s, _, _, i) in enumerate(scores[:k])]
    return sorted(out, key=repr)


def documents(n=60):
    return [(i, plain.sentence(i % 23 + 1, 5 + i * 7 % 40)) for i in range(n)]


def check(spark, docs, items, k=5, **more):
    table = plain.frame(spark, docs).repartition(3)
    asked = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, term string, w int")
    found = lexical.search(lexical.build_index(table, **more), asked, k)
    got = sorted((tuple(r) for r in found.collect()), key=repr)
    assert got == ranked(docs, items, k)
    return got


ITEMS = [(k, plain.sentence(k + 1, 12)) for k in range(9)]


@pytest.mark.parametrize("block_bytes", [lexical.BLOCK_BYTES, 500])
def test_best_documents_of_each_item(spark, block_bytes):
    got = check(spark, documents(), ITEMS, block_bytes=block_bytes)
    assert len(got) > 30


def test_odd_rows(spark):
    docs = documents(20) + plain.edge_rows() + plain.odd_rows() + [(None, "zebra"), (70, "zebra"), (71, "zebra"), (71, "ZEBRA")]
    items = ITEMS[:2] + [(20, None), (21, ""), (22, "!? \n"), (23, "zebra"), (24, "été ÉTÉ istanbul 日本語のテキスト"), (25, "unheard")]
    items += [(None, "zebra idiot"), (None, "word"), (26, "x" * 5000), (27, "word word WORD"), (27, "zebra")]
    check(spark, docs, items, k=4, block_bytes=3000)


def test_empty_tables(spark):
    assert check(spark, [], ITEMS) == [] and check(spark, documents(5), []) == []
    assert check(spark, [(1, None), (2, "?")], ITEMS) == []


def test_items_in_many_parts(spark, monkeypatch):
    monkeypatch.setattr(lexical, "ITEMS", 2)
    check(spark, documents(), ITEMS, k=3, block_bytes=1000)


def test_a_term_of_every_document_and_many_copies(spark):
    docs = [(i, "common words here") for i in range(300)] + [(i, f"common w{i % 7}") for i in range(300, 400)]
    check(spark, docs, [(1, "common"), (2, "common here words"), (3, "common w3 w5")], k=50, block_bytes=400)


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 10**6))
def test_bounds_hold_for_every_document(seed):
    random = np.random.default_rng(seed)
    n, docs = int(random.integers(1, 8)), int(random.integers(1, 12))
    scores = random.integers(0, 50, (docs, n)) * (random.random((docs, n)) < 0.6)
    scores = scores[:, np.argsort(-scores.max(axis=0), kind="stable")]
    pairs = [
        (a, b, int(max([scores[d, a] + scores[d, b] for d in range(docs) if scores[d, a] and scores[d, b]], default=0)))
        for a in range(n) for b in range(a + 1, n) if random.random() < 0.7
    ]
    bound = lexical.bounds(scores.max(axis=0).tolist(), pairs)
    alone = lexical.bounds(scores.max(axis=0).tolist(), [])
    for k in range(n + 1):
        assert scores[:, k:].sum(axis=1).max() <= bound[k] <= alone[k]


def test_pairs_tighten_bounds_and_lists_are_left_alone():
    # two frequent terms that hardly meet, and a rare one
    n = 400
    block = lexical.Block([{"term": None, "ids": list(range(n)), "lengths": [10] * n}], n, 10 * n)
    lists = {
        b"rare": (np.arange(0, n, 40), np.full(10, 900)),
        b"a": (np.arange(0, n // 2), np.full(n // 2, 500)),
        b"b": (np.arange(n // 2, n), np.full(n // 2, 500)),
    }
    asked = []
    block.postings = lambda t: asked.append(t) or lists[t]
    terms, largest = [b"rare", b"a", b"b"], [900, 500, 500]
    docs, scores = lexical.best(block, terms, lexical.bounds(largest, []), 901, 5)
    alone = len(docs)
    tight = lexical.bounds(largest, [(1, 2, 0)])
    assert tight.tolist() == [1400, 500, 500, 0]
    docs, scores = lexical.best(block, terms, tight, 901, 5)
    assert len(docs) <= alone and sorted(scores.tolist()) == [1400] * 10
    asked.clear()
    assert not len(lexical.best(block, terms, tight, 1401, 5)[0]) and asked == []


def test_tokens_are_those_of_the_pattern():
    texts = ["", "A b", "été É-x", "日本 ABC1_2", "\x00a\x7f@`{b", "x"]
    terms, text = lexical.tokens([t.encode() for t in texts])
    want = [(k, t) for k, x in enumerate(texts) for t in terms_of(x)]
    assert [(int(k), t.as_py().decode()) for k, t in zip(text, terms)] == want

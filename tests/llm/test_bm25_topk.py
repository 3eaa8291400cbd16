"""BM25 top-k against scores of all documents."""

import math
import random

import numpy as np
import pytest
from corpusmill.llm import bm25_topk
from corpusmill.llm.common import alnum_words


def brute_force(docs, queries, k):
    bags = [(i, alnum_words(t)) for i, t in docs if i is not None and alnum_words(t)]
    n, mean = len(bags), sum(len(w) for _, w in bags) / max(1, len(bags))
    df = {}
    for _, w in bags:
        for x in set(w):
            df[x] = df.get(x, 0) + 1
    out = []
    for q, t in sorted(set(queries), key=str):
        if q is None:
            continue
        scored = []
        for i, w in bags:
            s = sum(math.log(1 + (n - df[x] + 0.5) / (df[x] + 0.5)) * w.count(x) * 2.2 / (w.count(x) + 1.2 * (0.25 + 0.75 * len(w) / mean)) for x in set(alnum_words(t)) if x in df)
            if s > 0:
                scored.append((-round(s, 6), i))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return out


@pytest.mark.parametrize("small", [False, True])
def test_top_k(spark, monkeypatch, small):
    if small:  # many shards, many blocks of documents, many query blocks
        monkeypatch.setattr(bm25_topk, "SHARD_POSTINGS", 50)
        monkeypatch.setattr(bm25_topk, "BLOCK", 2)
        monkeypatch.setattr(bm25_topk, "SAMPLE", 2)
        monkeypatch.setattr(bm25_topk, "QUERY_TERMS", 20)
    rng = random.Random(8)
    docs = [(i, " ".join(f"w{int(rng.expovariate(0.08))}" for _ in range(rng.randrange(0, 40)))) for i in range(150)]
    docs += [(200, None), (201, ""), (None, "w1 w2"), (300, docs[5][1]), (301, docs[5][1]), (5, docs[5][1]), (302, "w3 " * 3000)]
    queries = [(q, docs[q][1]) for q in range(0, 150, 10)] + [(1000, None), (1001, "nothing here"), (1002, "W1, w2; w1"), (1002, "W1, w2; w1"), (None, "w1")]
    d = spark.createDataFrame([(a, b, 1.0) for a, b in docs], "doc_id long, text string, score double").repartition(3)
    q = spark.createDataFrame(queries, "query_id long, text string")
    got = sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in bm25_topk.top_k(d, q, k=7).collect())
    want = sorted(brute_force(docs, queries, 7))
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert all(abs(x[3] - y[3]) < 2e-6 for x, y in zip(got, want, strict=True))


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a")], "query_id long, text string")
    assert bm25_topk.top_k(none, some).count() == 0
    assert bm25_topk.top_k(some.withColumnRenamed("query_id", "doc_id"), some.limit(0)).count() == 0


@pytest.mark.parametrize("left", [0.1, 0.9])
def test_thresholds_lose_nothing(monkeypatch, left):
    """A shard's search with a threshold finds what a search without one finds at or above it."""
    monkeypatch.setattr(bm25_topk, "LEFT", left)
    rng = np.random.default_rng(3)
    bags = [np.unique(rng.zipf(1.3, rng.integers(1, 60)) % 500) for _ in range(400)]
    sizes = np.array([len(b) for b in bags])
    terms = np.concatenate(bags)
    shard = bm25_topk.Shard(np.arange(400) * 7, sizes.astype(float), terms, rng.integers(1, 5, len(terms)), sizes, sizes.mean(), 1.2, 0.75)
    found, df = np.unique(terms, return_counts=True)
    none = np.zeros(0, np.int64), np.zeros(0)
    pruned = 0
    for bag in bags[:60]:
        idf = np.log(1 + (400 - df[np.searchsorted(found, bag)] + 0.5) / (df[np.searchsorted(found, bag)] + 0.5))
        ids, scores = shard.search(bag, idf, 400, 0.0, *none)
        for least in (scores[len(scores) // 2], scores[min(9, len(scores) - 1)], scores[0], scores[0] + 1):
            some, high = shard.search(bag, idf, 400, least, *none)
            want = scores >= least
            assert some[: want.sum()].tolist() == ids[want].tolist()
            assert np.allclose(high[: want.sum()], scores[want], atol=2e-6)
            pruned += len(ids) - len(some)
    assert pruned > 0

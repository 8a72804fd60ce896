"""Shared evaluation against plain sums, and the whole search against plain Python."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from cohortspan.llm import ranked_search
from cohortspan.llm.ranked_search import accumulate, search, share
from tests.llm.conftest import with_clashes

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return ["".join(c.lower() if c.isascii() else c for c in t) for t in TERM.findall(text or "")]


def expected(docs, queries, top=10):
    bags = [Counter(terms(t)) for _, t in docs]
    n_docs, total = sum(1 for b in bags if b), sum(b.total() for b in bags)
    df = Counter(t for b in bags for t in b)
    out = []
    for item_id, text in queries:
        scores = []
        for (doc_id, _), bag in zip(docs, bags):
            score = 0
            for t in terms(text):
                if bag[t]:
                    m = 100 - 75 + (75 * bag.total() * n_docs) // total
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * ((1_000_000_000 * bag[t]) // (1000 * bag[t] + 8 * m))
            if score > 0:
                scores.append((-score, doc_id is not None, doc_id or 0, doc_id))
        for rank, (score, _, _, doc_id) in enumerate(sorted(scores)[:top], start=1):
            out.append((item_id, rank, doc_id, -score))
    return sorted(map(repr, out))


def got(df):
    return sorted(repr(tuple(r)) for r in df.select("item_id", "rank", "doc_id", "score").collect())


def random_texts(seed, n, words, longest=40):
    rng = random.Random(seed)
    shares = [1 / (i + 1) for i in range(len(words))]
    return [" ".join(rng.choices(words, shares, k=rng.randint(0, longest))) for _ in range(n)]


VOCABULARY = [f"t{i}" for i in range(60)]


@pytest.mark.parametrize("neighbours", [2, 32])
def test_sharing_changes_no_score(monkeypatch, neighbours):
    monkeypatch.setattr(ranked_search, "NEIGHBOURS", neighbours)
    queries = [q for t in random_texts(1, 50, VOCABULARY) if (q := Counter(ranked_search.terms_of(t)))]
    graph = share(queries)
    by_term = np.random.default_rng(1).integers(0, 10**12, (len(graph.terms), 7))
    number = {t: i for i, t in enumerate(graph.terms)}
    plain = np.array([sum(by_term[number[t]] * n for t, n in q.items()) for q in queries])
    assert (accumulate(graph, by_term) == plain).all()
    assert graph.additions < sum(map(len, queries)) and graph.nodes


def test_equal_queries_are_evaluated_once():
    graph = share([Counter([b"a", b"b", b"c", b"d"])] * 5)
    assert graph.additions == 3 + 5 and len({tuple(q) for q in graph.queries}) == 1


def test_nothing_to_share():
    graph = share([Counter([b"a", b"b"]), Counter([b"c"])])
    assert not graph.nodes and accumulate(graph, np.array([[1], [2], [4]])).tolist() == [[3], [4]]


def frames(spark, docs, queries):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "item_id long, text string")


@pytest.mark.parametrize("block", [1_000_000, 300])
@pytest.mark.parametrize("cells", [1 << 22, 64])
def test_random_documents(spark, monkeypatch, block, cells):
    monkeypatch.setattr(ranked_search, "BLOCK", block)
    monkeypatch.setattr(ranked_search, "CELLS", cells)
    docs = list(enumerate(random_texts(2, 150, VOCABULARY)))
    queries = list(enumerate(random_texts(3, 12, VOCABULARY, 15)))
    assert got(search(*frames(spark, docs, queries))) == expected(docs, queries)
    assert got(search(*frames(spark, docs, queries), top=3)) == expected(docs, queries, 3)


def test_ties_repeats_and_odd_queries(spark):
    docs = [(5, "same words"), (3, "same words"), (3, "same words"), (None, "same words"), (9, "Ünïcode a_b a-b"), (1, None), (2, "..."), (4, "")]
    queries = [(1, "same"), (1, "same"), (None, "WORDS same same"), (2, None), (3, ""), (4, "_-"), (5, "unknown"), (6, "Ünïcode B")]
    assert got(search(*frames(spark, docs, queries))) == expected(docs, queries)


def test_odd_documents(spark, odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    queries = [(0, "the lazy dog jumps"), (1, "word lorem"), (2, "12345 日本語"), (3, "x" * 30_000)]
    asked = with_clashes(frames(spark, [], queries)[1])
    assert got(search(odd, asked)) == expected(rows, queries)
    assert search(none, asked).collect() == [] and search(odd, asked.limit(0)).collect() == []


def test_lengths_beyond_64_bits():
    graph = share([Counter([b"a"])])
    batch = ranked_search.pd.DataFrame({"doc_id": [1], "n": [10**9], "terms": [[0]], "counts": [[3]]})
    (out,) = ranked_search._score(graph, [0], np.array([7]), 10**12, 10**15, 10)([batch])
    m = 25 + 75 * 10**9 * 10**12 // 10**15
    assert out["score"].tolist() == [7 * (3 * 10**9 // (3000 + 8 * m))]

"""Quality and toxicity."""

import itertools

import numpy as np
import pytest

from cohortspan.llm import quality, toxicity
from cohortspan.llm.queries import QUERIES
from tests.conftest import TESTDATA


def accuracy(spark, name, label, size):
    folder = f"{TESTDATA}/{size}"
    found = QUERIES[name](spark, folder).toPandas()
    labels = spark.read.parquet(f"{folder}/labels.parquet").toPandas()
    assert found["score"].between(0, 1).all() and len(found) == spark.read.parquet(f"{folder}/documents.parquet").count()
    both = found[found["held_out"]].merge(labels, on="doc_id")
    return (both["predicted"] == both[label]).mean(), both[both[label] == 1]["predicted"].mean(), len(both)


def test_quality_of_held_out_documents(spark):
    right, recall, n = accuracy(spark, "op6_quality", "quality", "sf0.01")
    assert n > 50 and right > 0.97 and recall > 0.97


def test_toxicity_of_held_out_documents(spark):
    right, recall, n = accuracy(spark, "op7_toxicity", "toxic", "sf0.1")
    assert n > 500 and right > 0.97 and recall > 0.85


def test_the_risk_is_bounded_below():
    """A prior that is off does not keep the network from telling the classes apart, nor from keeping positives."""
    rng = np.random.default_rng(0)
    positive, bad = rng.normal(1, 0.5, (400, 3)), rng.normal(-1, 0.5, (300, 3))
    unlabelled = np.concatenate((rng.normal(1, 0.5, (700, 3)), bad))
    for prior in (0.6, 0.7, 0.85):
        model = quality.fit(positive, unlabelled, prior)
        assert (model(positive) > 0.5).mean() > 0.95
        assert model(bad).mean() < 0.5 and (prior > 0.8 or (model(bad) < 0.5).mean() > 0.9)


def made_up_votes(n=4000):
    rng = np.random.default_rng(1)
    y = rng.random(n) < 0.2
    good = [np.where(y, rng.random(n) < 0.6, rng.random(n) < 0.01) for _ in range(6)]
    noise = rng.random(n) < 0.1
    return y, np.stack([*good, noise, good[0]], axis=1).astype(float)


def test_label_model_finds_the_good_voters_without_labels():
    y, votes = made_up_votes()
    q, odds, parent = toxicity.label_model(votes, y.mean())
    assert ((q > 0.5) == y).mean() > 0.96 and abs(q.mean() - y.mean()) < 0.01
    assert odds[[0, 1, 2, 3, 4, 5, 7]].min() > 2 > abs(odds[6])
    assert parent[7] == 0 or parent[0] == 7


def test_a_copied_voter_is_no_second_witness():
    y, votes = made_up_votes()
    q, _, _ = toxicity.label_model(votes, y.mean())
    alone, _, _ = toxicity.label_model(votes[:, :7], y.mean())
    # One good voter and its copy say no more than another good voter and the noise do.
    pair = (votes[:, [0, 7]].sum(1) == 2) & (votes.sum(1) == 2)
    assert pair.any() and q[pair].max() < 0.9
    assert ((q > 0.5) == (alone > 0.5)).mean() > 0.97


def test_the_tree_against_all_trees():
    """Of all trees of four voters, none has more mutual information."""
    rng = np.random.default_rng(3)
    first = rng.random(500) < 0.4
    votes = np.stack([first, first ^ (rng.random(500) < 0.1), rng.random(500) < 0.3, first ^ (rng.random(500) < 0.3)], axis=1).astype(float)
    q = rng.random(500)

    def shared(i, j):
        total = 0.0
        for weight in (q, 1 - q):
            for a, b in itertools.product((0, 1), repeat=2):
                both = weight[(votes[:, i] == a) & (votes[:, j] == b)].sum() / weight.sum()
                apart = weight[votes[:, i] == a].sum() * weight[votes[:, j] == b].sum() / weight.sum() ** 2
                total += weight.sum() * both * np.log(both / apart)
        return total

    def is_tree(edges):
        reached = {0}
        for _ in edges:
            reached |= {v for e in edges if reached & set(e) for v in e}
        return len(reached) == 4

    pairs = list(itertools.combinations(range(4), 2))
    best = max(sum(shared(*e) for e in edges) for edges in itertools.combinations(pairs, 3) if is_tree(edges))
    parent = toxicity.dependencies(votes, q)
    assert sum(parent < 0) == 1
    assert sum(shared(i, p) for i, p in enumerate(parent) if p >= 0) == pytest.approx(best)


def test_label_model_without_votes_or_of_one_voter():
    for votes in (np.zeros((10, 3)), np.ones((10, 1)), np.eye(4)[:, :1]):
        q, odds, _ = toxicity.label_model(votes, 0.3)
        assert np.isfinite(q).all() and np.isfinite(odds).all() and ((0 <= q) & (q <= 1)).all()


def test_figures():
    assert quality.figures(None) == quality.figures(" \n") == [0.0] * quality.FIGURES
    assert len(quality.figures("a b")) == quality.FIGURES
    assert np.isfinite(quality.figures("x" * 100_000 + " \ud800 é")).all()


@pytest.mark.parametrize("labelled", [True, False])
def test_odd_documents(spark, odd, none, labelled):
    rows = [(4, 1, 0), (5, 1, 1), (5, 0, 1), (7, 1, 0), (8, 0, 0), (None, 1, 1), (6, None, None), (99, 1, 1)] if labelled else []
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    for module, learned in ((quality, quality.learn(odd, labels)), (toxicity, toxicity.learn(odd, labels))):
        found = module.score(odd, learned).collect()
        assert sorted(r.doc_id or 0 for r in found) == sorted(r.doc_id or 0 for r in odd.collect())
        assert all(0 <= r.score <= 1 for r in found)
        assert module.score(none, learned).count() == 0
        same = [r for r in found if r.doc_id == 5]
        assert same[0] == same[1]


def test_lexicon_alone(spark):
    docs = spark.createDataFrame([(1, "what an Idiot"), (2, "what a day"), (3, None)], "doc_id long, text string")
    model = toxicity.learn(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.doc_id: r.predicted for r in toxicity.score(docs, model).collect()} == {1: 1, 2: 0, 3: 0}


def test_no_labels_at_all(spark, none):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert quality.learn(none, labels) is None

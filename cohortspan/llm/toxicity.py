"""Toxicity by weak supervision.

Many weak voters look at a text: words of a fixed lexicon, words and word stems whose documents labels mark as
toxic far more often than others, and patterns of shouting. A generative label model estimates from the votes alone how
often each voter fires in toxic and in clean texts, by expectation maximisation. Correlations are modelled by a tree: a
voter's rates depend on whether its parent fires, so that a word and its stem are no two witnesses. Of the labels the
model is told only which share of texts is toxic. Its posterior labels
train a linear classifier on the votes and their number, which scores every whole text where it lies.

Voters, label model and classifier are fitted on a bounded sample of labelled rows; only pattern counts
above a floor and 0/1 votes reach the driver.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspan.llm.common import LETTER_WORDS, bounded_sample

#: Labelled rows at most that are learned from, toxic and clean.
TOXIC, CLEAN = 6_000, 12_000
#: Voters found in labels at most; toxic documents each must be in; how many times likelier in toxic than in clean ones.
VOTERS, LEAST_DOCUMENTS, LEAST_RATIO = 600, 5, 30.0
STEMS = (3, 4, 5, 6, 7, 8)
THRESHOLD = 0.5
#: Figures that sum up a text's votes.
SUMMARY = 5
# Insults of four languages that vote from the start.
LEXICON = (
    "bastard clown disgusting idiot imbecile jerk loser moron pathetic scum stupid trash worthless "
    "abschaum dumm dummkopf idioten trottel versager widerlich wertlos "
    "imbécile crétin ordure pathétique minable débile "
    "basura estúpido idiota imbécil patético escoria asqueroso"
).split()
SHOUTS = {"!capitals": re.compile(r"\b[A-Z]{4,}\s+[A-Z]{4,}\s+[A-Z]{4,}"), "!marks": re.compile(r"!{3,}|\?!")}


def patterns(text: str | None) -> set[str]:
    """The different words, stems (``abc*``) and shouts of a text."""
    if not text:
        return set()
    words = set(LETTER_WORDS.findall(text.lower()))
    found = words | {w[:n] + "*" for n in STEMS for w in words if len(w) > n}
    return found | {name for name, shape in SHOUTS.items() if shape.search(text)}


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class ToxicityModel:
    voters: list[str]
    odds: np.ndarray
    weights: np.ndarray  # one for each voter, then those of the summary of the votes
    number: dict[str, int] = field(init=False)

    def __post_init__(self) -> None:
        self.number = {v: i for i, v in enumerate(self.voters)}
        self.stems = frozenset(v for v in self.voters if v.endswith("*"))
        self.words = frozenset(self.voters) - self.stems

    def votes(self, text: str | None) -> list[int]:
        if not text:
            return []
        words = set(LETTER_WORDS.findall(text.lower()))
        fired = words & self.words
        for n in STEMS:
            fired |= {w[:n] + "*" for w in words if len(w) > n} & self.stems
        fired |= {name for name, shape in SHOUTS.items() if name in self.number and shape.search(text)}
        return sorted(self.number[v] for v in fired)

    def __call__(self, text: str | None) -> float:
        votes = self.votes(text)
        return float(_sigmoid(self.weights[votes].sum() + _summary(votes, self.odds) @ self.weights[len(self.voters) :]))


def _summary(fired: Sequence[int], odds: np.ndarray) -> np.ndarray:
    """Of a text's votes: the strongest log odds, the root of their sum, the logarithm of their number, any, and 1."""
    speaking = np.maximum(odds[list(fired)], 0.0)
    return np.array([speaking.max(initial=0.0), math.sqrt(speaking.sum()), math.log1p(len(fired)), float(len(fired) > 0), 1.0])


def dependencies(votes: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Each voter's parent, or -1: the tree of greatest mutual information of neighbours, given the class (toxic by ``q``)."""
    gain = np.zeros((votes.shape[1],) * 2)
    for weight in (q, 1 - q):
        total = weight.sum() + 1e-9
        both = votes.T @ (votes * weight[:, None]) / total
        one = np.diag(both).copy()
        a, b = one[:, None], one[None, :]
        for joint, apart in ((both, a * b), (a - both, a * (1 - b)), (b - both, (1 - a) * b), (1 - a - b + both, (1 - a) * (1 - b))):
            joint = np.maximum(joint, 1e-12)
            gain += total * joint * np.log(joint / np.maximum(apart, 1e-12))
    parent = np.full(len(gain), -1)
    reach, best, outside, node = parent.copy(), np.full(len(gain), -np.inf), np.ones(len(gain), bool), 0
    for _ in gain:
        outside[node], parent[node] = False, reach[node]
        closer = outside & (gain[node] > best)
        best[closer], reach[closer] = gain[node][closer], node
        node = int(np.argmax(np.where(outside, best, -np.inf)))
    return parent


def _balanced(evidence: np.ndarray, prior: float) -> np.ndarray:
    """Probabilities with these log odds, moved alike, of which the mean is ``prior``."""
    low, high = -100.0 - evidence.max(initial=0), 100.0 - evidence.min(initial=0)
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if _sigmoid(evidence + middle).mean() < prior else (low, middle)
    return _sigmoid(evidence + high)


def label_model(votes: np.ndarray, prior: float, passes: int = 10) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior probability that each row is toxic, each voter's log odds, and its parent in the tree of dependencies.

    ``prior`` is the share of toxic rows; no row's own label is known. To begin with, rows with most votes are taken for
    toxic, as many as that share. A voter that does not fire abstains; one that does never speaks for a clean text, whether its
    parent fires or not. How many fire is a witness of its own.
    """
    number = votes.sum(1)
    bucket = np.minimum(number, 4).astype(int)
    at = max(1.0, np.sort(number)[::-1][min(len(number) - 1, int(prior * len(number)))])
    q = np.where(number > at, 0.95, np.where(number == at, 0.7, 0.02))
    for _ in range(passes):
        parent = dependencies(votes, q)
        with_parent = votes * votes[:, np.maximum(parent, 0)] * (parent >= 0)
        fires = votes[:, np.maximum(parent, 0)] * (parent >= 0)
        overall = [(w @ votes + 0.1) / (w.sum() + 1) for w in (q, 1 - q)]
        together = [(w @ with_parent + o) / (w @ fires + 1) for w, o in zip((q, 1 - q), overall)]
        alone = [(w @ (votes - with_parent) + o) / (w @ (1 - fires) + 1) for w, o in zip((q, 1 - q), overall)]
        by_parent, by_itself = (np.maximum(np.log(toxic / clean), 0.0) for toxic, clean in (together, alone))
        counts = [np.bincount(bucket, w, 5) + 0.1 for w in (q, 1 - q)]
        said = np.log(counts[0] / counts[0].sum()) - np.log(counts[1] / counts[1].sum())
        before = q
        q = _balanced(with_parent @ by_parent + (votes - with_parent) @ by_itself + said[bucket], prior)
        if np.abs(q - before).mean() < 1e-4:
            break
    odds = np.log(((q @ votes + 0.1) / (q.sum() + 1)) / (((1 - q) @ votes + 0.5) / ((1 - q).sum() + 1)))
    return q, odds, parent


def fit_linear(votes: np.ndarray, odds: np.ndarray, q: np.ndarray, steps: int = 500, rate: float = 0.03) -> np.ndarray:
    """Weights of a logistic regression on votes and their summary that follows the posterior labels ``q``."""
    x = np.hstack((votes, np.array([_summary(np.flatnonzero(v), odds) for v in votes])))
    w, first, second = (np.zeros(x.shape[1]) for _ in range(3))
    for step in range(1, steps + 1):
        grad = x.T @ (_sigmoid(x @ w) - q) / len(x) + 1e-5 * w
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        w = w - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return w


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    known = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    toxic = bounded_sample(known.where("toxic = 1"), "doc_id", TOXIC)
    clean = bounded_sample(known.where("toxic = 0"), "doc_id", CLEAN)
    # Bounded by the sample's size, so that no text is shuffled for it.
    return docs.select("doc_id", "text").join(F.broadcast(toxic.unionByName(clean)), "doc_id")


def find_voters(rows: DataFrame) -> list[str]:
    """Words and stems of labelled rows (text, toxic) that tell toxic ones, best first."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held = {0: Counter(), 1: Counter()}
            for text, toxic in zip(batch["text"], batch["toxic"]):
                held[toxic].update(patterns(text))
            yield pd.DataFrame([(p, n * t, n * (1 - t)) for t, c in held.items() for p, n in c.items()], columns=["pattern", "toxic", "clean"])

    total = rows.agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean")).first()
    if not total["toxic"]:
        return []
    counts = rows.select("text", F.col("toxic").cast("long").alias("toxic")).mapInPandas(count, "pattern string, toxic long, clean long")
    counts = counts.groupBy("pattern").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    ratio = (F.col("toxic") / total["toxic"]) / ((F.col("clean") + 0.5) / (total["clean"] + 1))
    best = counts.where(F.col("toxic") >= LEAST_DOCUMENTS).withColumn("ratio", ratio).where(F.col("ratio") >= LEAST_RATIO)
    return [r["pattern"] for r in best.orderBy(F.desc(F.col("toxic") * F.log("ratio")), "pattern").limit(VOTERS).collect()]


def learn(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """A model from (doc_id, toxic) labels; toxic 1 is toxic.

    Labels choose the voters and tell the share of toxic texts; the label model is not told which rows are toxic.
    Null labels and null ids are left out, and a doc_id counts once, as toxic if it has both labels. Without
    toxic labels only the fixed lexicon votes, each word enough by itself.
    """
    rows = _labelled(docs, labels)
    voters = list(dict.fromkeys([*LEXICON, *SHOUTS, *find_voters(rows)]))
    flat = np.zeros(len(voters))
    blank = ToxicityModel(voters, flat, np.zeros(len(voters) + SUMMARY))

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"toxic": batch["toxic"], "votes": [blank.votes(t) for t in batch["text"]]})

    cast = rows.select("text", F.col("toxic").cast("long").alias("toxic"))
    seen = cast.mapInPandas(vote, "toxic long, votes array<int>").toPandas()
    if not len(seen) or not seen["toxic"].any():
        lexicon = [4.0 if v in LEXICON else 0.0 for v in voters]
        return ToxicityModel(voters, flat, np.array([*lexicon, *[0.0] * (SUMMARY - 1), -2.0]))
    votes = np.zeros((len(seen), len(voters)))
    for i, fired in enumerate(seen["votes"]):
        votes[i, list(fired)] = 1
    q, odds, _ = label_model(votes, float((seen["toxic"] == 1).mean()))
    return ToxicityModel(voters, odds, fit_linear(votes, odds, q))


def score(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score and predicted of every row. A null or empty text gets no vote. Repeated rows are scored each."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": [model(t) for t in batch["text"]]})

    scored = rows.mapInPandas(work, "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))

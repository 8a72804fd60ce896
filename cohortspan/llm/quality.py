"""Quality scores by positive-unlabelled learning.

Trusted positives and unlabelled web text train a small network on what a text looks like, by minimising the
non-negative unbiased risk: the unlabelled text's risk of being taken for bad, less the part that positives
among it account for, is never let below zero. Labels of bad documents train nothing; they only enter the class
prior, which is the share of good documents among the labelled.

The network is fitted on a bounded sample, the only rows that reach the driver, as figures. Every text is
then scored whole where it lies.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspan.llm.common import bounded_sample

#: Rows at most of trusted positives and of unlabelled text that the network is fitted on.
POSITIVES, UNLABELLED = 8_000, 16_000
HIDDEN, STEPS, RATE, SEED = 12, 400, 0.02, 7
#: Scores from here on are good.
THRESHOLD = 0.3

_CLASSES = {
    "upper": range(0x41, 0x5B),
    "lower": range(0x61, 0x7B),
    "digit": range(0x30, 0x3A),
    "space": [0x20, *range(0x09, 0x0E)],
    "line": [0x0A],
    "stop": b".,;:'\"-()",
    "loud": b"!?",
    "bar": b"|",
    "symbol": b"#$%&*@^~_=+<>{}[]\\/`",
    "beyond": range(0x80, 0x100),
}
_MEMBER = np.zeros((256, len(_CLASSES)))
for _i, _bytes in enumerate(_CLASSES.values()):
    _MEMBER[list(_bytes), _i] = 1
FIGURES = len(_CLASSES) + 10


def figures(text: str | None) -> list[float]:
    """What a text looks like: shares of kinds of characters, lengths, repeats. All 0 for a text without words."""
    words = text.split() if text else []
    if not words:
        return [0.0] * FIGURES
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    shares = np.bincount(data, minlength=256) @ _MEMBER / len(data)
    n, seen = len(words), Counter(words)
    lines = text.split("\n")
    return [
        *shares.tolist(),
        math.log(n),
        len(text) / n,
        math.log(len(seen) + 1) / math.log(n + 1),
        sum(map(eq, words, words[1:])) / n,
        max(seen.values()) / n,
        sum(map(str.isupper, words)) / n,
        sum(map(str.isalpha, words)) / n,
        1 - len(set(lines)) / len(lines),
        math.log(len(lines)),
        sum(w[-1] in "!#$%&*|" for w in words) / n,
    ]


@dataclass
class QualityModel:
    mean: np.ndarray
    spread: np.ndarray
    weights: list[np.ndarray]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return 1 / (1 + np.exp(-_network((x - self.mean) / self.spread, self.weights)[1]))


def _network(x: np.ndarray, weights: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    a, b, c, d = weights
    inner = np.tanh(x @ a + b)
    return inner, np.clip(inner @ c + d[0], -30, 30)


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = STEPS) -> QualityModel:
    """Minimise prior * E+[l(g)] + max(0, Eu[l(-g)] - prior * E+[l(-g)]) with the sigmoid loss, by Adam."""
    mean, spread = unlabelled.mean(0), unlabelled.std(0) + 1e-6
    p, u = (positive - mean) / spread, (unlabelled - mean) / spread
    rng = np.random.default_rng(SEED)
    weights = [rng.normal(0, 0.3, (p.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.3, HIDDEN), np.zeros(1)]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    x = np.concatenate((p, u))
    is_p = np.arange(len(x)) < len(p)
    for step in range(1, steps + 1):
        inner, g = _network(x, weights)
        s = 1 / (1 + np.exp(-g))  # the loss of taking a text for bad, l(-g); l(g) is 1 - s
        slope = s * (1 - s)
        negative = s[~is_p].mean() - prior * s[is_p].mean()
        push = np.where(is_p, -prior / len(p), 0.0)
        bad = np.where(is_p, -prior / len(p), 1 / len(u))
        # Where the estimate of the negative risk has gone below zero, its own rise is what is sought.
        push = push + bad if negative >= 0 else -bad
        dg = push * slope
        back = np.outer(dg, weights[2]) * (1 - inner**2)
        grads = [x.T @ back, back.sum(0), inner.T @ dg, np.array([dg.sum()])]
        for i, grad in enumerate(grads):
            grad = grad + 1e-4 * weights[i]
            first[i] = 0.9 * first[i] + 0.1 * grad
            second[i] = 0.999 * second[i] + 0.001 * grad**2
            weights[i] = weights[i] - RATE * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return QualityModel(mean, spread, weights)


def _figures_frame(rows: DataFrame) -> DataFrame:
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"x": [figures(t) for t in batch["text"]]})

    return rows.select("text").mapInPandas(work, "x array<double>")


def learn(docs: DataFrame, labels: DataFrame) -> QualityModel | None:
    """A model from (doc_id, quality) labels; quality 1 is good. None without a good document or without text.

    Null labels and null ids are left out, and a doc_id counts once, as bad if it has both labels.
    """
    known = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    shares = known.agg(F.count(F.lit(1)).alias("n"), F.sum("quality").alias("good")).first()
    if not shares["good"]:
        return None
    prior = min(0.95, max(0.05, shares["good"] / shares["n"]))
    chosen = bounded_sample(known.where("quality = 1").select("doc_id"), "doc_id", POSITIVES)
    # Bounded by the sample's size, so that no text is shuffled for it.
    positive = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id", "left_semi")
    others = bounded_sample(docs.select("doc_id"), "doc_id", UNLABELLED).distinct()
    unlabelled = docs.select("doc_id", "text").join(F.broadcast(others), "doc_id", "left_semi")
    p, u = (np.array(_figures_frame(rows).toPandas()["x"].tolist(), float).reshape(-1, FIGURES) for rows in (positive, unlabelled))
    return fit(p, u, prior) if len(p) and len(u) else None


def is_good(model: QualityModel, texts: list[str | None], threshold: float = THRESHOLD) -> list[bool]:
    return (model(np.array([figures(t) for t in texts], float).reshape(-1, FIGURES)) >= threshold).tolist()


def score(docs: DataFrame, model: QualityModel | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score and predicted of every row. Null and empty texts look like nothing and are scored as such.

    Without a model every score is 0.5. Repeated rows are scored each.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if model is None:
        scored = rows.select("doc_id", F.lit(0.5).alias("score"))
    else:

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                x = np.array([figures(t) for t in batch["text"]], float).reshape(-1, FIGURES)
                yield pd.DataFrame({"doc_id": batch["doc_id"], "score": model(x)})

        scored = rows.mapInPandas(work, "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))

"""Ranked lexical search of many queries at once, with common parts of queries evaluated once.

Queries are sets of weighted terms, and a document's score is a sum over them, so what two queries share is a
partial sum. Pairs of terms that several queries hold are mined and become nodes; queries hold the node instead,
and nodes are paired again, until no pair is shared. The nodes form an acyclic graph above the terms. For a run of documents
every node's accumulator (a row with a number for each document) is the sum of its two parts', computed once, and
a query's scores are the sum of the few accumulators it is left with.

Documents are read twice: to count terms, of which those in any query are kept with the document, and to score.
Queries go in blocks of bounded size; each block is sent to all tasks, and documents are scored where they lie. A task passes
on its best documents for each query.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortspan.sources.staging import stage

#: Results for each query.
TOP = 10
#: Bytes of text of a block of queries, about; a longer query is a block by itself.
BLOCK = 1_000_000
#: A term is paired with so many others of its query, by rank of frequency.
NEIGHBOURS = 32
#: Numbers in the accumulators of a run of documents.
CELLS = 1 << 22
#: Parts into which a query's candidates are dealt before the last choice.
DEAL = 32

# Digits, letters and what is beyond ASCII make terms, A-Z are lower-cased. In UTF-8 all bytes beyond ASCII are above 0x7F.
_TERMS = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TERMS).split() if text else []


# --- the graph that queries share ---


@dataclass
class Graph:
    """Symbols are numbered: terms, then terms taken several times, then nodes, each after its two parts."""

    terms: list[bytes]
    repeated: list[tuple[int, int]] = field(default_factory=list)  # term, times
    nodes: list[tuple[int, int]] = field(default_factory=list)
    queries: list[list[int]] = field(default_factory=list)  # symbols to sum

    def __post_init__(self) -> None:
        first = len(self.terms) + len(self.repeated)
        # Nodes of one level depend on lower ones only, so a level is one addition of arrays.
        level = np.zeros(first + len(self.nodes), np.int64)
        for i, (a, b) in enumerate(self.nodes, start=first):
            level[i] = 1 + max(level[a], level[b])
        parts = np.array(self.nodes, np.int64).reshape(-1, 2)
        own = level[first:]
        self.levels = [(first + at, parts[at, 0], parts[at, 1]) for k in range(1, int(level.max(initial=0)) + 1) for at in [np.flatnonzero(own == k)]]
        self.size = first + len(self.nodes)
        self.flat = np.array([s for q in self.queries for s in q], np.int64)
        self.begins = np.cumsum([0, *map(len, self.queries)])[:-1]
        self.additions = len(self.nodes) + len(self.flat)


def share(queries: Sequence[dict[bytes, int]]) -> Graph:
    """The graph of these queries, each a term's number of occurrences. None may be empty."""
    held_by = Counter(term for q in queries for term in q)
    terms = sorted(held_by, key=lambda t: (-held_by[t], t))
    number = {t: i for i, t in enumerate(terms)}
    repeated: dict[tuple[int, int], int] = {}

    def symbol(term: bytes, times: int) -> int:
        own = number[term]
        return own if times == 1 else repeated.setdefault((own, times), len(terms) + len(repeated))

    now = [{symbol(t, n) for t, n in q.items()} for q in queries]
    first, nodes = len(terms) + len(repeated), []
    while True:
        frequency = Counter(s for q in now for s in q)
        pairs: dict[tuple[int, int], list[int]] = defaultdict(list)
        for i, q in enumerate(now):
            common = sorted((s for s in q if frequency[s] > 1), key=lambda s: (-frequency[s], s))
            if len(common) <= NEIGHBOURS:
                found = combinations(common, 2)
            else:
                found = ((a, b) for k, a in enumerate(common) for b in common[k + 1 : k + NEIGHBOURS])
            for pair in found:
                pairs[pair].append(i)
        grown: list[set[int]] = [set() for _ in now]
        before = len(nodes)
        for pair in sorted((p for p in pairs if len(pairs[p]) > 1), key=lambda p: (-len(pairs[p]), p)):
            users = [i for i in pairs[pair] if now[i].issuperset(pair)]
            if len(users) > 1:
                for i in users:
                    now[i].difference_update(pair)
                    grown[i].add(first + len(nodes))
                nodes.append(pair)
        now = [q | new for q, new in zip(now, grown)]
        if len(nodes) == before:
            return Graph(terms, list(repeated), nodes, [sorted(q) for q in now])


def accumulate(graph: Graph, by_term: np.ndarray) -> np.ndarray:
    """Scores (queries x documents) from what each term adds to each document."""
    acc = np.empty((graph.size, by_term.shape[1]), np.int64)
    acc[: len(graph.terms)] = by_term
    for i, (term, times) in enumerate(graph.repeated, start=len(graph.terms)):
        acc[i] = by_term[term] * times
    for own, a, b in graph.levels:
        acc[own] = acc[a] + acc[b]
    return np.add.reduceat(acc[graph.flat], graph.begins, axis=0)


# --- documents ---


def _matched(graph: Graph):
    number = {t: i for i, t in enumerate(graph.terms)}

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n, terms, counts = [], [], []
            for text in batch["text"]:
                found = Counter(terms_of(text))
                held = found.keys() & number.keys()
                n.append(found.total())
                terms.append([number[t] for t in held])
                counts.append([found[t] for t in held])
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n": n, "terms": terms, "counts": counts})

    return work


class _Best:
    """The foremost documents of each query among those seen: highest score, then smallest id, a missing id first."""

    def __init__(self, queries: int, top: int):
        self.top, self.least = top, np.ones(queries, np.int64)
        self.query = self.score = self.doc = np.zeros(0, np.int64)
        self.known = np.zeros(0, bool)

    def add(self, scores: np.ndarray, docs: np.ndarray, known: np.ndarray) -> None:
        query, at = np.nonzero(scores >= self.least[:, None])
        query, score = np.concatenate((self.query, query)), np.concatenate((self.score, scores[query, at]))
        doc, known = np.concatenate((self.doc, docs[at])), np.concatenate((self.known, known[at]))
        order = np.lexsort((doc, known, -score, query))
        query = query[order]
        begins = np.searchsorted(query, query, side="left")
        keep = np.arange(len(query)) - begins < self.top
        order = order[keep]
        self.query, self.score, self.doc, self.known = query[keep], score[order], doc[order], known[order]
        # Once there are enough, a document needs the score of the last of them.
        full, last = np.unique(self.query, return_counts=True), np.searchsorted(self.query, np.arange(len(self.least)), side="right") - 1
        enough = full[0][full[1] == self.top]
        self.least[enough] = self.score[last[enough]]


def _score(graph: Graph, rows: list[int], weights: np.ndarray, n_docs: int, n_terms: int, top: int):
    width = max(16, CELLS // graph.size)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = _Best(len(rows), top)
        for batch in batches:
            for a in range(0, len(batch), width):
                part = batch.iloc[a : a + width]
                sizes = part["terms"].map(len).to_numpy()
                if not sizes.sum():
                    continue
                doc = np.repeat(np.arange(len(part)), sizes)
                term = np.concatenate([np.asarray(x, np.int64) for x in part["terms"]])
                tf = np.concatenate([np.asarray(x, np.int64) for x in part["counts"]])
                # In whole numbers of any size, as n * N may pass 64 bits.
                m = np.array([25 + 75 * n * n_docs // n_terms for n in map(int, part["n"])], np.int64)
                by_term = np.zeros((len(graph.terms), len(part)), np.int64)
                by_term[term, doc] = weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
                known = part["doc_id"].notna().to_numpy()
                best.add(accumulate(graph, by_term), part["doc_id"].fillna(0).to_numpy(np.int64), known)
        doc_ids = pd.array(best.doc, "Int64")
        doc_ids[~best.known] = pd.NA
        yield pd.DataFrame({"item": np.array(rows, np.int64)[best.query], "doc_id": doc_ids, "score": best.score})

    return work


def _blocks(queries: DataFrame) -> tuple[DataFrame, int]:
    """item (a number), item_id and text, staged, with ``block``; and how many blocks there are."""
    rows = stage(queries.select(F.monotonically_increasing_id().alias("item"), "item_id", "text"), "search-items")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + size // BLOCK
    return rows.withColumn("block", F.expr(f"pmod(xxhash64(item), {blocks})")), blocks


def search(docs: DataFrame, queries: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id and score of the ``top`` documents of each row of ``queries`` (item_id, text).

    Equal scores rank by doc_id, a missing one first; only scores above 0 count. Null texts and texts without terms
    neither match nor are matched. Repeated queries are answered each, repeated documents ranked each. Weights, counts and lengths cover all documents.
    """
    spark = docs.sparkSession
    items, blocks = _blocks(queries)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL")
    found = []
    for block in range(blocks):
        asked = [(r["item"], q) for r in items.where(F.col("block") == block).collect() if (q := Counter(terms_of(r["text"])))]
        if not asked:
            continue
        graph = share([q for _, q in asked])
        sent = spark.sparkContext.broadcast(graph)
        matched = texts.mapInPandas(lambda batches, sent=sent: _matched(sent.value)(batches), "doc_id long, n long, terms array<int>, counts array<int>")
        matched = stage(matched, "search-terms")
        total = matched.agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("terms")).first()
        if not total["docs"]:
            break
        # At most as many rows as the block has terms.
        held = matched.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()
        weights = np.zeros(len(graph.terms), np.int64)
        for row in held:
            weights[row["term"]] = math.floor(1000 * math.log((2 * total["docs"] + 2) / (2 * row["df"] + 1)))
        rows = [i for i, _ in asked]

        def score(batches, sent=sent, rows=rows, weights=weights, n=int(total["docs"]), terms=int(total["terms"])):
            return _score(sent.value, rows, weights, n, terms, top)(batches)

        found.append(matched.mapInPandas(score, "item long, doc_id long, score long"))
    if not found:
        found = [spark.createDataFrame([], "item long, doc_id long, score long")]
    best = found[0]
    for more in found[1:]:
        best = best.union(more)
    best = best.withColumn("deal", F.spark_partition_id() % DEAL)
    order = [F.desc("score"), F.asc_nulls_first("doc_id")]
    # Twice, so that a query's candidates of all tasks need not meet at once.
    for by in (["item", "deal"], ["item"]):
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= top)
    return best.join(items.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")

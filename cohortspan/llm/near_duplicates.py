"""Near-duplicates by an inverted join over MinHash signature coordinates.

Each different shingle set is posted under its signature's coordinate-value pairs. Two sets as alike as asked
for agree in at least ``matches_for(alike)`` coordinates but for at most ``MISSED`` of the pairs, so

- a set whose shared coordinates are fewer is skipped whole,
- of the others only a prefix is posted, the rarest shared coordinates that leave out all but one of so many:
  two sets that agree often enough meet in it,
- postings of one coordinate are not paired with each other. They are merged with its most connected set
  first; sets already in one component are skipped, and only sets left outside are paired with the others.

Of two sets that meet, the coordinates in which they collide are counted on their signatures; pairs with fewer than the
threshold go, and the others are checked on full shingle sets. Before that, shingles that no other candidate has bound how
alike two sets can be, which spares nearly all of the pairs of a large group whose members drifted apart.
Equal sets are one node throughout, so exact copies cost nothing but their own row.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspan.llm.common import mixed, shingle_sets
from cohortspan.llm.components import components
from cohortspan.llm.languages import batched
from cohortspan.sources.staging import stage

#: Words of a shingle, and the least 100 * intersection / union of linked sets.
SHINGLE, ALIKE = 5, 85
#: Coordinates of a signature, and the share of linked pairs that may agree in too few of them to be compared.
COORDINATES, MISSED = 96, 2e-7
#: Characters of text that a task works on at once, and candidates whose ids are broadcast at most.
AT_ONCE, SENT = 400_000, 2_000_000

_rng = np.random.default_rng(20)
_XOR = _rng.integers(0, 1 << 64, COORDINATES, dtype=np.uint64)
_TIMES = _rng.integers(0, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def matches_for(alike: int) -> int:
    """Coordinates that two sets must agree in to be compared: fewer agree in at most ``MISSED`` of the pairs at the limit."""
    p, below = alike / 100, 0.0
    for n in range(COORDINATES):
        below += comb(COORDINATES, n) * p**n * (1 - p) ** (COORDINATES - n)
        if below > MISSED:
            return max(1, n)
    return COORDINATES


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of coordinate-value pairs for each nonempty set; pairs of different coordinates are never equal by design."""
    together = np.concatenate(sets)
    begins = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), COORDINATES), np.uint64)
    for j in range(COORDINATES):
        out[:, j] = np.minimum.reduceat((together ^ _XOR[j]) * _TIMES[j], begins)
    return mixed(out + np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _signed(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, set_key (a digest of the set) and signature of each row; null key and signature for empty sets."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at = 0
            for part in batched(batch["text"].tolist(), AT_ONCE):
                sets = shingle_sets([t or "" for t in part], size)
                full = [s for s in sets if len(s)]
                rows = iter(signatures(full) if full else ())
                yield pd.DataFrame(
                    {
                        "doc_id": batch["doc_id"].iloc[at : at + len(part)],
                        "n_shingles": [len(s) for s in sets],
                        "set_key": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
                        "signature": [next(rows) if len(s) else None for s in sets],
                    }
                )
                at += len(part)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInPandas(sign, "doc_id long, n_shingles long, set_key binary, signature array<long>")


def _sets(docs: DataFrame, size: int) -> DataFrame:
    def shingle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at = 0
            for part in batched(batch["text"].tolist(), AT_ONCE):
                sets = [s.view(np.int64) for s in shingle_sets([t or "" for t in part], size)]
                yield pd.DataFrame({"doc": batch["doc_id"].iloc[at : at + len(part)], "shingles": sets})
                at += len(part)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(shingle, "doc long, shingles array<long>")


def postings(signed: DataFrame, matches: int) -> DataFrame:
    """(pair, doc, links): the prefixes of sets that share enough coordinates.

    ``links`` says how connected a set is: how often its coordinate-value pairs occur over all sets.
    """
    posts = signed.select("doc", F.explode("signature").alias("pair"))
    # Counted on the map side first, and joined back: adaptive execution splits the posts of a hot pair.
    held = posts.groupBy("pair").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1")
    shared = posts.join(held, "pair")
    ranked = shared.selectExpr(
        "pair",
        "doc",
        "count(1) OVER (PARTITION BY doc) AS n",
        "sum(sets) OVER (PARTITION BY doc) AS links",
        "row_number() OVER (PARTITION BY doc ORDER BY sets, pair) AS place",
    )
    return ranked.where(f"n >= {matches} AND place <= n - {matches} + 1").select("pair", "doc", "links")


def _may_link(x: str, y: str, alike: int, own: str = "own") -> str:
    """Whether sets of n shingles can be alike enough, if the other one lacks those counted in ``own``."""
    both = f"least({x}.n - {x}.{own}, {y}.n - {y}.own)"
    return f"100 * {both} >= {alike} * greatest({x}.n + {y}.own, {y}.n + {x}.{own}, {x}.n + {y}.n - {both})"


def _lacking(outside: DataFrame, grouped: DataFrame, sets: DataFrame) -> DataFrame:
    """(doc, main, lacks): how many shingles of an outside set no member of a component has, if any.

    A component's members are its linked sets, or the one set that it is named after.
    """
    mains = outside.select(F.col("main").alias("component")).distinct()
    members = grouped.join(mains, "component", "left_semi").select("doc", "component")
    members = members.union(mains.select(F.col("component").alias("doc"), "component")).distinct()
    held = members.join(sets, "doc").select(F.col("component").alias("main"), F.explode("shingles").alias("shingle")).distinct()
    wanted = outside.join(sets, "doc").select("doc", "main", F.explode("shingles").alias("shingle"))
    return wanted.join(held, ["main", "shingle"], "left_anti").groupBy("doc", "main").agg(F.count(F.lit(1)).alias("lacks"))


def colliding(pairs: DataFrame, signed: DataFrame, matches: int) -> DataFrame:
    """The pairs (a, b) whose signatures (doc, signature) agree in at least ``matches`` coordinates."""
    first = signed.select(F.col("doc").alias("a"), F.col("signature").alias("s"))
    second = signed.select(F.col("doc").alias("b"), F.col("signature").alias("t"))
    # Values carry their coordinate, so that those in common are the coordinates that agree.
    agreeing = F.size(F.array_intersect("s", "t"))
    return pairs.join(first, "a").join(second, "b").where(agreeing >= matches).select("a", "b")


def linked(pairs: DataFrame, sets: DataFrame, alike: int) -> DataFrame:
    """The pairs (a, b) whose full sets are alike enough."""
    first = sets.select(F.col("doc").alias("a"), F.col("shingles").alias("s"))
    second = sets.select(F.col("doc").alias("b"), F.col("shingles").alias("t"))
    return (
        pairs.join(first, "a")
        .join(second, "b")
        .selectExpr("a", "b", "size(s) + size(t) AS total", "size(array_intersect(s, t)) AS shared")
        .where(f"100 * shared >= {alike} * (total - shared)")
        .select("a", "b")
    )


def cluster(docs: DataFrame, size: int = SHINGLE, alike: int = ALIKE, matches: int | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row: kept is the document with the component's smallest id.

    ``alike`` is the least 100 * intersection / union of linked sets; ``matches`` follows from it.

    Words end at ASCII white space, A-Z are lower-cased. A text of fewer words than a shingle has one shingle of
    all of them; null, empty and blank texts have none and link with nothing. Rows with one doc_id and different
    texts link each by their text. A row without doc_id links with nothing, has no component and is kept.
    """
    matches = matches_for(alike) if matches is None else matches
    signed = stage(_signed(docs, size), "signatures")
    classes = signed.where("set_key IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("doc"))
    classes = stage(classes, "classes")
    firsts = signed.select("doc_id", "set_key", "signature").join(
        classes.withColumnRenamed("set_key", "k"), (F.col("doc_id") == F.col("doc")) & (F.col("set_key") == F.col("k"))
    )
    firsts = firsts.dropDuplicates(["set_key"]).select("doc", "signature")
    posted = stage(postings(firsts, matches), "postings")
    wanted = stage(posted.select("doc").distinct(), "candidates")
    # One id each; beyond the bound the texts are shuffled to the ids instead.
    chosen = F.broadcast(wanted) if wanted.count() <= SENT else wanted
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL")
    signs = stage(firsts.join(chosen, "doc", "left_semi"), "candidate-signatures")
    sets = stage(_sets(texts.join(chosen, F.col("doc_id") == F.col("doc"), "left_semi"), size), "sets")

    own = sets.select("doc", F.explode("shingles").alias("shingle")).groupBy("shingle")
    own = own.agg(F.count(F.lit(1)).alias("holders"), F.min("doc").alias("doc")).where("holders = 1").groupBy("doc").agg(F.count(F.lit(1)).alias("own"))
    sizes = sets.select("doc", F.size("shingles").alias("n")).join(own, "doc", "left").selectExpr("doc", "n", "coalesce(own, 0) AS own")
    # A set's own shingles alone can rule out any link.
    sizes = stage(sizes.where(f"100 * (n - own) >= {alike} * n"), "sizes")

    near = stage(posted.join(sizes, "doc"), "postings")
    hubs = near.groupBy("pair").agg(F.max(F.struct("links", F.col("doc").alias("hub"), F.col("n").alias("hub_n"), F.col("own").alias("hub_own"))).alias("h"))
    hubs = hubs.select("pair", "h.hub", F.col("h.hub_n").alias("n"), F.col("h.hub_own").alias("own"))
    spokes = near.alias("x").join(hubs.alias("y"), F.expr(f"x.pair = y.pair AND x.doc <> y.hub AND {_may_link('x', 'y', alike)}"))
    spokes = spokes.select(F.col("x.doc").alias("a"), F.col("y.hub").alias("b")).distinct()
    links = stage(linked(colliding(spokes, signs, matches), sets, alike), "links")

    grouped = components(links).withColumnRenamed("node", "doc")
    prefixes = near.groupBy("doc").agg(F.collect_list("pair").alias("prefix"))
    placed = near.join(prefixes, "doc").join(grouped, "doc", "left")
    placed = placed.selectExpr("pair", "doc", "n", "own", "prefix", "coalesce(component, doc) AS component")
    placed = stage(placed.join(hubs.select("pair", "hub"), "pair"), "postings")
    main = placed.where("doc = hub").selectExpr("pair", "component AS main").distinct()
    outside = placed.join(main, "pair").where("component <> main")
    lacking = _lacking(outside.select("doc", "main").distinct(), grouped, sets)
    outside = outside.join(lacking, ["doc", "main"], "left").selectExpr("*", "greatest(own, coalesce(lacks, 0)) AS apart")
    # Of the postings in which two sets meet only the first one pairs them.
    rest = outside.alias("x").join(
        placed.alias("y"),
        F.expr(
            f"""x.pair = y.pair AND x.component <> y.component AND y.doc <> y.hub
            AND {_may_link('x', 'y', alike)}
            AND (y.component <> x.main OR {_may_link('x', 'y', alike, own='apart')})
            AND (y.component = x.main OR x.doc < y.doc)
            AND x.pair = array_min(array_intersect(x.prefix, y.prefix))"""
        ),
    )
    rest = rest.select(F.least("x.doc", "y.doc").alias("a"), F.greatest("x.doc", "y.doc").alias("b")).distinct()
    found = components(links.union(linked(colliding(rest, signs, matches), sets, alike)))

    named = signed.select("doc_id", "n_shingles", "set_key").join(classes, "set_key", "left").join(found, F.col("doc") == F.col("node"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc", "doc_id"))
    return named.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


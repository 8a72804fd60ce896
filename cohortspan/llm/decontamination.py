"""Benchmark decontamination with a positional inverted index.

Passages of benchmark items are searched for in all documents. For each window of an item its rarest term is
looked up first, rarest over all documents. The index stores the postings of these terms: document, position
and the words around it. In a posting the lists of the window's other terms, each moved by its offset from the
rarest, meet at one place, so they are intersected by comparing the words on both sides, nearest first, without
another shuffle. Common terms need no postings of their own, and no window is lost: whatever contains
a window contains its rarest term.

DataFrame functions only. Texts are split twice, to count terms and to look them up. Words are exploded next to a broadcast of the looked-up terms, at most ``BLOCK`` at a
time; a larger benchmark is looked up in so many passes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspan.llm.common import ascii_lower
from cohortspan.sources.staging import stage

#: Words are runs of digits, letters a-z after lower-casing A-Z, and characters beyond ASCII. This is what lies between them.
APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a window, and terms broadcast at once.
WINDOW, BLOCK = 13, 100_000


def words_of(text: Column) -> Column:
    # Splitting takes a fifth of the time of extracting each word. It leaves an empty one where a text begins or ends with other signs.
    return F.array_remove(F.split(ascii_lower(text), APART, -1), "")


def _documents(docs: DataFrame) -> DataFrame:
    """doc_id, a number that tells apart texts of one doc_id, and words; null where there is no text."""
    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), words_of(F.col("text")).alias("words"))


def _items(items: DataFrame) -> DataFrame:
    """item_key, item_id and words of each different item that has words."""
    split = items.select("item_id", words_of(F.col("text")).alias("words")).where("size(words) > 0")
    return split.withColumn("item_key", F.xxhash64("item_id", F.concat_ws(" ", "words"))).dropDuplicates(["item_key"])


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n): occurrences over all documents of each listed term that occurs."""
    tokens = docs.select(F.explode_outer(words_of(F.col("text"))).alias("term"))
    return tokens.join(terms, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def anchors(items: DataFrame, counts: DataFrame, window: int) -> DataFrame:
    """The places in items that must be looked up: each window's rarest term, once however many windows share it.

    item_key, item_id, term, the words before it (nearest first) and after it that windows can reach, and the
    length of the item's windows. Windows with a term that no document has are left out.
    """
    short = F.least(F.lit(window), F.size("words"))
    starts = items.select(
        "item_key", "item_id", "words", short.alias("need"), F.explode(F.sequence(F.lit(0), F.size("words") - short)).alias("start")
    )
    placed = starts.select("item_key", "need", "start", F.posexplode(F.slice("words", F.col("start") + 1, F.col("need"))).alias("at", "term"))
    rarest = (
        placed.join(counts, "term")
        .groupBy("item_key", "start", "need")
        .agg(F.min(F.struct("n", "term", (F.col("start") + F.col("at")).alias("place"))).alias("rarest"), F.count(F.lit(1)).alias("found"))
        .where("found = need")
        .select("item_key", "rarest.term", "rarest.place", "need")
        .distinct()
    )
    reach = window - 1
    return rarest.join(items, "item_key").selectExpr(
        "item_key",
        "item_id",
        "term",
        "need",
        f"reverse(slice(words, greatest(place - {reach}, 0) + 1, least(place, {reach}))) AS item_before",
        f"slice(words, place + 2, {reach}) AS item_after",
    )


def postings(docs: DataFrame, terms: DataFrame, around: int, sized: bool = False) -> DataFrame:
    """The index: term, doc_id, text_key, pos, and up to ``around`` words before it (nearest first) and after it.

    If ``sized``, each row of ``docs`` also has its n_words in one row, that of its first word or one without pos; other
    rows have none there. If no term is looked up in that row, term and words are null.
    """
    known = terms.select(F.col("term").alias("known")).distinct()
    blocks = -(-known.count() // BLOCK)
    parts = []
    # The outer form keeps Spark from splitting each text once more for a filter on the array's size.
    tokens = _documents(docs).select("doc_id", "text_key", "words", F.posexplode_outer("words").alias("pos", "term"))
    for i in range(max(1, blocks)):
        block = known if blocks < 2 else known.where(F.pmod(F.xxhash64("known"), F.lit(blocks)) == i)
        counting = sized and i == 0
        found = tokens.join(F.broadcast(block), F.col("term") == F.col("known"), "left" if counting else "inner")
        first = "coalesce(pos, 0) = 0" if counting else "false"
        parts.append(
            found.where(f"known IS NOT NULL OR {first}").selectExpr(
                "known AS term",
                "doc_id",
                "text_key",
                "pos",
                f"if(known IS NULL, NULL, reverse(slice(words, greatest(pos - {around}, 0) + 1, least(pos, {around})))) AS before",
                f"if(known IS NULL, NULL, slice(words, pos + 2, {around})) AS after",
                *([f"if({first}, greatest(size(words), 0), NULL) AS n_words"] if sized else []),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def _agreeing(a: str, b: str) -> str:
    """How many of the first elements of two arrays are equal."""
    differs = f"array_position(zip_with({a}, {b}, (x, y) -> x <=> y), false)"
    return f"if({differs} > 0, int({differs}) - 1, size({a}))"


def phrase_matches(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Where documents repeat items: doc_id, text_key, item_id, and the words begin (included) to end (not included).

    Each row is a run of at least ``window`` item words, or a whole shorter item; runs may overlap.
    """
    return _runs(*_looked_up(docs, items, window, sized=False))


def _looked_up(docs: DataFrame, items: DataFrame, window: int, sized: bool) -> tuple[DataFrame, DataFrame]:
    """The index of what the items look up, and their anchors."""
    split = stage(_items(items), "benchmark-items")
    terms = split.select(F.explode("words").alias("term")).distinct()
    counts = stage(term_counts(docs, stage(terms, "benchmark-terms")), "benchmark-counts")
    wanted = stage(anchors(split, counts, window), "benchmark-anchors")
    return stage(postings(docs, wanted, window - 1, sized), "postings"), wanted


def _runs(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """Where the words around a posting agree with those around an anchor of its term far enough."""
    return (
        index.join(wanted, "term")
        .selectExpr("*", f"{_agreeing('item_before', 'before')} AS l", f"{_agreeing('item_after', 'after')} AS r")
        .where("l + r + 1 >= need")
        .selectExpr("doc_id", "text_key", "item_id", "pos - l AS begin", "pos + r + 1 AS end")
        .distinct()
    )


def proximity_matches(docs: DataFrame, items: DataFrame, terms: int = 3, span: int = 20) -> DataFrame:
    """Where the ``terms`` rarest terms of an item stand together, in any order: doc_id, item_id, begin, end.

    The rarest is the first looked up, and the others must lie less than ``span`` words from it; of equally rare terms
    the smaller one is taken. ``begin`` and ``end`` enclose all of their places there. Items of which a chosen term occurs
    nowhere, and items with fewer different terms, do not match. Null texts and items have no words, equal rows
    of either table count once in the result, and a null id is a value like any other.
    """
    split = stage(_items(items), "benchmark-items")
    each = split.select("item_key", "item_id", F.explode("words").alias("term")).distinct()
    counts = term_counts(docs, stage(each.select("term").distinct(), "benchmark-terms"))
    ranked = each.join(counts, "term", "left").selectExpr(
        "item_key", "item_id", "term", "row_number() OVER (PARTITION BY item_key ORDER BY coalesce(n, 0), term) AS rank"
    )
    wanted = stage(ranked.where(F.col("rank") <= terms), "benchmark-rarest")
    # Equal rows have equal places, which would meet each other.
    index = stage(postings(docs, wanted, 0).select("term", "doc_id", "text_key", "pos").distinct(), "postings")
    placed = index.join(wanted, "term").withColumn("cell", F.floor(F.col("pos") / span))
    first = placed.where("rank = 1").select(
        "doc_id", "text_key", "item_key", F.col("pos").alias("at"), F.explode(F.expr("array(cell - 1, cell, cell + 1)")).alias("cell")
    )
    if terms == 1:
        return placed.selectExpr("doc_id", "item_id", "pos AS begin", "pos + 1 AS end").distinct()
    others = placed.where("rank > 1").withColumnRenamed("doc_id", "other_id")
    near = (
        first.join(others, ["text_key", "item_key", "cell"])
        .where(F.col("doc_id").eqNullSafe(F.col("other_id")) & (F.abs(F.col("pos") - F.col("at")) < span))
    )
    return (
        near.groupBy("doc_id", "text_key", "item_key", "item_id", "at")
        .agg(F.count_distinct("rank").alias("others"), F.min("pos").alias("low"), F.max("pos").alias("high"))
        .where(F.col("others") == terms - 1)
        .selectExpr("doc_id", "item_id", "least(at, low) AS begin", "greatest(at, high) + 1 AS end")
        .distinct()
    )


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, share: int = 20) -> DataFrame:
    """``judged`` without the key of the text."""
    return judged(docs, items, window, share).drop("text_key")


def judged(docs: DataFrame, items: DataFrame, window: int = WINDOW, share: int = 20) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256 and whether it is contaminated.

    A hit word lies in an occurrence of a window; contaminated is a document of whose words one in ``share`` or
    more is hit. Documents without text or words have zeros and the digest of no items. Repeated rows are judged
    each; a null doc_id is a value like any other. Items without words match nothing; items without an id make
    hits but are not listed; equal rows of the benchmark count once.
    """
    index, wanted = _looked_up(docs, items, window, sized=True)
    found = _runs(index, wanted)
    reach = "max(end) OVER (PARTITION BY doc_id, text_key ORDER BY begin, end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    hits = (
        found.select("doc_id", "text_key", "begin", "end")
        .distinct()
        .selectExpr("doc_id", "text_key", f"greatest(0, end - greatest(begin, coalesce({reach}, 0))) AS fresh")
        .groupBy("doc_id", "text_key")
        .agg(F.sum("fresh").alias("n_hit"))
    )
    listed = found.select("doc_id", "text_key", F.col("item_id").cast("string").alias("item")).distinct()
    listed = listed.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_list("item")).alias("items"))
    matched = hits.join(listed, _same(hits, listed)).select(hits["doc_id"].alias("d"), hits["text_key"].alias("k"), "n_hit", "items")
    # Counted where texts were split for the index.
    every = index.where("n_words IS NOT NULL").select("doc_id", "text_key", "n_words")
    items_found = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0))
    return every.join(matched, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")), "left").select(
        "doc_id",
        "text_key",
        F.col("n_words").cast("long").alias("n_words"),
        n_hit.cast("long").alias("n_hit"),
        F.size(items_found).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items_found), 256).alias("items_sha256"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_key"] == b["text_key"])

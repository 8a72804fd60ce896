"""Document fingerprints by content-defined chunking.

A gear hash rolls over the bytes of a text, and a chunk ends where the hash is small. Chunk lengths are
normalised: below the usual length the hash must be smaller than above it. As only the last 16 bytes
count, chunks after an edit are the same as before it. A fingerprint is the set of chunk digests with the bytes
that each stands for; likeness is containment, the share of a text's bytes whose chunks the other text has.

Spark deals documents into ranges of ids, one shuffle of the texts; each task then reads its range in order.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspan.llm.common import mixed, ordered_cells, partitions

#: Shortest, usual and longest chunk in bytes. The hash's window is no longer than the shortest.
SHORTEST, USUAL, LONGEST = 16, 48, 384
#: One hash in 2 ** bits ends a chunk, below and above the usual length.
STRICT_BITS, LOOSE_BITS = 7, 4
GEAR = mixed(np.arange(1, 257, dtype=np.uint64)).astype(np.uint32)


def gear_hashes(data: bytes) -> np.ndarray:
    """At each byte the hash of the 16 bytes that end there: the sum of their gear values, doubled at each step."""
    h = GEAR[np.frombuffer(data, np.uint8)]
    for width in (1, 2, 4, 8):
        wider = h.copy()
        wider[width:] += h[:-width] << np.uint32(width)
        h = wider
    return h


def chunk_ends(data: bytes) -> list[int]:
    """Where the chunks of ``data`` end."""
    h = gear_hashes(data)
    loose = np.flatnonzero(h < np.uint32(1 << (32 - LOOSE_BITS)))
    strict = (loose[h[loose] < np.uint32(1 << (32 - STRICT_BITS))] + 1).tolist()
    loose = (loose + 1).tolist()
    ends, at, size = [], 0, len(data)
    while size - at > SHORTEST:
        i = bisect_left(strict, at + SHORTEST)
        if i < len(strict) and strict[i] < at + USUAL:
            at = strict[i]
        else:
            i = bisect_left(loose, at + USUAL)
            at = min(loose[i] if i < len(loose) else size, at + LONGEST, size)
        ends.append(at)
    if at < size:
        ends.append(size)
    return ends


def chunk_weights(text: str) -> Counter:
    """Bytes by chunk digest."""
    data, at, weights = text.encode("utf-8", "surrogatepass"), 0, Counter()
    for end in chunk_ends(data):
        weights[xxhash.xxh64_intdigest(data[at:end])] += end - at
        at = end
    return weights


def written(weights: Counter) -> str:
    """``digest:bytes`` in ascending order, separated by spaces; empty for an empty text."""
    return " ".join(f"{d:016x}:{n}" for d, n in sorted(weights.items()))


def read(fingerprint: str) -> Counter:
    return Counter({int(d, 16): int(n) for d, n in (x.split(":") for x in fingerprint.split())})


def containment(a: Counter, b: Counter) -> float:
    """Share of the bytes of ``a`` that ``b`` has too. Nothing is wholly like nothing, and unlike anything else."""
    if not a or not b:
        return float(not a and not b)
    shared = sum(min(n, b[d]) for d, n in a.items() if d in b)
    return shared / sum(a.values())


def edited(text: str, following: str) -> str:
    """The last half of the code points, rounded down, replaced by the first as many of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held, cell, closed = None, None, False
    for batch in batches:
        found = []
        for doc_id, text, at, guest in zip(batch["doc_id"], batch["text"], batch["cell"], batch["guest"]):
            if at != cell:
                held, cell, closed = None, at, False
            if closed:
                continue
            text = "" if text is None else text
            weights = chunk_weights(text)
            if held is not None:
                before_id, before, was = held
                changed = edited(before, text)
                new = chunk_weights(changed)
                digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
                found.append((before_id, len(before), digest, written(was), written(new), containment(was, new), containment(was, weights)))
            held, closed = (doc_id, text, weights), guest
        yield pd.DataFrame(found, columns=[c.split()[0] for c in RESULT.split(", ")]).astype({"doc_id": "Int64"})


def compare_with_next(docs: DataFrame, cells: int | None = None) -> DataFrame:
    """Fingerprint of every document, of its edited text, and how like it is to that and to the next document.

    The next document has the next higher doc_id; after the last comes the first. A null text is empty;
    documents with equal ids follow each other by their text, and a null id comes first.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    celled, least = ordered_cells(rows, "doc_id", cells or 4 * partitions(docs))
    nulls = rows.where("doc_id IS NULL").limit(1).count()
    order = sorted({*least, 0} if nulls else least)
    # The first document of a cell also goes to the cell before it, as the last one's successor.
    before = {c: order[i - 1] for i, c in enumerate(order)}
    first = F.lit(None).cast("int")
    starts = {(None if nulls and c == 0 else least[c]): before[c] for c in order}
    known = [F.lit(k) for k in starts if k is not None]
    if known:
        at = F.array_position(F.array(*known), F.coalesce("doc_id", F.lit(-(2**63) + 1)))
        first = F.when(at > 0, F.element_at(F.array(*[F.lit(v) for k, v in starts.items() if k is not None]), F.greatest(at, F.lit(1)).cast("int")))
    if None in starts:
        first = F.when(F.col("doc_id").isNull(), F.lit(starts[None])).otherwise(first)
    own = F.struct(F.col("cell").alias("cell"), F.lit(False).alias("guest"))
    places = F.when(first.isNull(), F.array(own)).otherwise(F.array(own, F.struct(first.alias("cell"), F.lit(True).alias("guest"))))
    placed = celled.withColumn("place", F.explode(places)).select("doc_id", "text", "place.cell", "place.guest")
    dealt = placed.repartition(partitions(docs), "cell").sortWithinPartitions("cell", "guest", F.col("doc_id").asc_nulls_first(), "text")
    return dealt.mapInPandas(_compare, RESULT)

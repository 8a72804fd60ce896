"""Spelling variants: words of a corpus within one letter of another, and the frequent form behind them.

The index is bit-sliced: for each position and letter it has a bitset over the words, one bit a word. A word is
looked up letter by letter. Four sets are carried along, each a bitset: words that agree so far, words with
one other letter so far, words that have one letter more, and words that lack one. The last two look
at the position after and before. All are advanced by AND and OR on 64 words at a time, for all words of a block in lockstep.

Words within one letter share either their first or their last half, so a word is looked up among those with its
first half and among those with its last half only; Spark deals these groups out. Small groups share one index, each
lookup being masked with its group; groups too large for one are cut in slices, and each pair of slices is a block.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspan.llm.common import partitions
from cohortspan.sources.staging import stage

#: Code points and occurrences a word needs; how many times as frequent a form is.
LEAST_LETTERS, LEAST_COUNT, TIMES = 6, 5, 5
#: Of so many (document, run) pairs one is changed, to have misspellings to find; None changes none.
CHANGED = 199
#: Different words a task counts before it passes them on.
HELD = 400_000
#: Letters of a group from which it is cut in slices; letters of an index from which it is closed.
SLICE, INDEX = 32_768, 16_384
#: Rounds of doubling that follow any chain of forms: each is several times as frequent as the last.
MOST_ROUNDS = 8

# Letters of Latin-1 stay, A-Z are lower-cased; other characters, also those beyond Latin-1, part words.
_LETTERS = bytes(c if 0x61 <= c <= 0x7A or c >= 0xC0 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def runs_of(text: str | None) -> list[bytes]:
    """Maximal runs of letters of a text in Latin-1, one byte a letter, A-Z lower-cased."""
    return text.encode("latin-1", "replace").translate(_LETTERS).split() if text else []


def altered(run: bytes, state: int, changed: int | None = CHANGED) -> bytes:
    """The run, or the run without one letter if ``changed`` divides its hash; ``state`` is the crc32 of what comes before it."""
    if changed is None:
        return run
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), state)
    if h % changed:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def words(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, changed: int | None = CHANGED) -> DataFrame:
    """(word, n) of the words long and frequent enough, over all texts. A missing doc_id is an empty text in the hash."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter[bytes] = Counter()

        def frame() -> pd.DataFrame:
            out = pd.DataFrame({"word": [w.decode("latin-1") for w in held], "n": np.fromiter(held.values(), np.int64, len(held))})
            held.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                state = zlib.crc32(f"{doc_id}:".encode())
                for run, n in Counter(runs_of(text)).items():
                    if len(run) >= least_letters:
                        word = altered(run, state, changed)
                        if len(word) >= least_letters:
                            held[word] += n
                if len(held) > HELD:
                    yield frame()
        if held:
            yield frame()

    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text").where("text IS NOT NULL")
    counted = rows.mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= least_count)


# --- the index ---


def _first_bit(sets: np.ndarray) -> np.ndarray:
    """Number of the first bit set in each row, which has one."""
    column = np.argmax(sets != 0, axis=1)
    word = sets[np.arange(len(sets)), column]
    return column * 64 + np.bitwise_count((word & -word) - np.uint64(1)).astype(np.int64)


def _bitsets(rows: np.ndarray, bits: np.ndarray, n_rows: int, width: int) -> np.ndarray:
    """A bitset for each of ``n_rows``, with ``bits[i]`` set in row ``rows[i]``."""
    out = np.zeros((n_rows, width), np.uint64)
    np.bitwise_or.at(out, (rows, bits >> 6), np.uint64(1) << (bits & 63).astype(np.uint64))
    return out


def near_in_blocks(rows: pd.DataFrame) -> pd.DataFrame:
    """(word, n_near, best_n, best): for each row that has any, how many words of its block are near, and the foremost.

    ``rows`` has word, n, block (a number), size (letters of the shorter words of the block; others have one more),
    is_last (whether the group shares the last half, and pairs that share the first as well are left to that group),
    part (of a block of two slices, 0 or 1, which look up each other; -1 looks up all).
    """
    rows = rows.sort_values(["n", "word"], ascending=[False, True], kind="stable")
    text, size, is_last = rows["word"].to_numpy(), rows["size"].to_numpy(), rows["is_last"].to_numpy()
    lengths = np.fromiter(map(len, text), np.int64, len(text))
    count, longest, bits = len(text), int(lengths.max()), np.arange(len(text))
    width = count + 63 >> 6
    letters = np.array(text, f"U{longest}").view(np.uint32).reshape(count, longest)
    alphabet, letters = np.unique(letters, return_inverse=True)
    letters = letters.reshape(count, longest)
    # One set for each position and letter; an empty position before the first and after the last.
    n_letters = len(alphabet)
    position = np.tile(np.arange(1, longest + 1), count)
    inside = position <= np.repeat(lengths, longest)
    slot = (position * n_letters + letters.ravel())[inside]
    index = _bitsets(slot, np.repeat(bits, longest)[inside], (longest + 2) * n_letters, width)
    index = index.reshape(longest + 2, n_letters, width)
    # Bits of the words each row is to be compared with.
    _, block = np.unique(rows["block"].to_numpy(), return_inverse=True)
    part = rows["part"].to_numpy()
    side = block * 2 + np.maximum(part, 0)
    members = _bitsets(side, bits, 2 * (int(block.max()) + 1), width)
    exact = members[np.where(part < 0, side, side ^ 1)]
    # Longest first, so that rows still being read are the first ones.
    order = np.argsort(-lengths, kind="stable")
    exact, half = exact[order], (size // 2)[order]
    other, more, less = (np.zeros_like(exact) for _ in range(3))
    left_out = np.zeros_like(exact)
    # Only read in the order of the lengths: rows whose word ends before a position stay as they are.
    reading = np.searchsorted(-lengths[order], -np.arange(longest), side="left")
    for at in range(longest):
        k = reading[at]
        halved = np.flatnonzero(half[:k] == at)
        left_out[halved] = exact[halved]
        letter = letters[order[:k], at]
        here, after, before = index[at + 1, letter], index[at + 2, letter], index[at, letter]
        z = exact[:k]
        less[:k] = less[:k] & before | z
        more[:k] = (more[:k] | z) & after
        other[:k] = other[:k] & here | z & ~here
        exact[:k] = z & here
    by_length = _bitsets(lengths, bits, longest + 3, width)
    own = lengths[order]
    is_short = (own == size[order])[:, None]
    near = np.where(is_short, other & by_length[own] | (more | exact) & by_length[own + 1], less & by_length[own - 1])
    near &= ~np.where(is_last[order][:, None], left_out, np.uint64(0))
    found = np.flatnonzero(near.any(axis=1))
    best = _first_bit(near[found])
    return pd.DataFrame(
        {
            "word": text[order[found]],
            "n_near": np.bitwise_count(near[found]).sum(axis=1, dtype=np.int64),
            "best_n": rows["n"].to_numpy()[best],
            "best": text[best],
        }
    )


def _found(held: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    out = near_in_blocks(pd.concat(held))
    if len(out):
        yield out


def _look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in the order of their blocks: as many whole blocks at a time as make an index."""
    held: list[pd.DataFrame] = []
    carried = 0
    for batch in batches:
        if not len(batch):
            continue
        # Where blocks begin; the last one may go on in the next batch.
        block = batch["block"].to_numpy()
        before = held[-1]["block"].iloc[-1] if held else block[0]
        letters = np.concatenate(([0], np.cumsum(batch["word"].str.len().to_numpy())))
        at = 0
        for start in np.flatnonzero(block != np.concatenate(([before], block[:-1]))):
            if carried + letters[start] - letters[at] >= INDEX:
                held.append(batch.iloc[at:start])
                yield from _found(held)
                held, at, carried = [], start, 0
        held.append(batch.iloc[at:])
        carried += int(letters[-1] - letters[at])
    if held:
        yield from _found(held)


def _blocks(counted: DataFrame) -> DataFrame:
    """Each word in the groups in which it can meet a near one, as rows of ``near_in_blocks``."""
    length = F.length("word")
    sizes = F.array(length, length - 1)
    rows = counted.select("word", "n", F.explode(sizes).alias("size")).where(F.col("size") >= 1)
    rows = rows.select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("is_last"))
    key = F.when(F.col("is_last"), F.expr("right(word, size - size div 2)")).otherwise(F.expr("left(word, size div 2)"))
    rows = rows.withColumn("key", key)
    group = ["size", "is_last", "key"]
    sums = rows.groupBy(*group).agg(
        F.sum(length).alias("letters"), F.count(F.lit(1)).alias("members"), F.count_if(length == F.col("size")).alias("shorter")
    )
    # Without a second word or a shorter one there is nothing to look up; large groups are few and cut in slices.
    sums = sums.where("members > 1 AND shorter > 0").select(*group, F.expr(f"1 + (letters - 1) div {SLICE}").alias("slices"))
    dealt = rows.join(sums, group).withColumn("own", F.expr("pmod(xxhash64(word), slices)"))
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("target"))
    low, high = F.least("own", "target"), F.greatest("own", "target")
    return dealt.select(
        "word",
        "n",
        F.xxhash64(*group, low, high).alias("block"),
        "size",
        "is_last",
        F.when(F.col("own") == F.col("target"), -1).when(F.col("own") < F.col("target"), 0).otherwise(1).alias("part"),
    )


def near_words(counted: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) of words that have a near one; ``counted`` has each word once."""
    rows = _blocks(counted).repartition(partitions(counted), "block").sortWithinPartitions("size", "block")
    found = rows.mapInPandas(_look_up, "word string, n_near long, best_n long, best string")
    first = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best"))).alias("first")
    summed = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), first)
    return summed.select("word", "n_near", (-F.col("first.less")).alias("best_n"), F.col("first.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): where the forms of forms end. Each round doubles the steps taken."""
    paths = stage(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    for _ in range(MOST_ROUNDS):
        ahead = paths.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = paths.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        moved = stage(moved, "spelling-roots")
        if moved.where("moved").isEmpty():
            return paths
        paths = moved.select("word", "root")
    raise RuntimeError(f"forms did not end in {MOST_ROUNDS} rounds")


def variants(
    docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, times: int = TIMES, changed: int | None = CHANGED
) -> DataFrame:
    """Each word with n, n_near, its form and form_n, and root: one row a word.

    The form is the most frequent near word (of equally frequent ones the first in code-point order), if it is
    ``times`` as frequent as the word or more. Null and empty texts have no words; repeated rows count again;
    no documents give no rows. ``times`` must be above 1, so that forms of forms end.
    """
    counted = stage(words(docs, least_letters, least_count, changed), "spelling-words")
    near = near_words(counted)
    is_form = F.col("best_n") >= times * F.col("n")
    joined = counted.join(near, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(is_form, F.col("best")).alias("form"),
        F.when(is_form, F.col("best_n")).alias("form_n"),
    )
    joined = stage(joined, "spelling-forms")
    ends = roots(joined.where("form IS NOT NULL"))
    return joined.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

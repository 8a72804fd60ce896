"""Helpers that several operators share."""

from __future__ import annotations

import re
import tempfile
import zipfile
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LETTER_WORDS = re.compile(r"[^\W\d_]+")


def letter_words(text: str) -> list[str]:
    """Runs of letters of a text, lower-cased. Signs that count as numbers, such as a half or a circled one, are no letters."""
    words = LETTER_WORDS.findall(text.lower())
    if text.isascii() or "".join(words).isalpha():
        return words
    return ["".join(c for c in w if c.isalpha()) if not w.isalpha() else w for w in words if w.isalpha() or any(map(str.isalpha, w))]


_shipped: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Give the workers this package, as ``--py-files`` would; Spark copies it to every executor."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp()) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for module in sorted(package.rglob("*.py")):
            out.write(module, module.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased; other letters stay as they are."""
    return F.translate(text, UPPER, UPPER.lower())


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def in_split(name: str, modulus: int, remainder: int) -> Column:
    """Whether the crc32 of the id as text leaves this remainder; a missing id never does."""
    return F.coalesce(F.crc32(F.col(name).cast("string")) % modulus == remainder, F.lit(False))


def bounded_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most ``rows`` rows, the same ones at each run: those whose key hashes lowest.

    A threshold from the number of rows leaves about twice as many, so that the last choice is small wherever it is made.
    """
    hashed = F.xxhash64(F.col(key))
    share = min(1.0, 2 * rows / max(1, df.count()))
    few = df.where(hashed <= F.lit(int(-(2**63) + share * (2**64 - 1)))) if share < 1 and rows >= 1000 else df
    return few.orderBy(hashed, F.col(key)).limit(rows)


def ordered_cells(df: DataFrame, key: str, cells: int) -> tuple[DataFrame, dict[int, int]]:
    """``df`` with column ``cell``: ranges of the numeric ``key`` of about equal row counts, in ascending order.

    Also the smallest key of each cell that has rows. Rows without a key are in cell 0. The driver gets
    the bounds and these smallest keys, at most ``cells`` numbers each.
    """
    points = [i / cells for i in range(1, cells)]
    bounds = sorted(set(df.approxQuantile(key, points, 0.2 / cells))) if points else []
    cell = F.lit(0)
    if bounds:
        known = F.array(*[F.lit(int(b)) for b in bounds])
        cell = F.coalesce(F.size(F.filter(known, lambda b: b <= F.col(key))), F.lit(0))
    celled = df.withColumn("cell", cell)
    smallest = celled.where(F.col(key).isNotNull()).groupBy("cell").agg(F.min(key).alias("least")).collect()
    return celled, {row["cell"]: row["least"] for row in sorted(smallest)}


class Numbered(dict):
    """Numbers words in the order in which they are first asked for."""

    def __init__(self, *words):
        super().__init__(*words)
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.new.append(word)
        return number


_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """Each 64-bit value scrambled, so that all its bits depend on all bits of the input."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_BASE = 0x100000001B3D
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all texts, and where each text's words begin (one entry more than texts)."""
    joined = " ".join(texts).encode("utf-8", "surrogatepass")
    data = _LOWER[np.frombuffer(joined + b" ", np.uint8)]
    lengths = np.fromiter((len(t.encode("utf-8", "surrogatepass")) for t in texts), np.int64, len(texts))
    begins = np.concatenate(([0], np.cumsum(lengths + 1)))
    space = _SPACES[data]
    before = np.concatenate(([True], space[:-1]))
    starts = np.flatnonzero(~space & before)
    ends = np.flatnonzero(space & ~before)
    power = _powers(len(data), _BASE)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power)))
    back = _powers(len(data), _INVERSE)
    hashes = mixed((total[ends] - total[starts]) * back[starts] + _ODD * (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, begins)


def shingle_sets(texts: list[str], size: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles of ``size`` words; of all words if there are fewer; empty without words."""
    hashes, begins = word_hashes(texts)
    rolled = np.zeros(max(0, len(hashes) - size + 1), np.uint64)
    for i in range(size):
        rolled = mixed(rolled + hashes[i : i + len(rolled)] * _ODD)
    out = []
    for a, b in zip(begins, begins[1:]):
        if b - a >= size:
            out.append(np.unique(rolled[a : b - size + 1]))
        elif b > a:
            whole = np.array([b - a], np.uint64)
            for i in range(a, b):
                whole = mixed(whole + hashes[i : i + 1] * _ODD)
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
    return out

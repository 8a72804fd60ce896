"""Token counts of texts, kept in a cache from run to run.

A text's count is stored under two digests: one of its content, normalised as the tokenizer itself does first, and one
of the tokenizer (its file and its library's version). A run joins the digests of its texts to the stored counts;
of those without one, each different text is encoded once, and its count is appended to the cache.

The cache is a Parquet table ``digest, n_tokens``, partitioned by ``version``, the tokenizer's digest. Runs that
append the same digests at the same time store equal counts twice, which readers fold.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from importlib.metadata import version as library_version
from itertools import chain
from pathlib import Path

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspan.llm.languages import batched
from cohortspan.sources.staging import shared_dir, stage

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
LIMIT = 1024
#: Missing texts up to which their digests are sent to all scans; more are joined by a shuffle.
SENT = 10_000
#: Words a task remembers the counts of, and characters it encodes at once.
REMEMBERED, AT_ONCE = 500_000, 1_000_000

_SINGLE_SPACE = re.compile(r"(?<=\S) (?=\S)")


def tokenizer_version(path: str = TOKENIZER) -> str:
    """Digest of the tokenizer: what its file holds, and which library of which version reads it."""
    library = "sentencepiece" if path.endswith(".model") else "tokenizers"
    digest = hashlib.sha256(f"{library} {library_version(library)}\n".encode())
    digest.update(Path(path).read_bytes())
    return digest.hexdigest()


class TokenCounter:
    """Counts by the library the file is for, without tokens that the text does not have itself."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.pieces = self.tokenizer = self.normalizer = None
        self.by_word, self.special = False, []
        if path.endswith(".model"):
            import sentencepiece

            self.pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            return
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.normalizer = self.tokenizer.normalizer
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        kind = json.loads(self.tokenizer.to_str())
        # A byte-level tokenizer begins anew at a single space between words, so a text's count is its words'.
        before = kind["pre_tokenizer"] or {}
        plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before["add_prefix_space"]
        self.by_word = plain and self.normalizer is None
        self.known: dict[str, int] = {}

    def normalised(self, text: str) -> str:
        """What the tokenizer makes of a text first. One with a special string is left alone: those are found before."""
        if self.normalizer is None:
            return text
        out = self.normalizer.normalize_str(text)
        low = text.lower()
        return text if any(s in out or s.lower() in low for s in self.special) else out

    def digest(self, text: str) -> bytes:
        out = self.normalised(text)
        return hashlib.sha256(b"=" * (out is text and self.normalizer is not None) + out.encode("utf-8", "surrogatepass")).digest()

    def _whole(self, texts: list[str]) -> list[int]:
        if self.pieces is not None:
            return [len(ids) for ids in self.pieces.encode(texts, num_threads=1)] if texts else []
        return [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: list[str]) -> list[int]:
        if not self.by_word:
            return self._whole(texts)
        out: list[int | None] = [None] * len(texts)
        whole = [i for i, t in enumerate(texts) if any(s in t for s in self.special)]
        for i, n in zip(whole, self._whole([texts[i] for i in whole])):
            out[i] = n
        rest = [i for i, n in enumerate(out) if n is None]
        heads, words = [], []
        for i in rest:
            text = texts[i]
            # Where white space is more than single spaces and line ends, only single spaces cut.
            even = text.replace("\n", " ").split(" ") == text.split()
            first, *others = text.split(" ") if even else _SINGLE_SPACE.split(text)
            heads.append(first)
            words.append(others)
        if len(self.known) > REMEMBERED:
            self.known = {}
        new = list(set(chain.from_iterable(words)).difference(self.known))
        self.known.update(zip(new, self._whole([" " + w for w in new])))
        known = self.known.__getitem__
        for i, n, others in zip(rest, self._whole(heads), words):
            out[i] = n + sum(map(known, others))
        return out


_counters: dict[str, TokenCounter] = {}


def _counter(path: str) -> TokenCounter:
    if path not in _counters:
        _counters[path] = TokenCounter(path)
    return _counters[path]


def _keyed(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, text, n_bytes, digest, and ``who``, a hash of doc_id that is never null."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"),
        F.xxhash64("doc_id").alias("who"),
    )
    if _counter(path).normalizer is None:
        # Nothing to normalise, so the digest is the text's and the text need not leave the JVM.
        return rows.withColumn("digest", F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)))

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(digest=[_counter(path).digest(t) for t in batch["text"]])

    return rows.mapInPandas(digests, "doc_id long, text string, n_bytes long, who long, digest binary")


def stored_counts(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """(digest, n_tokens) of one tokenizer, each digest once. A cache that is not there yet is empty."""
    schema = "digest binary, n_tokens long, version string"
    folder = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema).select("digest", "n_tokens")
    rows = spark.read.schema(schema).parquet(cache).where(F.col("version") == version)
    return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def missing(rows: DataFrame, cache: str, version: str) -> DataFrame:
    """(digest, who) of one row for each text that the cache has no count of."""
    wanted = rows.groupBy("digest").agg(F.min("who").alias("who"))
    return wanted.join(stored_counts(rows.sparkSession, cache, version), "digest", "left_anti")


def count_tokens(docs: DataFrame, cache: str | None = None, path: str = TOKENIZER, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row; counts that the cache lacked are in it afterwards.

    ``path`` is a tokenizer file, the same on every machine. ``cache`` is a folder all executors share. A null text
    is an empty one. Repeated rows and equal texts are counted once and reported each; rows with one id and different texts keep theirs.
    """
    spark = docs.sparkSession
    cache = cache or f"{shared_dir(spark)}/token-counts"
    version = tokenizer_version(path)
    keyed = _keyed(docs, path)
    rows = stage(keyed.select("doc_id", "n_bytes", "who", "digest"), "token-rows")
    misses = stage(missing(rows, cache, version), "token-misses")
    n_missing = misses.count()
    if n_missing:
        # One row of each missing text is picked by its id, so that copies do not meet in one task. Many misses are
        # the small side of a shuffled hash join: their digests are held, texts stream past unsorted.
        picked = keyed.join(misses.hint("broadcast" if n_missing <= SENT else "shuffle_hash"), ["digest", "who"], "left_semi")
        counted = picked.select("digest", "text").mapInPandas(_count(path), "digest binary, n_tokens long")
        # Equal rows are all picked; one count is kept.
        counted = counted.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")).withColumn("version", F.lit(version))
        counted.write.mode("append").partitionBy("version").parquet(cache)
    found = stored_counts(spark, cache, version).hint("merge")
    return rows.join(found, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _count(path: str):
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts = [n for part in batched(batch["text"], AT_ONCE) for n in _counter(path)(part)]
            yield pd.DataFrame({"digest": batch["digest"], "n_tokens": counts})

    return work

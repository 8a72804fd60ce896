"""Counts against the libraries themselves, and what the cache saves."""

import random
import re
from functools import cache

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from cohortspan.llm import token_counts
from cohortspan.llm.token_counts import TOKENIZER, TokenCounter, count_tokens, missing, stored_counts, tokenizer_version
from tests.conftest import TESTDATA
from tests.llm.conftest import documents

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


@cache
def loaded(path):
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path)
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def library(path, text):
    if path.endswith(".model"):
        return len(loaded(path).encode(text))
    return len(loaded(path).encode(text, add_special_tokens=False).ids)


def odd_texts():
    rng = random.Random(7)
    parts = ["a", "Word", " ", "  ", "\n", "\n\n", "\t", " ", " ", "\x1c", "\x85", "'s", "don't", "½", "42", "...", "!", "é", "日本", "\U0001f600", "<|endoftext|>", "<|ENDOFTEXT|>"]
    return ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(600)] + ["x" * 5000, "", " ", "a  b", " a", "a "]


@pytest.mark.parametrize("path", [TOKENIZER, WORDS, PIECES])
def test_counts_are_the_librarys(path):
    texts = odd_texts()
    assert TokenCounter(path)(texts) == [library(path, t) for t in texts]


def test_words_are_forgotten_without_harm(monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED", 3)
    counter, texts = TokenCounter(TOKENIZER), ["one two three four", "five six one", "two one"]
    assert [counter([t])[0] for t in texts] == [library(TOKENIZER, t) for t in texts]


def test_normalised_texts_share_a_count():
    counter = TokenCounter(WORDS)
    assert counter.digest("Hello  World") == counter.digest("hello world")
    # A special string is found before anything is normalised.
    assert counter.digest("a <|endoftext|>") != counter.digest("a <|ENDOFTEXT|>")
    texts = odd_texts()
    by_digest = {}
    for t, n in zip(texts, counter(texts)):
        assert by_digest.setdefault(counter.digest(t), n) == n


def rows(df):
    return sorted(map(repr, df.collect()))


def expected(data, path=TOKENIZER, limit=1024):
    out = []
    for doc_id, text in data:
        n = library(path, text or "")
        out.append((doc_id, len((text or "").encode()), n, n > limit))
    return out


@pytest.mark.parametrize("sent", [0, 10_000])
def test_odd_documents(spark, odd, tmp_path, monkeypatch, sent):
    monkeypatch.setattr(token_counts, "SENT", sent)
    got = [tuple(r) for r in count_tokens(odd, str(tmp_path / "cache")).collect()]
    data = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, expected(data)))


def test_no_documents(spark, none, tmp_path):
    df = count_tokens(none, str(tmp_path / "cache"))
    assert df.collect() == [] and df.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]


@pytest.mark.parametrize("path", [TOKENIZER, WORDS, PIECES])
def test_only_what_is_new_is_encoded(spark, tmp_path, path, monkeypatch):
    folder, version = str(tmp_path / "cache"), tokenizer_version(path)
    first = documents(spark, ["one text", "another text", "one text", None, ""])
    assert rows(count_tokens(first, folder, path)) == rows(count_tokens(first, folder, path))
    assert stored_counts(spark, folder, version).count() == 3
    # A count that was stored wrongly is still taken: nothing is encoded again.
    wrong = stored_counts(spark, folder, version).withColumn("n_tokens", F.lit(99).cast("long")).withColumn("version", F.lit(version))
    wrong.write.partitionBy("version").parquet(str(tmp_path / "wrong"))
    second = documents(spark, ["one text", "a new text", "a new text"])
    keyed = token_counts._keyed(second, path)
    assert missing(keyed, str(tmp_path / "wrong"), version).count() == 1
    got = {r["doc_id"]: r["n_tokens"] for r in count_tokens(second, str(tmp_path / "wrong"), path).collect()}
    assert got == {0: 99, 1: library(path, "a new text"), 2: library(path, "a new text")}
    assert stored_counts(spark, str(tmp_path / "wrong"), version).count() == 4


def test_tokenizers_do_not_share_counts(spark, tmp_path):
    cache = str(tmp_path / "cache")
    docs = documents(spark, ["Some words, and more of them."])
    for path in (TOKENIZER, WORDS, PIECES):
        assert count_tokens(docs, cache, path).first()["n_tokens"] == library(path, "Some words, and more of them.")
    assert len({tokenizer_version(p) for p in (TOKENIZER, WORDS, PIECES)}) == 3


def test_counts_stored_twice_are_one(spark, tmp_path):
    cache = str(tmp_path / "cache")
    docs = documents(spark, ["twice"])
    count_tokens(docs, cache)
    version = tokenizer_version(TOKENIZER)
    again = stored_counts(spark, cache, version).withColumn("version", F.lit(version))
    again.write.mode("append").partitionBy("version").parquet(cache)
    assert spark.read.parquet(cache).count() == 2 and len(count_tokens(docs, cache).collect()) == 1


def test_query_on_the_given_documents(spark):
    from cohortspan.llm.queries import QUERIES

    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op11_token_counts"](spark, f"{TESTDATA}/sf0.001").collect()}
    docs = spark.read.parquet(f"{TESTDATA}/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert got == {d: x for d, *x in ((r[0], *r[1:]) for r in expected(docs)) for x in [tuple(x)]}


def test_version_is_in_the_path(spark, tmp_path):
    cache = tmp_path / "cache"
    count_tokens(documents(spark, ["text"]), str(cache))
    assert [p.name for p in cache.iterdir() if re.match("version=", p.name)] == [f"version={tokenizer_version(TOKENIZER)}"]

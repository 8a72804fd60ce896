import math
import random
from collections import Counter

import numpy as np
import pytest

from cohortspan.llm import languages
from cohortspan.llm.common import in_split
from tests.conftest import TESTDATA
from tests.llm.conftest import documents

PIECES = ["", "▁", "a", "b", "ab", "▁a", "ba", "▁ab", "bab"]


def segmentations(word):
    if not word:
        yield []
    for i, piece in enumerate(PIECES):
        if piece and word.startswith(piece):
            for rest in segmentations(word[len(piece) :]):
                yield [i, *rest]


def probabilities(seed, columns):
    p = np.random.default_rng(seed).random((len(PIECES), columns))
    return p / p.sum(0)


WORDS = ["a", "b", "abab", "babba", "aaabbb"]


def test_forward_sums_all_segmentations():
    p = probabilities(1, 3)
    found = languages.forward(languages.Lattice(PIECES), WORDS, p)
    expected = [sum(np.prod([p[i] for i in s], axis=0) for s in segmentations("▁" + w)) for w in WORDS]
    np.testing.assert_allclose(found, expected)
    for word, row in zip(WORDS, found):
        np.testing.assert_allclose(languages.log_forward_long(languages.Lattice(PIECES), word, p), np.log(row))


def test_expected_pieces():
    p, counts = probabilities(2, 1)[:, 0], np.array([1.0, 2, 3, 4, 5])
    found = languages.expected(languages.Lattice(PIECES), WORDS, counts, p)
    expected = np.zeros(len(PIECES))
    for word, n in zip(WORDS, counts):
        weights = [(math.prod(p[i] for i in s), Counter(s)) for s in segmentations("▁" + word)]
        for weight, used in weights:
            for i, k in used.items():
                expected[i] += n * k * weight / sum(w for w, _ in weights)
    np.testing.assert_allclose(found, expected)


def test_letters_without_a_piece():
    lattice, p = languages.Lattice(PIECES), probabilities(3, 1)
    np.testing.assert_allclose(languages.forward(lattice, ["z"], p), [p[1] * p[0]])
    assert np.isfinite(languages.log_forward_long(lattice, "az" * 5000, p)).all()


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{TESTDATA}/sf0.01/documents.parquet")
    held_out = in_split("doc_id", 4, 2)
    model = languages.learn(docs.where(~held_out))
    found = {r.doc_id: r for r in languages.identify(docs, model).collect()}
    rows = docs.where(held_out & docs.lang.isNotNull() & docs.text.rlike(r"\pL")).select("doc_id", "lang").collect()
    assert len(rows) > 200 and sum(found[d].lang_pred == lang for d, lang in rows) / len(rows) > 0.99
    assert all(0 <= r.score <= 1 for r in found.values())


def test_remembered_words_do_not_matter(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["le", "der"][i % 2 :][:1]) + rng.choice("abcdeé") for _ in range(9)), "fd"[i % 2]) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    scorer = languages.Scorer(languages.learn(docs))
    texts = [t for _, t, _ in rows]
    whole = scorer(texts)
    monkeypatch.setattr(languages, "REMEMBERED", 3)
    one_by_one = [languages.Scorer(scorer.model)([t])[0] for t in texts]
    again = languages.Scorer(scorer.model)
    for found in (one_by_one, [again([t])[0] for t in texts]):
        assert [x for x, _ in found] == [x for x, _ in whole] == ["fd"[i % 2] for i in range(60)]
        np.testing.assert_allclose([s for _, s in found], [s for _, s in whole])


def test_odd_documents(spark, odd, none):
    model = languages.learn(odd)
    found = sorted((r.doc_id or 0, r.lang_pred, r.score > 0) for r in languages.identify(odd, model).collect())
    texts = odd.select("doc_id", "text").collect()
    assert found == sorted((r.doc_id or 0, "en" if any(c.isalpha() for c in r.text or "") else "und", any(c.isalpha() for c in r.text or "")) for r in texts)
    assert languages.identify(none, model).count() == 0
    assert languages.learn(none) is None
    unknown = languages.identify(documents(spark, ["some text"]), None).first()
    assert (unknown.lang_pred, unknown.score) == ("und", 0.0)


def test_long_words_are_counted_like_short_ones():
    pieces = languages.read_pieces(languages.VOCABULARY)
    lattice, p = languages.Lattice(pieces), np.random.default_rng(1).random(len(pieces)) / 1000
    words, counts = ["a", "understanding", "naïve", "日本語", "xyz" * 16], np.array([1.0, 5, 2, 3, 4])
    assert np.allclose(languages.expected_long(lattice, words, counts, p), languages.expected(lattice, words, counts, p))
    used = languages.expected_long(lattice, ["of" * 3000], np.array([2.0]), p)
    assert np.isclose(used @ [len(x) or 1 for x in pieces], 2 * 6001)


def test_languages_of_long_words_only(spark):
    rows = [(1, "abba" * 30, "xx"), (2, "dodo" * 30, "yy"), (3, "ba" * 40, None), (4, "od" * 40, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r.doc_id: r.lang_pred for r in languages.identify(docs, languages.learn(docs)).collect()}
    assert found == {1: "xx", 2: "yy", 3: "xx", 4: "yy"}


def test_numbers_that_are_no_letters(spark):
    docs = spark.createDataFrame([(1, "of the", "en"), (2, "½ ² ① 42", None), (3, "a½b", None)], "doc_id long, text string, lang string")
    found = {r.doc_id: r.lang_pred for r in languages.identify(docs, languages.learn(docs)).collect()}
    assert found == {1: "en", 2: "und", 3: "en"}


def test_foreign_and_random_texts_do_not_fit(spark):
    docs = spark.read.parquet(f"{TESTDATA}/sf0.01/documents.parquet")
    scorer = languages.Scorer(languages.learn(docs))
    texts = [r.text for r in docs.where("lang IS NOT NULL").collect()]
    fit = languages.fits(scorer, texts)
    assert all(ok for ok, t in zip(fit, texts) if len(languages.letter_words(t or "")) >= 5)
    rng = random.Random(2)
    random_letters = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9))) for _ in range(n)) for n in (20, 2000)]
    foreign = "Lapset leikkivät iltapäivällä puutarhassa, kun isoäiti leipoi keittiössä kakkua ja katseli ikkunasta ulos."
    others = [foreign, foreign * 50, "Дети играли днём в саду, пока бабушка пекла на кухне пирог.", *random_letters, None, "", "½ 42"]
    assert languages.fits(scorer, others) == [False] * len(others)


def test_what_is_usual_comes_from_all_words(spark, monkeypatch):
    rng = random.Random(4)
    rare = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(50)]
    rows = [(1, "the of " * 40, "en"), (2, " ".join(rare), "en"), (3, "x" + "yz" * 40, "en"), (4, "der die " + " ".join(rare[:9]), "de"), (5, "12", "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(languages, "COMMON", 9)
    model = languages.learn(docs)
    for column, lang in enumerate(model.languages):
        words = [w for _, t, own in rows if own == lang for w in languages.letter_words(t)]
        scores = languages.score_words(languages.Lattice(model.pieces), words, model.p)[:, column]
        assert np.isclose(model.usual[column], scores.sum() / sum(map(len, words)) if words else -np.inf)

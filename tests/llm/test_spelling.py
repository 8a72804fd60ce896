"""The bit-sliced index against comparing all pairs, and the whole operator against plain Python."""

import random
import re
import zlib
from collections import Counter

import pandas as pd
import pytest

from cohortspan.llm import spelling
from tests.llm.conftest import documents


def apart_by_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_near(counted):
    out = {}
    for w in counted:
        near = [v for v in counted if v != w and apart_by_one(v, w)]
        if near:
            best = min(near, key=lambda v: (-counted[v], v))
            out[w] = (len(near), counted[best], best)
    return out


def random_words(seed, n, letters="ab", low=1, high=9):
    rng = random.Random(seed)
    return {"".join(rng.choices(letters, k=rng.randint(low, high))): rng.choice([1, 1, 5, 30, 200]) for _ in range(n)}


def frame(spark, counted):
    return spark.createDataFrame(list(counted.items()), "word string, n long")


def found(df):
    return {r["word"]: (r["n_near"], r["best_n"], r["best"]) for r in df.collect()}


@pytest.mark.parametrize("letters,low,high", [("ab", 1, 9), ("abcé", 2, 7), ("aÿz×", 6, 8)])
def test_near_words(spark, letters, low, high):
    counted = random_words(len(letters), 400, letters, low, high)
    assert found(spelling.near_words(frame(spark, counted))) == plain_near(counted)


@pytest.mark.parametrize("slice_letters,index_letters", [(20, 30), (100, 1), (40, 1000)])
def test_groups_cut_in_slices(spark, monkeypatch, slice_letters, index_letters):
    monkeypatch.setattr(spelling, "SLICE", slice_letters)
    monkeypatch.setattr(spelling, "INDEX", index_letters)
    counted = random_words(3, 300, "ab", 4, 9)
    assert found(spelling.near_words(frame(spark, counted))) == plain_near(counted)


def test_long_words(spark):
    base = "ab" * 1500
    counted = {base: 100, base[:-1]: 1, base[1:]: 2, "c" + base[1:]: 3, base[:700] + "x" + base[700:]: 4, base * 2: 5}
    assert found(spelling.near_words(frame(spark, counted))) == plain_near(counted)


def test_one_index_of_several_blocks():
    words = [("abcdef", 9, 1), ("abcdeg", 3, 1), ("abcdeh", 9, 2), ("abcdei", 1, 2), ("abcdefg", 1, 1)]
    rows = pd.DataFrame([(w, n, b, 6, False, -1) for w, n, b in words], columns=["word", "n", "block", "size", "is_last", "part"])
    got = {r.word: (r.n_near, r.best_n, r.best) for r in spelling.near_in_blocks(rows).itertuples()}
    assert got == {
        "abcdef": (2, 3, "abcdeg"), "abcdeg": (2, 9, "abcdef"), "abcdefg": (2, 9, "abcdef"),
        "abcdeh": (1, 1, "abcdei"), "abcdei": (1, 9, "abcdeh"),
    }


def expected(rows, least_letters=6, least_count=5, times=5, changed=199):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if changed and h % changed == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= least_letters and n >= least_count}
    near = plain_near(counts)
    form = {w: b for w, (_, n, b) in near.items() if n >= times * counts[w]}
    out = []
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, near.get(w, (0,))[0], counts.get(form.get(w))))
    return sorted(map(repr, out))


def got(df):
    return sorted(repr(tuple(r)) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_variants_and_chains(spark):
    # Each of a chain is one letter from the next and five times as frequent.
    chain = {"abcdefgh": 1, "abcdefgx": 5, "abcdefyx": 25, "abcdezyx": 125, "abcduzyx": 625, "abcvuzyx": 3125}
    texts = [" ".join([w] * n) for w, n in chain.items()] + ["Naïveté NAÏVETÉ naïveté, naïvet½naïveté"]
    rows = list(enumerate(texts))
    for changed in (None, 2, 199):
        assert got(spelling.variants(documents(spark, texts), 6, 1, 5, changed)) == expected(rows, 6, 1, 5, changed)
    ends = {r["word"]: r["root"] for r in spelling.variants(documents(spark, texts), 6, 1, 5, None).collect()}
    assert ends["abcdefgh"] == "abcvuzyx"


def test_random_documents(spark):
    rng = random.Random(5)
    vocabulary = list(random_words(9, 120, "abé", 5, 8))
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 80))) for _ in range(60)]
    assert got(spelling.variants(documents(spark, texts), changed=7)) == expected(list(enumerate(texts)), changed=7)


def test_odd_documents(spark, odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    assert got(spelling.variants(odd)) == expected(rows)
    assert got(spelling.variants(odd, 1, 1)) == expected(rows, 1, 1)
    assert spelling.variants(none).collect() == []

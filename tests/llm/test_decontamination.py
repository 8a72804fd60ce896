import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cohortspan.llm import decontamination
from tests.llm.conftest import documents, with_clashes

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items, window=13):
    own, hit, found = words(text), set(), set()
    for item_id, item in items:
        other = words(item)
        n = min(window, len(other))
        spans = {tuple(other[i : i + n]) for i in range(len(other) - n + 1)} if n else ()
        for p in range(len(own) - n + 1):
            if tuple(own[p : p + n]) in spans:
                hit |= set(range(p, p + n))
                found |= {str(item_id)} if item_id is not None else set()
    listed = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(own), len(hit), len(found), listed, bool(hit) and 20 * len(hit) >= len(own)


def made_up(seed):
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(40)] + ["the", "of"] * 10
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 4, 13, 14, 30, 60])))) for i in range(12)]
    items += [(20, items[3][1]), (None, items[4][1]), (21, None), (22, "..."), items[5]]
    texts = []
    for _ in range(60):
        text = rng.choices(vocabulary, k=rng.randint(0, 80))
        for _ in range(rng.randint(0, 2)):
            item = words(rng.choice(items)[1])
            at = rng.randint(0, len(item))
            part = item[at : at + rng.randint(1, 30)] if rng.random() < 0.5 else item
            place = rng.randint(0, len(text))
            text[place:place] = part
        texts.append(rng.choice([" ", ", ", "\n"]).join(w.upper() if rng.random() < 0.1 else w for w in text))
    return texts, items


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    texts, items = made_up(seed)
    found = decontamination.contamination(documents(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r[0]: tuple(r[1:]) for r in found} == {i: brute(t, items) for i, t in enumerate(texts)}


def test_blocks_of_terms(spark, monkeypatch):
    texts, items = made_up(7)
    monkeypatch.setattr(decontamination, "BLOCK", 3)
    found = decontamination.contamination(documents(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r[0]: tuple(r[1:]) for r in found} == {i: brute(t, items) for i, t in enumerate(texts)}


def test_odd_documents(spark, odd, none):
    items = [(1, "brown fox jumps"), (2, "lorem ipsum"), (None, "two texts"), (3, None)]
    benchmark = with_clashes(spark.createDataFrame(items, "item_id long, text string"))
    found = decontamination.contamination(odd, benchmark).collect()
    expected = [(r.doc_id, *brute(r.text, items)) for r in odd.select("doc_id", "text").collect()]
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, expected))
    assert decontamination.contamination(none, benchmark).count() == 0
    assert not any(r.contaminated for r in decontamination.contamination(odd, benchmark.limit(0)).collect())


def test_repeated_rows_count_once_each_with_blocks(spark, odd, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK", 2)
    items = [(1, "brown fox jumps"), (2, "lorem ipsum"), (None, "two texts"), (4, "word")]
    found = decontamination.contamination(odd, spark.createDataFrame(items, "item_id long, text string")).collect()
    expected = [(r.doc_id, *brute(r.text, items)) for r in odd.select("doc_id", "text").collect()]
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, expected))


def test_words(spark):
    texts = [None, "", " ", "...", "a", " a", "a ", "--A-b--", "a\x00b\x7fc\u0080d", "\r\nÉa Éb\u2028c\u00a0d", "\U0001f600x \U0001f600", "[`@{/:9^_Z"]
    found = documents(spark, texts).select("doc_id", decontamination.words_of(F.col("text"))).collect()
    assert {i: own for i, own in found} == {i: None if t is None else words(t) for i, t in enumerate(texts)}


def test_words_are_split_not_extracted(spark):
    plan = documents(spark, ["a"]).select(decontamination.words_of(F.col("text")))._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" in plan and "regexp_extract" not in plan


def test_texts_are_not_split_again_to_count_their_words(spark, odd):
    benchmark = spark.createDataFrame([(1, "brown fox")], "item_id long, text string")
    plan = decontamination.contamination(odd, benchmark)._jdf.queryExecution().optimizedPlan().toString()
    assert "n_words" in plan and "translate(" not in plan


def test_proximity(spark):
    texts = ["beta x y alpha z gamma", "alpha " + "x " * 30 + "beta gamma", "gamma beta", "alpha beta gamma alpha beta gamma"]
    benchmark = spark.createDataFrame([(1, "alpha beta gamma"), (2, "alpha missing gamma")], "item_id long, text string")
    found = decontamination.proximity_matches(documents(spark, texts), benchmark, terms=3, span=10).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(0, 1), (3, 1)}
    assert {(r.begin, r.end) for r in found if r.doc_id == 0} == {(0, 6)}


def brute_proximity(rows, items, terms=3, span=20):
    own = [(d, words(t)) for d, t in rows]
    counts, found = Counter(w for _, ws in own for w in ws), set()
    for item_id, item in items:
        rarest = sorted(set(words(item)), key=lambda w: (counts[w], w))[:terms]
        if len(rarest) < terms:
            continue
        for d, ws in own:
            for at in [p for p, w in enumerate(ws) if w == rarest[0]]:
                near = {w: [p for p, x in enumerate(ws) if x == w and abs(p - at) < span] for w in rarest[1:]}
                if all(near.values()):
                    places = [at, *[p for ps in near.values() for p in ps]]
                    found.add((d, item_id, min(places), max(places) + 1))
    return found


@pytest.mark.parametrize("seed, terms, span", [(0, 3, 20), (1, 2, 5), (2, 1, 9), (3, 4, 40)])
def test_proximity_against_brute_force(spark, seed, terms, span):
    texts, items = made_up(seed)
    rows = [*enumerate(texts), *list(enumerate(texts))[:9], (None, texts[3]), (None, texts[4]), (1, texts[5]), (99, None), (98, "")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.proximity_matches(spark.createDataFrame(rows, "doc_id long, text string"), benchmark, terms, span).collect()
    assert len(found) == len(set(found))
    assert {tuple(r) for r in found} == brute_proximity(rows, items, terms, span)


def test_proximity_in_odd_documents(spark, odd, none):
    items = [(1, "brown fox jumps"), (2, "lorem ipsum dolor"), (None, "text without words"), (3, None), (4, "two texts"), (1, "brown fox jumps")]
    benchmark = with_clashes(spark.createDataFrame(items, "item_id long, text string"))
    found = decontamination.proximity_matches(odd, benchmark).collect()
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    short = [(d, t if len(t or "") < 9_000 else "") for d, t in rows]
    assert {tuple(r) for r in found if r.doc_id != 7} == {f for f in brute_proximity(short, items)}
    assert sum(r.doc_id == 7 for r in found) == 12_000
    assert decontamination.proximity_matches(none, benchmark).count() == 0
    assert decontamination.proximity_matches(odd, benchmark.limit(0)).count() == 0


def test_plan_is_native(spark, odd):
    benchmark = spark.createDataFrame([(1, "brown fox")], "item_id long, text string")
    plan = decontamination.contamination(odd, benchmark)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan

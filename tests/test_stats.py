import random
from collections import Counter

import pytest

from cohortspan.operators.stats import masked_counts, masked_distribution
from tests import brute
from tests.helpers import values


def spread(spark, groups, **options):
    rows = [(g, p, v) for g, vs in groups.items() for p, v in enumerate(vs)]
    frame = spark.createDataFrame(rows, "g int, person_id long, days long")
    found = values(masked_distribution(frame, "days", by=("g",), **options))
    return {row[1]: (row[0], *row[2:]) for row in found}


def test_every_group_size_against_definition(spark):
    # Sizes around the threshold, and those where p * n is a whole number; values beyond the cap.
    rng = random.Random(1)
    groups = {n: [rng.randint(-15000, 15000) for _ in range(n)] for n in range(1, 121)}
    assert spread(spark, groups) == {g: brute.distribution(v) for g, v in groups.items()}


@pytest.mark.parametrize("options", [{"saturate": None}, {"saturate": 3, "min_count": 1}, {"min_count": 30}])
def test_options(spark, options):
    rng = random.Random(2)
    groups = {n: [rng.randint(-5, 8) for _ in range(n)] for n in range(1, 60)}
    assert spread(spark, groups, **options) == {g: brute.distribution(v, **options) for g, v in groups.items()}


def test_cap_spares_the_first_value_and_the_extremes(spark):
    found = spread(spark, {1: [20000] * 20, 2: [20000] * 21})
    # p * n = 1 for the lowest quantile of 20 rows: nothing lies below the threshold.
    assert found[1] == (20, 20000, 20000, *[9999] * 6, 20000)
    assert found[2] == (21, 20000, *[9999] * 7, 20000)


def test_without_key(spark):
    frame = spark.createDataFrame([(p, p * p) for p in range(50)], "person_id long, days long")
    assert values(masked_distribution(frame, "days")) == [brute.distribution([p * p for p in range(50)])]


@pytest.mark.parametrize("n, shown", [(0, 0), (4, 1), (5, 1)])
def test_small_cohorts(spark, n, shown):
    frame = spark.createDataFrame([(p, 3) for p in range(n)], "person_id long, days long")
    found = values(masked_distribution(frame, "days"))
    # An empty cohort gives no row, not a suppressed one.
    assert found == ([(-5, *[None] * 9) if n < 5 else (5, *[3] * 9)] if shown else [])


def test_column_names(spark):
    frame = spark.createDataFrame([], "person_id long, days_to_diag long")
    assert masked_distribution(frame, "days_to_diag").columns == ["n"] + [
        f"{s}_days_to_diag" for s in ("min", "q5", "q10", "q25", "median", "q75", "q90", "q95", "max")
    ]


def test_counts(spark):
    rng = random.Random(3)
    rows = [(p, c, rng.randint(1, 5)) for c in range(30) for p in range(c)]
    frame = spark.createDataFrame(rows, "person_id long, concept_id long, n_events long")
    expected = set()
    for concept, size in Counter(c for _, c, _ in rows).items():
        more = [sum(1 for _, c, n in rows if c == concept and n > k) for k in (1, 2, 3)]
        expected.add((concept, size if size >= 5 else -5, *[m if m >= 5 else None for m in more]))
    found = masked_counts(frame)
    assert set(values(found)) == expected
    assert found.columns == [
        "concept_id",
        "excluded_patient_count",
        "excluded_patient_count_multiple",
        "excluded_patient_count_multiple_2",
        "excluded_patient_count_multiple_3",
    ]


@pytest.mark.parametrize("value, by", [("days to dx", ()), ("days", ("v",)), ("days", ("total",)), ("days", ("a-b",)), ("v`w", ("_total",))])
def test_any_column_names(spark, value, by):
    rows = [(g, p, p * g) for g in (1, 2) for p in range(8)]
    frame = spark.createDataFrame(rows, "g int, person_id long, d long").toDF(by[0] if by else "g", "person_id", value)
    found = {tuple(r) for r in masked_distribution(frame, value, by=by).collect()}
    if by:
        expected = {(8, g, *brute.distribution([p * g for p in range(8)])[1:]) for g in (1, 2)}
    else:
        expected = {brute.distribution([v for *_, v in rows])}
    assert found == expected
    assert masked_distribution(frame, value, by=by).columns[len(by) + 1] == f"min_{value}"


def test_values_must_be_whole_days(spark):
    frame = spark.createDataFrame([(1, 0.5)], "person_id long, days double")
    with pytest.raises(TypeError, match="whole number of days"):
        masked_distribution(frame, "days")


def test_threshold_zero(spark):
    frame = spark.createDataFrame([(p, 7, 1) for p in range(6)], "person_id long, `a-b` long, n_events long")
    found = masked_counts(frame, by=("a-b",), thresholds=(0, 1))
    assert found.columns[-2:] == ["excluded_patient_count_multiple_0", "excluded_patient_count_multiple"]
    assert values(found) == [(7, 6, 6, None)]


@pytest.mark.parametrize("kind, bits", [("tinyint", 7), ("smallint", 15), ("int", 31), ("bigint", 63)])
@pytest.mark.parametrize("keyed", [False, True])
def test_values_of_any_width(spark, kind, bits, keyed):
    rng = random.Random(bits)
    drawn = [rng.choice([rng.randrange(-(2**bits), 2**bits), rng.randrange(-3, 3)]) for _ in range(300)]
    drawn += [-(2**bits), 2**bits - 1] * 3
    rows = [(None if i % 3 == 0 else i % 3, v) for i, v in enumerate(drawn)]
    frame = spark.createDataFrame(rows, "g int, days long").selectExpr("g", f"CAST(days AS {kind}) AS days")
    found = masked_distribution(frame, "days", by=("g",) if keyed else (), saturate=None)
    assert dict(found.dtypes)["q25_days"] == kind
    if keyed:
        groups = {g: [v for h, v in rows if h == g] for g in (None, 1, 2)}
        assert {r[1]: (r[0], *r[2:]) for r in values(found)} == {g: brute.distribution(v, saturate=None) for g, v in groups.items()}
    else:
        assert values(found) == [brute.distribution(drawn, saturate=None)]


def test_cumulated_in_small_steps(spark, monkeypatch):
    # Groups of four values each, so that many levels are passed.
    from cohortspan.operators import stats

    monkeypatch.setattr(stats, "LEVEL", 2)
    monkeypatch.setattr(stats, "KEYED", 0)
    rng = random.Random(4)
    rows = [(k, v, rng.randint(1, 9)) for k in (1, None) for v in rng.sample(range(-128, 128), 90)]
    frame = spark.createDataFrame(rows, "k int, _v int, _copies long")
    for keys in ([], ["k"]):
        mine = frame if keys else frame.groupBy("_v").sum("_copies").toDF("_v", "_copies")
        found = {((r["k"] if keys else 0), r["_v"]): (r["_reached"], r["_total"]) for r in stats.cumulated(mine, keys, 8).collect()}
        expected = {}
        for k in {k for k, *_ in rows} if keys else {0}:
            own = Counter()
            for g, v, n in rows:
                if not keys or g == k:
                    own[v] += n
            at = 0
            for v in sorted(own):
                at += own[v]
                expected[k, v] = (at, own.total())
        assert found == expected

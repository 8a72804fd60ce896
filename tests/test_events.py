from datetime import date, datetime

import pytest

from cohortspan.functions.dates import as_date, days_between
from cohortspan.operators import events
from cohortspan.sources.cdm import Cdm
from pyspark.sql import functions as F
from tests.helpers import DAY, day, make_cdm, make_codesets, values


def frame(spark, rows):
    return spark.createDataFrame(rows, "person_id long, concept_id long, event_date date")


def index(spark, rows):
    return spark.createDataFrame(rows, "person_id long, index_date date")


def test_first_event(spark):
    rows = frame(spark, [(1, 5, day(3)), (1, 5, day(1)), (2, 5, None), (3, 5, None), (3, 5, day(9))])
    assert sorted(values(events.first_event(rows))) == [(1, day(1)), (3, day(9))]


@pytest.mark.parametrize(
    "offsets, nearest",
    [([5, -3], -3), ([3, -3], -3), ([-3, 3, 2], 2), ([0, 1, -1], 0), ([100000], 100000), ([-4, -4], -4)],
)
def test_nearest_event(spark, offsets, nearest):
    rows = frame(spark, [(1, 5, day(o)) for o in offsets])
    assert values(events.nearest_event(index(spark, [(1, DAY), (2, DAY)]), rows)) == [(1, nearest)]


def test_nearest_event_ignores_undated_events_and_strangers(spark):
    rows = frame(spark, [(1, 5, None), (1, 5, day(8)), (2, 5, None), (9, 5, day(1))])
    assert values(events.nearest_event(index(spark, [(1, DAY), (2, DAY)]), rows)) == [(1, 8)]


def test_nearest_event_per_concept(spark):
    rows = frame(spark, [(1, 5, day(8)), (1, 5, day(2)), (1, 6, day(-1)), (2, 5, day(1))])
    found = values(events.nearest_event(index(spark, [(1, DAY), (2, DAY)]), rows, by=("concept_id",)))
    assert sorted(found) == [(1, 5, 2), (1, 6, -1), (2, 5, 1)]


LABELLED = [
    (1, 5, day(4)),
    (2, 5, day(4)),
    (2, 7, None),
    (3, 7, day(1)),
    (4, 6, day(-2)),
    (4, 7, day(3)),
    (4, 7, day(2)),
    (4, 7, day(3)),
    (4, 8, day(-9)),
    (5, 99, day(1)),
    (9, 5, day(1)),
    (9, 7, day(1)),
]
SETS = {12: {5, 6}, 13: {6, 7, 8}}


def labelled(spark):
    return events.label_events(frame(spark, LABELLED), make_codesets(spark, SETS), wanted=12, barred=13)


def everyone(spark):
    return index(spark, [(p, DAY) for p in range(1, 6)])


def test_label_prefers_wanted(spark):
    found = {(p, c, b) for p, c, _, b in values(labelled(spark))}
    assert found == {(p, c, c in {7, 8}) for p, c, _ in LABELLED if c != 99}
    assert labelled(spark).count() == len(LABELLED) - 1


def test_barred_events(spark):
    who, rows = everyone(spark), labelled(spark)
    # A barred event without a date still bars.
    assert values(events.nearest_event_unless_barred(who, rows)) == [(1, 4)]
    assert sorted(values(events.nearest_barred_event(who, rows))) == [(4, 7, 2), (4, 8, -9)]
    assert sorted(values(events.count_barred_events(who, rows))) == [(2, 7, 1), (4, 7, 3), (4, 8, 1)]
    assert sorted(values(events.wanted_never_barred(rows))) == [(1,)]


def test_counted_events(spark):
    who, rows = everyone(spark), labelled(spark)
    once = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n_events"))
    assert sorted(values(events.count_barred_events(who, once))) == [(2, 7, 1), (4, 7, 3), (4, 8, 1)]


def test_exclude_and_require(spark):
    rows = frame(spark, [(1, 5, day(1)), (1, 5, day(2)), (8, 5, day(1))])
    who = index(spark, [(1, DAY), (2, DAY)])
    assert values(events.exclude(who, rows)) == [(2, DAY)]
    assert values(events.require(who, rows)) == [(1, DAY)]
    assert sorted(values(events.persons(rows))) == [(1,), (8,)]


def test_first_on_or_after(spark):
    who = index(spark, [(1, DAY), (2, DAY), (3, DAY)])
    rows = frame(spark, [(1, 5, day(-1)), (1, 5, day(7)), (1, 5, day(9)), (1, 6, day(9)), (2, 5, DAY), (3, 5, day(-1))])
    assert sorted(values(events.days_to_first(who, rows))) == [(1, 7), (2, 0)]
    assert sorted(values(events.days_on_or_after(who, rows))) == [(1, 7), (1, 9), (2, 0)]


def test_occurrences_count_rows(spark):
    rows = frame(spark, [(1, 5, day(2)), (1, 5, day(2)), (1, 6, day(3))])
    assert sorted(values(events.occurrences(rows))) == [(1, 5, 2, day(2)), (1, 6, 1, day(3))]


def test_days_are_calendar_days(spark):
    row = (datetime(2024, 1, 1, 23), datetime(2024, 1, 2, 1))
    for kind in ("timestamp", "timestamp_ntz"):
        df = spark.createDataFrame([row], f"a {kind}, b {kind}")
        a, b = (as_date(c, df.schema[c].dataType) for c in "ab")
        assert values(df.select(days_between(a, b), days_between(b, a))) == [(1, -1)]


def test_text_dates(spark):
    texts = [("20240115",), ("2024-01-15",), (None,)]
    df = spark.createDataFrame(texts, "d string")
    found = [r[0] for r in values(df.select(as_date("d", df.schema["d"].dataType)))]
    assert found == [date(2024, 1, 15), date(2024, 1, 15), None]
    number = spark.createDataFrame([(20240115,)], "d int")
    assert values(number.select(as_date("d", number.schema["d"].dataType))) == [(date(2024, 1, 15),)]


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_unreadable_dates_are_errors(spark, ansi):
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        for text in ("soon", "2024", "2024-01", "2024011", "20241345", "2024-13-45", "202401150", "", "15.01.2024"):
            df = spark.createDataFrame([(text,)], "d string")
            with pytest.raises(Exception, match="no date: "):
                df.select(as_date("d", df.schema["d"].dataType)).collect()
        timed = spark.createDataFrame([("2024-01-15 23:10:00",), ("2024-1-5T01:00",)], "d string")
        assert values(timed.select(as_date("d", timed.schema["d"].dataType))) == [(date(2024, 1, 15),), (date(2024, 1, 5),)]
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_unreadable_ids_are_errors(spark, ansi):
    from dataclasses import replace

    odd = spark.createDataFrame([("p1", 7, DAY)], "person_id string, measurement_concept_id long, measurement_date date")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        with pytest.raises(Exception, match="no id: p1"):
            replace(make_cdm(spark), measurement=odd).measurements().collect()
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")


def test_tables_are_checked_and_coerced(spark):
    cdm = make_cdm(spark)
    odd = spark.createDataFrame(
        [(1, 7, "20240115"), (None, 7, "20240116")],
        "PERSON_ID int, measurement_concept_id int, measurement_date string",
    )
    from dataclasses import replace

    fixed = replace(cdm, measurement=odd).measurements()
    assert [t for _, t in fixed.dtypes] == ["bigint", "bigint", "date"]
    assert values(fixed) == [(1, 7, date(2024, 1, 15))]
    with pytest.raises(ValueError, match="measurement lacks measurement_date"):
        replace(cdm, measurement=odd.drop("measurement_date"))


def test_tables_from_path_and_catalog(spark, tmp_path):
    cdm = make_cdm(spark, measurement=[(1, 5, DAY)], names={5: "five"})
    spark.sql("CREATE SCHEMA IF NOT EXISTS clinic")
    for name in ("measurement", "condition_occurrence", "drug_exposure", "concept", "concept_ancestor"):
        getattr(cdm, name).write.mode("overwrite").parquet(f"{tmp_path}/{name}")
        getattr(cdm, name).write.mode("overwrite").saveAsTable(f"clinic.{name}")
    for loaded in (Cdm.from_path(spark, str(tmp_path)), Cdm.from_catalog(spark, "clinic")):
        assert values(loaded.measurements()) == [(1, 5, DAY)]
        assert values(loaded.vocabulary().select("concept_name")) == [("five",)]


def test_folding_by_person_agrees_with_joins(spark):
    import random

    from cohortspan.operators import events
    from tests.helpers import day

    rng = random.Random(8)

    def some(n, *more):
        return [(rng.randint(1, 30), None if rng.random() < 0.1 else day(rng.randint(-9, 9)), *(rng.choice(m) for m in more)) for _ in range(n)]

    firsts = spark.createDataFrame(some(25), "person_id long, index_date date")
    index = firsts.where("index_date IS NOT NULL").groupBy("person_id").agg({"index_date": "min"}).toDF("person_id", "index_date")
    seen = spark.createDataFrame(some(60), "person_id long, event_date date")
    labelled = spark.createDataFrame(some(60, [False, False, True], [1, 2]), "person_id long, event_date date, barred boolean, concept_id long")
    cohort = index.join(events.wanted_never_barred(labelled), "person_id", "left_semi")
    pairs = [
        (events.nearest_to_first(firsts, seen), events.nearest_event(index, seen)),
        (events.nearest_to_first_unless_barred(firsts, labelled), events.nearest_event_unless_barred(index, labelled)),
        (events.days_to_first_of_cohort(firsts, labelled, seen), events.days_to_first(cohort, seen)),
    ]
    for folded, joined in pairs:
        assert sorted(values(folded)) == sorted(values(joined)) != []
        assert values(folded.limit(0)) == []
    none = firsts.limit(0)
    assert values(events.nearest_to_first(none, seen)) == values(events.days_to_first_of_cohort(none, labelled, seen)) == []

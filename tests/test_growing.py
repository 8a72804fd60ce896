"""Rows set aside, and counts that are merged."""

import os

import pytest
from pyspark.sql import functions as F

from cohortspan.operators import merging
from cohortspan.operators.events import occurrences
from cohortspan.sources.screening import screen, screen_table
from tests.helpers import day, make_cdm, values

TEXT = "person_id string, condition_concept_id string, condition_start_date string, extra string"


def test_unreadable_rows_are_set_aside(spark):
    rows = [
        ("1", "10", "2010-01-02", "a"),
        ("1", "10", "20100102", None),
        ("x", "10", "2010-01-02", "a"),
        ("x", "y", "soon", "a"),
        ("2", None, None, "a"),
        (None, "10", "2010-13-01", "a"),
        (None, "10", "2010-01-01", "a"),
        ("2", "", "2010-01-01", "a"),
        ("x", "10", "2010-01-02", "a"),
    ]
    good, rejected, counts = screen_table(spark.createDataFrame(rows, TEXT), "condition_occurrence")
    assert counts == {"n_rows": 9, "n_good": 4, "n_bad_person": 3, "n_bad_concept": 2, "n_bad_date": 2}
    assert good.columns == ["person_id", "condition_concept_id", "condition_start_date"]
    assert [t for _, t in good.dtypes] == ["bigint", "bigint", "date"]
    assert sorted(map(repr, values(good))) == sorted(
        map(repr, [(1, 10, day(1)), (1, 10, day(1)), (2, None, None), (None, 10, day(0))])
    )
    assert sorted(map(repr, values(rejected))) == sorted(
        map(
            repr,
            [
                ("condition_occurrence", "person", "x", "10", "2010-01-02"),
                ("condition_occurrence", "person", "x", "10", "2010-01-02"),
                ("condition_occurrence", "person", "x", "y", "soon"),
                ("condition_occurrence", "date", None, "10", "2010-13-01"),
                ("condition_occurrence", "concept", "2", "", "2010-01-01"),
            ],
        )
    )


def test_clean_and_empty_tables_lose_nothing(spark):
    cdm = make_cdm(spark, measurement=[(1, 5, day(3)), (2, 6, None)], condition_occurrence=[(1, 7, day(1))])
    found = screen(cdm)
    assert found.rejected.count() == 0
    assert {r.event_table: (r.n_rows, r.n_good) for r in found.counts.collect()} == {
        "measurement": (2, 2),
        "condition_occurrence": (1, 1),
        "drug_exposure": (0, 0),
    }
    assert sorted(map(repr, values(found.cdm.measurements()))) == sorted(map(repr, values(cdm.measurements())))
    assert found.cdm.drugs().count() == 0


def test_the_table_is_read_once(spark):
    read = spark.sparkContext.accumulator(0)

    def passing(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    source = spark.createDataFrame([("1", "2", "2010-01-01", None)] * 500, TEXT)
    screen_table(source.mapInArrow(passing, source.schema), "condition_occurrence")
    assert read.value == 500


EVENTS = "person_id long, concept_id long, event_date date"


def _same(spark, path, rows):
    whole = occurrences(spark.createDataFrame(rows, EVENTS))
    merged = merging.merged_occurrences(spark, path)
    assert sorted(map(repr, values(merged.select(whole.columns)))) == sorted(map(repr, values(whole)))


def test_days_are_merged_and_replaced(spark, tmp_path):
    path = str(tmp_path / "counts")
    first = [(1, 5, day(0)), (1, 5, day(0)), (2, 5, day(0)), (1, 6, day(1)), (3, None, None)]
    merging.add_batches(spark.createDataFrame(first, EVENTS), path, F.col("event_date"))
    _same(spark, path, first)
    untouched = {d: sorted(os.listdir(f"{path}/{d}")) for d in os.listdir(path) if d.startswith("batch=") and d != "batch=2010-01-02"}
    late = [(1, 6, day(1)), (2, 6, day(1)), (1, 5, day(2))]
    for _ in range(2):  # The same delivery again changes nothing.
        merging.add_batches(spark.createDataFrame(late, EVENTS), path, F.col("event_date"))
        _same(spark, path, [r for r in first if r[2] != day(1)] + late)
    assert {d: sorted(os.listdir(f"{path}/{d}")) for d in untouched} == untouched
    merging.add_batches(spark.createDataFrame([], EVENTS), path, F.col("event_date"))
    _same(spark, path, [r for r in first if r[2] != day(1)] + late)


def test_a_failed_delivery_leaves_the_counts(spark, tmp_path):
    path = str(tmp_path / "counts")
    first = [(1, 5, day(0)), (2, 5, day(1))]
    merging.add_batches(spark.createDataFrame(first, EVENTS), path, F.col("event_date"))
    broken = spark.createDataFrame([(p, 5, day(0)) for p in range(50)], EVENTS).withColumn(
        "person_id", F.expr("if(person_id = 49, raise_error('lost'), person_id)").cast("long")
    )
    with pytest.raises(Exception, match="lost"):
        merging.add_batches(broken, path, F.col("event_date"))
    _same(spark, path, first)


def test_days_fold_to_months(spark, tmp_path):
    rows = [(p % 3, p % 2, day(p)) for p in range(90)] + [(1, 1, None)]
    merging.add_batches(spark.createDataFrame(rows, EVENTS), str(tmp_path / "days"), F.col("event_date"))
    merging.fold_batches(spark, str(tmp_path / "days"), str(tmp_path / "months"), F.substring("batch", 1, 7))
    _same(spark, str(tmp_path / "months"), rows)
    assert len([d for d in os.listdir(tmp_path / "months") if d.startswith("batch=")]) == 4

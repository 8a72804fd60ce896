from cohortspan.__main__ import main
from cohortspan.plans.reports import REPORTS
from cohortspan.sources.cdm import EVENT_TABLES
from cohortspan.sources.definitions import SCHEMA, define
from tests.brute import Cohort
from tests.helpers import make_cdm
from tests.test_reports import NAMES, SETS, made_up


def test_reports_are_written(spark, tmp_path):
    data = made_up(9)
    cdm = make_cdm(spark, *data, {c: NAMES.get(c, f"concept {c}") for s in SETS.values() for c in s})
    for name in (*EVENT_TABLES, "concept", "concept_ancestor"):
        getattr(cdm, name).write.parquet(f"{tmp_path}/cdm/{name}")
    rows = [row for s, concepts in SETS.items() for row in define(s, concepts)]
    spark.createDataFrame(rows, SCHEMA).write.option("header", True).csv(f"{tmp_path}/sets")
    main(["--cdm-path", f"{tmp_path}/cdm", "--definitions", f"{tmp_path}/sets", "--output", f"{tmp_path}/out"])
    for disease, number in (("nsclc", 12), ("bladder", 15)):
        truth = Cohort(*data, SETS, number)
        for report in ("days_to_diagnosis", "days_to_diagnosis_clean", "time_to_treatment"):
            found = spark.read.option("header", True).csv(f"{tmp_path}/out/{disease}_{report}").collect()
            expected = getattr(truth, report)()
            assert [tuple(r) for r in found] == [tuple(None if v is None else str(v) for v in r) for r in expected]
        counted = spark.read.option("header", True).csv(f"{tmp_path}/out/{disease}_exclusion_counts")
        assert counted.columns[0] == "concept_name" and counted.count() > 0


def test_built_in_sets(spark, tmp_path):
    # Set 12 comes from the file, the index and drug sets are built in.
    from tests.helpers import day

    people = range(6)
    cdm = make_cdm(
        spark,
        measurement=[(p, 1635142, day(0)) for p in people],
        condition_occurrence=[(p, 777, day(-p)) for p in people],
        names={1635142: "index", 777: "disease"},
    )
    for name in (*EVENT_TABLES, "concept", "concept_ancestor"):
        getattr(cdm, name).write.mode("overwrite").saveAsTable(f"{name}")
    (tmp_path / "nsclc.csv").write_text("concept_id\n777\n")
    main(["--cdm-schema", "default", "--nsclc", str(tmp_path / "nsclc.csv"), "--output", f"{tmp_path}/out"])
    main(["--cdm-schema", "default", "--output", f"{tmp_path}/without"])
    assert sorted(x.name for x in (tmp_path / "without").iterdir()) == sorted(f"bladder_{name}" for name in REPORTS)
    found = spark.read.option("header", True).csv(f"{tmp_path}/out/nsclc_days_to_diagnosis").first()
    assert (found["n"], found["min_days_to_diag"], found["max_days_to_diag"]) == ("6", "-5", "0")

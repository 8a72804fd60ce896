"""Event tables laid out by concept, and tables staged by person."""

import os

import pytest

from cohortspan.operators.concepts import stage_codesets
from cohortspan.operators.events import events_in, label_events
from cohortspan.plans.reports import REPORTS, CohortSpec, run_all
from cohortspan.sources.cdm import Cdm
from cohortspan.sources.layout import lay_out
from cohortspan.sources.staging import session_dir, stage_by
from tests.helpers import day, make_cdm, make_codesets, values
from tests.test_plans import plan, ran
from tests.test_reports import NAMES, SETS, made_up


def leaves(df):
    """The scans of the plan that ``df`` ran by."""
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        elif kind == "FileSourceScanExec":
            found.append(node)
        else:
            todo += [node.children().apply(i) for i in range(node.children().size())]
    return found


def files_read(df, column):
    """Files that scans of tables with this column read when ``df`` was collected last."""
    scans = [n for n in leaves(df) if column in n.relation().schema().fieldNames()]
    assert scans
    return sum(n.metrics().apply("numFiles").value() for n in scans)


def test_only_folders_of_the_concepts_are_read(spark, tmp_path):
    rows = [(p, c, day(p)) for c in range(40) for p in range(3)] + [(1, None, day(0)), (1, 3, None), (None, 3, day(0))]
    cdm = make_cdm(spark, condition_occurrence=rows)
    laid = lay_out(cdm, str(tmp_path / "laid"), parts=16)
    sets = stage_codesets(make_codesets(spark, {1: {3}, 2: {3, 4}, 3: set(range(40)), 4: {99}}))
    folder = tmp_path / "laid" / "condition_occurrence"
    whole = sum(name.endswith(".parquet") for _, _, names in os.walk(folder) for name in names)
    assert len([d for d in os.listdir(folder) if "=" in d]) > 10
    files = {}
    for codeset in (1, 2, 3, 4):
        concepts = sets.where(f"codeset_id = {codeset}")
        found = events_in(laid.conditions(), concepts)
        assert sorted(found.columns) == ["concept_id", "event_date", "person_id"]
        assert "dynamicpruning" in plan(found)
        assert sorted(map(repr, values(found))) == sorted(map(repr, values(events_in(cdm.conditions(), concepts))))
        files[codeset] = files_read(found, "condition_concept_id")
    assert 0 < files[1] <= files[2] <= 4 < whole
    labelled, plain = (label_events(t.conditions(), sets, wanted=1, barred=2) for t in (laid, cdm))
    assert sorted(map(repr, values(labelled))) == sorted(map(repr, values(plain)))
    assert files_read(labelled, "condition_concept_id") == files[2]


def test_every_row_of_a_person_is_laid_out(spark, tmp_path):
    rows = [(1, None, day(0)), (2, 5, None), (None, 5, day(0)), (2, 5, None)]
    cdm = make_cdm(spark, measurement=rows)
    laid = lay_out(cdm, str(tmp_path / "laid"), parts=1)
    kept = laid.measurements().select("person_id", "concept_id", "event_date")
    assert sorted(map(repr, values(kept))) == sorted(map(repr, values(cdm.measurements())))
    assert laid.drugs().count() == 0
    with pytest.raises(Exception, match="(?i)exists"):
        lay_out(cdm, str(tmp_path / "laid"), parts=1)
    with pytest.raises(ValueError):
        lay_out(cdm, str(tmp_path / "none"), parts=0)


def test_reports_on_laid_out_tables(spark, tmp_path):
    cdm = make_cdm(spark, *made_up(3), NAMES)
    sets = stage_codesets(make_codesets(spark, SETS))
    lay_out(cdm, str(tmp_path), parts=8)
    for name in ("concept", "concept_ancestor"):
        getattr(cdm, name).write.parquet(f"{tmp_path}/{name}")
    read = Cdm.from_path(spark, str(tmp_path))
    for name, report in REPORTS.items():
        expected = values(report(cdm, sets, CohortSpec(disease=12)))
        assert sorted(map(repr, values(report(read, sets, CohortSpec(disease=12))))) == sorted(map(repr, expected)), name
    cut = read.narrowed(sets)
    assert cut.conditions().columns == ["person_id", "concept_id", "event_date"]


def test_a_frequent_concept_is_written_by_many_tasks(spark, tmp_path):
    rows = spark.range(60_000).selectExpr("id AS person_id", "7L AS drug_concept_id", "date_add(DATE'2010-01-01', int(id % 4000)) AS drug_exposure_start_date")
    cdm = make_cdm(spark)
    cdm = Cdm(cdm.measurement, cdm.condition_occurrence, rows, cdm.concept, cdm.concept_ancestor)
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "100kb")
    try:
        laid = lay_out(cdm, str(tmp_path / "laid"), parts=8)
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    folder = tmp_path / "laid" / "drug_exposure"
    assert sum(name.endswith(".parquet") for _, _, names in os.walk(folder) for name in names) > 1
    assert laid.drugs().count() == 60_000


@pytest.mark.parametrize("name", list(REPORTS))
def test_staged_reports_do_not_shuffle_by_person(spark, name):
    cdm = make_cdm(spark, *made_up(5), NAMES)
    sets = stage_codesets(make_codesets(spark, SETS))
    # Without broadcasts, as with cohorts that are too large for them.
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        report = run_all(cdm, sets, {"a": CohortSpec(disease=12)}, [name])[f"a_{name}"]
        text = ran(report)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    shuffles = [line for line in text.splitlines() if "Exchange hashpartitioning(person_id" in line]
    assert not shuffles, "\n".join(shuffles)
    assert "Bucketed: true" in text
    expected = values(REPORTS[name](cdm, sets, CohortSpec(disease=12)))
    assert sorted(map(repr, values(report))) == sorted(map(repr, expected))


def test_bucketed_tables_keep_their_rows_until_dropped(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (None, "b"), (1, "a"), (2, None)], "person_id long, extra string")
    staged = stage_by(rows, "some-rows", "person_id", buckets=3)
    assert sorted(map(repr, values(staged))) == sorted(map(repr, values(rows)))
    assert stage_by(rows.limit(0), "none", "person_id").count() == 0
    names = [t.name for t in spark.catalog.listTables() if t.name.startswith("cohortspan_staged_some_rows")]
    assert len(names) == 1 and os.path.isdir(f"{session_dir(spark)}/{names[0]}")

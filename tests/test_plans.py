"""What the physical plans must and must not contain."""

import re

import pytest

from cohortspan.operators.concepts import stage_codesets
from cohortspan.plans.reports import REPORTS, CohortSpec
from cohortspan.sources.cdm import EVENT_TABLES, Cdm
from tests.helpers import make_cdm, make_codesets
from tests.test_reports import NAMES, SETS, made_up


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("cdm")
    cdm = make_cdm(spark, *made_up(1), NAMES)
    for name in (*EVENT_TABLES, "concept", "concept_ancestor"):
        getattr(cdm, name).write.parquet(f"{folder}/{name}")
    return Cdm.from_path(spark, str(folder)), stage_codesets(make_codesets(spark, SETS))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scans(text, table):
    return len(re.findall(rf"FileScan parquet [^\n]*/{table}\b", text))


def ran(df):
    """The plan as it ran: adaptive execution reads a shuffle again that two branches share."""
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0]


@pytest.mark.parametrize("name", list(REPORTS))
def test_report_plans(stored, name):
    cdm, codesets = stored
    text = plan(REPORTS[name](cdm, codesets, CohortSpec(disease=12)))
    for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "SortAggregate"):
        assert unwanted not in text
    # Only sets of days need an aggregate that holds objects.
    assert all("collect_set(day" in line for line in text.splitlines() if "ObjectHashAggregate" in line)
    text = ran(REPORTS[name](cdm, codesets, CohortSpec(disease=12)))
    assert scans(text, "measurement") == 1
    assert scans(text, "condition_occurrence") == 1
    assert scans(text, "drug_exposure") == (name == "time_to_treatment")
    # Concept sets are small on disk, so no event is shuffled by concept before it is filtered.
    assert "LeftSemi, BuildRight" in text
    assert not re.search(r"hashpartitioning\((condition_|measurement_|drug_)?concept_id[^,]*, \d+\)[^\n]*\n[^\n]*FileScan", text)


FOLDED = ["days_to_diagnosis", "days_to_diagnosis_clean", "time_to_treatment"]


@pytest.mark.parametrize("name", FOLDED)
def test_single_partition_holds_groups_of_values_only(stored, name):
    """No window sees the histogram in one partition: what is cumulated there are sums by leading bits."""
    cdm, codesets = stored
    lines = plan(REPORTS[name](cdm, codesets, CohortSpec(disease=12))).splitlines()
    single = [i for i, line in enumerate(lines) if "Exchange SinglePartition" in line]
    assert len(single) == 1
    assert "functions=[sum(_copies#" in lines[single[0] + 1]
    windows = [line for line in lines if re.search(r"Window \[", line)]
    assert windows and all("_node#" in line or "sum(_copies" in line for line in windows)


@pytest.mark.parametrize("name", FOLDED)
def test_one_shuffle_by_person_and_no_join(stored, name):
    cdm, codesets = stored
    text = plan(REPORTS[name](cdm, codesets, CohortSpec(disease=12)))
    # The histogram is read twice, from one shuffle, so every exchange is written once for each reader.
    by_person = re.findall(r"Exchange hashpartitioning\(person_id#\d+L, \d+\)", text)
    assert len(by_person) == 2
    assert not re.search(r"(MergeJoin|HashJoin|LoopJoin) \[person_id", text)
    assert "event_date >= index_date" not in text
    executed = ran(REPORTS[name](cdm, codesets, CohortSpec(disease=12)))
    assert len(re.findall(r"Exchange hashpartitioning\(person_id#\d+L, \d+\)", executed)) == 1


def test_labelling_joins_the_sets_once(stored):
    from cohortspan.operators.events import label_events

    cdm, codesets = stored
    text = plan(label_events(cdm.conditions(), codesets, 12, 13))
    assert len(re.findall(r"(MergeJoin|HashJoin|LoopJoin)", text)) == 1


@pytest.mark.parametrize("name", list(REPORTS))
def test_person_joins_are_fed_by_aggregates(stored, name):
    """Whatever is shuffled by person alone has been reduced to distinct rows per person first."""
    cdm, codesets = stored
    lines = plan(REPORTS[name](cdm, codesets, CohortSpec(disease=12))).splitlines()
    by_person = [i for i, line in enumerate(lines) if re.search(r"Exchange hashpartitioning\(person_id#\d+L, \d+\)", line)]
    assert by_person
    for i in by_person:
        # A join with a broadcast index, whose streamed side comes next, keeps one row per row.
        rest = [line for line in lines[i + 1 :] if not re.search("Project|Filter|BroadcastHashJoin.*BuildRight", line)]
        assert "HashAggregate" in rest[0], rest[0]


def test_person_windows_see_aggregates(stored):
    """A window that gathers a person's rows gets one row a concept, never event rows."""
    cdm, codesets = stored
    for name in ("exclusion_counts", "exclusion_days"):
        lines = plan(REPORTS[name](cdm, codesets, CohortSpec(disease=12))).splitlines()
        windows = [i for i, line in enumerate(lines) if "Window" in line and "[person_id#" in line]
        assert windows
        for i in windows:
            rest = [x for x in lines[i + 1 :] if not re.search("Sort|Project|Filter|Exchange|BroadcastHashJoin|SortMergeJoin", x)]
            assert "HashAggregate(keys=[person_id" in rest[0] and "concept_id" in rest[0], rest[0]


@pytest.mark.parametrize(
    "names, labels",
    [
        (["days_to_diagnosis", "exclusion_days"], ["conditions", "conditions", "index"]),
        (["time_to_treatment"], ["conditions", "conditions", "index", "treatments"]),
    ],
)
def test_tables_that_are_staged(stored, monkeypatch, names, labels):
    from cohortspan.plans import reports

    seen = []
    staged = reports.stage_by
    monkeypatch.setattr(reports, "stage_by", lambda df, label, key: seen.append(label) or staged(df, label, key))
    cdm, codesets = stored
    reports.run_all(cdm, codesets, {"a": CohortSpec(disease=12), "b": CohortSpec(disease=15)}, names)
    assert sorted(seen) == labels


def test_scans_read_three_columns(stored):
    cdm, codesets = stored
    text = plan(REPORTS["exclusion_days"](cdm, codesets, CohortSpec(disease=12)))
    for schema in re.findall(r"ReadSchema: struct<([^>]*)>", text):
        assert schema.count(":") <= 3


def test_validity_and_set_filters_reach_the_scan(stored):
    cdm, codesets = stored
    text = plan(REPORTS["days_to_diagnosis"](cdm, codesets, CohortSpec(disease=12)))
    assert "EqualTo(codeset_id,12)" in text and "EqualTo(codeset_id,6)" in text
    assert "IsNotNull(person_id)" in text


def test_shared_folder_is_the_sessions(spark, stored):
    _, codesets = stored
    assert all(spark.conf.get("spark.checkpoint.dir") in f for f in codesets.inputFiles())

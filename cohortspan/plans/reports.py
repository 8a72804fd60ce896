"""The five reports on a disease cohort.

The cohort is indexed by the first event of concept set ``index`` in ``measurement``. Exclusion concepts
are those of set ``other`` outside the disease set. Each report scans each event table once.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspan.operators.concepts import concepts_of, difference, with_names
from cohortspan.operators.events import (
    count_barred_events,
    days_to_first,
    days_to_first_of_cohort,
    events_in,
    first_event,
    label_events,
    nearest_barred_event,
    nearest_event,
    nearest_event_unless_barred,
    nearest_to_first,
    nearest_to_first_unless_barred,
    wanted_never_barred,
)
from cohortspan.operators.stats import masked_counts, masked_distribution
from cohortspan.sources.cdm import Cdm
from cohortspan.sources.staging import stage_by


@dataclass(frozen=True)
class CohortSpec:
    """Which concept set plays which part, and the disclosure limits."""

    disease: int
    index: int = 6
    treatment: int = 11
    other: int = 13
    min_count: int = 5
    saturate: int | None = 9999


NSCLC = CohortSpec(disease=12)
BLADDER = CohortSpec(disease=15)


@dataclass(frozen=True)
class Parts:
    """What the reports on one cohort read: the index, labelled conditions and treatments.

    ``firsts`` has the dates of which a person's earliest is the index date, so that reports that fold by person
    anyway need no index by itself. A report computes those it needs; ``run_all`` stages them for all reports of a disease.
    Staged parts are bucketed by person: there joins by person move nothing, while a union of parts would lose the buckets.
    """

    firsts: DataFrame
    index: DataFrame
    conditions: DataFrame
    treatments: DataFrame | None
    staged: bool = False


def _parts(cdm: Cdm, codesets: DataFrame, spec: CohortSpec) -> Parts:
    starting = events_in(cdm.measurements(), concepts_of(codesets, spec.index))
    return Parts(
        firsts=starting.select("person_id", F.col("event_date").alias("index_date")),
        index=first_event(starting),
        # Disease diagnoses, and as barred events those of exclusion concepts.
        conditions=label_events(cdm.conditions(), codesets, wanted=spec.disease, barred=spec.other),
        treatments=events_in(cdm.drugs(), concepts_of(codesets, spec.treatment)),
    )


def _exclusions(codesets: DataFrame, spec: CohortSpec) -> DataFrame:
    return difference(codesets, keep=spec.other, minus=spec.disease)


def _distribution(days: DataFrame, value: str, spec: CohortSpec, by: tuple[str, ...] = ()) -> DataFrame:
    # Differences of dates have 32 bits, which makes their ranks cheaper; results are of the wider type.
    short = days.select("person_id", *by, F.col("days").cast("int").alias(value))
    found = masked_distribution(short, value, by=by, min_count=spec.min_count, saturate=spec.saturate)
    return found.select([F.col(c).cast("long").alias(c) if c.endswith(value) else F.col(c) for c in found.columns])


def days_to_diagnosis(cdm: Cdm, codesets: DataFrame, spec: CohortSpec, parts: Parts | None = None) -> DataFrame:
    """Days from the index date to the nearest disease diagnosis."""
    if parts:
        diagnoses = parts.conditions.where("NOT barred")
    else:
        parts = _parts(cdm, codesets, spec)
        diagnoses = events_in(cdm.conditions(), concepts_of(codesets, spec.disease))
    nearest = nearest_event(parts.index, diagnoses) if parts.staged else nearest_to_first(parts.firsts, diagnoses)
    return _distribution(nearest, "days_to_diag", spec)


def days_to_diagnosis_clean(cdm: Cdm, codesets: DataFrame, spec: CohortSpec, parts: Parts | None = None) -> DataFrame:
    """``days_to_diagnosis`` without persons who ever had an exclusion diagnosis."""
    parts = parts or _parts(cdm, codesets, spec)
    if parts.staged:
        nearest = nearest_event_unless_barred(parts.index, parts.conditions)
    else:
        nearest = nearest_to_first_unless_barred(parts.firsts, parts.conditions)
    return _distribution(nearest, "days_to_diag", spec)


def exclusion_counts(cdm: Cdm, codesets: DataFrame, spec: CohortSpec, parts: Parts | None = None) -> DataFrame:
    """How many cohort members each exclusion concept hits, and how many of them repeatedly.

    Ordered by the reported count, so suppressed concepts come last.
    """
    parts = parts or _parts(cdm, codesets, spec)
    members = count_barred_events(parts.index, parts.conditions)
    counts = masked_counts(members, min_count=spec.min_count)
    return (
        with_names(counts, cdm.concept, _exclusions(codesets, spec))
        .orderBy(F.desc("excluded_patient_count"), "concept_id")
        .select("concept_name", *[c for c in counts.columns if c != "concept_id"])
    )


def exclusion_days(cdm: Cdm, codesets: DataFrame, spec: CohortSpec, parts: Parts | None = None) -> DataFrame:
    """Days from the index date to the nearest diagnosis of each exclusion concept, among the cohort."""
    parts = parts or _parts(cdm, codesets, spec)
    nearest = nearest_barred_event(parts.index, parts.conditions)
    found = _distribution(nearest, "days_to_diag", spec, by=("concept_id",))
    named = with_names(found, cdm.concept, _exclusions(codesets, spec))
    statistics = [c for c in found.columns if c not in ("n", "concept_id")]
    return named.select("n", F.col("concept_id").alias("condition_concept_id"), "concept_name", *statistics)


def time_to_treatment(cdm: Cdm, codesets: DataFrame, spec: CohortSpec, parts: Parts | None = None) -> DataFrame:
    """Days from the index date to the first drug, in the cohort without exclusion diagnoses.

    Members need a disease diagnosis at any date; untreated members are dropped, not censored.
    """
    parts = parts or _parts(cdm, codesets, spec)
    if parts.staged:
        members = parts.index.join(wanted_never_barred(parts.conditions), "person_id", "left_semi")
        days = days_to_first(members, parts.treatments)
    else:
        days = days_to_first_of_cohort(parts.firsts, parts.conditions, parts.treatments)
    return _distribution(days, "days_to_treatment", spec)


REPORTS = {
    "days_to_diagnosis": days_to_diagnosis,
    "days_to_diagnosis_clean": days_to_diagnosis_clean,
    "exclusion_counts": exclusion_counts,
    "exclusion_days": exclusion_days,
    "time_to_treatment": time_to_treatment,
}


def run_all(
    cdm: Cdm, codesets: DataFrame, specs: dict[str, CohortSpec], names: Sequence[str] = tuple(REPORTS)
) -> dict[str, DataFrame]:
    """The named reports for every disease.

    Staged are: the index of each index set, the treatments of its persons if a report asks for them, and for
    each disease the labelled conditions of its persons, equal events once with their number. Each event
    table is read once for each of these, and not at all if no report asks. What is staged is bucketed by
    person, so the reports join and fold it by person where it lies.
    """
    indexes: dict[int, DataFrame] = {}
    treatments: dict[tuple[int, int], DataFrame] = {}
    conditions: dict[tuple[int, int, int], DataFrame] = {}
    found = {}
    for disease, spec in specs.items():
        fresh = _parts(cdm, codesets, spec)
        if spec.index not in indexes:
            indexes[spec.index] = stage_by(fresh.index, "index", "person_id")
        index = indexes[spec.index]
        drugs = None
        if "time_to_treatment" in names:
            key = (spec.index, spec.treatment)
            if key not in treatments:
                treatments[key] = stage_by(_of_persons(fresh.treatments, index), "treatments", "person_id")
            drugs = treatments[key]
        key = (spec.index, spec.disease, spec.other)
        if key not in conditions:
            conditions[key] = stage_by(_of_persons(fresh.conditions, index, "barred"), "conditions", "person_id")
        parts = Parts(index, index, conditions[key], drugs, staged=True)
        found |= {f"{disease}_{name}": REPORTS[name](cdm, codesets, spec, parts) for name in names}
    return found


def _of_persons(events: DataFrame, index: DataFrame, *more: str) -> DataFrame:
    """Events of persons with an index, equal ones once; counted before they are shuffled by person."""
    counted = events.groupBy("person_id", "concept_id", "event_date", *more).agg(F.count(F.lit(1)).alias("n_events"))
    return counted.join(index.select("person_id"), "person_id", "left_semi")

from datetime import date, timedelta

from cohortspan.sources.cdm import EVENT_TABLES, Cdm

DAY = date(2010, 1, 1)


def day(offset):
    return DAY + timedelta(days=offset)


def event_frame(spark, table, rows):
    concept, when = EVENT_TABLES[table]
    return spark.createDataFrame(rows, f"person_id long, {concept} long, {when} date")


def make_cdm(spark, measurement=(), condition_occurrence=(), drug_exposure=(), names=None):
    """Rows are (person, concept, date). ``names`` maps concept to name."""
    concepts = [(c, n, None) for c, n in (names or {}).items()]
    return Cdm(
        measurement=event_frame(spark, "measurement", list(measurement)),
        condition_occurrence=event_frame(spark, "condition_occurrence", list(condition_occurrence)),
        drug_exposure=event_frame(spark, "drug_exposure", list(drug_exposure)),
        concept=spark.createDataFrame(concepts, "concept_id long, concept_name string, invalid_reason string"),
        concept_ancestor=spark.createDataFrame([], "ancestor_concept_id long, descendant_concept_id long"),
    )


def make_codesets(spark, sets):
    rows = [(s, c) for s, concepts in sets.items() for c in sorted(concepts)]
    return spark.createDataFrame(rows, "codeset_id int, concept_id long")


def values(df):
    return [tuple(row) for row in df.collect()]

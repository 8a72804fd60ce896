
from __future__ import annotations

import sys
import uuid
from collections.abc import Callable
from dataclasses import replace
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

sys.path.insert(0, str(Path(__file__).resolve().parent))

import oracles  # noqa: E402
from cohortspan.functions.dates import as_date, days_between  # noqa: E402
from cohortspan.operators import concepts, events, merging, stats  # noqa: E402
from cohortspan.plans.reports import REPORTS, CohortSpec, run_all  # noqa: E402
from cohortspan.sources import sample  # noqa: E402
from cohortspan.sources.cdm import EVENT_TABLES, Cdm  # noqa: E402
from cohortspan.sources.definitions import read_definitions  # noqa: E402
from cohortspan.sources.layout import lay_out  # noqa: E402
from cohortspan.sources.screening import Screened, screen  # noqa: E402
from cohortspan.sources.staging import session_dir  # noqa: E402

# The operators on documents and pages are a part of their own, which may be left out.
# Whatever they need may be missing too; the other queries do without.
try:
    import corpus_pipeline  # noqa: E402
    from cohortspan.llm import queries as llm  # noqa: E402
except ImportError as missing:
    print(f"without the operators on documents: {missing}", file=sys.stderr)
    llm = corpus_pipeline = None

SMOKE_DIR = "/root/testdata/sf0.001"
SPECS = {"disease_a": CohortSpec(disease=sample.DISEASE_A), "disease_b": CohortSpec(disease=sample.DISEASE_B)}

Query = Callable[[SparkSession, str], DataFrame]

# Resolved concept sets per Spark application and folder: like a session table, they are written once
# and read by every report of the session.
_staged: dict[tuple[str, str], DataFrame] = {}
# The clinical tables, which are plain views of the given ones.
_views: dict[tuple[str, str], Cdm] = {}
# The same, laid out by concept.
_laid: dict[tuple[str, int], Cdm] = {}


def _cdm(spark: SparkSession, sf_dir: str) -> Cdm:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _views:
        _views[key] = sample.sample_cdm(spark, sf_dir)
    return _views[key]


def _resolve(spark: SparkSession, cdm: Cdm, definitions: DataFrame | None = None) -> DataFrame:
    return concepts.resolve(definitions or sample.definitions(spark), cdm.vocabulary(), cdm.concept_ancestor)


def codesets_for(spark: SparkSession, sf_dir: str, cdm: Cdm) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _staged:
        _staged[key] = concepts.stage_codesets(_resolve(spark, cdm))
    return _staged[key]


def _on_cdm(query: Callable[[SparkSession, Cdm], DataFrame]) -> Query:
    return lambda spark, sf_dir: query(spark, _cdm(spark, sf_dir))


def _on_sets(query: Callable[[Cdm, DataFrame], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        cdm = _cdm(spark, sf_dir)
        return query(cdm, codesets_for(spark, sf_dir, cdm))

    return run


def _report(name: str, spec: CohortSpec) -> Query:
    return _on_sets(lambda cdm, sets: REPORTS[name](cdm, sets, spec))


def _text(name: str) -> Column:
    """Dates leave as text, which both engines print alike."""
    return F.date_format(name, "yyyy-MM-dd").alias(name)


def _dated(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[_text(c) if c in names else c for c in df.columns])


def _scan(table: Callable[[Cdm], DataFrame]) -> Query:
    return _on_cdm(lambda spark, cdm: _dated(table(cdm), "event_date").select("person_id", "concept_id", "event_date"))


def _in_set(cdm: Cdm, sets: DataFrame, codeset: int) -> DataFrame:
    return events.events_in(cdm.conditions(), concepts.concepts_of(sets, codeset))


def _barred(cdm: Cdm, sets: DataFrame) -> DataFrame:
    others = concepts.difference(sets, sample.OTHERS, sample.DISEASE_A)
    return events.events_in(cdm.conditions(), others)


def _labelled(cdm: Cdm, sets: DataFrame) -> DataFrame:
    return events.label_events(cdm.conditions(), sets, wanted=sample.DISEASE_A, barred=sample.OTHERS)


def _sets_shallow(spark: SparkSession, cdm: Cdm) -> DataFrame:
    definitions = sample.definitions(spark).where("NOT is_excluded").withColumn("include_descendants", F.lit(False))
    return _resolve(spark, cdm, definitions)


def _sets_view(cdm: Cdm, sets: DataFrame) -> DataFrame:
    # The sets are staged already; a view of them writes nothing.
    sets.createOrReplaceTempView("codesets")
    return sets.sparkSession.sql(
        "SELECT codeset_id, count(*) AS n_concepts, min(concept_id) AS lowest, max(concept_id) AS highest "
        "FROM codesets GROUP BY codeset_id"
    )


def _definitions_from_file(spark: SparkSession, cdm: Cdm) -> DataFrame:
    path = f"{session_dir(spark)}/definitions.csv"
    sample.definitions(spark).write.mode("overwrite").option("header", True).csv(path)
    return _resolve(spark, cdm, read_definitions(spark, path))


def _catalog_tables(spark: SparkSession, cdm: Cdm) -> DataFrame:
    # Views of a schema are found by the same path as tables, and write nothing.
    for name in (*EVENT_TABLES, "concept", "concept_ancestor"):
        getattr(cdm, name).createOrReplaceGlobalTempView(name)
    return _event_counts(Cdm.from_catalog(spark, spark.conf.get("spark.sql.globalTempDatabase", "global_temp")))


def _saved_sets(cdm: Cdm, sets: DataFrame) -> DataFrame:
    path = f"{session_dir(sets.sparkSession)}/saved-codesets"
    return concepts.save_codesets(sets, "cohortspan_codesets", path)


def _ordered(report: DataFrame) -> DataFrame:
    """The rows of a report with their place in it."""
    return report.coalesce(1).withColumn("position", F.monotonically_increasing_id() + 1)


def _everyone(cdm: Cdm) -> DataFrame:
    return events.first_event(cdm.measurements())


def _nearest(cdm: Cdm, by: tuple[str, ...] = ()) -> DataFrame:
    return events.nearest_event(_everyone(cdm), cdm.conditions(), by=by)


def _distribution(cdm: Cdm, by: tuple[str, ...] = (), **options) -> DataFrame:
    return stats.masked_distribution(_nearest(cdm, by), "days", by=by, **options)


def _date_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    day = F.col("l_shipdate").cast("date")
    # Both tolerated spellings occur.
    spelled = F.when(F.col("l_linenumber") % 2 == 0, F.date_format(day, "yyyyMMdd")).otherwise(day.cast("string"))
    spelled = lines.select("l_orderkey", "l_linenumber", spelled.alias("event_date"))
    return _dated(spelled.withColumn("event_date", as_date("event_date", T.StringType())), "event_date")


def _days_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    ordered = as_date("o_orderdate", orders.schema["o_orderdate"].dataType)
    shipped = as_date("l_shipdate", lines.schema["l_shipdate"].dataType)
    days = days_between(ordered, shipped).cast("long")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "l_orderkey", "l_linenumber", days.alias("days")
    )


def _cohort_size(cdm: Cdm, sets: DataFrame) -> DataFrame:
    index = events.first_event(events.events_in(cdm.measurements(), concepts.concepts_of(sets, sample.INDEX)))
    # One row per person already, so a plain count is the distinct count.
    return events.require(index, _in_set(cdm, sets, sample.DISEASE_A)).agg(F.count(F.lit(1)).alias("n"))


def _names(cdm: Cdm, sets: DataFrame) -> DataFrame:
    counted = events.occurrences(_barred(cdm, sets), by=("concept_id",)).select("concept_id", "n_events")
    others = concepts.difference(sets, sample.OTHERS, sample.DISEASE_A)
    return concepts.with_names(counted, cdm.concept, others)


def _per_concept(rows: DataFrame, *by: str) -> DataFrame:
    # Two steps, so that a frequent concept is counted in parallel.
    return (
        events.occurrences(rows, by=("person_id", *by))
        .groupBy(*by)
        .agg(F.sum("n_events").alias("n_events"), F.count(F.lit(1)).alias("n_persons"))
    )


def _narrowed(cdm: Cdm, sets: DataFrame) -> DataFrame:
    return _event_counts(cdm.narrowed(sets))


def _laid_out(cdm: Cdm) -> Cdm:
    """The clinical tables in folders by part of the concept, written once a session."""
    spark = cdm.concept.sparkSession
    key = (spark.sparkContext.applicationId, id(cdm))
    if key not in _laid:
        _laid[key] = lay_out(cdm, f"{session_dir(spark)}/laid-out-{uuid.uuid4().hex}", parts=64)
    return _laid[key]


def _event_counts(cdm: Cdm) -> DataFrame:
    tables = {"measurement": cdm.measurements(), "condition_occurrence": cdm.conditions(), "drug_exposure": cdm.drugs()}
    counted = [
        _per_concept(rows, "concept_id").select(F.lit(name).alias("event_table"), "*") for name, rows in tables.items()
    ]
    return reduce(DataFrame.unionByName, counted)


def _wide_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Numbers far apart, of both signs, nearly all of them different.
    spread = "l_orderkey * if(l_linenumber % 2 = 0, 1000003, -7000033) + l_partkey AS days"
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(spread)
    return stats.masked_distribution(lines, "days", saturate=None)


def _masks(cdm: Cdm, sets: DataFrame) -> DataFrame:
    return concepts.concept_masks(sets, [sample.INDEX, sample.DRUGS, sample.DISEASE_A, sample.OTHERS, sample.DISEASE_B])


def _firsts(cdm: Cdm) -> DataFrame:
    return cdm.measurements().select("person_id", F.col("event_date").alias("index_date"))


def _misspelt(cdm: Cdm) -> Cdm:
    """The clinical tables as text, in which some persons, concepts and dates cannot be read."""
    tables = {}
    for table, (concept, date) in EVENT_TABLES.items():
        tables[table] = getattr(cdm, table).selectExpr(
            "if(person_id % 41 = 0, 'P-' || person_id, CAST(person_id AS string)) AS person_id",
            f"if({concept} % 13 = 5, 'c' || {concept}, CAST({concept} AS string)) AS {concept}",
            f"if(day({date}) = 31, date_format({date}, 'dd/MM/yyyy'), CAST({date} AS string)) AS {date}",
        )
    return replace(cdm, **tables)


def _screened(result: Callable[[Screened], DataFrame]) -> Query:
    return _on_cdm(lambda spark, cdm: result(screen(_misspelt(cdm))))


def _merged(spark: SparkSession, cdm: Cdm) -> DataFrame:
    """Counts of two deliveries by year, the second of which has a year of the first one anew and in full."""
    path = f"{session_dir(spark)}/merged-{uuid.uuid4().hex}"
    happened = cdm.conditions()
    merging.add_batches(happened.where("event_date < DATE'1995-07-01'"), path, F.year("event_date"))
    merging.add_batches(happened.where("event_date >= DATE'1995-01-01' OR event_date IS NULL"), path, F.year("event_date"))
    return merging.merged_occurrences(spark, path)


def _suite(cdm: Cdm, sets: DataFrame) -> DataFrame:
    reports = run_all(cdm, sets, SPECS, names=["days_to_diagnosis", "days_to_diagnosis_clean"])
    return reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("report"), "*") for name, df in reports.items()])


def entry(spark: SparkSession) -> DataFrame:
    """Days from index to diagnosis in the clean cohort."""
    return queries()["r2_days_to_diagnosis_clean_disease_a"](spark, SMOKE_DIR)


def queries() -> dict[str, Query]:
    found = {
        "scan_measurement": _scan(Cdm.measurements),
        "scan_condition_occurrence": _scan(Cdm.conditions),
        "scan_drug_exposure": _scan(Cdm.drugs),
        "scan_concept": _on_cdm(lambda spark, cdm: cdm.concept),
        "scan_concept_ancestor": _on_cdm(lambda spark, cdm: cdm.concept_ancestor),
        "concept_sets_explicit": _on_cdm(_sets_shallow),
        "concept_sets_descendants": _on_cdm(
            lambda spark, cdm: _resolve(spark, cdm, sample.definitions(spark).where("NOT is_excluded"))
        ),
        "concept_sets_excluding": _on_cdm(
            lambda spark, cdm: _resolve(spark, cdm, sample.definitions(spark).where("codeset_id IN (13, 15)"))
        ),
        "concept_sets_all": _on_cdm(_resolve),
        "concept_sets_view": _on_sets(_sets_view),
        "codeset_difference": _on_sets(
            lambda cdm, sets: concepts.difference(sets, keep=sample.OTHERS, minus=sample.DISEASE_A)
        ),
        "events_in_codeset": _on_sets(lambda cdm, sets: _dated(_in_set(cdm, sets, sample.DISEASE_A), "event_date")),
        "labelled_events": _on_sets(lambda cdm, sets: _per_concept(_labelled(cdm, sets), "barred", "concept_id")),
        "first_event_per_person": _on_sets(
            lambda cdm, sets: _dated(
                events.first_event(events.events_in(cdm.measurements(), concepts.concepts_of(sets, sample.INDEX))),
                "index_date",
            )
        ),
        "nearest_event_per_person": _on_cdm(lambda spark, cdm: _nearest(cdm)),
        "nearest_event_per_person_concept": _on_cdm(lambda spark, cdm: _nearest(cdm, ("concept_id",))),
        "nearest_event_unless_barred": _on_sets(
            lambda cdm, sets: events.nearest_event_unless_barred(_everyone(cdm), _labelled(cdm, sets))
        ),
        "nearest_barred_event": _on_sets(
            lambda cdm, sets: events.nearest_barred_event(_everyone(cdm), _labelled(cdm, sets))
        ),
        "exclude_persons": _on_sets(
            lambda cdm, sets: _dated(events.exclude(_everyone(cdm), _barred(cdm, sets)), "index_date")
        ),
        "require_persons": _on_sets(
            lambda cdm, sets: _dated(events.require(_everyone(cdm), _in_set(cdm, sets, sample.DISEASE_A)), "index_date")
        ),
        "laid_out_events": _on_sets(lambda cdm, sets: _dated(_in_set(_laid_out(cdm), sets, sample.DISEASE_A), "event_date")),
        "laid_out_days_to_diagnosis_clean": _on_sets(
            lambda cdm, sets: REPORTS["days_to_diagnosis_clean"](_laid_out(cdm), sets, SPECS["disease_a"])
        ),
        "concept_set_masks": _on_sets(_masks),
        "nearest_to_first": _on_cdm(
            lambda spark, cdm: events.nearest_to_first(_firsts(cdm), cdm.conditions()).selectExpr("person_id", "CAST(days AS bigint) AS days")
        ),
        "nearest_to_first_unless_barred": _on_sets(
            lambda cdm, sets: events.nearest_to_first_unless_barred(_firsts(cdm), _labelled(cdm, sets)).selectExpr(
                "person_id", "CAST(days AS bigint) AS days"
            )
        ),
        "days_to_first_of_cohort": _on_sets(
            lambda cdm, sets: events.days_to_first_of_cohort(_firsts(cdm), _labelled(cdm, sets), cdm.drugs()).selectExpr(
                "person_id", "CAST(days AS bigint) AS days"
            )
        ),
        "masked_distribution_wide": _wide_distribution,
        "time_to_first_event": _on_cdm(lambda spark, cdm: events.days_to_first(_everyone(cdm), cdm.drugs())),
        "range_join_on_or_after": _on_cdm(lambda spark, cdm: events.days_on_or_after(_everyone(cdm), cdm.drugs())),
        "occurrences_per_person_concept": _on_cdm(
            lambda spark, cdm: _dated(events.occurrences(cdm.conditions()), "first_date")
        ),
        "masked_counts": _on_cdm(lambda spark, cdm: stats.masked_counts(events.occurrences(cdm.conditions()))),
        "masked_distribution_global": _on_cdm(lambda spark, cdm: _distribution(cdm)),
        "masked_distribution_by_key": _on_cdm(lambda spark, cdm: _distribution(cdm, ("concept_id",))),
        "masked_distribution_uncapped": _on_cdm(
            lambda spark, cdm: _distribution(cdm, ("concept_id",), saturate=None, min_count=20)
        ),
        "masked_distribution_low_cap": _on_cdm(lambda spark, cdm: _distribution(cdm, ("concept_id",), saturate=100)),
        "date_coercion": _date_coercion,
        "days_between": _days_between,
        "cohort_size": _on_sets(_cohort_size),
        "cohort_size_by_concept": _on_cdm(
            lambda spark, cdm: _nearest(cdm, ("concept_id",)).groupBy("concept_id").agg(F.count(F.lit(1)).alias("n"))
        ),
        "concept_name_lookup": _on_sets(_names),
        "narrowed_events": _on_sets(_narrowed),
        "report_suite": _on_sets(_suite),
        "definitions_from_file": _on_cdm(_definitions_from_file),
        "catalog_tables": _on_cdm(_catalog_tables),
        "saved_codesets": _on_sets(_saved_sets),
        "screened_counts": _screened(lambda found: found.counts),
        "screened_rejects": _screened(lambda found: found.rejected),
        "screened_events": _screened(lambda found: _event_counts(found.cdm)),
        "merged_occurrences": _on_cdm(lambda spark, cdm: _dated(_merged(spark, cdm), "first_date")),
        "merged_masked_counts": _on_cdm(lambda spark, cdm: stats.masked_counts(_merged(spark, cdm))),
    }
    for disease, spec in SPECS.items():
        for number, name in enumerate(REPORTS, start=1):
            found[f"r{number}_{name}_{disease}"] = _report(name, spec)
        found[f"r3_exclusion_counts_ordered_{disease}"] = _on_sets(
            lambda cdm, sets, spec=spec: _ordered(REPORTS["exclusion_counts"](cdm, sets, spec))
        )
    return found | (llm.QUERIES | {"pipeline": corpus_pipeline.run} if llm else {})


def oracle_sql() -> dict[str, str]:
    return oracles.statements() | (llm.ORACLES if llm else {})

"""Clinical event tables and vocabulary."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspan.functions.dates import as_date, or_error
from cohortspan.sources.staging import stage

EVENT_TABLES = {
    "measurement": ("measurement_concept_id", "measurement_date"),
    "condition_occurrence": ("condition_concept_id", "condition_start_date"),
    "drug_exposure": ("drug_concept_id", "drug_exposure_start_date"),
}
VOCABULARY_TABLES = {
    "concept": ("concept_id", "concept_name", "invalid_reason"),
    "concept_ancestor": ("ancestor_concept_id", "descendant_concept_id"),
}
#: Name, but for the number of parts, of the column by which ``layout.lay_out`` lays out event tables.
PART_COLUMN = "concept_part_"


def concept_part(concept: str, parts: int) -> Column:
    """Which of so many parts a concept is in; null without a concept."""
    part = F.pmod(F.xxhash64(F.col(concept).cast("long")), F.lit(parts)).cast("int")
    return F.when(F.col(concept).isNotNull(), part)


def part_columns(df: DataFrame) -> dict[str, int]:
    """The columns of ``df`` that are parts of concepts, with the number of parts."""
    named = {c: re.fullmatch(PART_COLUMN + "([1-9][0-9]*)", c.lower()) for c in df.columns}
    return {c: int(found[1]) for c, found in named.items() if found}


def _require(table: str, df: DataFrame, columns: tuple[str, ...]) -> None:
    present = {c.lower() for c in df.columns}
    missing = [c for c in columns if c not in present]
    if missing:
        raise ValueError(f"table {table} lacks {', '.join(missing)}")


def _as_long(name: str, kind: T.DataType) -> Column:
    # A cast that changes nothing is left out: it would keep filters from reaching the scan.
    if isinstance(kind, T.LongType):
        return F.col(name)
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
        return F.col(name).cast("long")
    return or_error(F.col(name).try_cast("long"), F.col(name), "id")


@dataclass(frozen=True)
class Cdm:
    """The tables the reports read.

    ``concept`` names concepts in report output; ``vocabulary_concept`` decides which concepts exist
    and are valid. They are the same table unless two are given. ``concept_id`` is unique in both.
    """

    measurement: DataFrame
    condition_occurrence: DataFrame
    drug_exposure: DataFrame
    concept: DataFrame
    concept_ancestor: DataFrame
    vocabulary_concept: DataFrame | None = None

    def __post_init__(self) -> None:
        for table, columns in EVENT_TABLES.items():
            _require(table, getattr(self, table), ("person_id", *columns))
        for table, columns in VOCABULARY_TABLES.items():
            _require(table, getattr(self, table), columns)

    @classmethod
    def _load(cls, table: Callable[[str], DataFrame], vocabulary: Callable[[str], DataFrame]) -> Cdm:
        return cls(
            **{name: table(name) for name in EVENT_TABLES},
            concept=table("concept"),
            concept_ancestor=vocabulary("concept_ancestor"),
            vocabulary_concept=vocabulary("concept"),
        )

    @classmethod
    def from_catalog(cls, spark: SparkSession, cdm_schema: str, vocabulary_schema: str | None = None) -> Cdm:
        """Tables of catalog schema ``cdm_schema``; the vocabulary may live in another schema."""
        vocabulary_schema = vocabulary_schema or cdm_schema
        return cls._load(
            lambda name: spark.table(f"{cdm_schema}.{name}"),
            lambda name: spark.table(f"{vocabulary_schema}.{name}"),
        )

    @classmethod
    def from_path(
        cls, spark: SparkSession, cdm_path: str, vocabulary_path: str | None = None, file_format: str = "parquet"
    ) -> Cdm:
        """Tables stored as ``<path>/<table name>`` in any columnar format Spark reads."""
        reader = spark.read.format(file_format)
        vocabulary_path = vocabulary_path or cdm_path
        return cls._load(
            lambda name: reader.load(f"{cdm_path}/{name}"),
            lambda name: reader.load(f"{vocabulary_path}/{name}"),
        )

    def events(self, table: str) -> DataFrame:
        """An event table in one shape: person_id, concept_id, event_date, and the concept's part if it is laid out by one.

        An event of no person counts for nobody. Dates are left as they are: operators that need one drop rows without.
        """
        df = getattr(self, table)
        concept, date = EVENT_TABLES[table]
        kind = {field.name.lower(): field.dataType for field in df.schema}
        return df.select(
            _as_long("person_id", kind["person_id"]).alias("person_id"),
            _as_long(concept, kind[concept]).alias("concept_id"),
            as_date(date, kind[date]).alias("event_date"),
            *part_columns(df),
        ).where("person_id IS NOT NULL")

    def measurements(self) -> DataFrame:
        return self.events("measurement")

    def conditions(self) -> DataFrame:
        return self.events("condition_occurrence")

    def drugs(self) -> DataFrame:
        return self.events("drug_exposure")

    def vocabulary(self) -> DataFrame:
        return self.concept if self.vocabulary_concept is None else self.vocabulary_concept

    def narrowed(self, codesets: DataFrame, tables: tuple[str, ...] = tuple(EVENT_TABLES)) -> Cdm:
        """The same data with the event tables cut down to events of any concept set, and staged.

        No report reads other events, so results stay the same. One scan of each big table then
        serves any number of reports.
        """
        concepts = codesets.select("concept_id")
        cut = {}
        for table in tables:
            concept, date = EVENT_TABLES[table]
            # Columns of parts go, as the result is not laid out by them.
            events = self.events(table).select("person_id", "concept_id", "event_date").join(concepts, "concept_id", "left_semi")
            cut[table] = stage(events, table).select(
                "person_id", F.col("concept_id").alias(concept), F.col("event_date").alias(date)
            )
        return replace(self, **cut)

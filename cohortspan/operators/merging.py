"""Counts per person and concept that are kept and merged, not computed anew.

A table holds, for each batch of events (a day, a month), how often each person had each concept in it and when
first. Both can be merged: occurrences of all time are sums and minima over the batches. A new day costs a scan of
that day; events of earlier ones are not read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspan.operators.events import occurrences

_SCHEMA = "person_id long, concept_id long, n_events long, first_date date, batch string"


def add_batches(events: DataFrame, path: str, batch: Column) -> None:
    """Count ``events`` by ``batch`` and put the counts into the table at ``path``, in one job.

    ``batch`` names the batch of an event by a short text; null is a batch too. ``events`` must hold each batch it has any event of in
    full: its counts replace what the table had of that batch, and other batches stay. So a batch may be given again,
    after late events or a failed run, and is never counted twice. Batches are switched when the job commits.
    """
    counted = occurrences(events.withColumn("batch", batch.cast("string")), by=("person_id", "concept_id", "batch"))
    # Batches go to files of their own: a batch is spread by person, so that none is one task's work.
    counted.select("person_id", "concept_id", "n_events", "first_date", "batch").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("batch").parquet(path)


def merged_occurrences(spark: SparkSession, path: str) -> DataFrame:
    """``occurrences`` of all events ever added to the table at ``path``."""
    kept = spark.read.schema(_SCHEMA).parquet(path)
    return kept.groupBy("person_id", "concept_id").agg(F.sum("n_events").alias("n_events"), F.min("first_date").alias("first_date"))


def fold_batches(spark: SparkSession, path: str, into: str, batch: Column) -> None:
    """Write the table at ``path`` to ``into``, a new folder, with its batches folded to the coarser ``batch`` of their column ``batch``.

    For tables of many small days: months have thirty times fewer rows of persons with daily events, and fewer files.
    """
    kept = spark.read.schema(_SCHEMA).parquet(path).withColumn("batch", batch.cast("string"))
    folded = kept.groupBy("person_id", "concept_id", "batch").agg(F.sum("n_events").alias("n_events"), F.min("first_date").alias("first_date"))
    folded.select("person_id", "concept_id", "n_events", "first_date", "batch").write.partitionBy("batch").parquet(into)

"""Event tables laid out by concept, so that a report reads only the folders its concept sets need.

``concept_part_<n>`` is a partition column that a table written by ``lay_out`` has: one of n parts, told by the concept
alone. ``events_in`` and ``label_events`` join on it as well as on the concept; Spark then learns from the concept sets at run time which
folders can hold an event of theirs (dynamic partition pruning) and lists no others. Which concepts a report asks for
need not be known when the table is written.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from cohortspan.sources.cdm import EVENT_TABLES, PART_COLUMN, Cdm, concept_part


def lay_out(cdm: Cdm, path: str, parts: int = 256) -> Cdm:
    """Write the event tables to ``path``/<table>, in folders by part of the concept, and return ``cdm`` reading them.

    Each has person_id, its concept and its date column. Rows without a person, which count for nobody, are left out; those without a
    concept are kept in a folder of their own. ``path`` must not hold such tables yet. Folders are written by a rebalancing shuffle:
    adaptive execution splits a part with a frequent concept over many tasks and files, and puts small parts together.
    """
    if parts < 1:
        raise ValueError("at least one part")
    laid = {}
    for table, (concept, date) in EVENT_TABLES.items():
        column = f"{PART_COLUMN}{parts}"
        rows = cdm.events(table).select(
            "person_id",
            F.col("concept_id").alias(concept),
            F.col("event_date").alias(date),
            concept_part("concept_id", parts).alias(column),
        )
        rows.hint("rebalance", column).write.partitionBy(column).parquet(f"{path}/{table}")
        laid[table] = rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/{table}")
    return replace(cdm, **laid)

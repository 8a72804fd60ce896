"""Event tables with unreadable rows, set aside instead of ending the run.

``Cdm`` takes an id or a date that cannot be read for an error. Where the good rows are to be used all the same,
``screen`` reads a table once and writes it in two parts: events, and the bad rows as they were given, each with
what is wrong with it. The rows of each kind are counted by the same pass.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspan.functions.dates import try_date
from cohortspan.sources.cdm import EVENT_TABLES, Cdm
from cohortspan.sources.staging import stage

#: What can be wrong with a row, as counted; of several the first is given as the reason.
FAULTS = ("person", "concept", "date")


@dataclass(frozen=True)
class Screened:
    """A clinical database without its bad rows, those rows by table, and counts.

    ``rejected`` has event_table, reason and the three columns as text; ``counts`` event_table, n_rows, n_good,
    n_bad_person, n_bad_concept and n_bad_date. A row with two faults counts for both.
    """

    cdm: Cdm
    rejected: DataFrame
    counts: DataFrame


def _try_long(name: str, kind: T.DataType) -> Column:
    whole = isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    return F.col(name).cast("long") if whole else F.col(name).try_cast("long")


def _faults(df: DataFrame, concept: str, date: str) -> tuple[dict[str, Column], dict[str, Column]]:
    """The three values read, and for each whether something stands there that cannot be read."""
    kind = {field.name.lower(): field.dataType for field in df.schema}
    read = {
        "person_id": _try_long("person_id", kind["person_id"]),
        concept: _try_long(concept, kind[concept]),
        date: try_date(date, kind[date]),
    }
    wrong = {fault: value.isNull() & F.col(name).isNotNull() for fault, (name, value) in zip(FAULTS, read.items())}
    return read, wrong


def screen_table(df: DataFrame, table: str) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Good rows in the columns of event table ``table``, bad rows as text with their reason, and counts.

    A missing value is no fault: events of no person and events without a date follow the rules they always have.
    One pass over ``df``, whose output is the table written; so an executor lost on the way costs its tasks once
    more, and rows are counted once, with the tasks that were committed.
    """
    concept, date = EVENT_TABLES[table]
    read, wrong = _faults(df, concept, date)
    reason = F.coalesce(*[F.when(found, F.lit(fault)) for fault, found in wrong.items()])
    raw = [F.col(name).cast("string").alias(f"raw_{i}") for i, name in enumerate(read)]
    judged = df.select(*[value.alias(name) for name, value in read.items()], *raw, *[x.alias(f"bad_{f}") for f, x in wrong.items()], reason.alias("reason"))
    seen = Observation()
    counted = judged.observe(
        seen,
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("reason").isNull()).alias("n_good"),
        *[F.count_if(F.col(f"bad_{fault}")).alias(f"n_bad_{fault}") for fault in FAULTS],
    )
    # The text is kept of bad rows only.
    bad = F.col("reason").isNotNull()
    kept = counted.select(*read, *[F.when(bad, F.col(f"raw_{i}")).alias(f"raw_{i}") for i in range(len(read))], "reason")
    both = stage(kept, f"screened-{table}", by=[bad.alias("bad")])
    good = both.where("NOT bad").select(*read)
    rejected = both.where("bad").select(
        F.lit(table).alias("event_table"), "reason", *[F.col(f"raw_{i}").alias(name) for i, name in enumerate(("person_id", "concept_id", "event_date"))]
    )
    return good, rejected, dict(seen.get)


def screen(cdm: Cdm, tables: Sequence[str] = tuple(EVENT_TABLES)) -> Screened:
    """``cdm`` with bad rows of ``tables`` set aside: each table is read once and written to the shared folder."""
    good, bad, numbers = {}, [], []
    for table in tables:
        good[table], rejected, counts = screen_table(getattr(cdm, table), table)
        bad.append(rejected)
        numbers.append((table, *[int(counts[name]) for name in ("n_rows", "n_good", *[f"n_bad_{f}" for f in FAULTS])]))
    rejected = bad[0]
    for more in bad[1:]:
        rejected = rejected.unionByName(more)
    columns = "event_table string, n_rows long, n_good long, " + ", ".join(f"n_bad_{f} long" for f in FAULTS)
    return Screened(replace(cdm, **good), rejected, rejected.sparkSession.createDataFrame(numbers, columns))

"""Selecting and comparing patient events.

Events are ``(person_id, concept_id, event_date)``; an index is ``(person_id, index_date)`` with one
row per person.

A single person may hold a large share of all events. Every join on ``person_id`` is therefore fed by
an aggregation that is combined on the map side and leaves a person at most one row per calendar day
(and concept), however many events there were.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspan.functions.dates import closeness, days_between
from cohortspan.operators.concepts import concept_masks
from cohortspan.sources.cdm import concept_part, part_columns


def _meet(events: DataFrame, concepts: DataFrame, how: str) -> DataFrame:
    """Join by concept, and by its part where events are laid out by one, so that other folders are not read."""
    parts = part_columns(events)
    keyed = concepts.select("*", *[concept_part("concept_id", n).alias(c) for c, n in parts.items()])
    return events.join(keyed, ["concept_id", *parts], how).drop(*parts)


def events_in(events: DataFrame, concepts: DataFrame) -> DataFrame:
    """Events whose concept is listed. Catalyst moves the semi join down to the scan of the concept."""
    return _meet(events, concepts.select("concept_id"), "left_semi")


def label_events(events: DataFrame, codesets: DataFrame, wanted: int, barred: int) -> DataFrame:
    """Events of either concept set in one scan, with ``barred`` true for those outside set ``wanted``.

    A concept in both sets is wanted. One join to the sets: a concept's mask has a bit for each.
    """
    masks = concept_masks(codesets, [wanted, barred])
    return _meet(events, masks, "inner").selectExpr("person_id", "concept_id", "event_date", "sets & 1L = 0 AS barred")


def first_event(events: DataFrame) -> DataFrame:
    """Index date of each person: the earliest event. Persons without a dated event have none."""
    dated = events.where("event_date IS NOT NULL")
    return dated.groupBy("person_id").agg(F.min("event_date").alias("index_date"))


def _spans(index: DataFrame, dated: DataFrame) -> DataFrame:
    days = days_between(F.col("index_date"), F.col("event_date"))
    return dated.join(index, "person_id").withColumn("days", days)


def _nearest(eligible: Column | None = None) -> Column:
    key = closeness(F.col("days"))
    return F.min_by("days", key if eligible is None else F.when(eligible, key)).cast("long").alias("days")


def nearest_event(index: DataFrame, events: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Signed ``days`` from the index date to the nearest event, per person or per person and ``by``.

    Of two events equally far away, the one before the index date wins.
    """
    keys = ["person_id", *by]
    dated = events.where("event_date IS NOT NULL").select(*keys, "event_date").distinct()
    return _spans(index, dated).groupBy(*keys).agg(_nearest())


def nearest_event_unless_barred(index: DataFrame, labelled: DataFrame) -> DataFrame:
    """``nearest_event`` per person, leaving out persons with any barred event at any date."""
    # A barred event matters only by its presence, so its date goes and the rows collapse.
    dated = labelled.selectExpr("person_id", "barred", "if(barred, NULL, event_date) AS event_date").distinct()
    return (
        _spans(index, dated)
        .groupBy("person_id")
        .agg(_nearest(~F.col("barred")), F.bool_or("barred").alias("barred"))
        .where("NOT barred AND days IS NOT NULL")
        .select("person_id", "days")
    )


def nearest_barred_event(index: DataFrame, labelled: DataFrame) -> DataFrame:
    """``nearest_event`` per person and barred concept, for persons who have a wanted event too."""
    # Wanted events matter only by their presence.
    dated = (
        labelled.where("NOT barred OR event_date IS NOT NULL")
        .selectExpr(
            "person_id",
            "barred",
            "if(barred, concept_id, NULL) AS concept_id",
            "if(barred, event_date, NULL) AS event_date",
        )
        .distinct()
    )
    # Reduced to a row per concept before a person's rows are asked for a wanted one.
    nearest = _spans(index, dated).groupBy("person_id", "barred", "concept_id").agg(_nearest())
    return barred_rows_of_wanted(nearest)


def count_barred_events(index: DataFrame, labelled: DataFrame) -> DataFrame:
    """Number of events per person and barred concept, for persons who have a wanted event too.

    ``labelled`` may hold equal events once, with their number in ``n_events``.
    """
    rows = "n_events" if "n_events" in labelled.columns else "1L AS n_events"
    counted = (
        labelled.selectExpr("person_id", "barred", "if(barred, concept_id, NULL) AS concept_id", rows)
        .groupBy("person_id", "barred", "concept_id")
        .agg(F.sum("n_events").alias("n_events"))
    )
    return barred_rows_of_wanted(counted.join(index, "person_id", "left_semi"))


def barred_rows_of_wanted(rows: DataFrame) -> DataFrame:
    """Barred rows of persons who have a row that is not barred.

    The rows must have been reduced to one a concept, as those of a person meet in one task.
    """
    return (
        rows.selectExpr("*", "bool_or(NOT barred) OVER (PARTITION BY person_id) AS wanted")
        .where("barred AND wanted")
        .drop("barred", "wanted")
    )


def wanted_never_barred(labelled: DataFrame) -> DataFrame:
    """``person_id`` of those with a wanted event and no barred one, whatever the dates."""
    return labelled.groupBy("person_id").agg(F.bool_or("barred").alias("barred")).where("NOT barred").select("person_id")


def persons(events: DataFrame) -> DataFrame:
    """Each person with at least one event, once."""
    return events.select("person_id").distinct()


def exclude(index: DataFrame, events: DataFrame) -> DataFrame:
    """Index rows of persons without any of ``events``.

    An anti join rather than NOT IN: the latter is null-aware, which Spark can only run by
    broadcasting the persons. Person ids are never NULL here.
    """
    return index.join(persons(events), "person_id", "left_anti")


def require(index: DataFrame, events: DataFrame) -> DataFrame:
    """Index rows of persons with at least one of ``events``."""
    return index.join(persons(events), "person_id", "left_semi")


def _on_or_after(index: DataFrame, events: DataFrame) -> DataFrame:
    # The comparison drops rows without a date.
    dated = events.select("person_id", "event_date").distinct()
    return dated.join(index, "person_id").where("event_date >= index_date")


def days_on_or_after(index: DataFrame, events: DataFrame) -> DataFrame:
    """Each distinct day with an event on or after the index date, as ``days`` since then."""
    days = days_between(F.col("index_date"), F.col("event_date")).cast("long")
    return _on_or_after(index, events).select("person_id", days.alias("days"))


def days_to_first(index: DataFrame, events: DataFrame) -> DataFrame:
    """``days`` from the index date to the first event on or after it; persons without one are dropped."""
    days = days_between(F.min("index_date"), F.min("event_date")).cast("long")
    return _on_or_after(index, events).groupBy("person_id").agg(days.alias("days"))


# The same questions for reports on whole cohorts, in one aggregation. Index events and others are put under each
# other, tagged, and folded by person: the earliest index date, the set of days of the others, and flags. That is one
# shuffle by person and no join. Days are combined on the map side, so a person sends each day once a task; a
# person's set holds no more than the calendar has days.


def _gathered(firsts: DataFrame, *tagged: DataFrame) -> DataFrame:
    """person_id, index_date, days, barred, wanted of each person with an index date.

    ``firsts`` has (person_id, index_date), any number a person; the others (person_id, day, barred).
    """
    rows = firsts.where("index_date IS NOT NULL").selectExpr("person_id", "index_date", "CAST(NULL AS date) AS day", "CAST(NULL AS boolean) AS barred")
    for events in tagged:
        rows = rows.union(events.selectExpr("person_id", "CAST(NULL AS date) AS index_date", "day", "barred"))
    folded = rows.groupBy("person_id").agg(
        F.min("index_date").alias("index_date"),
        F.collect_set("day").alias("days"),
        F.expr("bool_or(barred)").alias("barred"),
        F.expr("bool_or(NOT barred)").alias("wanted"),
    )
    return folded.where("index_date IS NOT NULL")


def _closest_day() -> Column:
    """Signed days to the nearest of ``days``, the earlier one of two equally far; null without any."""
    key = F.array_min(F.transform("days", lambda day: closeness(days_between(F.col("index_date"), day))))
    # The key's last bit tells on which side the day lies.
    return F.when(key % 2 == 1, F.floor(key / 2)).otherwise(-F.floor(key / 2)).cast("int").alias("days")


def nearest_to_first(firsts: DataFrame, events: DataFrame) -> DataFrame:
    """``nearest_event`` of each person to the earliest of ``firsts`` (person_id, index_date)."""
    dated = events.where("event_date IS NOT NULL").selectExpr("person_id", "event_date AS day", "false AS barred")
    return _gathered(firsts, dated).select("person_id", _closest_day()).where("days IS NOT NULL")


def nearest_to_first_unless_barred(firsts: DataFrame, labelled: DataFrame) -> DataFrame:
    """``nearest_to_first`` leaving out persons with any barred event at any date."""
    tagged = labelled.selectExpr("person_id", "if(barred, NULL, event_date) AS day", "barred")
    kept = _gathered(firsts, tagged).where("NOT coalesce(barred, false)")
    return kept.select("person_id", _closest_day()).where("days IS NOT NULL")


def days_to_first_of_cohort(firsts: DataFrame, labelled: DataFrame, events: DataFrame) -> DataFrame:
    """``days`` from the earliest of ``firsts`` to the first of ``events`` on or after it.

    Only of persons with a wanted event and no barred one, whatever their dates; who has no such event is left out.
    """
    flags = labelled.selectExpr("person_id", "CAST(NULL AS date) AS day", "barred")
    dated = events.where("event_date IS NOT NULL").selectExpr("person_id", "event_date AS day", "CAST(NULL AS boolean) AS barred")
    kept = _gathered(firsts, flags, dated).where("wanted AND NOT barred")
    first = F.array_min(F.filter("days", lambda day: day >= F.col("index_date")))
    return kept.select("person_id", days_between(F.col("index_date"), first).alias("days")).where("days IS NOT NULL")


def occurrences(events: DataFrame, by: Sequence[str] = ("person_id", "concept_id")) -> DataFrame:
    """Number of events (rows, not days) per person and concept, with the first date."""
    return events.groupBy(*by).agg(F.count(F.lit(1)).alias("n_events"), F.min("event_date").alias("first_date"))

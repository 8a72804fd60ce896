"""Time the reports on made-up clinical tables of any size against the same questions as plain Spark SQL.

    python bench_large.py --events 60000000 --persons 2000000 --runs 3 --folder <new scratch folder> [--hot]

Each event table has ``--events`` rows over ``--persons`` persons and ``--concepts`` concepts; with ``--hot`` one
person and one concept have a third of all rows each. Tables are derived from row numbers by hashing, so a size
always gives the same rows. The plain form uses windows, NOT IN and COUNT DISTINCT. Each is timed from building
the DataFrame to the last row, ``--runs`` times; printed are all times, as one JSON line a report.
"""

from __future__ import annotations

import argparse
import json
import os
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspan.plans.reports import REPORTS, CohortSpec, run_all
from cohortspan.sources.cdm import EVENT_TABLES, Cdm

INDEX, DRUGS, DISEASE, OTHERS = 6, 11, 12, 13
#: Shares of the concepts that each set has, by remainders of the concept's number.
SETS = {INDEX: range(0, 10), DRUGS: range(10, 25), DISEASE: range(25, 31), OTHERS: range(29, 45)}


def _pick(salt: int, n: int, hot: bool) -> Column:
    drawn = F.pmod(F.xxhash64(F.col("id"), F.lit(salt)), F.lit(n)) + 1
    return F.when(F.pmod(F.xxhash64(F.col("id"), F.lit(salt + 100)), F.lit(3)) == 0, F.lit(1)).otherwise(drawn) if hot else drawn


def make(spark: SparkSession, options: argparse.Namespace) -> tuple[Cdm, DataFrame]:
    """Write the tables unless they are there; return them and the concept sets."""
    folder = options.folder
    if not os.path.exists(folder):
        for salt, (name, (concept, date)) in enumerate(EVENT_TABLES.items()):
            day = F.date_add(F.lit("2010-01-01").cast("date"), F.pmod(F.xxhash64("id", F.lit(salt + 50)), F.lit(4000)).cast("int"))
            spark.range(options.events).select(
                _pick(salt, options.persons, options.hot).alias("person_id"),
                _pick(salt + 10, options.concepts, options.hot).alias(concept),
                day.alias(date),
            ).write.parquet(f"{folder}/{name}")
        concepts = spark.range(1, options.concepts + 1).withColumnRenamed("id", "concept_id")
        concepts.selectExpr("concept_id", "concat('concept ', concept_id) AS concept_name", "CAST(NULL AS string) AS invalid_reason").write.parquet(
            f"{folder}/concept"
        )
        concepts.selectExpr("concept_id AS ancestor_concept_id", "concept_id AS descendant_concept_id").write.parquet(f"{folder}/concept_ancestor")
        kind = "concept_id % 100"
        each = [concepts.where(f"{kind} BETWEEN {r.start} AND {r.stop - 1}").selectExpr(f"{s} AS codeset_id", "concept_id") for s, r in SETS.items()]
        each[0].union(each[1]).union(each[2]).union(each[3]).write.parquet(f"{folder}/codesets")
    return Cdm.from_path(spark, folder), spark.read.parquet(f"{folder}/codesets")


def plain(spark: SparkSession, cdm: Cdm, sets: DataFrame) -> dict[str, str]:
    """The reports' per-person rows, as one would first write them."""
    for name, events in (("meas", cdm.measurements()), ("cond", cdm.conditions()), ("drug", cdm.drugs())):
        events.createOrReplaceTempView(name)
    sets.createOrReplaceTempView("sets")
    of = "concept_id IN (SELECT concept_id FROM sets WHERE codeset_id = {})"
    idx = f"idx AS (SELECT person_id, min(event_date) AS d0 FROM meas WHERE {of.format(INDEX)} GROUP BY person_id)"
    dx = f"dx AS (SELECT * FROM cond WHERE {of.format(DISEASE)})"
    bad = f"bad AS (SELECT * FROM cond WHERE {of.format(OTHERS)} AND NOT {of.format(DISEASE)})"
    clean = "person_id NOT IN (SELECT person_id FROM bad)"
    members = "person_id IN (SELECT person_id FROM dx)"

    def nearest(events: str, keys: str, where: str) -> str:
        return f"""SELECT * FROM (
            SELECT {keys}, datediff(event_date, d0) AS days,
                   row_number() OVER (PARTITION BY {keys} ORDER BY abs(datediff(event_date, d0)), event_date) AS rn
            FROM {events} JOIN idx USING (person_id) WHERE {where}) WHERE rn = 1"""

    def spread(rows: str, by: str = "") -> str:
        group, key = (f"GROUP BY {by}", f"{by}, ") if by else ("", "")
        points = ", ".join(f"percentile_disc({p}) WITHIN GROUP (ORDER BY days)" for p in (0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95))
        return f"SELECT {key}count(DISTINCT person_id), min(days), {points}, max(days) FROM ({rows}) {group}"

    head = f"WITH {idx}, {dx}, {bad} "
    counts = f"SELECT person_id, concept_id, count(*) AS n FROM bad JOIN idx USING (person_id) WHERE {members} GROUP BY person_id, concept_id"
    drugs = f"""SELECT person_id, min(datediff(event_date, d0)) AS days FROM drug JOIN idx USING (person_id)
        WHERE {of.format(DRUGS)} AND event_date >= d0 AND {members} AND {clean} GROUP BY person_id"""
    return {
        "days_to_diagnosis": head + spread(nearest("dx", "person_id", "true")),
        "days_to_diagnosis_clean": head + spread(nearest("dx", "person_id", clean)),
        "exclusion_counts": head + f"SELECT concept_id, count(DISTINCT person_id), count_if(n > 1), count_if(n > 2), count_if(n > 3) FROM ({counts}) GROUP BY concept_id",
        "exclusion_days": head + spread(nearest("bad", "person_id, concept_id", members), "concept_id"),
        "time_to_treatment": head + spread(drugs),
    }


def seconds(runs: int, query) -> list[float]:
    out = []
    for _ in range(runs):
        start = time.perf_counter()
        for df in query():
            df.write.format("noop").mode("overwrite").save()
        out.append(round(time.perf_counter() - start, 2))
    return out


def main() -> None:
    parser = argparse.ArgumentParser()
    for name, default in (("events", 60_000_000), ("persons", 2_000_000), ("concepts", 50_000), ("runs", 3)):
        parser.add_argument(f"--{name}", type=int, default=default)
    parser.add_argument("--folder", required=True)
    parser.add_argument("--hot", action="store_true")
    options = parser.parse_args()
    spark = (
        SparkSession.builder.master(f"local[{os.environ.get('BENCH_CPUS', '8')}]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.checkpoint.dir", f"{options.folder}-staged")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    cdm, sets = make(spark, options)
    spec, statements = CohortSpec(disease=DISEASE), plain(spark, cdm, sets)
    for name, report in REPORTS.items():
        found = {
            "ours": seconds(options.runs, lambda: [report(cdm, sets, spec)]),
            "plain": seconds(options.runs, lambda: [spark.sql(statements[name])]),
        }
        print(json.dumps({"report": name, "events": options.events, "hot": options.hot, **found}), flush=True)
    specs = {"a": spec, "b": CohortSpec(disease=DRUGS)}
    print(json.dumps({"report": "run_all, ten reports", "ours": seconds(options.runs, lambda: run_all(cdm, sets, specs).values())}), flush=True)
    one_by_one = lambda: [report(cdm, sets, s) for s in specs.values() for report in REPORTS.values()]
    print(json.dumps({"report": "ten reports one by one", "ours": seconds(options.runs, one_by_one)}), flush=True)


if __name__ == "__main__":
    main()

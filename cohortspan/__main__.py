"""Run the reports from spark-submit and write each as CSV with a header.

    spark-submit --conf spark.checkpoint.dir=<shared folder> cohortspan/__main__.py \\
        --cdm-schema clinic --vocabulary-schema vocabulary --nsclc nsclc.csv --output <folder>

Without ``--nsclc`` and ``--definitions`` there is no concept set 12, and the reports on it are left out.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from cohortspan.operators.concepts import resolve, stage_codesets
from cohortspan.plans.reports import BLADDER, NSCLC, run_all
from cohortspan.sources.cdm import Cdm
from cohortspan.sources.definitions import read_concepts, read_definitions, standard_definitions
from cohortspan.sources.staging import drop_staged


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="cohortspan")
    tables = parser.add_mutually_exclusive_group(required=True)
    tables.add_argument("--cdm-schema", help="catalog schema of the event tables and concept names")
    tables.add_argument("--cdm-path", help="folder with one Parquet table per name")
    parser.add_argument("--vocabulary-schema", help="catalog schema of the vocabulary, if another")
    parser.add_argument("--vocabulary-path", help="folder of the vocabulary, if another")
    sets = parser.add_mutually_exclusive_group()
    sets.add_argument("--nsclc", help="CSV with column concept_id: set 12; the other sets are built in")
    sets.add_argument("--definitions", help="CSV with all concept-set definitions")
    parser.add_argument("--output", required=True, help="folder for the results; must not hold them yet")
    options = parser.parse_args(arguments)

    spark = SparkSession.builder.appName("cohortspan").getOrCreate()
    if options.cdm_schema:
        cdm = Cdm.from_catalog(spark, options.cdm_schema, options.vocabulary_schema)
    else:
        cdm = Cdm.from_path(spark, options.cdm_path, options.vocabulary_path)
    if options.definitions:
        definitions = read_definitions(spark, options.definitions)
    else:
        definitions = standard_definitions(spark, read_concepts(spark, options.nsclc) if options.nsclc else None)
    codesets = stage_codesets(resolve(definitions, cdm.vocabulary(), cdm.concept_ancestor))
    specs = {"nsclc": NSCLC, "bladder": BLADDER}
    if not (options.nsclc or options.definitions):
        print("no --nsclc: the reports on concept set 12 are left out")
        del specs["nsclc"]
    for name, report in run_all(cdm, codesets, specs).items():
        report.write.option("header", True).csv(f"{options.output}/{name}")
    drop_staged(spark)


if __name__ == "__main__":
    main()

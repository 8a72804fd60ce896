"""Concept sets: from definitions over a vocabulary hierarchy to lists of concepts.

A definition row ``(codeset_id, concept_id, include_descendants, is_excluded)`` puts one concept,
optionally with all its descendants, into a set or takes it out. Resolved sets are
``(codeset_id, concept_id)``, each pair once.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspan.sources.definitions import checked
from cohortspan.sources.staging import stage


def descendants(definitions: DataFrame, concept_ancestor: DataFrame) -> DataFrame:
    """The definition rows that ask for descendants, one row per descendant reached."""
    return (
        definitions.where("include_descendants")
        .withColumnRenamed("concept_id", "ancestor_concept_id")
        .join(concept_ancestor, "ancestor_concept_id")
        .select("codeset_id", F.col("descendant_concept_id").alias("concept_id"), "is_excluded")
    )


def resolve(definitions: DataFrame, concept: DataFrame, concept_ancestor: DataFrame) -> DataFrame:
    """All sets in ``definitions`` at once, in one pass over each vocabulary table.

    Concepts unknown to ``concept`` never count. Descendants count while valid (``invalid_reason`` is
    NULL); concepts listed by name count either way. That holds for both sides of a set, so an
    invalid descendant of an excluded concept stays if it is listed for inclusion. Gaps in definitions are errors.
    """
    definitions = checked(definitions)
    listed = definitions.select("codeset_id", "concept_id", "is_excluded", F.lit(False).alias("by_descent"))
    reached = descendants(definitions, concept_ancestor).withColumn("by_descent", F.lit(True))

    def any_of(excluded: bool, by_descent: bool) -> Column:
        return F.bool_or((F.col("is_excluded") == excluded) & (F.col("by_descent") == by_descent))

    # Folding the candidates to one row per concept replaces union-distinct and anti join, and leaves
    # little to join with the vocabulary.
    candidates = (
        listed.unionByName(reached)
        .groupBy("codeset_id", "concept_id")
        .agg(
            any_of(False, False).alias("in_listed"),
            any_of(False, True).alias("in_reached"),
            any_of(True, False).alias("out_listed"),
            any_of(True, True).alias("out_reached"),
        )
    )
    valid = F.col("invalid_reason").isNull()
    return (
        candidates.join(concept.select("concept_id", "invalid_reason"), "concept_id")
        .where(F.col("in_listed") | (F.col("in_reached") & valid))
        .where(~(F.col("out_listed") | (F.col("out_reached") & valid)))
        .select("codeset_id", "concept_id")
    )


def concepts_of(codesets: DataFrame, *codeset_ids: int) -> DataFrame:
    """``concept_id`` of one set, or of several sets taken together (once per set)."""
    if not codeset_ids:
        raise ValueError("no concept set named")
    return codesets.where(f"codeset_id IN ({', '.join(map(str, codeset_ids))})").select("concept_id")


def concept_masks(codesets: DataFrame, codeset_ids: Sequence[int]) -> DataFrame:
    """Each concept of any of these sets once, with ``sets``: bit i is set if it is in set ``codeset_ids[i]``.

    One lookup then tells of an event which of up to 63 sets its concept is in.
    """
    if not 0 < len(codeset_ids) < 64:
        raise ValueError("name 1 to 63 concept sets")
    bits = " ".join(f"WHEN {s} THEN {1 << i}L" for i, s in enumerate(codeset_ids))
    listed = codesets.where(f"codeset_id IN ({', '.join(map(str, codeset_ids))})")
    return listed.groupBy("concept_id").agg(F.expr(f"bit_or(CASE codeset_id {bits} END)").alias("sets"))


def difference(codesets: DataFrame, keep: int, minus: int) -> DataFrame:
    """Concepts of set ``keep`` that set ``minus`` lacks."""
    return concepts_of(codesets, keep).join(concepts_of(codesets, minus), "concept_id", "left_anti")


def with_names(rows: DataFrame, concept: DataFrame, concepts: DataFrame) -> DataFrame:
    """``rows`` with ``concept_name``; rows whose concept has no entry are dropped.

    ``concepts`` are the ids that can occur. They cut the vocabulary down before it meets the rows.
    """
    names = concept.select("concept_id", "concept_name").join(concepts, "concept_id", "left_semi")
    return rows.join(names, "concept_id")


def stage_codesets(codesets: DataFrame, view: str | None = None) -> DataFrame:
    """Write resolved sets to the shared folder once, for all reports of a session.

    ``view`` makes them available to ``spark.sql`` under that name as well.
    """
    staged = stage(codesets.dropDuplicates(["codeset_id", "concept_id"]), "codesets")
    if view:
        staged.createOrReplaceTempView(view)
    return staged


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def save_codesets(codesets: DataFrame, table: str, path: str | None = None) -> DataFrame:
    """Write resolved sets to a catalog table that outlives the session, replacing it.

    Each version is written to a folder of its own under ``path`` (if none is named, next to the warehouse's tables),
    and the table is then switched to it by a change of its location. If the write fails, the table is as
    before; readers that have begun go on, as the version before stays until the next replacement. The
    sets may come from the table itself. A table of that name with other columns is an error and is left alone.
    """
    spark = codesets.sparkSession
    path = path or f"{spark.conf.get('spark.sql.warehouse.dir')}/{table.replace('.', '/')}-versions"
    rows = codesets.select(F.col("codeset_id").cast("int"), F.col("concept_id").cast("long"))
    exists = spark.catalog.tableExists(table)
    if exists and [f.dataType for f in spark.table(table).schema] != [f.dataType for f in rows.schema]:
        raise ValueError(f"table {table} does not hold concept sets")
    version = f"{path}/version-{uuid.uuid4().hex}"
    rows.write.parquet(version)
    before = None
    if exists:
        described = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {table}").collect()}
        before = described.get("Location")
        spark.sql(f"ALTER TABLE {table} SET LOCATION '{version}'")
        spark.catalog.refreshTable(table)
    else:
        spark.sql(f"CREATE TABLE {table} (codeset_id INT, concept_id BIGINT) USING parquet LOCATION '{version}'")
    folder, files = _folder(spark, path)
    kept = {version.rsplit("/", 1)[1], (before or "").rstrip("/").rsplit("/", 1)[-1]}
    for status in files.listStatus(folder):
        if status.getPath().getName().startswith("version-") and status.getPath().getName() not in kept:
            files.delete(status.getPath(), True)
    return spark.table(table)

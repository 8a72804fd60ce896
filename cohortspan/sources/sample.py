"""Clinical tables derived from the order tables used for tests and benchmarks.

A customer stands for a person, a line item for an event at its ship date, and the return flag tells
which event table it belongs to. Parts form a vocabulary of three levels: brand, brand and type, and
below them the size class, which is the level most events are coded at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspan.sources.cdm import EVENT_TABLES, Cdm
from cohortspan.sources.definitions import define, definitions_frame

TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
RETURN_FLAGS = {"measurement": "A", "condition_occurrence": "R", "drug_exposure": "N"}

INDEX, DRUGS, DISEASE_A, OTHERS, DISEASE_B = 6, 11, 12, 13, 15


def _leaf_id(brand: int, kind: int, size: int) -> int:
    return 10000 + 100 * brand + 10 * kind + size


DEFINITIONS = [
    *define(INDEX, [101], [101]),
    *define(DRUGS, [105, 106, 107], [105, 106, 107]),
    *define(DISEASE_A, [_leaf_id(b, t, z) for b in (2, 3) for t in range(1, 5) for z in range(4)]),
    *define(OTHERS, [104, 1021, 108], [104, 1021], [1041], [1041]),
    *define(DISEASE_B, [109, 10811, 10812], [109], [1091], [1091]),
]


def definitions(spark: SparkSession) -> DataFrame:
    return definitions_frame(spark, DEFINITIONS)


def _coded_parts(part: DataFrame) -> DataFrame:
    return part.select(
        "p_partkey",
        "p_brand",
        "p_type",
        F.substring_index("p_brand", "#", -1).cast("long").alias("b"),
        F.array_position(F.array(*map(F.lit, TYPES)), F.col("p_type")).alias("t"),
        (F.col("p_size") % 4).cast("long").alias("z"),
    )


def _levels() -> list[Column]:
    b, t, z = F.col("b"), F.col("t"), F.col("z")
    return [100 + b, 1000 + 10 * b + t, 10000 + 100 * b + 10 * t + z]


def _vocabulary(part: DataFrame) -> tuple[DataFrame, DataFrame]:
    classes = _coded_parts(part).select("p_brand", "p_type", "b", "t", "z").distinct()
    top, middle, leaf = _levels()
    brand_type = F.concat_ws(" ", "p_brand", "p_type")
    valid = F.lit(None).cast("string")
    leaf_state = F.when((F.col("b") + F.col("t") + F.col("z")) % 7 == 0, F.lit("D"))

    def entry(concept: Column, name: Column, state: Column) -> Column:
        return F.struct(
            concept.alias("concept_id"), name.alias("concept_name"), state.alias("invalid_reason")
        )

    concept = classes.select(
        F.inline(
            F.array(
                entry(top, F.col("p_brand"), valid),
                entry(middle, brand_type, valid),
                entry(leaf, F.concat_ws(" ", brand_type, F.col("z").cast("string")), leaf_state),
            )
        )
    ).distinct()

    def pair(ancestor: Column, descendant: Column) -> Column:
        return F.struct(ancestor.alias("ancestor_concept_id"), descendant.alias("descendant_concept_id"))

    levels = [top, middle, leaf]
    concept_ancestor = classes.select(
        F.inline(F.array(*[pair(a, d) for i, a in enumerate(levels) for d in levels[i:]]))
    ).distinct()
    return concept, concept_ancestor


def _events(table: str, lineitem: DataFrame, orders: DataFrame, part: DataFrame) -> DataFrame:
    concept, date = EVENT_TABLES[table]
    *_, leaf = _levels()
    # One brand is coded at brand level, so that persons get repeats of a concept.
    coded = _coded_parts(part).select("p_partkey", F.when(F.col("b") == 8, F.lit(108)).otherwise(leaf).alias(concept))
    # Computed columns stay below the joins. The columns on top are plain, so Catalyst can move a semi
    # join on the concept down to the parts, and line items of other concepts never reach the orders.
    items = lineitem.where(F.col("l_returnflag") == RETURN_FLAGS[table]).select(
        "l_orderkey", "l_partkey", F.col("l_shipdate").cast("date").alias(date)
    )
    return (
        items.join(coded, F.col("l_partkey") == F.col("p_partkey"))
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(F.col("o_custkey").alias("person_id"), concept, date)
    )


def sample_cdm(spark: SparkSession, folder: str) -> Cdm:
    lineitem, orders, part = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("lineitem", "orders", "part"))
    concept, concept_ancestor = _vocabulary(part)
    return Cdm(
        **{table: _events(table, lineitem, orders, part) for table in EVENT_TABLES},
        concept=concept,
        concept_ancestor=concept_ancestor,
    )

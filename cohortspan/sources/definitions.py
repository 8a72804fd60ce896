"""Concept-set definitions.

A definition is user input: rows of ``(codeset_id, concept_id, include_descendants, is_excluded)`` from
any file or table. ``standard_definitions`` supplies the oncology sets the reports are meant for.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspan.functions.dates import or_error

SCHEMA = "codeset_id int, concept_id long, include_descendants boolean, is_excluded boolean"

SECONDARY_MALIGNANCY = 6
OTHER_PRIMARIES_SPECIFIC = 10
ANTINEOPLASTIC_DRUGS = 11
NSCLC = 12
OTHER_PRIMARIES = 13
LUNG_PRIMARIES = 14
BLADDER_CANCER = 15

# Public vocabulary ids of each set. (set, listed, of which with descendants,
# excluded, of which with descendants)
_SPECIFIC_EXCLUDED = [
    4112752, 4111921, 4334322, 40493428, 35610164, 443399, 443388, 35610239, 4311499, 4151250, 4157454,
    4300558, 3187314, 4298029, 4191647, 40484156, 36716620, 443392, 40488448, 604497, 4301510, 4300560,
    42513373, 42514272, 42513374, 42513117, 42514287, 42513173, 42513168, 42514220, 42514355, 42514250,
    42513095, 42513175, 42513174, 42514332, 42513383, 42513381, 42513176, 42514252, 42513384, 42513382,
    42513380, 42513138, 42514379, 42511220, 42513171, 42513105, 42513086, 42514206, 42513055, 42514341,
    42514350, 42513172, 42513004, 42511203, 42513012, 42513618, 42514367, 42513203, 42514096, 42514372,
    42513301, 42513042, 42513232, 42513016, 42514239, 42513017, 42514278, 42514376, 42513008, 42513010,
    42513169, 42513602, 42514333, 42513385, 42513188, 42513178, 42513177, 42513223, 42514263, 42514303,
    42513329, 42514099, 42513322, 42513331, 42514290, 42513299, 42514100, 42513601, 42514271, 42511201,
    42513028, 42514170, 42514338, 42513181, 42514089, 42513030, 42514060, 42513034, 42513014, 42514108,
    42514293, 42513019, 42514091, 42513097, 42514260, 42513333, 42514325, 42513156, 42514324, 42513018,
    42511208, 42514098, 42513057, 42513040, 42513043, 42514048, 42513045, 42513049, 42513041, 42513046,
    42514137, 42513047, 42514218, 42514138, 42513052, 42513099, 42514125, 42514305, 42511206, 37166413,
    37166321, 439392, 4149322, 37166411, 37166415, 36713996, 4300559, 4300118, 4298030,
]
_BLADDER_EXCLUDED = [4200889, 4280899, 4289374, 4280900, 4283614, 4289097, 4280901, 4289376]
_SETS = [
    (SECONDARY_MALIGNANCY, [36769180, 1635142, 1633308], [36769180, 1635142, 1633308], [], []),
    (OTHER_PRIMARIES_SPECIFIC, [443392], [443392], _SPECIFIC_EXCLUDED, [4112752, 4111921, 443399, 443388]),
    (ANTINEOPLASTIC_DRUGS, [21601387], [21601387], [], []),
    (OTHER_PRIMARIES, [439392], [439392], [4112752, 4111921], [4112752, 4111921]),
    (LUNG_PRIMARIES, [258369], [258369], [], []),
    (BLADDER_CANCER, [197508, 200680, 198401], [197508], _BLADDER_EXCLUDED, _BLADDER_EXCLUDED),
]


def define(
    codeset_id: int,
    included: Iterable[int],
    with_descendants: Iterable[int] = (),
    excluded: Iterable[int] = (),
    excluded_with_descendants: Iterable[int] = (),
) -> list[tuple[int, int, bool, bool]]:
    """Definition rows of one set. Ids that bring their descendants need not be repeated as listed."""
    rows = []
    for ids, deep, is_excluded in (
        (included, with_descendants, False),
        (excluded, excluded_with_descendants, True),
    ):
        deep = set(deep)
        rows += [(codeset_id, concept, concept in deep, is_excluded) for concept in sorted({*ids, *deep})]
    return rows


def definitions_frame(spark: SparkSession, rows: Iterable[tuple[int, int, bool, bool]]) -> DataFrame:
    return spark.createDataFrame(list(rows), SCHEMA)


def _number(name: str, kind: str) -> Column:
    text = F.col(name).cast("string")
    whole = F.when(text.rlike(r"^\s*[0-9]{1,18}\s*$"), F.trim(text).try_cast(kind))
    return _present(or_error(whole, text, name), name)


def _flag(name: str) -> Column:
    text = F.lower(F.trim(F.col(name).cast("string")))
    known = F.when(text.isin("true", "1"), F.lit(True)).when(text.isin("false", "0"), F.lit(False))
    return _present(or_error(known, text, name), name)


def _present(value: Column, name: str) -> Column:
    return F.coalesce(value, F.raise_error(F.lit(f"a row without {name}")))


def _columns(df: DataFrame, needed: tuple[str, ...]) -> None:
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"concept sets lack {', '.join(missing)}")


def checked(definitions: DataFrame) -> DataFrame:
    """The four columns of a definition, found by name, as their types. Other values and gaps are errors, not gone rows.

    Flags are true, false, 1 or 0. Columns of other names are left out.
    """
    _columns(definitions, ("codeset_id", "concept_id", "include_descendants", "is_excluded"))
    return definitions.select(
        _number("codeset_id", "int").alias("codeset_id"),
        _number("concept_id", "long").alias("concept_id"),
        _flag("include_descendants").alias("include_descendants"),
        _flag("is_excluded").alias("is_excluded"),
    )


def _read(spark: SparkSession, path: str, file_format: str) -> DataFrame:
    reader = spark.read.format(file_format)
    # By header, and as text, so that nothing unreadable becomes a null.
    return (reader.option("header", True).option("inferSchema", False) if file_format == "csv" else reader).load(path)


def read_definitions(spark: SparkSession, path: str, file_format: str = "csv") -> DataFrame:
    """Definitions from a file with the names of ``SCHEMA``, in any order; CSV needs a header line."""
    return checked(_read(spark, path, file_format))


def read_concepts(spark: SparkSession, path: str, file_format: str = "csv") -> DataFrame:
    """Column ``concept_id`` of a file; CSV needs a header line. A value that is no id is an error."""
    listed = _read(spark, path, file_format)
    _columns(listed, ("concept_id",))
    return listed.select(_number("concept_id", "long").alias("concept_id"))


def standard_definitions(spark: SparkSession, nsclc: DataFrame | None = None) -> DataFrame:
    """The oncology sets 6, 10, 11, 13, 14 and 15, and set 12 from the ``concept_id`` column of ``nsclc``.

    Set 12 is a list of some hundred diagnosis and histology codes without descendants; it is a parameter,
    read from wherever the caller keeps it. Without it there is no set 12.
    """
    fixed = definitions_frame(spark, [row for codeset_id, *lists in _SETS for row in define(codeset_id, *lists)])
    if nsclc is None:
        return fixed
    listed = nsclc.select(
        F.lit(NSCLC).alias("codeset_id"),
        _number("concept_id", "long").alias("concept_id"),
        F.lit(False).alias("include_descendants"),
        F.lit(False).alias("is_excluded"),
    )
    return fixed.unionByName(listed)

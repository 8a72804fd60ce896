"""Exact discrete quantiles and person counts with small cells suppressed."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import Decimal
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspan.functions.masking import mask_count, mask_value

# Exact decimals: as doubles, p * n could land on the wrong side of a whole number.
QUANTILES = {
    "q5": Decimal("0.05"),
    "q10": Decimal("0.10"),
    "q25": Decimal("0.25"),
    "median": Decimal("0.50"),
    "q75": Decimal("0.75"),
    "q90": Decimal("0.90"),
    "q95": Decimal("0.95"),
}


def _named(column: str) -> Column:
    """A column by its very name, whatever characters that has."""
    return F.col("`" + column.replace("`", "``") + "`")


#: Bits of a value that one level of prefix sums tells apart: no window sees more than 2 ** LEVEL rows.
LEVEL = 16
#: Bits of values that are cumulated at once where there are keys: whole numbers of days, of which calendars have few.
KEYED = 32
_BITS = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}


def _matching(left: DataFrame, right: DataFrame, names: Sequence[str]) -> DataFrame:
    """Inner join on equal ``names``, of which any may be null; the columns of both, the shared ones once."""
    renamed = right.select([F.col(c).alias(f"{c}_r") if c in names else F.col(c) for c in right.columns])
    on = reduce(and_, [F.col(c).eqNullSafe(F.col(f"{c}_r")) for c in names])
    return left.join(renamed, on).drop(*[f"{c}_r" for c in names])


def cumulated(histogram: DataFrame, keys: Sequence[str], bits: int) -> DataFrame:
    """``histogram`` (keys, _v, _copies; each value once a key) with ``_reached``, the copies up to a value, and ``_total``.

    Distributed prefix sums: values are grouped by their leading bits, and groups again, until a key has at most
    2 ** LEVEL groups. Those are cumulated, and each group hands what lies before it to its members. So every window,
    also one over all rows, sees at most 2 ** LEVEL rows, however many values of ``bits`` bits there are. With keys, which
    share the work out already, values of up to KEYED bits are cumulated at once.
    """
    if keys and bits <= KEYED:
        group = f"PARTITION BY {', '.join(keys)}"
        every = f"sum(_copies) OVER ({group} ORDER BY _v ROWS UNBOUNDED PRECEDING) AS _reached"
        return histogram.selectExpr("*", every, f"sum(_copies) OVER ({group}) AS _total")

    def parent(shift: int) -> str:
        return f"shiftright(_v, {shift}) AS _node"

    shifts = list(range(LEVEL, bits, LEVEL))
    # Counts by leading bits, each from the finer ones below it.
    levels = [histogram]
    for shift in shifts:
        below = levels[-1].selectExpr(*keys, parent(LEVEL), "_copies").withColumnRenamed("_node", "_v")
        levels.append(below.groupBy(*keys, "_v").agg(F.expr("sum(_copies) AS _copies")))
    own = f"PARTITION BY {', '.join(keys)}" if keys else ""
    running = "sum(_copies) OVER ({} ORDER BY _v ROWS UNBOUNDED PRECEDING)"
    reached = levels.pop().selectExpr("*", f"{running.format(own)} AS _reached", f"sum(_copies) OVER ({own}) AS _total")
    while levels:
        above = reached.selectExpr(*keys, "_v AS _node", "_reached - _copies AS _before", "_total")
        group = "PARTITION BY " + ", ".join([*keys, "_node"])
        # Without keys the first groups are so few that they can be sent to all tasks.
        above = F.broadcast(above) if not keys and len(levels) == len(shifts) else above
        inside = levels.pop().selectExpr("*", parent(LEVEL)).selectExpr("*", f"{running.format(group)} AS _inside")
        reached = _matching(inside, above, [*keys, "_node"]).selectExpr(*keys, "_v", "_copies", "_before + _inside AS _reached", "_total")
    return reached


def masked_distribution(
    rows: DataFrame,
    value: str,
    by: Sequence[str] = (),
    min_count: int = 5,
    saturate: int | None = 9999,
    quantiles: Mapping[str, Decimal] = QUANTILES,
) -> DataFrame:
    """Count, minimum, nearest-rank quantiles and maximum of ``value``, overall or per ``by``.

    ``rows`` holds one row per person. The p-quantile is the smallest value with at least ``p * n``
    rows up to it. Quantiles above ``saturate`` are reported as ``saturate``, except where ``p * n`` is
    at most one; minimum and maximum never are. Below ``min_count`` rows, ``n`` is ``-min_count`` and
    the rest NULL. No rows give no result row.

    ``value`` is any whole number. Ranks come from cumulated counts of the distinct values, however many there
    are; a narrower type needs fewer steps. Results have the type of ``value``.
    """
    kind = rows.select(_named(value)).schema[0].dataType
    if type(kind) not in _BITS:
        raise TypeError(f"{value} is {kind.simpleString()}, not a whole number of days")
    # Names that no caller's column has, as any of them may stand next to the keys.
    keys = {f"_key_{i}": column for i, column in enumerate(by)}
    seen = rows.select(*[_named(c).alias(k) for k, c in keys.items()], _named(value).alias("_v")).where("_v IS NOT NULL")
    wide = isinstance(kind, T.LongType)
    if not wide:
        seen = seen.withColumn("_v", F.col("_v").cast("int"))
    histogram = seen.groupBy(*keys, "_v").agg(F.expr("count(1) AS _copies"))
    ranked = cumulated(histogram, list(keys), _BITS[type(kind)])

    def quantile(p: Decimal) -> str:
        exact = f"min(if(_reached >= {p} * _total, _v, NULL))"
        return exact if saturate is None else f"if({p} * _total > 1, least({exact}, {saturate}L), {exact})"

    statistics = {"min": "min(_v)", **{name: quantile(p) for name, p in quantiles.items()}, "max": "max(_v)"}
    masked = [F.expr(mask_value(x, "_total", min_count)).cast(kind).alias(f"{name}_{value}") for name, x in statistics.items()]
    found = ranked.groupBy("_total", *keys).agg(*masked)
    return found.select(
        F.expr(mask_count("_total", min_count)).alias("n"),
        *[F.col(k).alias(c) for k, c in keys.items()],
        *[_named(f"{name}_{value}") for name in statistics],
    )


def masked_counts(
    occurrences: DataFrame,
    by: Sequence[str] = ("concept_id",),
    thresholds: Sequence[int] = (1, 2, 3),
    min_count: int = 5,
) -> DataFrame:
    """Persons per ``by``, and persons with more than k events for each threshold k.

    ``occurrences`` holds one row per person and ``by``, with ``n_events``. Below ``min_count`` the
    count of persons is ``-min_count`` and the threshold counts are NULL. The column of threshold 1 has no suffix.
    """
    counts = [f"{mask_count('count(1)', min_count)} AS excluded_patient_count"]
    for k in thresholds:
        repeated = f"count_if(n_events > {k})"
        suffix = "" if k == 1 else f"_{k}"
        counts.append(f"{mask_value(repeated, repeated, min_count)} AS excluded_patient_count_multiple{suffix}")
    return occurrences.groupBy(*map(_named, by)).agg(*map(F.expr, counts))

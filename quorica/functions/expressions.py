"""Small column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def row_count() -> Column:
    return F.count(F.lit(1))


def ratio(numerator: Column, denominator: Column, digits: int = 4) -> Column:
    """Rounded quotient, null where the denominator is zero."""
    return F.round(F.try_divide(numerator.cast("double"), denominator.cast("double")), digits)


def share(condition: Column, digits: int = 4) -> Column:
    """Aggregate: share of rows where the condition holds."""
    return ratio(F.count_if(condition), row_count(), digits)


def mean(value: Column, digits: int = 2) -> Column:
    """Aggregate: rounded average."""
    return F.round(F.avg(value), digits)


def sum_where(condition: Column, value: Column) -> Column:
    """Aggregate: sum of the value over the rows where the condition holds, 0 if none."""
    return F.sum(F.when(condition, value).otherwise(F.lit(0)))


def first_below(value: Column, cuts: Iterable[tuple[int, str]], last: str, inclusive: bool = False) -> Column:
    """Label of the first cut above the value, ``last`` beyond all cuts."""
    expr = F
    for bound, label in cuts:
        expr = expr.when(value <= bound if inclusive else value < bound, F.lit(label))
    return expr.otherwise(F.lit(last))


def integer_tier(value: Column, bounds: Sequence[int]) -> Column:
    """Labels of the form ``Below 1``, ``1 to 5``, ``168 or Above``; null is ``Undefined``."""
    cuts = [(bounds[0], f"Below {bounds[0]}")]
    cuts += [(hi, f"{lo} to {hi - 1}") for lo, hi in zip(bounds, bounds[1:])]
    tiered = first_below(value, cuts, f"{bounds[-1]} or Above")
    return F.when(value.isNull(), F.lit("Undefined")).otherwise(tiered)


def month_of(ts: Column) -> Column:
    return F.trunc(F.to_date(ts), "month")

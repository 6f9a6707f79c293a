"""Small column builders shared by the operators. All stay inside Catalyst."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(value, F.lit(float(low))), F.lit(float(high)))


def zero_if_null(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0.0))


def rounded(value: Column, digits: int = 6) -> Column:
    """Round for output.

    The nudge keeps a decimal tie from turning on the last bit of a double; adding zero turns
    -0.0 into 0.0.
    """
    return F.round(value + F.lit(2.5e-9), digits) + F.lit(0.0)


def flag(condition: Column) -> Column:
    """1 when the condition holds, 0 when it is false or null."""
    return F.when(condition, 1).otherwise(0)


def weighted_average_skip_null(pairs: Iterable[tuple[float | Column, Column]], fallback: float = 0.0) -> Column:
    """Weighted mean over the non-null terms; the weight of a null term is dropped too."""
    total = weight_sum = F.lit(0.0)
    for weight, value in pairs:
        w = weight if isinstance(weight, Column) else F.lit(float(weight))
        total = total + F.coalesce(w * value, F.lit(0.0))
        weight_sum = weight_sum + F.when(value.isNull(), 0.0).otherwise(w)
    return F.when(weight_sum <= 0, F.lit(fallback)).otherwise(total / weight_sum)


# Rating floors with bucket name and colour.
RATING_LADDER = (
    (83, "green", "#00b050"),
    (75, "purple", "#8000ff"),
    (68, "indigo", "#4b3cff"),
    (60, "blue", "#0066ff"),
    (50, "sky", "#66ccff"),
    (40, "yellow", "#ffd400"),
    (30, "orange", "#ff8c00"),
)
RATING_BOTTOM = ("red", "#e60000")


def ladder(value: Column, steps: Iterable[tuple[float, object]], otherwise: object) -> Column:
    """First step whose floor the value reaches."""
    out = None
    for floor, result in steps:
        cond = value >= F.lit(floor)
        out = F.when(cond, F.lit(result)) if out is None else out.when(cond, F.lit(result))
    return out.otherwise(F.lit(otherwise))


def rating(score: Column) -> Column:
    return F.round(1 + 99 * score).cast("int")


def rating_even(score: Column) -> Column:
    """Rating with ties to even, used for the visible (frame level) ratings."""
    return F.bround(1 + 99 * score).cast("int")


def rating_bucket(value: Column) -> Column:
    return ladder(value, [(floor, name) for floor, name, _ in RATING_LADDER], RATING_BOTTOM[0])


def rating_color(value: Column) -> Column:
    return ladder(value, [(floor, color) for floor, _, color in RATING_LADDER], RATING_BOTTOM[1])


def lenient_true(value: Column) -> Column:
    """True for boolean true, 1 and the usual text forms; null counts as false."""
    text = F.lower(F.trim(value.cast("string")))
    return F.coalesce(text.isin("1", "true", "t", "yes", "y", "on"), F.lit(False))


def rounded_even(value: Column, digits: int = 0) -> Column:
    """Round with ties to even; values within 1e-7 of a tie (after scaling) count as ties."""
    scale = 10 ** digits
    return F.bround(F.round(value * scale, 7), 0) / scale + F.lit(0.0)

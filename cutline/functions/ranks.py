"""Rank, label and score expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
CATEGORY_ALIASES = {"EWS": "GEN-EWS", "OPEN": "GEN"}
DUAL_DEGREE_PATTERN = r"IDD|M\.Tech|MSc|Dual"
SAFE_PROBABILITY = 0.70
LIKELY_PROBABILITY = 0.40
TREND_STEP = 50
FINAL_ROUND = 7.0
DEFAULT_ROUND = 6


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def as_number(col: Column | str) -> Column:
    """Double, or NULL where the text is no number (never an ANSI error, never NaN)."""
    value = _c(col).try_cast("double")
    return F.when(~F.isnan(value), value)


def canonical_pool(col: Column | str) -> Column:
    is_female = F.lower(_c(col)).contains("female")
    return F.when(is_female, F.lit("Female-Only")).otherwise(F.lit("Gender-Neutral"))


def canonical_category(col: Column | str, aliases: dict[str, str] | None = None) -> Column:
    value = _c(col)
    table = CATEGORY_ALIASES if aliases is None else aliases
    out = value
    for alias, target in table.items():
        out = F.when(value == alias, F.lit(target)).otherwise(out)
    return out


def trend_label(latest: Column, previous: Column, step: int = TREND_STEP) -> Column:
    """UP means the closing rank rose by more than ``step`` (easier to enter)."""
    change = latest - previous
    return (
        F.when(previous.isNull(), "UNKNOWN")
        .when(change > step, "UP")
        .when(change < -step, "DOWN")
        .otherwise("STABLE")
    )


def rank_pressure(average: Column | str, opening: Column | str) -> Column:
    low = _c(opening)
    return F.when(low > 0, F.round(_c(average) / low, 3))


def infer_segment(name: Column | str, marker: str = "IIT") -> Column:
    """Segment of a row without an institute type, read from the institute's name."""
    hit = F.coalesce(F.upper(_c(name)).contains(marker), F.lit(False))
    return F.when(hit, "IIT").otherwise("NIT")


def route_segment(exam_type: Column | str) -> Column:
    return F.when(F.lower(_c(exam_type)).contains("advanced"), "IIT").otherwise("NIT")


def log_rank(col: Column | str) -> Column:
    return F.log1p(_c(col).cast("double"))


def unlog_rank(col: Column | str) -> Column:
    return F.expm1(_c(col))


def whole_rank(col: Column | str) -> Column:
    """Cut to a whole number. Ranks are not negative, so ``floor`` cuts toward zero."""
    return F.floor(_c(col)).cast("long")


def probability_tier(prob: Column | str) -> Column:
    """Tier of an already rounded probability; NULL below the lower limit."""
    p = _c(prob)
    return F.when(p >= SAFE_PROBABILITY, "Safe").when(p >= LIKELY_PROBABILITY, "Likely")


def rounded_probability(prob: Column | str) -> Column:
    return F.round(_c(prob), 4)


def flag(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False)).cast("int")

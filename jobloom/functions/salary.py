"""Salary parsing."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from jobloom.constants import HOURS_PER_YEAR, SALARY_PATTERN


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def salary_values(text) -> Column:
    """All amounts found in the text, scaled like the reference: array<double>."""
    t = _c(text)
    low = F.lower(t)
    raw = F.regexp_extract_all(t, F.lit(SALARY_PATTERN), 1)
    nums = F.transform(raw, lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("double"))
    nums = F.filter(nums, lambda v: v.isNotNull())
    k = low.contains("k")
    hour = low.contains("hour")
    nums = F.transform(nums, lambda v: F.when(k & (v < 1000), v * 1000).otherwise(v))
    return F.transform(nums, lambda v: F.when(hour & (v < 500), v * HOURS_PER_YEAR).otherwise(v))


def parse_salary(text, given_min=None, given_max=None) -> Column:
    """struct<salary_min double, salary_max double>.

    Pre-parsed values win when ``given_min`` is present (max falls back to min
    when missing or zero); else amounts are parsed from the text.
    """
    return salary_of_values(salary_values(F.coalesce(_c(text), F.lit(""))), given_min, given_max)


def salary_of_values(vals: Column, given_min=None, given_max=None) -> Column:
    """X7 from the amounts of a text."""
    parsed_min = F.when(F.size(vals) > 0, F.array_min(vals))
    parsed_max = F.when(F.size(vals) > 0, F.array_max(vals))
    if given_min is None:
        return F.struct(parsed_min.alias("salary_min"), parsed_max.alias("salary_max"))
    gmin = _c(given_min).cast("double")
    gmax = _c(given_max).cast("double") if given_max is not None else F.lit(None).cast("double")
    gmax = F.when(gmax.isNull() | (gmax == 0), gmin).otherwise(gmax)
    return F.struct(F.when(gmin.isNotNull(), gmin).otherwise(parsed_min).alias("salary_min"),
                    F.when(gmin.isNotNull(), gmax).otherwise(parsed_max).alias("salary_max"))


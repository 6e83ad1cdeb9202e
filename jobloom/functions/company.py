"""Company and member attributes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from jobloom.constants import CITY_GAZETTEER, SIZE_BUCKETS, SIZE_TOP_LABEL


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def size_bucket(employee_count) -> Column:
    """Employee count → size label; null stays null."""
    n = _c(employee_count)
    expr = None
    for upper, label in SIZE_BUCKETS:
        expr = (F.when(n <= upper, F.lit(label)) if expr is None
                else expr.when(n <= upper, F.lit(label)))
    return F.when(n.isNull(), F.lit(None).cast("string")).otherwise(
        expr.otherwise(F.lit(SIZE_TOP_LABEL)))


def format_location(locality, region, country) -> Column:
    """Non-empty parts joined by ', '; none → null."""
    parts = [F.nullif(_c(p), F.lit("")) for p in (locality, region, country)]
    return F.nullif(F.concat_ws(", ", *parts), F.lit(""))


def city_from_location(location, country) -> Column:
    """First gazetteer city contained (case-insensitive) in the location.

    A known country restricts the search to its own cities; an unknown or
    missing country searches every city in gazetteer order.
    """
    loc = F.lower(_c(location))
    ctry = _c(country)
    known = [c for c, _ in CITY_GAZETTEER]

    def first_hit(cities):
        e = None
        for city in cities:
            cond = loc.contains(city.lower())
            e = F.when(cond, F.lit(city)) if e is None else e.when(cond, F.lit(city))
        return e

    all_cities = [city for _, cities in CITY_GAZETTEER for city in cities]
    out = None
    for ctry_name, cities in CITY_GAZETTEER:
        cond = ctry == ctry_name
        out = (F.when(cond, first_hit(cities)) if out is None
               else out.when(cond, first_hit(cities)))
    out = out.otherwise(first_hit(all_cities))
    return F.when(F.coalesce(loc, F.lit("")) == "", F.lit(None).cast("string")).otherwise(out)


"""Relative-date parsing and date presentation.

``as_of`` is always passed in: a Python datetime / string literal or a column.
Timestamps are TIMESTAMP_NTZ (naive local times, as the reference stores them).
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, functions as F

from jobloom.functions.text import py_strip

DAY_MICROS = 86_400_000_000


def as_of_col(as_of) -> Column:
    if isinstance(as_of, Column):
        return as_of.cast("timestamp_ntz")
    if isinstance(as_of, _dt.datetime):
        as_of = as_of.strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.lit(str(as_of)).cast("timestamp_ntz")


def posted(text: Column, as_of) -> Column:
    """The posting date, or without ``as_of`` the text that ``relative_date_a`` makes it of later."""
    return text.alias("posted_text") if as_of is None else relative_date_a(text, as_of).alias("posted_date")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def first_int(text: Column) -> Column:
    return F.regexp_extract(text, r"(\d+)", 1).try_cast("int")


def _shift(now: Column, text: Column, n: Column | None = None) -> Column:
    """Shared tail of rules A and B: first integer and the unit word."""
    n = first_int(text) if n is None else n
    has = lambda w: text.contains(w)
    return (F.when(n.isNull(), now)
            .when(has("hour"), F.timestamp_add("HOUR", -n, now))
            .when(has("day"), F.timestamp_add("DAY", -n, now))
            .when(has("week"), F.timestamp_add("DAY", -7 * n, now))
            .when(has("month"), F.timestamp_add("DAY", -30 * n, now))
            .otherwise(now))


def relative_date_a(text, as_of) -> Column:
    """X5 (search-page rule)."""
    now = as_of_col(as_of)
    t = py_strip(F.lower(F.coalesce(_c(text), F.lit(""))))
    return F.when(t.isin("", "just posted", "today"), now).otherwise(_shift(now, t))


def text_b(text) -> Column:
    """The text that rule B reads, without any 'posted'."""
    return py_strip(F.replace(py_strip(F.lower(F.coalesce(_c(text), F.lit("")))),
                              F.lit("posted"), F.lit("")))


def date_of_text_b(t: Column, n: Column, as_of) -> Column:
    """X6 of a text of ``text_b`` and its first integer."""
    now = as_of_col(as_of)
    return F.when((t == "") | (t == "just") | t.contains("today"), now).otherwise(_shift(now, t, n))


def relative_date_b(text, as_of) -> Column:
    """X6 (extraction-item rule): drop every 'posted', then rule A's tail."""
    t = text_b(text)
    return date_of_text_b(t, first_int(t), as_of)


def micros(ts) -> Column:
    return F.unix_micros(_c(ts).cast("timestamp"))


def age_days(posted, as_of) -> Column:
    """Whole days, floor, negative for a future date."""
    return F.floor((micros(as_of_col(as_of)) - micros(posted)) / F.lit(DAY_MICROS)).cast("long")


def age_label(posted, as_of) -> Column:
    """ceil(|diff| in days) → Today / Yesterday / n days / n weeks / n months ago."""
    d = F.ceil(F.abs(micros(as_of_col(as_of)) - micros(posted)) / F.lit(DAY_MICROS)).cast("long")
    return (F.when(d == 0, F.lit("Today"))
            .when(d == 1, F.lit("Yesterday"))
            .when(d < 7, F.concat(d.cast("string"), F.lit(" days ago")))
            .when(d < 30, F.concat(F.floor(d / 7).cast("string"), F.lit(" weeks ago")))
            .otherwise(F.concat(F.floor(d / 30).cast("string"), F.lit(" months ago"))))


def iso_format(ts) -> Column:
    """Python isoformat (micro-seconds only when non-zero); null → ''."""
    c = _c(ts)
    base = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    frac = F.date_format(c, "SSSSSS")
    return F.coalesce(F.when(frac == "000000", base).otherwise(F.concat(base, F.lit("."), frac)),
                      F.lit(""))


def long_us_date(ts) -> Column:
    """X22: 'September 1, 2001'."""
    return F.date_format(_c(ts), "MMMM d, yyyy")

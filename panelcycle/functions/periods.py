"""Reporting periods to dates.

Two conventions coexist: debt series are stamped on the first day of the period, reserve
shares and inequality on the last one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DATED = r"-Q|-M|^\d+$"


def looks_dated(period: Column) -> Column:
    """True for a period that claims to be a quarter, a month or a year."""
    return period.rlike(_DATED)


def period_start(period: Column) -> Column:
    """First day of ``YYYY-Qn``, ``YYYY-Mnn`` or ``YYYY``; NULL for anything else."""
    form = F.regexp_extract(period, "-([QM])", 1)
    year = F.trim(F.split_part(period, F.lit("-"), F.lit(1))).try_cast("smallint")
    number = F.trim(F.substr(period, F.instr(period, "-") + 2)).try_cast("tinyint")
    month = F.when(form == "Q", number * 3 - 2).when(form == "M", number.cast("int")).otherwise(F.lit(1))
    # an impossible month or a missing part makes a text that is no date, so try_cast gives NULL
    first = F.format_string("%04d-%02d-01", year, month).try_cast("date")
    return F.when(looks_dated(period) & year.between(1, 9999), first)


def period_error(period: Column) -> Column:
    """Message for a period that looks like one but names no real date, else NULL.

    An unknown form is merely skipped; a quarter, month or year out of range is a defect of
    the whole series.
    """
    return F.when(
        looks_dated(period) & period_start(period).isNull(),
        F.concat(F.lit("period out of range: "), period),
    )


def period_end(period: Column) -> Column:
    """Last day of ``YYYY-Qn`` or ``YYYY``; NULL for anything else, months included."""
    year = F.substr(period, F.lit(1), F.lit(4)).try_cast("int")
    quarter = F.substr(period, F.lit(7)).try_cast("int")
    return (
        F.when(period.rlike(r"^\d{4}-Q[1-4]$") & (year >= 1), F.last_day(F.make_date(year, quarter * 3, F.lit(1))))
        .when(period.rlike(r"^\d{4}$") & (year >= 1), F.make_date(year, F.lit(12), F.lit(31)))
    )

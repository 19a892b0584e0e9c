"""Column functions over dates and times; ``as_of`` is always given, never the clock."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from talentweave.functions.text import let

# The date forms that are read; others give null.
FORMATS = (
    "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd",
    "MM/dd/yyyy", "MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy"
)
MILLIS_FROM = 10_000_000_000
_MONTHS = (
    "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december",
    "jan", "feb", "mar", "apr", "jun", "jul", "aug", "sep", "oct", "nov", "dec"
)


def parse_time(c: Column) -> Column:
    """Text or number to a UTC timestamp: null, empty and 0 are null; large numbers are milliseconds."""
    text = F.trim(c.cast("string"))
    number = text.try_cast("double")
    seconds = F.when(number > MILLIS_FROM, number / 1000).otherwise(number)
    parsed = F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in FORMATS])
    return F.when((text == "") | (number == 0), None).when(number.isNotNull(), F.timestamp_seconds(seconds)).otherwise(parsed)


def iso(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ssXXX")


def partial_date(c: Column, as_of: dt.date | Column) -> Column:
    """``Jan 2021``, ``January 2021``, ``3/2020``, ``2020`` as the first of the month; ``present`` is as_of's month."""
    now = F.lit(as_of) if not isinstance(as_of, Column) else as_of

    def read(text: Column) -> Column:
        # by patterns, since a format that does not fit costs an exception
        year = F.regexp_extract(text, rf"^(?:(?:{'|'.join(_MONTHS)}) |0*(?:[1-9]|1[0-2])/)?(\d{{4}})$", 1).try_cast("int")
        name, number = F.substring(text, 1, 3), F.regexp_extract(text, r"^0*(\d{1,2})/", 1)
        month = F.when(text.contains("/"), number.try_cast("int")).when(
            text.contains(" "), F.array_position(F.array(*[F.lit(m[:3]) for m in _MONTHS[:12]]), name).cast("int")
        ).otherwise(1)
        return F.when(text.isin("present", "current", "now"), F.trunc(now, "month")).when(year > 0, F.make_date(year, month, F.lit(1)))

    return let(F.lower(F.trim(F.regexp_replace(c, r"[.,]", ""))), read)


def due(last: Column, every_minutes: int, as_of: dt.datetime) -> Column:
    """Never done, or as long ago as the interval."""
    return last.isNull() | (F.unix_timestamp(F.lit(as_of)) - F.unix_timestamp(last) >= every_minutes * 60)

"""Column functions for numbers and times that are kept as text. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of width other than ASCII, and what they stand for.
WIDE = "０１２３４５６７８９．＋－，　"
NARROW = "0123456789.+-, "


def whole_number(text: Column) -> Column:
    """The whole number a text denotes, in plain ASCII digits; null where it denotes none.

    ' 007', '7.0', '７' and '7' are one number. The common case is a single cast; only what
    that can't read goes through width folding and decimals (up to 38 digits).
    """
    plain = text.try_cast("bigint")
    folded = F.trim(F.translate(text, WIDE, NARROW)).try_cast("decimal(38,6)")
    whole = F.when(folded == F.floor(folded), F.floor(folded).cast("decimal(32,0)").cast("string"))
    return F.coalesce(plain.cast("string"), whole)


def micros(time: Column) -> Column:
    """Microseconds since 1970 of a time without zone, whatever the session's zone is."""
    second = F.lit(1).cast("bigint")
    return (
        F.unix_date(F.to_date(time)).cast("bigint") * 86_400_000_000
        + F.hour(time) * (second * 3_600_000_000)
        + F.minute(time) * (second * 60_000_000)
        + (F.extract(F.lit("SECOND"), time) * 1_000_000).cast("bigint")
    )


def local_timestamp(text: Column) -> Column:
    """A time without zone from any of the notations in use; null where none is recognised.

    Read are: year-month-day or year/month/day, with or without T, with or without fractions;
    fourteen digits in a row; twelve-hour times after 上午 or 下午; and years of the local
    calendar (below 1000, counted from 1911).
    """
    compact = text.rlike(r"^\s*\d{14}\s*$")
    spread = F.when(compact, F.regexp_replace(text, r"(\d{4})(\d\d)(\d\d)(\d\d)(\d\d)(\d\d)", "$1 $2 $3 $4 $5 $6")).otherwise(text)

    def made(parts: Column) -> Column:
        part = lambda i: F.try_element_at(parts, F.lit(i)).try_cast("int")
        year = F.when(part(1) < 1000, part(1) + 1911).otherwise(part(1))
        clock = F.coalesce(part(4), F.lit(0))
        hour = F.when(text.contains("下午"), clock % 12 + 12).when(text.contains("上午"), clock % 12).otherwise(clock)
        second = F.concat_ws(".", F.coalesce(F.try_element_at(parts, F.lit(6)), F.lit("0")), F.try_element_at(parts, F.lit(7))).try_cast("decimal(8,6)")
        return F.call_function("try_make_timestamp_ntz", year, part(2), part(3), hour, F.coalesce(part(5), F.lit(0)), second)

    # the digits are taken apart once: a lambda's argument isn't computed again for each use
    digits = F.array(F.regexp_extract_all(spread, F.lit(r"(\d+)"), F.lit(1)))
    return F.when(text.rlike(r"^\s*\d[\d\s/\-T:.年月日上下午]*$"), F.element_at(F.transform(digits, made), 1))

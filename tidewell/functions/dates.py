"""Dates in the spellings that sources use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Month names in Portuguese, by their first three letters.
MONTHS = ("jan", "fev", "mar", "abr", "mai", "jun", "jul", "ago", "set", "out", "nov", "dez")


def _made(y: Column, m: Column, d: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", F.lpad(y, 4, "0"), F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")


def tolerant_date(text: Column) -> Column:
    """ISO, dd/mm/yyyy, dd.mm.yy(yy) or "12 de março de 2026"; anything else and impossible days are null."""
    t = F.lower(F.trim(text))
    part = lambda pattern, i: F.regexp_extract(t, pattern, i)
    iso, slash, dots, words = r"^(\d{4})-(\d{2})-(\d{2})", r"(\d{1,2})/(\d{1,2})/(\d{4})", r"^(\d{1,2})\.(\d{1,2})\.(\d{2,4})$", r"(\d{1,2})\s+de\s+([a-zç]{3})[a-zç]*\s+de\s+(\d{4})"
    year = F.when(F.length(part(dots, 3)) == 2, F.concat(F.lit("20"), part(dots, 3))).otherwise(part(dots, 3))
    month = F.array_position(F.array(*map(F.lit, MONTHS)), part(words, 2)).cast("string")
    return (
        F.when(t.rlike(iso), _made(part(iso, 1), part(iso, 2), part(iso, 3)))
        .when(t.rlike(slash), _made(part(slash, 3), part(slash, 2), part(slash, 1)))
        .when(t.rlike(dots), _made(year, part(dots, 2), part(dots, 1)))
        .when(t.rlike(words), _made(part(words, 3), month, part(words, 1)))
    )


def epoch_to_iso(value: Column) -> Column:
    """Seconds or milliseconds since 1970 (above 10^11) as ISO text in UTC."""
    n = value.cast("double")
    seconds = F.when(n > 1e11, n / 1000).otherwise(n)
    return F.when(n > 0, F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'+00:00'"))


def utc_day(timestamp_text: Column) -> Column:
    return F.substring(timestamp_text, 1, 10)

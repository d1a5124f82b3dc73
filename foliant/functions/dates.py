"""Column builders for dates written in texts. Free-form texts are not parsed: their reading depends on the host."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters read for digits in dates; English month names by their first three letters.
OCR_DIGITS = ("OILSBoilsb", "0115801158")
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def _made(y: Column, m: Column, d: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", F.lpad(y, 4, "0"), F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd") if hasattr(F, "try_to_date") else F.to_date(F.try_to_timestamp(F.concat_ws("-", F.lpad(y, 4, "0"), F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), F.lit("yyyy-MM-dd")))


def event_date(value: Column) -> Column:
    """A date from yyyy-mm-dd, or m/d/y with d/m/y where only that is valid; null otherwise."""
    t = F.trim(F.coalesce(value.cast("string"), F.lit("")))
    part = lambda k: F.regexp_extract(t, r"^(\d{1,2})[/-](\d{1,2})[/-](\d{4})$", k)
    a, b, y = part(1), part(2), part(3)
    iso = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), _made(F.substr(t, F.lit(1), F.lit(4)), F.substr(t, F.lit(6), F.lit(2)), F.substr(t, F.lit(9), F.lit(2))))
    return F.coalesce(iso, F.when(y != "", F.coalesce(_made(y, a, b), _made(y, b, a))))


def normal_date(value: Column) -> Column:
    """yyyy-mm-dd from y-m-d, m/d/y (d/m/y where the first is above 12) or Mon d, yyyy (ordinals dropped), the calendar unchecked; else empty."""
    t = F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), r"(?i)(\d)(st|nd|rd|th)", "$1"))
    ymd = lambda k: F.regexp_extract(t, r"^(\d{4})[/-](\d{1,2})[/-](\d{1,2})$", k)
    mdy = lambda k: F.regexp_extract(t, r"^(\d{1,2})/(\d{1,2})/(\d{4})$", k)
    name = lambda k: F.regexp_extract(t, r"^([A-Za-z]{3})[A-Za-z]{0,6}\s+(\d{1,2}),\s*(\d{4})$", k)
    two = lambda c: F.lpad(c, 2, "0")
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(name(1))).cast("string")
    return F.when(ymd(1) != "", F.concat_ws("-", ymd(1), two(ymd(2)), two(ymd(3)))).when((mdy(3) != "") & (mdy(1).try_cast("int") > 12), F.concat_ws("-", mdy(3), two(mdy(2)), two(mdy(1)))).when(mdy(3) != "", F.concat_ws("-", mdy(3), two(mdy(1)), two(mdy(2)))).when((name(3) != "") & (month != "0"), F.concat_ws("-", name(3), two(month), two(name(2)))).otherwise("")


def ocr_date(value: Column) -> Column:
    """Confused letters to digits, then the first date-like stretch, else what is left of the text."""
    fixed = F.regexp_replace(F.translate(F.trim(F.coalesce(value, F.lit(""))), *OCR_DIGITS), r"[^\dA-Za-z/\-. ,]", "")
    hit = F.regexp_extract(fixed, r"\b\d{1,4}[/\-.]\d{1,2}[/\-.]\d{1,4}\b", 0)
    return F.trim(F.when(hit != "", hit).otherwise(fixed))


def looks_date(text: Column) -> Column:
    return text.rlike(r"\d{1,4}[/.-]\d{1,2}[/.-]\d{1,4}") | text.rlike(r"(?i)\b(" + "|".join(MONTHS) + r")[a-z]*\b")

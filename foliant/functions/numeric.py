"""Column builders for numbers written in texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T


#: Letters read for digits.
OCR_DIGITS = ("OQDIL|SBZoqdilsbz", "00011158200011582")


def number(value: Column) -> Column:
    """A double, null if the text is none."""
    return F.try_cast(F.nullif(value, F.lit("")), "double") if hasattr(F, "try_cast") else F.nullif(value, F.lit("")).try_cast("double")


def fixed2(value: Column) -> Column:
    """Two decimals as text, halves away from zero by the double's product with 100; empty for null or non-finite."""
    cents = F.floor(F.abs(value) * 100 + 0.5).cast("decimal(30,0)")
    shown = F.concat(F.when((value < 0) & (cents > 0), "-").otherwise(""), (cents / 100).cast("decimal(30,2)").cast("string"))
    return F.when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), "").otherwise(shown)


def clean_numeric(value: Column) -> Column:
    """A number with two decimals as text, empty if there is none; parentheses are not negative."""
    kept = F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), "[^0-9.-]", "")
    return F.when(kept.rlike(r"^-?\.?$"), "").otherwise(fixed2(kept.try_cast("double")))


def parse_numeric(value: Column) -> Column:
    """A double: dollar signs and commas dropped, parentheses negative, null if there is no number."""
    raw = F.trim(F.coalesce(value.cast("string"), F.lit("")))
    kept = F.regexp_replace(raw, "[^0-9.+-]", "")
    num = F.when((kept == "") | kept.rlike(r"^[-+.]$"), None).otherwise(kept.try_cast("double"))
    return F.when(raw.rlike(r"^\(.*\)$"), -F.abs(num)).otherwise(num)


def money(value: Column) -> Column:
    """Thousands separated by commas, two decimals, a minus if there is one anywhere; empty if there is no number."""
    raw = F.coalesce(value.cast("string"), F.lit(""))
    num = F.regexp_extract(F.regexp_replace(raw, "[^0-9.]", ""), r"^(\d*\.?\d*)", 1).try_cast("double")
    return F.when(num.isNull(), "").otherwise(F.concat(F.when(F.contains(raw, F.lit("-")), "-").otherwise(""), F.format_number(num, 2)))


def ocr_number(value: Column) -> Column:
    """Confused letters to digits, then the number with most digits (the first of equals), parentheses negative, commas dropped."""
    signed = F.regexp_replace(F.trim(F.coalesce(value, F.lit(""))), r"^\((.*)\)$", "-$1")
    fixed = F.translate(signed, *OCR_DIGITS)
    digits = lambda c: F.length(F.regexp_replace(c, r"\D", ""))
    runs = F.regexp_extract_all(fixed, F.lit(r"-?\d[\d,]*(?:\.\d+)?"), 0)
    longest = F.aggregate(runs, F.lit(""), lambda best, r: F.when(digits(r) > digits(best), r).otherwise(best))
    return F.replace(F.when(longest == "", F.regexp_replace(fixed, r"[^\d.,-]", "")).otherwise(longest), F.lit(","), F.lit(""))


def infer(quantity: Column, price: Column, amount: Column) -> tuple[Column, Column, Column]:
    """(quantity, amount, assumed) of clean texts: quantity from a near-whole amount / price, else 1 if both are blank; amount from the product."""
    q, p, a = (F.nullif(c, F.lit("")).cast("double") for c in (quantity, price, amount))
    ratio = F.try_divide(a, p)
    whole = F.floor(ratio + 0.5)
    from_ratio = F.when((quantity == "") & (F.abs(ratio - whole) < 1e-2), fixed2(whole.cast("double"))).otherwise(quantity)
    assumed = (from_ratio == "") & (amount == "") & p.isNotNull()
    q1 = F.when(assumed, F.lit("1.00")).otherwise(from_ratio)
    a1 = F.when(assumed, price).otherwise(amount)
    product = F.nullif(q1, F.lit("")).cast("double") * p
    return q1, F.when((a1 == "") & (q1 != "") & p.isNotNull(), fixed2(product)).otherwise(a1), F.coalesce(assumed, F.lit(False))


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def half_up(value: Column, digits: int) -> Column:
    """value rounded to so many decimals, halves of the double's product with a power of ten away from zero, as JavaScript and SQL round doubles."""
    ten = 10.0**digits
    return F.signum(value) * F.floor(F.abs(value) * ten + 0.5) / ten


#: What makes a text a date, an invoice number or a quantity.
DATED = r"(?i)\b\d{4}-\d{1,2}-\d{1,2}\b|\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b|\b[a-z]{3,9}\s+\d{1,2},\s*\d{4}\b"
NUMBERED, COUNTED = r"(?i)[a-z0-9][a-z0-9\-_/.]{2,}", r"^\s*\d+(\.\d+)?\s*$"


def format_score(key: Column, text: Column) -> Column:
    """1 or 0 for whether a text fits its field: invoice_number, invoice_date, an amount by its key, quantity; 0.4 for other fields.

    A null or empty text scores 0; any digit makes an amount."""
    t = F.coalesce(text, F.lit(""))
    fits = F.when(key == "invoice_number", t.rlike(NUMBERED) & ~t.rlike(DATED)).when(key == "invoice_date", t.rlike(DATED)).when(key.rlike("total|subtotal|tax|discount"), t.rlike(r"\d")).when(key == "quantity", t.rlike(COUNTED))
    return F.when(t == "", 0.0).when(fits.isNull(), 0.4).otherwise(fits.cast("double"))


#: Words of a field's key that make it a number.
NUMBER_KEYS = r"\b(invoice_number|quantity|qty|amount|subtotal|total|tax|discount|price|unit_price|invoice_total)\b"


def type_hint(magic: Column, key: Column) -> Column:
    """date, text, numeric or any, by a field's declared type, else its key; null counts as blank."""
    m, k = (F.lower(F.coalesce(c, F.lit(""))) for c in (magic, key))
    has = lambda c, *words: F.coalesce(*(F.when(F.contains(c, F.lit(w)), True) for w in words), F.lit(False))
    return F.when(has(m, "date") | has(k, "date"), "date").when(has(m, "text"), "text").when(has(m, "num", "money", "currency") | k.rlike(NUMBER_KEYS), "numeric").otherwise("any")


def consistent(quantity: Column, price: Column, amount: Column) -> tuple[Column, Column, Column]:
    """(quantity, price, amount) as texts: signs stripped, money with two decimals (empty if there is none), a missing amount from the
    product. A number is what a text begins with once all but digits, points and minus signs are gone."""
    kept = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9.-]", "")
    start = lambda c: F.regexp_extract(c, r"^-?(\d+\.?\d*|\.\d+)", 0).try_cast("double")
    q, p, a = kept(quantity), fixed2(start(kept(price))), fixed2(start(kept(amount)))
    return q, p, F.when((a == "") & (q != "") & (p != ""), fixed2(start(q) * p.try_cast("double"))).otherwise(a)


def cleaned_by_hint(value: Column, magic: Column, key: Column) -> Column:
    """The cleaning that a field's type hint calls for: a date made regular, a number read, text with single spaces; any other as it is, trimmed.

    Where a date or number leaves nothing, the trimmed text stays."""
    from . import dates

    t = F.trim(F.coalesce(value, F.lit("")))
    hint = type_hint(magic, key)
    day = dates.ocr_date(t)
    read = F.coalesce(F.nullif(dates.normal_date(day), F.lit("")), F.when(dates.looks_date(day), day), t)
    return F.when(hint == "date", read).when(hint == "numeric", F.coalesce(F.nullif(ocr_number(t), F.lit("")), t)).when(hint == "text", F.trim(F.regexp_replace(t, r"\s+", " "))).otherwise(t)

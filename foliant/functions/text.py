"""Column builders for text: normalisation, similarity, matching, glyph correction."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space as browsers see it: Unicode white space and the byte order mark.
SPACE = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"
#: Glyphs that OCR confuses.
AMBIGUOUS_DIGITS, AMBIGUOUS_LETTERS = "0157", "OIlST"
LETTER_TO_DIGIT = ("OIlST", "01157")
DIGIT_TO_UPPER, DIGIT_TO_LOWER = ("0157", "OIST"), ("0157", "olst")


def collapse(value: Column) -> Column:
    """White space to single spaces, trimmed; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), SPACE, " "))


def keyword_norm(value: Column) -> Column:
    """Lower case, everything but a-z and 0-9 to single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), "[^a-z0-9]+", " "))


def header_norm(value: Column) -> Column:
    """Column header: lower case, white space to underscores, other signs dropped."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(value)), r"\s+", "_"), "[^a-z0-9_]", "")


@F.pandas_udf(StringType())
def decomposed(values: pd.Series) -> pd.Series:
    """NFKD without combining marks; there is no built-in for it."""
    plain = lambda s: "".join(c for c in unicodedata.normalize("NFKD", s) if not "̀" <= c <= "ͯ")
    return values.fillna("").map(lambda s: s if s.isascii() else plain(s))


def match_norm(value: Column) -> Column:
    """Text as the search compares it: decomposed, then as a keyword."""
    return keyword_norm(decomposed(value))


def squash(value: Column) -> Column:
    return F.replace(value, F.lit(" "), F.lit(""))


def edit_ratio(a: Column, b: Column) -> Column:
    """Edit distance over the longer length; 0 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 0.0).otherwise(F.levenshtein(a, b) / longest)


def similarity(a: Column, b: Column) -> Column:
    return 1 - edit_ratio(a, b)


def jaccard(a: Column, b: Column) -> Column:
    """Shared words over all words of two texts; 0 if both are empty."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+"), lambda w: w != ""))
    x, y = words(a), words(b)
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(x, y)) / union)


def token_overlap(found: Column, wanted: Column) -> Column:
    """Share of the wanted words that are found."""
    words = lambda c: F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != "")
    x, y = words(found), words(wanted)
    return F.when(F.size(y) == 0, 0.0).otherwise(F.size(F.filter(y, lambda w: F.array_contains(x, w))) / F.size(y))


def token_match_score(candidate: Column, part: Column) -> Column:
    """3 equal, 2 begins with, 1 contains, 0.5 is contained, else 0."""
    blank = (F.coalesce(candidate, F.lit("")) == "") | (F.coalesce(part, F.lit("")) == "")
    return F.when(blank, 0.0).when(candidate == part, 3.0).when(F.startswith(candidate, part), 2.0).when(F.contains(candidate, part), 1.0).when(F.contains(part, candidate), 0.5).otherwise(0.0)


def form_penalty(text: Column) -> Column:
    """What e-mail-like, URL-like and mixed texts lose in ranking."""
    return F.when(is_email(text), -2.0).otherwise(0.0) + F.when(is_url(text), -1.0).otherwise(0.0) + F.when(is_mixed(text), -0.5).otherwise(0.0)


def token_matches(candidate: Column, part: Column, least: int = 3) -> Column:
    """Equal, or one contains the other and the shorter has `least` characters, or as many as a shorter part."""
    either = F.contains(candidate, part) | F.contains(part, candidate)
    long = F.least(F.length(candidate), F.length(part)) >= F.least(F.lit(least), F.length(part))
    return (candidate != "") & (part != "") & ((candidate == part) | (either & long))


def compatible(expected: Column, candidate: Column) -> Column:
    """Equal; contained from 4 characters on; one edit apart if longer than 3."""
    contained = (F.least(F.length(expected), F.length(candidate)) >= 4) & (F.contains(expected, candidate) | F.contains(candidate, expected))
    near = (F.greatest(F.length(expected), F.length(candidate)) > 3) & F.levenshtein(expected, candidate, 1).between(0, 1)
    return (expected != "") & (candidate != "") & ((expected == candidate) | contained | near)


def is_email(text: Column) -> Column:
    return F.contains(text, F.lit("@"))


def is_url(text: Column) -> Column:
    return text.rlike(r"(?i)\bhttps?://|www\.")


def is_numeric_only(text: Column) -> Column:
    return F.trim(text).rlike(r"^[\d.,-]+$")


def is_mixed(text: Column) -> Column:
    return text.rlike("[0-9]") & text.rlike("(?i)[a-z]")


def collapse_repeats(text: Column) -> Column:
    """Adjacent repeated phrases once, until nothing repeats. A pass leaves at most half of a repeated phrase's words, so a text
    of n words is done after log2(n) + 1 passes."""
    once = lambda s: F.regexp_replace(s, r"(?i)(\b[\w#&.-]+(?:\s+[\w#&.-]+)*)(?:\s+\1\b)+", "$1")
    passes = F.ceil(F.log2(F.size(F.split(text, r"\s+")) + 1)).cast("int") + 1
    return F.aggregate(F.sequence(F.lit(1), passes), text, lambda s, _: once(s))


def strip_alnum(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z0-9]", "")


def rehydrate(original: Column, fixed: Column) -> Column:
    """The alphanumerics of original replaced in order by the characters of fixed."""
    step = lambda acc, ch: F.when(
        ch.rlike("[A-Za-z0-9]"),
        F.struct(F.concat(acc["text"], F.when(acc["n"] < F.length(fixed), F.substr(fixed, acc["n"] + 1, F.lit(1))).otherwise(ch)).alias("text"), (acc["n"] + 1).alias("n")),
    ).otherwise(F.struct(F.concat(acc["text"], ch).alias("text"), acc["n"].alias("n")))
    return F.aggregate(chars(original), F.struct(F.lit("").alias("text"), F.lit(0).alias("n")), step, lambda acc: acc["text"])


def chars(text: Column) -> Column:
    """The characters of a text; none for an empty one."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), ""), lambda c: c != "")


def digit_to_letter(digit: Column, left: Column) -> Column:
    """The letter an ambiguous digit stands for: lower case after a lower-case letter."""
    return F.when(left.rlike("[a-z]"), F.translate(digit, *DIGIT_TO_LOWER)).otherwise(F.translate(digit, *DIGIT_TO_UPPER))


def letter_to_digit(text: Column) -> Column:
    return F.translate(text, *LETTER_TO_DIGIT)


def adjacency_fixed(text: Column) -> Column:
    """Ambiguous digits that follow a letter become letters, from left to right, each seeing the corrected one before.

    A digit to the left, ambiguous or not, keeps what follows."""
    step = lambda out, ch: F.concat(out, F.when(ch.isin(*AMBIGUOUS_DIGITS) & F.right(out, F.lit(1)).rlike("[A-Za-z]"), digit_to_letter(ch, F.right(out, F.lit(1)))).otherwise(ch))
    return F.aggregate(chars(text), F.lit(""), step)


def type_fixed(text: Column, kind: Column) -> Column:
    """text_only: ambiguous digits to letters (by the original character before); numeric_only: letters to digits."""
    before = lambda i: F.substr(text, i, F.lit(1))
    letters = F.array_join(F.transform(chars(text), lambda c, i: F.when(c.isin(*AMBIGUOUS_DIGITS), digit_to_letter(c, F.when(i > 0, before(i)).otherwise(""))).otherwise(c)), "")
    return F.when(kind == "text_only", letters).when(kind == "numeric_only", letter_to_digit(text)).otherwise(text)


def magic_type(value: Column) -> Column:
    v = F.lower(F.coalesce(value, F.lit("")))
    return F.when(F.contains(v, F.lit("text")), "text_only").when(F.contains(v, F.lit("num")), "numeric_only").otherwise("any")


def segments(text: Column) -> Column:
    """Map of segment id to text: the whole, the first word, the first two, the last two."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")
    some = lambda part: F.coalesce(F.nullif(F.array_join(part, " "), F.lit("")), text)
    last = F.when(F.size(words) > 2, F.slice(words, -2, 2)).otherwise(words)
    return F.create_map(F.lit("full"), text, F.lit("first1"), some(F.slice(words, 1, 1)), F.lit("first2"), some(F.slice(words, 1, 2)), F.lit("last2"), some(last))


def layout_confidence(slots: Column, layout: Column) -> Column:
    """support, conflicts and ok of a text against a learned layout of L, N and ?: strong glyphs alone are considered."""
    strong = F.transform(chars(slots), lambda c: F.when(c.rlike("[234689]"), "N").when(c.rlike("[A-Za-z]") & ~c.isin(*AMBIGUOUS_LETTERS), "L").otherwise("?"))
    pairs = F.zip_with(strong, chars(layout), lambda s, e: F.when((s == "?") | (F.coalesce(e, F.lit("?")) == "?") | s.isNull(), 0).when(s == e, 1).otherwise(-1))
    support, conflicts = F.size(F.filter(pairs, lambda p: p == 1)), F.size(F.filter(pairs, lambda p: p == -1))
    ok = (support + conflicts >= 2) & (support >= 0.8 * (support + conflicts)) & (conflicts < 2)
    return F.struct(support.alias("support"), conflicts.alias("conflicts"), ok.alias("ok"))


def value_after_label(line: Column) -> Column:
    """What follows the first word of a line, its colon dropped; the line itself if it has one word."""
    rest = F.regexp_extract(F.trim(line), r"^\S+[\s:]+(.*)$", 1)
    return F.when(rest == "", F.trim(line)).otherwise(rest)

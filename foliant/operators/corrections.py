"""The chain of four corrections of a field's texts: glyphs after letters, the field's type, what its positions have held before, and a fix by that.

Events (keys, seq, text, kind) of a key are taken in order of seq. The state that an event sees is that of all events up to and with it: scores
of letters and digits by length of the text and position, by shape of its words, word and place, and by word and place alone. In
the batch form these are running sums, partitioned by position, so that no task holds a key's history; corrected_stream() holds
them as state. Both give the same texts.

Defined results: a null text is empty; equal seq are taken in order of the text, equal rows one after the other; a text without letters and digits stays as the
first two corrections leave it. keys must not be named like the columns here.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import text as X
from .learn import layout_of

GAIN, COVERAGE = 5, 0.6
PLAIN = (*X.AMBIGUOUS_DIGITS, *X.AMBIGUOUS_LETTERS)


def typed(events: DataFrame, strategy: str = "full") -> DataFrame:
    """events with typed (after the first two corrections), raw (the segment of it), slots (its letters and digits), words (those of each word)."""
    e = events.withColumn("typed", X.type_fixed(X.adjacency_fixed(F.coalesce("text", F.lit(""))), X.magic_type(F.col("kind"))))
    e = e.withColumn("raw", F.coalesce(F.element_at(X.segments(F.col("typed")), strategy), F.lit("")))
    words = F.filter(F.split(F.trim("raw"), r"\s+"), lambda w: w != "")
    return e.withColumns({"slots": X.strip_alnum(F.col("raw")), "words": F.transform(words, X.strip_alnum)})


def _fixed(slots: Column, layout: Column, expected: Column) -> Column:
    """Glyphs turned to the learned kind of their position, unless their word is known to hold the other kind there."""
    steps = F.arrays_zip(X.chars(slots).alias("c"), X.chars(layout).alias("l"), X.chars(expected).alias("e"))

    def step(out, s):
        to_digit = (s["l"] == "N") & s["c"].isin(*X.AMBIGUOUS_LETTERS) & (s["e"] != "L")
        to_letter = (s["l"] == "L") & s["c"].isin(*X.AMBIGUOUS_DIGITS) & (s["e"] != "N")
        return F.concat(out, F.when(to_digit, X.letter_to_digit(s["c"])).when(to_letter, X.digit_to_letter(s["c"], F.right(out, F.lit(1)))).otherwise(s["c"]))

    return F.aggregate(steps, F.lit(""), step)


def finished(e: DataFrame) -> DataFrame:
    """Adds ok (enough of the text agrees with the layout) and final, from typed, raw, slots, layout, expected and violation."""
    ok = X.layout_confidence(F.col("slots"), F.col("layout"))["ok"]
    fix = X.rehydrate(F.col("raw"), _fixed(F.col("slots"), F.col("layout"), F.col("expected")))
    at = F.instr("typed", F.col("raw"))
    spliced = F.concat(F.substr("typed", F.lit(1), at - 1), fix, F.substr("typed", at + F.length("raw")))
    e = e.withColumn("ok", F.coalesce(ok, F.lit(False)))
    return e.withColumn("final", F.when(F.col("violation") & F.col("ok"), spliced).otherwise(F.col("typed")))


def corrected(events: DataFrame, keys: list[str], strategy: str = "full") -> DataFrame:
    """keys, seq, text, typed, layout, expected (by words), violation, ok, final of every event."""
    ids = [*keys, "seq", "text", "turn"]
    repeats = Window.partitionBy(*keys, "seq", "text").orderBy("kind")
    e = typed(events.select(*keys, "seq", "text", "kind").withColumn("turn", F.row_number().over(repeats)), strategy)
    e = e.withColumns({"size": F.length("slots"), "shape": F.array_join(F.transform("words", lambda w: F.length(w).cast("string")), ",")})
    place = lambda w, i: F.transform(X.chars(w), lambda c, j: F.struct(i.alias("word"), j.alias("offset"), c.alias("c")))
    rows = e.select(*ids, "size", "shape", F.posexplode(F.flatten(F.transform("words", place))).alias("pos", "s")).select("*", "s.word", "s.offset", "s.c")
    plain = ~F.col("c").isin(*PLAIN)
    gain = {"letter": F.when(plain & F.col("c").rlike("[A-Za-z]"), GAIN).otherwise(0), "number": F.when(plain & F.col("c").rlike("[0-9]"), GAIN).otherwise(0)}
    rows = rows.withColumns(gain)
    order = ["seq", "text", "turn"]
    for name, by in (("own", ("size", "pos")), ("by_shape", ("shape", "word", "offset")), ("by_word", ("word", "offset"))):
        w = Window.partitionBy(*keys, *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn(name, layout_of(F.sum("letter").over(w), F.sum("number").over(w)))
    rows = rows.withColumn("expected", F.when(F.col("by_shape") == "?", F.col("by_word")).otherwise(F.col("by_shape")))
    g = rows.groupBy(*ids, "size").agg(F.array_sort(F.collect_list(F.struct("pos", "own", "expected"))).alias("p"))
    said = lambda c: F.array_join(F.transform("p", lambda x: x[c]), "")
    g = g.select(*ids, "size", said("own").alias("layout"), said("expected").alias("expected"))
    known = F.length(F.replace("layout", F.lit("?"), F.lit("")))
    mixed = F.col("layout").rlike("LN|NL") & (known / F.col("size") >= COVERAGE)
    running = Window.partitionBy(*keys, "size").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    g = g.withColumn("violation", F.max(mixed).over(running)).select(*(F.col(c).alias(f"g_{c}") for c in ids), "layout", "expected", "violation")
    found = e.join(g, [F.col(c) == F.col(f"g_{c}") for c in ids], "left")  # texts with letters or digits are not null
    none = F.lit("")
    found = found.withColumns({"layout": F.coalesce("layout", none), "expected": F.coalesce("expected", none), "violation": F.coalesce("violation", F.lit(False))})
    return finished(found).select(*keys, "seq", "text", "typed", "layout", "expected", "violation", "ok", "final")


def _learned(scores: list) -> str:
    letter, number = scores
    if letter + number >= 20 and abs(letter - number) >= 15:
        return "L" if letter > number else "N"
    return "?"


def advance(state: dict, slots: str, words: list[str]) -> tuple[str, str, bool]:
    """One event: the state's scores go on; layout, expected and violation after it."""

    def score(key: str, c: str) -> str:
        held = state.setdefault(key, [0, 0])
        if c not in PLAIN:
            held[0 if c.isalpha() else 1] += GAIN
        return _learned(held)

    shape = ",".join(str(len(w)) for w in words)
    layout = "".join(score(f"s/{len(slots)}/{i}", c) for i, c in enumerate(slots))
    expected = ""
    for k, w in enumerate(words):
        for j, c in enumerate(w):
            own, pooled = score(f"c/{shape}/{k}/{j}", c), score(f"w/{k}/{j}", c)
            expected += pooled if own == "?" else own
    mixed = bool(slots) and ("LN" in layout or "NL" in layout) and (len(layout) - layout.count("?")) / len(slots) >= COVERAGE
    sticky = f"v/{len(slots)}"
    state[sticky] = bool(state.get(sticky)) or mixed
    return layout, expected, state[sticky] if slots else False


def corrected_stream(events: DataFrame, keys: list[str], strategy: str = "full") -> DataFrame:
    """The rows of corrected() for a stream whose events of a key come in order of seq, with the scores held as state of the key."""
    e = typed(events.select(*keys, "seq", "text", "kind"), strategy)
    names = ["seq", "text", "typed", "raw", "slots"]

    def step(key, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state = json.loads(held.get[0]) if held.exists else {}
        found = []
        for row in pd.concat(batches).sort_values(["seq", "text"]).itertuples():
            found.append((*key, *(getattr(row, n) for n in names), *advance(state, row.slots, list(row.words))))
        held.update((json.dumps(state),))
        yield pd.DataFrame(found, columns=[*keys, *names, "layout", "expected", "violation"])

    fields = [e.schema[k] for k in (*keys, *names)] + [T.StructField("layout", T.StringType()), T.StructField("expected", T.StringType()), T.StructField("violation", T.BooleanType())]
    out = e.groupBy(*keys).applyInPandasWithState(step, T.StructType(fields), "scores string", "append", GroupStateTimeout.NoTimeout)
    return finished(out).select(*keys, "seq", "text", "typed", "layout", "expected", "violation", "ok", "final")

"""Mixing sources to target weights by a low-discrepancy schedule; DataFrame functions only.

Sources in code point order, null last, have weights 1, 2, 3, repeating. Their targets share the total size; a target
stops at REPEATS times its source's size and the excess goes to the others by weight. With sources sorted by
REPEATS * size / weight the stopped ones are a prefix, so the final level follows from running sums.

A source's documents, in an order shuffled by a hash of doc_id, are laid end to end and cut into blocks of BLOCK words.
Slot j of the schedule belongs to the source whose cumulative share covers j; its place in time is j with its bits
reversed (a van der Corput point), so that every stretch of the schedule holds each source by its weight. The k-th slot
of a source, by time, takes block k modulo its blocks; the last slot takes what is missing to the target.

blocks() is the mix itself: which words of which document stand at which time. mix() sums it to the words taken of each
document, resampled() turns it into documents in the order of the schedule. No window is over a whole source: positions
are summed by range of the shuffled order and ranks by stretch of time first. Only the windows over targets() are over
a whole table, that of the sources (a row each).

Defined results: a null or empty text has size 0 and is never taken; a null source is a source of its own; rows with
equal doc_id are ordered by a hash of their text, rows without doc_id lie where that hash says, and equal rows share
what falls to them; an empty table gives an empty result. mix() reads doc_id, source and text only; columns of any name
may stand beside them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, materialize

REPEATS, BLOCK, SPAN, RANGE = 3, 256, 1 << 16, 1 << 18
WORD = r"[^\x20\x09-\x0D]+"
#: A word with the white space before it: these pieces of a text, joined, are the text up to its last word.
PIECE = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"


def row_hash(docs: DataFrame):
    """A hash of all columns but maps, which Spark cannot hash."""
    return F.xxhash64(*(docs[f"`{c}`"] for c, kind in docs.dtypes if "map<" not in kind))


def sized(docs: DataFrame, link=None) -> DataFrame:
    """doc_id, source, size, place (hash order), link (a hash of the text, or the given one), salt of every row.

    The rows are written through a rebalance, as a task per input split would leave as many tiny files. The salt divides
    groups of equal rows; as these are alike, it does not matter which of them gets which part of the mix.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    link = F.xxhash64("text") if link is None else link
    key = F.coalesce(F.col("doc_id").cast("string"), link.cast("string"))
    place = F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")
    size = F.regexp_count(text, F.lit(WORD)).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), place.alias("place"), link.alias("link"))
    return materialize(rows.hint("rebalance").withColumn("salt", F.monotonically_increasing_id()), "mix-docs")


def targets(base: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row per source: src, source, source_size, weight, target, whole (full passes), rest (words of the last pass), blocks, slots, lo, hi."""
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    s = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("src", F.row_number().over(in_order) - 1).withColumn("weight", (F.col("src") % 3 + 1).cast("double"))
    most = F.lit(REPEATS) * F.col("source_size")
    s = s.withColumn("ratio", most / F.col("weight"))
    everything = Window.orderBy("ratio", "src").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("ratio", "src").rowsBetween(Window.unboundedPreceding, -1)
    since = Window.orderBy("ratio", "src").rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum(most).over(before), F.lit(0))) / F.sum("weight").over(since))
    level = F.first(F.when(F.col("level") <= F.col("ratio"), F.col("level")), ignorenulls=True).over(everything)
    s = s.withColumn("target", F.least(most.cast("double"), F.coalesce(level, F.lit(0.0)) * F.col("weight")))
    size = F.greatest("source_size", F.lit(1))
    words = F.floor(F.col("target") + 1e-6)
    s = s.withColumn("whole", F.floor(words / size)).withColumn("rest", words - F.col("whole") * F.col("source_size"))
    s = s.withColumn("blocks", F.ceil(F.col("source_size") / block)).withColumn("slots", F.col("whole") * F.col("blocks") + F.ceil(F.col("rest") / block))
    s = s.withColumn("hi", F.sum("slots").over(in_order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("lo", F.col("hi") - F.col("slots"))
    return s.select("src", "source", "source_size", "weight", "target", *(F.col(c).cast("long").alias(c) for c in ("whole", "rest", "blocks", "slots", "lo", "hi")))


def schedule(goal: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row per slot: src, time (place in the schedule), rank (of its source's slots), block, pass (times the block came before), words (taken from the block's start)."""
    total = goal.agg(F.max("hi")).first()[0] or 0
    bits = max(1, (max(total, 1) - 1).bit_length())
    spread = goal.where("slots > 0").select("*", F.explode(F.sequence(F.floor(F.col("lo") / SPAN), F.floor((F.col("hi") - 1) / SPAN))).alias("span"))
    j = goal.sparkSession.range(total).select(F.col("id").alias("j"), F.floor(F.col("id") / SPAN).alias("at"))
    time = F.conv(F.reverse(F.lpad(F.bin("j"), bits, "0")), 2, 10).cast("long")
    slots = j.join(spread, (F.col("at") == F.col("span")) & (F.col("j") >= F.col("lo")) & (F.col("j") < F.col("hi")))
    stretch = F.shiftright("time", max(0, bits - max(0, (total // SPAN).bit_length())))
    slots = slots.select("src", "source_size", "rest", "blocks", "slots", time.alias("time")).withColumn("stretch", stretch)
    counts = slots.groupBy("src", "stretch").count()
    sums = counts.select(F.col("src").alias("s"), F.col("stretch").alias("c"), (F.sum("count").over(Window.partitionBy("src").orderBy("stretch")) - F.col("count")).alias("base"))
    ranked = slots.withColumn("n", F.row_number().over(Window.partitionBy("src", "stretch").orderBy("time")) - 1)
    ranked = ranked.join(sums, (F.col("src") == F.col("s")) & (F.col("stretch") == F.col("c"))).withColumn("rank", F.col("base") + F.col("n"))
    which = F.pmod("rank", "blocks")
    length = F.least(F.lit(block), F.col("source_size") - which * block)
    last = (F.col("rank") == F.col("slots") - 1) & (F.col("rest") > 0)
    words = F.when(last, F.least(length, F.col("rest") - which * block)).otherwise(length)
    return ranked.select("src", "time", "rank", which.alias("block"), F.floor(F.col("rank") / F.col("blocks")).alias("pass"), words.alias("words"))


def placed(base: DataFrame, goal: DataFrame) -> DataFrame:
    """sized() rows with src, source_size, target and p, the words of their source that lie before them in the shuffled order."""
    known = goal.select(F.col("source").alias("its"), "src", "source_size", "target")
    rows = base.join(known, F.col("source").eqNullSafe(F.col("its"))).drop("its")
    ranges = max(base.sparkSession.sparkContext.defaultParallelism, base.count() // RANGE)
    rows = rows.repartitionByRange(ranges, "src", "place", "link", "salt").withColumn("range", F.spark_partition_id())
    rows = materialize(rows, "mix-rows")
    sums = rows.groupBy("src", "range").agg(F.sum("size").alias("n"))
    sums = sums.select(F.col("src").alias("s"), F.col("range").alias("c"), (F.sum("n").over(Window.partitionBy("src").orderBy("range")) - F.col("n")).alias("base"))
    inner = Window.partitionBy("src", "range").orderBy("place", "link", "salt").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    rows = rows.join(sums, (F.col("src") == F.col("s")) & (F.col("range") == F.col("c")))
    return rows.withColumn("p", F.col("base") + F.col("before")).drop("s", "c", "base", "before", "range", "place", "salt")


def _pieces(rows: DataFrame, goal: DataFrame, block: int) -> DataFrame:
    """The columns of placed() rows, all of them, with time, pass, block, start, stop for every piece that the mix takes (null where it takes none)."""
    most = F.greatest(F.col("p") + F.col("size") - 1, F.col("p"))
    cut = rows.withColumn("block", F.explode(F.sequence(F.floor(F.col("p") / block), F.floor(most / block))))
    slots = schedule(goal, block).select(F.col("src").alias("s"), F.col("block").alias("k"), "time", "pass", "words")
    begin, end = F.greatest(F.lit(0), F.col("block") * block - F.col("p")), F.col("block") * block - F.col("p") + F.coalesce("words", F.lit(0))
    cut = cut.join(slots, (F.col("src") == F.col("s")) & (F.col("block") == F.col("k")), "left").drop("s", "k")
    return cut.withColumn("start", begin).withColumn("stop", F.greatest(begin, F.least(F.col("size"), end))).drop("words")


def blocks(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The mix: time, source, block, pass, doc_id, link, start, stop; a row for every piece of a document, its words from start
    to before stop, in the block that the schedule has at `time`. Rows in order of time (then of p, their place in the source) read the mix."""
    base = sized(docs)
    goal = materialize(targets(base, block), "mix-goal")
    return _pieces(placed(base, goal), goal, block).where("stop > start").select("time", "source", "block", "pass", "p", "doc_id", "link", "start", "stop")


def mix(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words that the mix takes, repeats counted) of every row of docs."""
    base = sized(docs)
    goal = materialize(targets(base, block), "mix-goal")
    rows = placed(base, goal)
    names = ["doc_id", "source", "size", "source_size", "target"]
    some = _pieces(rows.where("size > 0"), goal, block).groupBy("src", "p", *names).agg(F.sum(F.col("stop") - F.col("start")).alias("taken"))
    return some.select(*names, "taken").unionByName(rows.where("size = 0").select(*names, F.lit(0).cast("long").alias("taken")))


def resampled(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The documents as mixed: one for every pass that takes words of it, cut to these words in the last pass, in the schedule's
    order over the partitions and within them. Every source has the words of its target. n_chars, if there is one, follows the text.

    Texts are shuffled twice: to meet what is taken of them, and into that order."""
    i, t, row, one = fresh(docs, "doc", "link", "row", "one")
    base = sized(docs, row_hash(docs))
    goal = materialize(targets(base, block), "mix-goal")
    taken = _pieces(placed(base, goal).where("size > 0"), goal, block).where("stop > start")
    taken = taken.groupBy("src", "p", "pass", "doc_id", "link", "size").agg(F.min("time").alias("time"), F.sum(F.col("stop") - F.col("start")).alias("words"))
    nothing = F.lit(-(2**63))
    taken = materialize(taken.select(F.coalesce("doc_id", nothing).alias("i"), "link", "size", "time", "p", "words"), "mix-taken")
    texts = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias(row), F.coalesce(docs["doc_id"].cast("long"), nothing).alias(i), row_hash(docs).alias(t))
    texts = texts.dropDuplicates([i, t])
    found = texts.join(taken, (texts[i] == taken["i"]) & (texts[t] == taken["link"]))
    text = F.col(row)["text"].cast("string")
    short = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)), F.lit(1), F.col("words").cast("int")), "")
    found = found.withColumn(one, F.when(F.col("words") < F.col("size"), short).otherwise(text))
    found = found.repartitionByRange("time", "p").sortWithinPartitions("time", "p")
    own = {"text": F.col(one), "n_chars": F.char_length(one)}
    return found.select(*((own[c.lower()].cast(kind) if c.lower() in own else F.col(row)[c]).alias(c) for c, kind in docs.dtypes))

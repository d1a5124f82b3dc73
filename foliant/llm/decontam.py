"""Benchmark decontamination; DataFrame functions only.

1. Benchmark items become windows of WINDOW consecutive words (an item of fewer words is one window). Equal windows collapse;
   their hashes are the set that is broadcast. It is written first and measured: beyond ROWS windows or BYTES it is cut by hash
   into as many parts as that needs, and the documents are scanned once for each part, so what is broadcast stays bounded.
2. Documents are scanned where they lie: every word is hashed once, in Java's lower case, and every place looks up a hash of the
   word hashes that begin there. A word keeps its place under any lower-casing, so equal windows have equal hashes.
3. A hit is verified in the join itself, by its words under the rule of the operator (A-Z only). Scan, lookup and verification are
   one generated loop, in which a document's words are never copied; only hits leave it, summed by document before they are shuffled.
4. decontaminated() removes the words hit, or the documents that hold any.

Defined results: a null or empty text has no words and is never hit; a null item_id counts as the item ''; rows with equal
item_id are one item with the windows of all of them; rows are answered one by one, also with null or repeated doc_ids (hits
are kept by doc_id and a hash of the text, so equal rows share theirs); an empty benchmark hits nothing; an empty table gives an
empty result. Of documents doc_id and text are read, of the benchmark item_id and text; other columns cannot clash.
"""

from __future__ import annotations

from functools import reduce
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, fresh, materialize

WINDOW, ROWS, BYTES = 10, 1 << 18, 32 << 20
#: Words before A-Z are lowered, and what stands between them.
WORD, BETWEEN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN[:-1] + "+"), "")


def lowered(text: Column) -> Column:
    """A-Z in lower case; other letters stay."""
    return F.translate(text, ascii_uppercase, ascii_lowercase)


def window_hash(hashes: Column, at: Column | int, n: int) -> Column:
    """Hash of n word hashes from place `at`."""
    return F.xxhash64(*(F.get(hashes, (F.lit(at) if isinstance(at, int) else at) + k) for k in range(n)))


def word_hashes(found: Column) -> Column:
    return F.transform(found, lambda w: F.xxhash64(F.lower(w)))


def benchmark_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """item (the id as text), n (words), gram (the words, joined by spaces), gid (their digest), h (hash of the scan), bytes; a row per item and distinct window."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    w = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(lowered(text)).alias("w"))
    many = F.transform(F.sequence(F.lit(1), F.size("w") - window + 1), lambda i: F.slice("w", i, window))
    grams = F.when(F.size("w") >= window, many).when(F.size("w") > 0, F.array("w")).otherwise(F.array().cast("array<array<string>>"))
    rows = w.select("item", F.explode(grams).alias("g")).select("item", F.size("g").alias("n"), F.array_join("g", " ").alias("gram"), word_hashes(F.col("g")).alias("g"))
    h = reduce(lambda c, n: c.when(F.col("n") == n, window_hash(F.col("g"), 0, n)), range(2, window + 1), F.when(F.col("n") == 1, window_hash(F.col("g"), 0, 1)))
    rows = rows.select("item", "n", "gram", h.alias("h")).distinct()
    return rows.select("item", "n", "gram", F.md5("gram").alias("gid"), "h", (F.octet_length("gram") + 64).cast("long").alias("bytes"))


def scanned(docs: DataFrame, lengths: list[int]) -> DataFrame:
    """doc_id, key (hash of the text), w (its words), at, n, h: the hash of n words from place `at`, for every place and length."""
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), words(text).alias("w"))
    rows = rows.select("*", word_hashes(F.col("w")).alias("hw"))
    rows = rows.select("doc_id", "key", "w", "hw", F.posexplode_outer("hw").alias("at", "h0"))  # inner, it would have all words hashed twice, to filter empty arrays
    rows = rows.withColumn("n", F.lit(lengths[0]) if len(lengths) == 1 else F.explode(F.array(*map(F.lit, lengths))))
    h = reduce(lambda c, n: c.when(F.col("n") == n, window_hash(F.col("hw"), F.col("at"), n)), lengths[1:], F.when(F.col("n") == lengths[0], window_hash(F.col("hw"), F.col("at"), lengths[0])))
    return rows.where(F.col("at") + F.col("n") <= F.size("w")).select("doc_id", "key", "w", "at", "n", h.alias("h"))


def hits(docs: DataFrame, windows: DataFrame, rows: int = ROWS, size: int = BYTES) -> tuple[DataFrame, DataFrame]:
    """(spots, items): doc_id, key and spots (array of {at, n}: a window of n words begins at word `at`) or items (array of ids)."""
    lengths = sorted(x[0] for x in windows.select("n").distinct().collect())  # at most WINDOW lengths
    total = windows.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    parts = max(1, -(-total[0] // rows), -(-total[1] // size))
    spots, items = [], []
    for k in range(parts):
        pairs = windows.where(F.pmod("h", F.lit(parts)) == k)
        fits = (pairs.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]) <= 2 * size
        grams = pairs.dropDuplicates(["gid"]).select(F.col("h").alias("gram_h"), F.col("n").alias("gram_n"), "gram", "gid")
        grams = F.broadcast(grams) if fits else grams
        if lengths:
            found = scanned(docs, lengths)
            said = lowered(F.array_join(F.slice("w", F.col("at") + 1, F.col("n")), " "))
            same = (said >= F.col("gram")) & (said <= F.col("gram"))  # an equality would become a join key, built for every window
            found = found.join(grams, (F.col("h") == F.col("gram_h")) & (F.col("n") == F.col("gram_n")) & same)
            found = found.select("doc_id", "key", F.struct("at", "n").alias("spot"), "gid")
        else:
            found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).cast("long").alias("key"), F.struct(F.lit(0).alias("at"), F.lit(0).alias("n")).alias("spot"), F.lit("").alias("gid")).where("false")
        found = materialize(found.groupBy("doc_id", "key").agg(F.collect_set("spot").alias("spots"), F.collect_set("gid").alias("gids")), "decontam-hits")
        whose = pairs.select(F.col("gid").alias("of"), "item")
        each = found.select("doc_id", "key", F.explode("gids").alias("gid")).join(F.broadcast(whose) if fits else whose, F.col("gid") == F.col("of"))
        items.append(each.groupBy("doc_id", "key").agg(F.collect_set("item").alias("items")))
        spots.append(found.select("doc_id", "key", "spots"))
    if parts == 1:
        return spots[0], items[0]
    merged = lambda tables, c: reduce(DataFrame.union, tables).groupBy("doc_id", "key").agg(F.array_distinct(F.flatten(F.collect_list(c))).alias(c))
    return merged(spots, "spots"), merged(items, "items")


def covered(spots: Column) -> Column:
    """Struct of hit (number of words in any spot), end, gaps (array of {from, to} between the spots, but for the last) of spots."""
    start = F.struct(F.lit(0).alias("hit"), F.lit(0).alias("end"), F.array().cast("array<struct<from:int,to:int>>").alias("gaps"))

    def step(acc, s):
        stop = (s["at"] + s["n"]).cast("int")
        gap = F.array(F.struct(acc["end"].alias("from"), s["at"].cast("int").alias("to")))
        new = F.greatest(F.lit(0), stop - F.greatest(acc["end"], s["at"].cast("int")))
        return F.struct((acc["hit"] + new).alias("hit"), F.greatest(acc["end"], stop).alias("end"), F.when(s["at"] > acc["end"], F.concat(acc["gaps"], gap)).otherwise(acc["gaps"]).alias("gaps"))

    return F.aggregate(F.array_sort(F.coalesce(spots, F.array().cast("array<struct<at:int,n:int>>"))), start, step)


def contamination(docs: DataFrame, items: DataFrame, rows: int = ROWS, size: int = BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted ids, as text), contaminated of every row of docs."""
    windows = materialize(benchmark_windows(items), "decontam-windows")
    spots, whose = hits(docs, windows, rows, size)
    text = F.col("text").cast("string")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), F.size(words(text)).cast("long").alias("n_words"))
    base = _with(_with(base, spots, "spots"), whose, "items")
    hit = covered(F.col("spots"))["hit"].cast("long")
    return base.select("doc_id", "n_words", hit.alias("n_hit"), F.array_sort(F.coalesce("items", F.array().cast("array<string>"))).alias("items")).withColumn("contaminated", F.col("n_hit") > 0)


def _with(base: DataFrame, table: DataFrame, column: str) -> DataFrame:
    table = table.select(F.col("doc_id").alias("its_doc"), F.col("key").alias("its_key"), column)
    return base.join(table, F.col("doc_id").eqNullSafe(F.col("its_doc")) & (F.col("key") == F.col("its_key")), "left").drop("its_doc", "its_key")


def digests(found: DataFrame) -> DataFrame:
    """The columns of the op11 contract from contamination()."""
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def decontaminated(docs: DataFrame, items: DataFrame, whole: bool = False, rows: int = ROWS, size: int = BYTES) -> DataFrame:
    """docs without the documents that hold a window of an item (whole), or with the words of these windows, and what stands before each, taken out."""
    d, k, s, text = fresh(docs, "hit_doc", "hit_key", "hit_spots", "hit_text")
    windows = materialize(benchmark_windows(items), "decontam-windows")
    spots = hits(docs, windows, rows, size)[0].select(F.col("doc_id").alias(d), F.col("key").alias(k), F.col("spots").alias(s))
    discard(windows)
    same = docs["doc_id"].cast("long").eqNullSafe(spots[d]) & (F.xxhash64(docs["text"].cast("string")) == spots[k])
    if whole:
        return docs.join(spots, same, "left_anti")
    found = docs.join(spots, same, "left")
    whole_text = docs["text"].cast("string")
    pieces = F.regexp_extract_all(whole_text, F.lit(BETWEEN + WORD), F.lit(0))
    gaps = F.concat(covered(F.col(s))["gaps"], F.array(F.struct(covered(F.col(s))["end"].alias("from"), F.size(pieces).alias("to"))))
    kept = F.flatten(F.transform(gaps, lambda g: F.slice(pieces, g["from"] + 1, F.greatest(F.lit(0), g["to"] - g["from"]))))
    rest = F.regexp_extract(whole_text, BETWEEN + r"\z", 0)
    found = found.withColumn(text, F.when(F.col(s).isNull(), whole_text).otherwise(F.concat(F.array_join(kept, ""), rest)))
    own = {"text": F.col(text), "n_chars": F.char_length(text)}
    return found.select(*((own[c.lower()].cast(kind) if c.lower() in own else docs[f"`{c}`"]).alias(c) for c, kind in docs.dtypes))

"""Chat formatting with typed content parts; DataFrame functions only.

A message is (conv_id, turn, role, parts), a part (kind, text, uri, units). A visitor, one expression per kind, turns
every part into its place in the message: text as itself, escaped; an image, audio or document into a placeholder
<|kind_n|>, n counting the attachments of the message, with its reference and its expanded token count recorded. Messages
become <|im_start|>role, newline, content, <|im_end|>, newline.

Escaping is reversible: a backslash doubles and <| becomes <\\|, so no text can hold a control string; in roles a newline
becomes \\n as well. The loss mask holds the [from, to) code point ranges of assistant contents.

Defined results: a null text or role is empty; a null conv_id is a conversation of its own; messages are ordered by turn
(null first), equal turns by role and content, and repeated rows stay; a null or empty list of parts is an empty
content; unknown kinds are treated as documents; an empty table gives an empty result. The named columns alone are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Tokens that one unit of each kind expands to: an image tile, a second of audio, a document page.
UNITS = {"image": 256, "audio": 25, "document": 1024}
PART = "struct<kind:string,text:string,uri:string,units:int>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    lines = F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\n")
    return unescape(lines)


def visited(parts: Column) -> Column:
    """Struct of content (escaped text with placeholders), attachments (place, kind, uri, tokens) of a list of parts."""
    known = F.coalesce(parts, F.array().cast(f"array<{PART}>"))
    kind = lambda p: F.when(p["kind"].isin("text", *UNITS), p["kind"]).otherwise(F.when(p["kind"].isNull(), "text").otherwise("document"))
    others = F.filter(known, lambda p: kind(p) != "text")
    tokens = lambda p: F.coalesce(p["units"], F.lit(1)) * F.when(kind(p) == "image", UNITS["image"]).when(kind(p) == "audio", UNITS["audio"]).otherwise(UNITS["document"])
    attachments = F.transform(others, lambda p, i: F.struct((i + 1).alias("place"), kind(p).alias("kind"), p["uri"].alias("uri"), tokens(p).cast("int").alias("tokens")))
    place = lambda i: F.size(F.filter(F.slice(known, 1, i + 1), lambda q: kind(q) != "text"))
    shown = F.transform(known, lambda p, i: F.when(kind(p) == "text", escape(F.coalesce(p["text"], F.lit("")))).otherwise(F.concat(F.lit("<|"), kind(p), F.lit("_"), place(i).cast("string"), F.lit("|>"))))
    return F.struct(F.array_join(shown, "").alias("content"), attachments.alias("attachments"))


def text_part(text: Column) -> Column:
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("uri"), F.lit(None).cast("int").alias("units")))


def formatted(messages: DataFrame) -> DataFrame:
    """conv_id, formatted, loss (array of {from, to}), attachments, attachment_tokens of messages (conv_id, turn, role, parts)."""
    m = messages.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), visited(F.col("parts")).alias("v")).select("conv_id", "turn", "role", "v.content", "v.attachments")
    head = F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit("\n"))
    m = m.withColumn("head", head).withColumn("piece", F.concat("head", "content", F.lit(CLOSE + "\n")))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("content")]
    w = Window.partitionBy("conv_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    m = m.withColumn("start", F.coalesce(F.sum(F.length("piece").cast("long")).over(w), F.lit(0)) + F.length("head")).withColumn("n", F.count("*").over(w))
    span = F.when(F.col("role") == "assistant", F.struct(F.col("start").alias("from"), (F.col("start") + F.length("content")).alias("to")))
    rows = F.array_sort(F.collect_list(F.struct("n", "piece", span.alias("span"), "attachments")))
    c = m.groupBy("conv_id").agg(rows.alias("rows"))
    spans = F.filter(F.transform("rows", lambda r: r["span"]), lambda s: s.isNotNull())
    refs = F.flatten(F.transform("rows", lambda r: F.transform(r["attachments"], lambda a: F.struct(r["n"].alias("message"), a["place"].alias("place"), a["kind"].alias("kind"), a["uri"].alias("uri"), a["tokens"].alias("tokens")))))
    c = c.select("conv_id", F.array_join(F.transform("rows", lambda r: r["piece"]), "").alias("formatted"), spans.alias("loss"), refs.alias("attachments"))
    return c.withColumn("attachment_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda s, a: s + a["tokens"]))


def parsed(output: DataFrame) -> DataFrame:
    """conv_id, turns (array of {role, text}, unescaped), loss_text, formatted_chars, read back from formatted and loss."""
    pieces = F.filter(F.split("formatted", r"<\|im_start\|>"), lambda p: p != "")
    body = lambda p: F.substring_index(p, CLOSE + "\n", 1)
    role = lambda p: F.substring_index(body(p), "\n", 1)
    turn = lambda p: F.struct(unescape_role(role(p)).alias("role"), unescape(F.substr(body(p), F.length(role(p)) + 2)).alias("text"))
    masked = F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), (s["from"] + 1).cast("int"), (s["to"] - s["from"]).cast("int"))))
    return output.select("conv_id", F.transform(pieces, turn).alias("turns"), F.array_join(masked, "").alias("loss_text"), F.length("formatted").cast("long").alias("formatted_chars"))


def digests(read: DataFrame) -> DataFrame:
    """The columns of the op4 contract from parsed()."""
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars")

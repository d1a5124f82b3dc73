"""Refined regions, local frames, searched boxes and corrected texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import corrections, frames, refine, transfer
from .alignment_queries import KEYS, REGIONS, fields, kinds, regions, tokens
from .tabular_queries import table

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def pixels(r):
    k = F.col("id")
    return r.select("sheet", "id", *(F.round(F.col(c) * 1000).alias(c) for c in "xywh"), (k % 10 / 10.0).alias("confidence"), (k % 3 == 0).alias("ocr"), (k % 4 == 0).alias("contour"), (k % 7 / 7.0).alias("text_density"))


@query(REGIONS + """, p AS (SELECT sheet, id, round(x * 1000) AS x, round(y * 1000) AS y, round(w * 1000) AS w, round(h * 1000) AS h FROM r),
e AS (SELECT sheet, id, 'left' AS side, true AS across, x AS v FROM p UNION ALL SELECT sheet, id, 'right', true, x + w FROM p UNION ALL SELECT sheet, id, 'top', false, y FROM p UNION ALL SELECT sheet, id, 'bottom', false, y + h FROM p),
n AS (SELECT *, CASE WHEN v - lag(v) OVER (PARTITION BY sheet, across ORDER BY v) > 6 THEN 1 ELSE 0 END AS new_ FROM e),
c AS (SELECT *, sum(new_) OVER (PARTITION BY sheet, across ORDER BY v) AS run FROM n),
m AS (SELECT *, avg(v) OVER (PARTITION BY sheet, across, run) AS middle FROM c),
s AS (SELECT *, CASE WHEN abs(v - middle) <= 6 THEN round(middle, 2) ELSE v END AS snap FROM m),
g AS (SELECT sheet, id, max(snap) FILTER (WHERE side = 'left') AS x, max(snap) FILTER (WHERE side = 'right') AS x1, max(snap) FILTER (WHERE side = 'top') AS y, max(snap) FILTER (WHERE side = 'bottom') AS y1 FROM s GROUP BY ALL)
SELECT sheet, id, round(x, 2) AS x, round(y, 2) AS y, round(greatest(2, x1 - x), 2) AS w, round(greatest(2, y1 - y), 2) AS h FROM g""")
def snapped_boundaries(spark, sf_dir):
    return refine.snapped(pixels(regions(spark, sf_dir)), KEYS, 6.0).select("sheet", "id", *(F.round(c, 2).alias(c) for c in "xywh"))


@query()
def refined_regions(spark, sf_dir):
    """The regions of every sheet without overlaps, on common lines and of equal sizes where they repeat."""
    return refine.refined(pixels(regions(spark, sf_dir)), KEYS).select("sheet", "id", *(F.round(c, 4).alias(c) for c in "xywh"))


@query(REGIONS + """, s AS (SELECT sheet, id, x, y, w, h, CASE WHEN id % 3 = 0 THEN (id % 90) * 1.0::DOUBLE END AS block FROM r WHERE id % 5 = 1),
a AS (SELECT sheet, id - id % 5 + 1 AS id, id % 5 IN (2, 3) AS is_line, CASE WHEN id % 4 <> 0 THEN (id * 37 % 30 + 345) * 1.0::DOUBLE END AS angle FROM r WHERE id % 5 IN (0, 2, 3)),
m AS (SELECT sheet, id, is_line, (degrees(atan2(avg(sin(radians(angle % 360))), avg(cos(radians(angle % 360))))) + 360) % 360 AS mean FROM a WHERE angle IS NOT NULL GROUP BY ALL),
j AS (SELECT s.*, l.mean AS line, g.mean AS region FROM s LEFT JOIN m l ON l.sheet = s.sheet AND l.id = s.id AND l.is_line LEFT JOIN m g ON g.sheet = s.sheet AND g.id = s.id AND NOT g.is_line)
SELECT sheet, id, round(coalesce(line, block, region, 0), 6) AS angle, CASE WHEN line IS NOT NULL THEN 'text-line-orientation' WHEN block IS NOT NULL THEN 'containing-block-orientation' WHEN region IS NOT NULL THEN 'region-orientation' ELSE 'fallback-seed-axis' END AS source,
  round(cos(radians(coalesce(line, block, region, 0))), 6) + 0.0 AS px, round(sin(radians(coalesce(line, block, region, 0))), 6) + 0.0 AS py,
  round(least(greatest((line IS NOT NULL)::INT * 0.62::DOUBLE + (block IS NOT NULL)::INT * 0.2::DOUBLE + (region IS NOT NULL)::INT * 0.1::DOUBLE + 0.08::DOUBLE, 0.2), 0.98), 6) AS confidence FROM j""")
def local_frames(spark, sf_dir):
    """The dominant axis around every field; directions on both sides of zero keep their mean there."""
    r, k = regions(spark, sf_dir), F.col("id")
    seeds = r.where(k % 5 == 1).withColumn("block_angle", F.when(k % 3 == 0, (k % 90).cast("double")))
    angle = F.when(k % 4 != 0, (k * 37 % 30 + 345).cast("double"))
    near = r.select("sheet", (k - k % 5 + 1).alias("id"), (k % 5).alias("five"), angle.alias("angle"))
    found = frames.local_frames(seeds, near.where("five in (2, 3)"), near.where("five = 0"), KEYS)
    return found.select("sheet", "id", F.round("angle", 6).alias("angle"), "source", (F.round("px", 6) + 0.0).alias("px"), (F.round("py", 6) + 0.0).alias("py"), F.round("confidence", 6).alias("confidence"))


@query()
def searched_boxes(spark, sf_dir):
    """The best of up to 21 boxes for every field of every sheet, by what the part names of its first version say in it."""
    k = kinds(regions(spark, sf_dir))
    tried = frames.variants(fields(k), k, KEYS)
    said = tokens(spark, sf_dir).where("doc = 1")
    boxes = tried.withColumn("doc", F.lit(1).cast("long")).withColumn("field_id", F.struct("id", "n"))
    read = transfer.read(boxes, said, KEYS).withColumn("wanted", F.when(F.col("id") % 2 == 0, "red bolt").otherwise("small ring"))
    return frames.best_boxes(frames.scored_variants(read), KEYS)


def codes(spark, sf_dir):
    """Two letters and four digits of every event, some with glyphs read wrong."""
    e = F.col("event_id")
    code = F.concat(F.lit("KV-"), F.lpad((e * 7919 % 10000).cast("string"), 4, "0"))
    read = F.when(e % 5 == 0, F.translate(code, "01", "OI")).when(e % 11 == 0, F.translate(code, "V", "5")).otherwise(code)
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("account"), e.alias("seq"), F.when(e % 97 != 0, read).alias("text"), F.when(e % 13 == 0, "text").otherwise("any").alias("kind"))


@query()
def corrected_texts(spark, sf_dir):
    """Every event's code after four corrections, the last by what its account's codes were before."""
    return corrections.corrected(codes(spark, sf_dir), ["account"]).select("account", "seq", "typed", "layout", "violation", "final")

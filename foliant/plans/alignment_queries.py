"""Alignment of pages and transfer of fields: customers as regions of sheets, with three changed versions of every sheet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import alignment, learn, transfer
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


#: A sheet holds about 60 regions at any scale factor.
REGIONS = """WITH r AS (SELECT c_nationkey * 100000 + c_custkey // 1500 AS sheet, c_custkey AS id, (c_acctbal + 1000) / 11000 * 0.7::DOUBLE AS x, (c_custkey * 37 % 1000) / 1000.0::DOUBLE * 0.7::DOUBLE AS y,
  0.02::DOUBLE + (c_custkey % 7) / 20.0::DOUBLE AS w, 0.02::DOUBLE + (c_custkey % 5) / 20.0::DOUBLE AS h FROM customer),
b AS (SELECT sheet, id, y, x / 2 AS x1, x / 2 + 0.1::DOUBLE + (id % 10) / 12.0::DOUBLE AS x2, id % 8 = 0 AS separator FROM r WHERE id % 4 = 0),
v AS (SELECT v, 1 + 0.04::DOUBLE * v AS sx, 1 - 0.05::DOUBLE * v AS sy, 0.03::DOUBLE * v AS tx, 0.02::DOUBLE * v AS ty FROM range(1, 4) t(v)),
rv AS (SELECT sheet, v, id, x * sx + tx AS x, y * sy + ty AS y, CASE WHEN v = 3 AND sheet % 4 = 0 THEN w * 0.1::DOUBLE ELSE w * sx END AS w, h * sy AS h FROM r, v WHERE (id + v) % 5 <> 0),
bv AS (SELECT sheet, v, id, y * sy + ty AS y, x1 * sx + tx AS x1, CASE WHEN v = 3 AND sheet % 4 = 0 THEN x1 * sx + tx + 0.05::DOUBLE ELSE x2 * sx + tx END AS x2, separator FROM b, v WHERE (id + v) % 5 <> 0)
"""


def regions(spark, sf_dir) -> DataFrame:
    k = F.col("c_custkey")
    sheet = F.col("c_nationkey").cast("long") * 100000 + F.floor(k / 1500)
    return table(spark, sf_dir, "customer").select(sheet.alias("sheet"), k.alias("id"), ((F.col("c_acctbal") + 1000) / 11000 * 0.7).alias("x"), (k * 37 % 1000 / 1000.0 * 0.7).alias("y"), (0.02 + k % 7 / 20.0).alias("w"), (0.02 + k % 5 / 20.0).alias("h"))


def bands(r: DataFrame) -> DataFrame:
    k, x = F.col("id"), F.col("x")
    return r.where(k % 4 == 0).select("sheet", "id", "y", (x / 2).alias("x1"), (x / 2 + 0.1 + k % 10 / 12.0).alias("x2"), (k % 8 == 0).alias("separator"))


def versions(df: DataFrame) -> DataFrame:
    """df with version v and its change sx, sy, tx, ty; every fifth row is missing in each."""
    v = F.col("v")
    df = df.withColumn("v", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(3).cast("long")))).where((F.col("id") + v) % 5 != 0)
    return df.withColumns({"sx": 1 + 0.04 * v, "sy": 1 - 0.05 * v, "tx": 0.03 * v, "ty": 0.02 * v, "poor": (v == 3) & (F.col("sheet") % 4 == 0)})


def changed_regions(r: DataFrame) -> DataFrame:
    c = versions(r)
    return c.select("sheet", "v", "id", (F.col("x") * F.col("sx") + F.col("tx")).alias("x"), (F.col("y") * F.col("sy") + F.col("ty")).alias("y"), F.when(F.col("poor"), F.col("w") * 0.1).otherwise(F.col("w") * F.col("sx")).alias("w"), (F.col("h") * F.col("sy")).alias("h"))


def changed_bands(b: DataFrame) -> DataFrame:
    c = versions(b)
    x = lambda n: F.col(n) * F.col("sx") + F.col("tx")
    return c.select("sheet", "v", "id", (F.col("y") * F.col("sy") + F.col("ty")).alias("y"), x("x1").alias("x1"), F.when(F.col("poor"), x("x1") + 0.05).otherwise(x("x2")).alias("x2"), "separator")


def _q(a: str, q: str) -> str:
    """SQL of a linear quantile of a sorted list."""
    place = f"((len({a}) - 1) * ({q}))"
    return f"(({a})[floor({place})::INT + 1] * (1 - ({place} - floor({place}))) + ({a})[least(len({a}), floor({place})::INT + 2)] * ({place} - floor({place})))"


def _spread(a: str) -> str:
    return f"(CASE WHEN len({a}) < 2 THEN 0.0::DOUBLE ELSE greatest(1e-6, {_q(a, '0.9::DOUBLE')} - {_q(a, '0.1::DOUBLE')}) END)"


def _clamp(e: str, lo: float, hi: float) -> str:
    return f"least(greatest({e}, {lo}::DOUBLE), {hi}::DOUBLE)"


def _reference(r: str, b: str, keys: str, name: str) -> str:
    """SQL CTEs of a page reference."""
    return f"""
{name}_s0 AS (SELECT {keys}, x AS x0, y AS y0, x + w AS x1, y + h AS y1 FROM {r} WHERE w * h >= 0.01 UNION ALL SELECT {keys}, x1, y, x2, y FROM {b} WHERE x2 - x1 >= 0.25),
{name}_s1 AS (SELECT {keys}, {', '.join(_clamp(f'quantile_cont({c}, {q})', 0, 1) + ' AS ' + c for c, q in (('x0', 0.05), ('y0', 0.05), ('x1', 0.95), ('y1', 0.95)))} FROM {name}_s0 GROUP BY ALL),
{name}_s AS (SELECT {keys}, CASE WHEN x1 - x0 < 0.05 THEN greatest(0, x0 - 0.025) ELSE x0 END AS x0, CASE WHEN x1 - x0 < 0.05 THEN least(1, x1 + 0.025) ELSE x1 END AS x1, CASE WHEN y1 - y0 < 0.05 THEN greatest(0, y0 - 0.025) ELSE y0 END AS y0, CASE WHEN y1 - y0 < 0.05 THEN least(1, y1 + 0.025) ELSE y1 END AS y1 FROM {name}_s1),
{name}_t AS (SELECT {keys}, sum((x + w / 2) * greatest(1e-6, w * h)) / sum(greatest(1e-6, w * h)) AS cx, sum((y + h / 2) * greatest(1e-6, w * h)) / sum(greatest(1e-6, w * h)) AS cy, list(x + w / 2 ORDER BY x + w / 2) AS xs
  FROM (SELECT * FROM {r} QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY w * h DESC, id) <= 8) GROUP BY {keys}),
{name}_p AS (SELECT {keys}, list(y ORDER BY y) AS ys FROM (SELECT * FROM {b} WHERE separator QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY x2 - x1 DESC, y, id) <= 12) GROUP BY {keys}),
{name}_h AS (SELECT {keys}, list(y ORDER BY y) AS ys FROM (SELECT * FROM {b} QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY x2 - x1 DESC, y, id) <= 16) GROUP BY {keys}),
{name} AS (SELECT {keys}, x0, x1, y0, y1, coalesce(cx, 0.5) AS cx, coalesce(cy, 0.5) AS cy, coalesce(xs, []) AS xs, coalesce({name}_p.ys, {name}_h.ys, []) AS ys
  FROM (SELECT {keys} FROM {r} UNION SELECT {keys} FROM {b}) LEFT JOIN {name}_s USING ({keys}) LEFT JOIN {name}_t USING ({keys}) LEFT JOIN {name}_p USING ({keys}) LEFT JOIN {name}_h USING ({keys}))"""


def _graph(axis: str, c: str, a: str, cc: str, rc: str) -> str:
    """SQL of spreads, scale, pairs, then shift along an axis."""
    s = f"(CASE WHEN {_spread(c)} > 1e-6 AND {_spread(a)} > 1e-6 THEN {_clamp(f'{_spread(a)} / {_spread(c)}', 0.75, 1.35)} ELSE 1.0::DOUBLE END)"
    n = f"least(len({c}), len({a}), 12)"
    at = f"({_q(a, f'i / greatest(1, {n} - 1)')} - {s} * {_q(c, f'i / greatest(1, {n} - 1)')})"
    shifts = f"list_sort(list_concat([{_q(a, '0.5::DOUBLE')} - {s} * {_q(c, '0.5::DOUBLE')}], CASE WHEN {n} >= 2 THEN [{at} for i in range(0, {n})] ELSE [] END))"
    both = f"len({c}) > 0 AND len({a}) > 0"
    return f"CASE WHEN {both} THEN {s} ELSE 1.0 END AS s{axis}0, CASE WHEN {both} THEN {n} ELSE 0 END AS n{axis}, CASE WHEN {both} THEN {_spread(c)} + {_spread(a)} ELSE 0 END AS spread{axis}, CASE WHEN {both} THEN {shifts} END AS shifts{axis}, {cc} AS cc{axis}, {rc} AS rc{axis}"


LOCKS = REGIONS + ", " + _reference("r", "b", "sheet", "c") + ", " + _reference("rv", "bv", "sheet, v", "t") + f""",
g0 AS (SELECT t.sheet, t.v, {_graph('x', 'c.xs', 't.xs', 'c.cx', 't.cx')}, {_graph('y', 'c.ys', 't.ys', 'c.cy', 't.cy')},
  c.x0 AS cx0, c.x1 AS cx1, c.y0 AS cy0, c.y1 AS cy1, t.x0 AS rx0, t.x1 AS rx1, t.y0 AS ry0, t.y1 AS ry1 FROM t JOIN c USING (sheet)),
g1 AS (SELECT *, {_clamp('sx0', 0.75, 1.35)} AS gsx, {_clamp('sy0', 0.75, 1.35)} AS gsy,
  {_clamp(f"CASE WHEN shiftsx IS NULL THEN rcx - ccx ELSE {_q('shiftsx', '0.5::DOUBLE')} * 0.7 + (rcx - sx0 * ccx) * 0.3 END", -0.4, 0.4)} AS gtx,
  {_clamp(f"CASE WHEN shiftsy IS NULL THEN rcy - ccy ELSE {_q('shiftsy', '0.5::DOUBLE')} * 0.7 + (rcy - sy0 * ccy) * 0.3 END", -0.4, 0.4)} AS gty,
  (rx1 - rx0) / (cx1 - cx0) AS rawx, (ry1 - ry0) / (cy1 - cy0) AS rawy FROM g0),
g2 AS (SELECT *, {_clamp('rawx', 0.6, 1.6)} AS psx, {_clamp('rawy', 0.6, 1.6)} AS psy,
  {_clamp(f"{_clamp('least(12, nx + ny) / 10', 0, 1)} * 0.5 + {_clamp('(spreadx + spready) / 4 / 0.2', 0, 1)} * 0.25 + {_clamp('1 - sqrt((gsx * ccx + gtx - rcx) ** 2 + (gsy * ccy + gty - rcy) ** 2) / 0.2', 0, 1)} * 0.25", 0.05, 0.98)} AS gconf FROM g1),
g3 AS (SELECT *, {_clamp('rx0 - psx * cx0', -0.45, 0.45)} AS ptx, {_clamp('ry0 - psy * cy0', -0.45, 0.45)} AS pty FROM g2),
g4 AS (SELECT *, ({' + '.join(f'sqrt((psx * cx{i} + ptx - rx{i}) ** 2 + (psy * cy{j} + pty - ry{j}) ** 2)' for i, j in ('00', '10', '11', '01'))}) / 4 AS residual, {_clamp('1 - abs(rawx - psx) - abs(rawy - psy)', 0, 1)} AS plausible FROM g3),
g5 AS (SELECT *, {_clamp(f"{_clamp('1 - residual / 0.05', 0, 1)} * 0.5 + plausible * 0.3 + {_clamp('least((cx1 - cx0) * (cy1 - cy0), (rx1 - rx0) * (ry1 - ry0)) / 0.25', 0, 1)} * 0.2", 0.05, 0.98)} AS pconf,
  CASE WHEN rx0 IS NULL OR cx0 IS NULL THEN 1.0 ELSE {_clamp('1 - (abs(psx - gsx) + abs(psy - gsy) + abs(ptx - gtx) + abs(pty - gty)) / 0.8', 0, 1)} END AS agree FROM g4),
g6 AS (SELECT *, rx0 IS NOT NULL AND cx0 IS NOT NULL AND ((round(residual, 5) <= 0.035 AND round(plausible, 4) >= 0.8) OR pconf >= gconf) AS per FROM g5),
lock AS (SELECT sheet, v, CASE WHEN per THEN 'perimeter' ELSE 'region_graph' END AS source, CASE WHEN per THEN psx ELSE gsx END AS sx, CASE WHEN per THEN psy ELSE gsy END AS sy, CASE WHEN per THEN ptx ELSE gtx END AS tx, CASE WHEN per THEN pty ELSE gty END AS ty,
  agree AS agreement, {_clamp('CASE WHEN per THEN pconf ELSE gconf END * 0.7 + agree * 0.3', 0.05, 0.98)} AS confidence FROM g6)
"""


def locks(spark, sf_dir) -> DataFrame:
    r = regions(spark, sf_dir)
    config = alignment.page_reference(r, bands(r), ["sheet"])
    runtime = alignment.page_reference(changed_regions(r), changed_bands(bands(r)), ["sheet", "v"])
    return alignment.structural_lock(config, runtime, ["sheet"], ["v"])


@query(LOCKS + "SELECT sheet, v, source, round(sx, 6) AS sx, round(sy, 6) AS sy, round(tx, 6) AS tx, round(ty, 6) AS ty, round(agreement, 4) AS agreement, round(confidence, 4) AS confidence FROM lock")
def structural_locks(spark, sf_dir):
    """The lock of every sheet with each of its versions."""
    return locks(spark, sf_dir).select("sheet", "v", "source", *(F.round(c, 6).alias(c) for c in ("sx", "sy", "tx", "ty")), "agreement", "confidence")


@query(LOCKS + f""", e AS (SELECT l.sheet, l.v, r.id, {_clamp('sx * x + tx', 0, 1)} * 1000 AS x0, {_clamp('sx * (x + w) + tx', 0, 1)} * 1000 AS x1, {_clamp('sy * y + ty', 0, 1)} * 1400 AS y0, {_clamp('sy * (y + h) + ty', 0, 1)} * 1400 AS y1 FROM lock l JOIN r USING (sheet))
SELECT sheet, v, id, round(x0, 3) AS x, round(y0, 3) AS y, round(greatest(1, x1 - x0), 3) AS w, round(greatest(1, y1 - y0), 3) AS h FROM e""")
def projected_boxes(spark, sf_dir):
    """Every region of a sheet, projected into the pixels of each version."""
    p = alignment.projected(regions(spark, sf_dir), locks(spark, sf_dir), ["sheet"], F.lit(1000.0), F.lit(1400.0))
    return p.select("sheet", "v", "id", *(F.round(F.col("box")[c], 3).alias(c) for c in "xywh"))


# fields, anchors and pairs of a sheet, whose versions are the other documents of its batch

KEYS = ["sheet"]
FIELDS = REGIONS + """, k AS (SELECT *, 'k' || (id % 3) AS kind FROM r), f AS (SELECT * FROM k WHERE id % 5 = 1),
an AS (SELECT *, id AS region_id, 0.5::DOUBLE + (id % 50) / 100.0::DOUBLE AS confidence FROM k WHERE id % 3 = 0),
nb0 AS (SELECT f.sheet, f.id AS field_id, k.id AS region_id, k.kind, k.w * k.h AS area, k.w / k.h AS aspect, sqrt((f.x + f.w / 2 - k.x - k.w / 2) ** 2 + (f.y + f.h / 2 - k.y - k.h / 2) ** 2) AS away, (k.x + k.w / 2) - (f.x + f.w / 2) AS dx, (k.y + k.h / 2) - (f.y + f.h / 2) AS dy,
  greatest(0, least(f.x + f.w, k.x + k.w) - greatest(f.x, k.x)) * greatest(0, least(f.y + f.h, k.y + k.h) - greatest(f.y, k.y)) AS shared, f.w * f.h AS own,
  k.x <= f.x AND k.y <= f.y AND k.x + k.w >= f.x + f.w AND k.y + k.h >= f.y + f.h AS inside FROM f JOIN k USING (sheet)),
nb1 AS (SELECT *, shared / (own + area - shared) AS iou FROM nb0),
nb2 AS (SELECT *, greatest(least(greatest(1 - away / 0.5, 0), 1), CASE WHEN iou > 0 THEN 0.5 + iou * 0.5 ELSE 0 END) AS near FROM nb1),
nb AS (SELECT *, row_number() OVER (PARTITION BY sheet, field_id ORDER BY round(near, 4) DESC, region_id) AS rank, count(*) OVER (PARTITION BY sheet, field_id) AS n FROM nb2 WHERE near > 0.05),
rel0 AS (SELECT an.sheet, an.id, f.id AS field_id, an.confidence, nb.rank, nb.n, an.w * an.h AS area, sqrt((f.x + f.w / 2 - an.x - an.w / 2) ** 2 + (f.y + f.h / 2 - an.y - an.h / 2) ** 2) AS away,
  greatest(0, least(f.x + f.w, an.x + an.w) - greatest(f.x, an.x)) * greatest(0, least(f.y + f.h, an.y + an.h) - greatest(f.y, an.y)) AS shared, f.w * f.h AS own
  FROM an JOIN f USING (sheet) LEFT JOIN nb ON nb.sheet = an.sheet AND nb.field_id = f.id AND nb.region_id = an.region_id),
rel1 AS (SELECT *, (greatest(1 - away / 0.4, 0) * 0.3 + CASE WHEN shared > 0 THEN 0.3 + shared / (own + area - shared) * 0.7 ELSE 0 END * 0.2 + CASE WHEN rank IS NULL THEN 0 ELSE 0.4 + 0.4 * (1 - (rank - 1) / n::DOUBLE) END * 0.25 + confidence * 0.075)
  * CASE WHEN area > 0.15 THEN least(greatest(1 - (area - 0.15) / 0.35, 0.2), 1) ELSE 1 END AS local FROM rel0),
rel AS (SELECT sheet, id, round(max(local), 4) AS relevance, arg_min(field_id, (-local, field_id)) FILTER (WHERE away < 0.4 OR shared > 0 OR rank IS NOT NULL) AS field_id FROM rel1 GROUP BY sheet, id)
"""


def kinds(r: DataFrame) -> DataFrame:
    return r.withColumn("kind", F.concat(F.lit("k"), (F.col("id") % 3).cast("string")))


def fields(k: DataFrame) -> DataFrame:
    return k.where(F.col("id") % 5 == 1).select("sheet", "id", "x", "y", "w", "h")


def anchors(k: DataFrame) -> DataFrame:
    return k.where(F.col("id") % 3 == 0).select("sheet", "id", F.col("id").alias("region_id"), "x", "y", "w", "h", (0.5 + F.col("id") % 50 / 100.0).alias("confidence"))


@query(FIELDS + """SELECT sheet, field_id, string_agg(region_id, ',' ORDER BY round(atan2(dy, dx), 3), rank) FILTER (WHERE rank <= 8) AS circle, arg_min(region_id, (area, region_id)) FILTER (WHERE inside) AS container, sum(round(away, 4)) AS distances
FROM nb GROUP BY sheet, field_id""")
def field_fingerprints(spark, sf_dir):
    """The eight nearest regions of every field in order of their angle, and the smallest region around it."""
    k = kinds(regions(spark, sf_dir))
    near = transfer.neighbours(fields(k), k, KEYS)
    away = near.groupBy("sheet", "field_id").agg(F.sum("distance").alias("distances"))
    ids = F.array_join(F.transform("circle", lambda s: s["region_id"].cast("string")), ",")
    return transfer.fingerprints(near, KEYS).join(away, ["sheet", "field_id"]).select("sheet", "field_id", ids.alias("circle"), "container", "distances")


@query(FIELDS + "SELECT sheet, id, relevance, field_id FROM rel WHERE relevance >= 0.15")
def refined_anchors(spark, sf_dir):
    """Anchors that are relevant to a field."""
    k = kinds(regions(spark, sf_dir))
    scored = transfer.relevance(anchors(k), fields(k), transfer.neighbours(fields(k), k, KEYS), KEYS)
    return transfer.refined(scored).select("sheet", "id", "relevance", "field_id")


def other_regions(k: DataFrame) -> DataFrame:
    """The versions' regions, every 24th out of place."""
    c = changed_regions(k.drop("kind")).withColumn("x", F.col("x") + F.when(F.col("id") % 24 == 0, 0.15).otherwise(0.0))
    return c.select("sheet", F.col("v").alias("doc"), "id", "x", "y", "w", "h", F.concat(F.lit("k"), (F.col("id") % 3).cast("string")).alias("kind"), (F.col("id") % 3).alias("depth"), (F.col("id") % 5 / 4.0).alias("adjacency"))


def correspondences(k: DataFrame) -> DataFrame:
    c = versions(k)
    return c.select("sheet", F.col("v").alias("doc"), F.col("id").alias("region_id"), F.col("id").alias("target_id"), (0.5 + F.col("id") * F.col("v") % 50 / 100.0).alias("similarity"))


def pairs_of(k: DataFrame) -> DataFrame:
    chosen = transfer.refined(transfer.relevance(anchors(k), fields(k), transfer.neighbours(fields(k), k, KEYS), KEYS))
    return transfer.anchor_pairs(chosen, correspondences(k), other_regions(k), KEYS)


def _six(suffix: str, p: str) -> str:
    """SQL of the affine fit by Cramer's rule from the sums of CTE columns p_w, p_xx, ..."""
    det = lambda a, b, c: f"({a[0]} * ({b[1]} * {c[2]} - {b[2]} * {c[1]}) - {b[0]} * ({a[1]} * {c[2]} - {a[2]} * {c[1]}) + {c[0]} * ({a[1]} * {b[2]} - {a[2]} * {b[1]}))"
    s = lambda *n: [f"{p}_{k}" for k in n]
    x, y, one = s("xx", "xy", "x"), s("xy", "yy", "y"), s("x", "y", "w")
    out = []
    for t, names in (("u", ("a", "b", "tx")), ("v", ("c", "d", "ty"))):
        r = s(f"x{t}", f"y{t}", t)
        out += [f"{e} / {det(x, y, one)} AS {n}{suffix}" for n, e in zip(names, (det(r, y, one), det(x, r, one), det(x, y, r)))]
    return ", ".join(out + [f"{det(x, y, one)} AS det{suffix}"])


def _sums(p: str, w: str = "w") -> str:
    return ", ".join(f"sum({w} * {e}) AS {p}_{n}" for n, e in {"w": "1", "x": "x", "y": "y", "u": "u", "v": "v", "xx": "x * x", "xy": "x * y", "yy": "y * y", "xu": "x * u", "yu": "y * u", "xv": "x * v", "yv": "y * v"}.items())


PAIRS = FIELDS + """, pr AS (SELECT rel.sheet, rv.v AS doc, rel.id AS anchor_id, an.x + an.w / 2 AS x, an.y + an.h / 2 AS y, rv.x + CASE WHEN rv.id % 24 = 0 THEN 0.15 ELSE 0 END + rv.w / 2 AS u, rv.y + rv.h / 2 AS v,
  rel.relevance * (0.5 + (rel.id * rv.v % 50) / 100.0::DOUBLE) AS w FROM rel JOIN an USING (sheet, id) JOIN rv USING (sheet, id) WHERE relevance >= 0.15)
"""


@query(PAIRS + f""", gs AS (SELECT sheet, doc, {_sums('g')} FROM pr GROUP BY sheet, doc), g AS (SELECT sheet, doc, {_six('', 'g')} FROM gs),
l0 AS (SELECT f.sheet, doc, f.id AS field_id, pr.x, pr.y, u, v, exp(-(((f.x + f.w / 2 - pr.x) ** 2 + (f.y + f.h / 2 - pr.y) ** 2) / 0.04)) * pr.w AS w FROM f JOIN pr USING (sheet)),
l1 AS (SELECT *, {', '.join(f'sum({c} * w) OVER p / sum(w) OVER p AS m{c}' for c in 'xyuv')} FROM l0 WHERE w > 0.01 WINDOW p AS (PARTITION BY sheet, doc, field_id)),
l2 AS (SELECT sheet, doc, field_id, {_sums('l')}, count(*) AS n, sum(w * sqrt((x - mx) ** 2 + (y - my) ** 2)) AS src, sum(w * sqrt((u - mu) ** 2 + (v - mv) ** 2)) AS dst, {', '.join(f'any_value(m{c}) AS m{c}' for c in 'xyuv')} FROM l1 GROUP BY ALL),
l3 AS (SELECT *, {_six('_l', 'l')}, {_clamp('CASE WHEN src > 1e-8 THEN dst / src ELSE 1 END', 0.7, 1.5)} AS s FROM l2 WHERE n >= 2),
l AS (SELECT *, n >= 3 AND abs(det_l) >= 1e-12 AS ok, 0.7 * least(1, n / 5) AS part FROM l3)
SELECT f.sheet, g.doc, f.id AS field_id, {', '.join(f"round(CASE WHEN part IS NULL THEN g.{n} ELSE part * CASE WHEN ok THEN {n}_l ELSE {e} END + (1 - part) * g.{n} END, 4) + 0.0 AS {n}" for n, e in (('a', 's'), ('b', '0'), ('c', '0'), ('d', 's'), ('tx', 'mu - s * mx'), ('ty', 'mv - s * my')))}, coalesce(n, 0) AS local_pairs
FROM f JOIN g USING (sheet) LEFT JOIN l ON l.sheet = f.sheet AND l.doc = g.doc AND l.field_id = f.id""")
def local_transforms(spark, sf_dir):
    """All six coefficients around every field of every document; the fallback is the fit of all pairs."""
    k = kinds(regions(spark, sf_dir))
    pairs = pairs_of(k)
    used = pairs.groupBy("sheet", "doc").agg(F.collect_list("anchor_id").alias("used"))
    fits = learn.affine(pairs, ["sheet", "doc"]).join(used, ["sheet", "doc"])
    found = transfer.local_transforms(fields(k), pairs, fits, KEYS)
    return found.select("sheet", "doc", "field_id", *((F.round(c, 4) + 0.0).alias(c) for c in transfer.COEFFICIENTS), "local_pairs")


def tokens(spark, sf_dir) -> DataFrame:
    """Words of part names on the versions of every sheet, four to a part."""
    k = F.col("p_partkey")
    n = F.explode(F.sequence(F.lit(0), F.lit(3)))
    p = table(spark, sf_dir, "part").select(k.alias("k"), F.split("p_name", " ").alias("words"), n.alias("n"))
    sheet = (F.col("k") % 25).cast("long") * 100000 + F.floor(F.col("k") / 1500)
    at = (F.col("k") * 13 % 90) / 100.0
    return p.select(sheet.alias("sheet"), (F.col("k") % 3 + 1).cast("long").alias("doc"), (F.col("k") * 4 + F.col("n")).alias("id"), F.coalesce(F.get("words", F.col("n")), F.lit("-")).alias("text"), (at + F.col("n") * 0.03).alias("x"), (F.col("k") * 29 % 97 / 100.0).alias("y"), F.lit(0.025).alias("w"), F.lit(0.012).alias("h"), F.when(F.col("k") % 6 != 0, 0.9).alias("confidence"))


@query()
def extracted_fields(spark, sf_dir):
    """Every field of every sheet in each version: transferred box, confidence and what the part names there say."""
    k = kinds(regions(spark, sf_dir))
    docs = k.select("sheet").distinct().withColumn("doc", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(4).cast("long"))))  # nothing is known of the fourth
    return transfer.extracted(fields(k), docs, anchors(k), correspondences(k), other_regions(k), k, tokens(spark, sf_dir), KEYS)

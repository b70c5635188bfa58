"""Queries over rasters: ``part`` (40 wide) and ``orders`` (100 wide) as dense grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.grid import gridded
from tidemark.functions import scalars as S
from tidemark.operators import evidence as E
from tidemark.operators import focal, hydro, morphology
from tidemark.session import materialise, table

WIDTH = 40


def part_grid(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """x, y, v (the size, no data below 5), mask (size up to 18) and dem, and the number of rows. The height is a count."""
    part = table(spark, sf_dir, "part")
    height = part.count() // WIDTH
    size = F.col("p_size").cast("double")
    grid = gridded(part, "p_partkey", WIDTH, F.when(size >= 5, size).alias("v"), (F.col("p_size") <= 18).alias("mask"), (size + 60 * F.floor(F.col("p_partkey") / WIDTH)).alias("dem"), size.alias("size"))
    return grid.where(F.col("y") < height), height


def orders_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Optical bands before and after, height above the river and slope, made of two columns of ``orders``."""
    o = table(spark, sf_dir, "orders")
    k, t = F.col("o_orderkey"), F.col("o_totalprice")
    part = lambda a, b: (F.pmod(k * a + F.floor(t), F.lit(b)) / F.lit(float(b)))
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.when(k % 11 != 0, part(7, 97) - 0.3).alias("pre_ndvi"), F.when(k % 13 != 0, part(3, 89) - 0.4).alias("post_ndvi"),
        (part(5, 83) - 0.5).alias("pre_bsi"), (part(11, 79) - 0.5).alias("post_bsi"),
        (part(13, 73) * 0.3).alias("pre_bright"), (part(17, 71) * 0.3).alias("post_bright"),
        (part(19, 67) - 0.5).alias("pre_mndwi"), (part(23, 61) - 0.5).alias("post_mndwi"),
        F.when(k % 17 != 0, part(29, 59) * 100).alias("hand"), (part(31, 53) * 60).alias("slope"),
    )


def optical_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_bands(spark, sf_dir).select("id", *[c.alias(n) for n, c in E.optical_evidence().items()])


def terrain_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_bands(spark, sf_dir).select("id", *[c.alias(n) for n, c in E.terrain_gates().items()])


def classify_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and confidence of each pixel by rules alone, radar and model evidence from the key."""
    flags = orders_bands(spark, sf_dir).select("*", *[c.alias(n) for n, c in (E.optical_evidence() | E.terrain_gates()).items()])
    radar = E.outranked(F.col("id") % 5 == 0, F.col("seen"), F.col("optical_change"))
    flags = flags.withColumn("radar_change", radar).withColumn("model_water", F.coalesce((F.col("id") % 7) / 7.0, F.lit(0.0)) >= 0.5)
    water = (F.col("model_water") | F.col("optical_water")) & F.col("gate_water")
    changed = (F.col("optical_change") | F.col("radar_change")) & F.col("gate_debris") & ~water
    channel = (F.col("id") % 10 == 0) & E.yes(F.col("hand") <= 6) & ~water & ~changed
    cls = E.class_of(changed, water, channel)
    classed = flags.withColumn("cls", cls)
    conf = E.confidence(F.col("cls"), F.col("optical_change") | F.col("optical_water"), F.col("radar_change"), F.col("model_water"))
    return classed.withColumn("conf", F.round(conf, 6)).select("id", "cls", "conf", "optical_change", "optical_water", "radar_change", "model_water")


def evidence_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    areas = E.evidence_areas(classify_pixels(spark, sf_dir), ["optical_change", "optical_water", "radar_change", "model_water"], 100.0)
    return areas.select("evidence", F.round("km2", 6).alias("km2"))


def box_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid, h = part_grid(spark, sf_dir)
    return focal.box_mean(grid, WIDTH, h, "v").select("x", "y", F.round("mean", 6).alias("mean"))


def lee_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid, h = part_grid(spark, sf_dir)
    return focal.lee_filter(grid, WIDTH, h, "v", size=3).select("x", "y", F.round("filtered", 5).alias("filtered"))


def min_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid, _ = part_grid(spark, sf_dir)
    return focal.relative_elevation(grid, "dem", 7).select("x", "y", F.round("rel", 6).alias("rel"))


def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid, h = part_grid(spark, sf_dir)
    return focal.majority(grid, WIDTH, h, "mask").where("mask").select("x", "y")


def gradient_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid, _ = part_grid(spark, sf_dir)
    g = focal.gradient(grid, "dem", 10.0)
    return g.select("x", "y", *[F.round(c, 5).alias(n) for n, c in focal.slope_aspect().items()])


def bilinear_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid, h = part_grid(spark, sf_dir)
    return focal.bilinear(grid, "size", WIDTH, h, 1.5, 26, int(h / 1.5)).select("x", "y", F.round("size", 5).alias("size"))


def max_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid, _ = part_grid(spark, sf_dir)
    return focal.block_max(grid, "size", 2)


def dilate(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid, h = part_grid(spark, sf_dir)
    return morphology.dilate(grid.where("size <= 3").select("x", "y"), 3, WIDTH, h)


def distance_to_river(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid, h = part_grid(spark, sf_dir)
    return morphology.nearest_within(grid.where("size <= 2").select("x", "y"), 5, WIDTH, h).select("x", "y", F.round(F.sqrt("d2") * 10, 6).alias("metres"))


def channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid, h = part_grid(spark, sf_dir)
    pixels = grid.withColumn("hand", F.col("size") / 5)
    return morphology.channel(pixels.where("size >= 48").select("x", "y"), pixels, WIDTH, h, 30.0)


def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid, _ = part_grid(spark, sf_dir)
    return morphology.components(grid.where("mask").select("x", "y"))


def blob_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small components out, then small holes filled; components of 4 pixels stand for the 0.3 ha."""
    grid, h = part_grid(spark, sf_dir)
    kept = materialise(morphology.drop_small(grid.where("mask").select("x", "y"), 4), "blobs")
    return morphology.fill_small_holes(kept, grid, WIDTH, h, 4)


def corridor_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid, h = part_grid(spark, sf_dir)
    river = grid.where("x = 20").select("x", "y")
    mask = grid.where("mask").select("x", "y")
    return morphology.touching(mask, morphology.nearest_within(river, 2, WIDTH, h))


def terrain_pixels(grid: DataFrame) -> DataFrame:
    """A valley along x = 20: height above it grows with the distance and the size."""
    return grid.select("x", "y", (F.abs(F.col("x") - 20) * 1.0 + F.when(F.col("x") == 20, 0.0).otherwise(F.col("size") / 10)).alias("hand"), (F.col("size") / 1.4).alias("slope"), "size")


def reach_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid, h = part_grid(spark, sf_dir)
    pixels = terrain_pixels(grid)
    affected = pixels.where("size <= 12 and hand <= 8").select("x", "y")
    _, levels = morphology.reach_levels(affected, pixels, WIDTH, h, 50.0, least_pixels=5)
    return levels.select("reach", F.round("level", 6).alias("level"))


def terrain_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid, h = part_grid(spark, sf_dir)
    pixels = terrain_pixels(grid)
    affected = pixels.where("size <= 12 and hand <= 8").select("x", "y")
    return morphology.complete_with_terrain(affected, pixels, WIDTH, h, 50.0, least_pixels=5)


def flow(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    grid, _ = part_grid(spark, sf_dir)
    return grid, materialise(hydro.flow_direction(grid, "dem"), "flow")


def d8_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow(spark, sf_dir)[1]


def accumulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    acc = hydro.accumulation(flow(spark, sf_dir)[1])
    return acc.select((F.col("cell") % (1 << 32)).cast("int").alias("x"), F.floor(F.col("cell") / (1 << 32)).cast("int").alias("y"), "acc")


def hand(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid, directions = flow(spark, sf_dir)
    cell = F.col("y").cast("long") * (1 << 32) + F.col("x")
    heights = grid.select(cell.alias("cell"), "dem")
    high = hydro.height_above_drainage(directions, grid.where("y = 0").select(cell.alias("cell")), heights)
    return high.select((F.col("cell") % (1 << 32)).cast("int").alias("x"), F.floor(F.col("cell") / (1 << 32)).cast("int").alias("y"), "hand")


def terrain_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heights above the minor and the major streams, with mapped rivers burned in."""
    grid, _ = part_grid(spark, sf_dir)
    mapped = grid.select("x", "y", "dem", F.col("x").isin(8, 30).alias("minor"), (F.col("x") == 20).alias("major"))
    return hydro.terrain(mapped, 4, 30)


def d8_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid, directions = flow(spark, sf_dir)
    starts = grid.where("y = 4 and x % 8 = 3").select(F.col("x").alias("id"), (F.col("y").cast("long") * (1 << 32) + F.col("x")).alias("cell"))
    path = hydro.walk(directions, starts, 1000)
    return path.select("id", "step", (F.col("cell") % (1 << 32)).cast("int").alias("x"), F.floor(F.col("cell") / (1 << 32)).cast("int").alias("y"))


def depression_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pit of each 20-row window raised to its spill level."""
    grid, _ = part_grid(spark, sf_dir)
    filled = hydro.fill_depressions(grid.withColumn("basin", F.floor(F.col("y") / 20)), "size")
    return filled.select("x", "y", F.round("filled", 3).alias("filled"))


def softmax_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("z"))
    return v.select("vec_id", S.argmax("z").alias("cls"), F.round(F.get(S.softmax("z"), F.lit(0)), 6).alias("p0"))


def overlap_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tent-weighted mean of the predictions of overlapping tiles (16 wide, step 12) along the rows of the grid."""
    grid, _ = part_grid(spark, sf_dir)
    tiles = F.explode(F.array(F.lit(0), F.lit(12), F.lit(24)))
    over = grid.select("x", "y", "size", tiles.alias("t0")).where("x between t0 and t0 + 15")
    at = F.col("x") - F.col("t0")
    w = F.least(F.least(at + 1, 16 - at) / 2.0, F.lit(1.0))
    p = (F.col("size") + F.col("t0")) / 100
    blend = over.groupBy("x", "y").agg((F.sum(p * w) / F.greatest(F.sum(w), F.lit(1e-6))).alias("p"))
    return blend.select("x", "y", F.round("p", 6).alias("p"))


def colour_ramps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours of classes with their confidence, as an overlay has them."""
    c = classify_pixels(spark, sf_dir)
    x = F.greatest(F.least((F.col("conf") - 0.35) / 0.65, F.lit(1.0)), F.lit(0.0))
    on = F.col("cls") > 0
    ramp = lambda a, b: F.when(on, F.floor(a - b * x)).otherwise(0).cast("int")
    return c.select("id", ramp(250, 60).alias("r"), ramp(225, 175).alias("g"), ramp(120, 90).alias("b"), F.when(on, 210).otherwise(0).alias("a"))


QUERIES = {
    f.__name__: f
    for f in (
        optical_evidence, terrain_gates, classify_pixels, evidence_areas, box_mean, lee_filter, min_filter, majority_vote, gradient_slope, bilinear_resample,
        max_resample, dilate, distance_to_river, channel, connected_components, blob_clean, corridor_filter, reach_levels, terrain_completion, d8_flow,
        accumulation, hand, terrain_streams, d8_walk, depression_fill, softmax_argmax, overlap_blend, colour_ramps,
    )
}

_GRID = """WITH RECURSIVE g AS (SELECT CAST(p_partkey % 40 AS INTEGER) AS x, CAST(p_partkey // 40 AS INTEGER) AS y, CAST(p_size AS DOUBLE) AS size,
  CASE WHEN p_size >= 5 THEN CAST(p_size AS DOUBLE) END AS v, p_size <= 18 AS mask, CAST(p_size + 60 * (p_partkey // 40) AS DOUBLE) AS dem
  FROM part WHERE p_partkey // 40 < (SELECT count(*) // 40 FROM part)),
h AS (SELECT max(y) + 1 AS h FROM g),
o AS (SELECT dx, dy FROM range(-8, 9) a(dx), range(-8, 9) b(dy))"""
# Mirrored neighbours of each pixel in a 3 x 3 window.
_NEAR3 = _GRID + """,
n AS (SELECT g.x, g.y, greatest(0, least(39, g.x + dx)) AS nx, greatest(0, least(h.h - 1, g.y + dy)) AS ny FROM g, h, o WHERE abs(dx) <= 1 AND abs(dy) <= 1),
w AS (SELECT n.x, n.y, m.v, m.mask FROM n JOIN g m ON m.x = n.nx AND m.y = n.ny)"""
_BANDS = """WITH b AS (SELECT o_orderkey AS id,
  CASE WHEN o_orderkey % 11 <> 0 THEN ((o_orderkey * 7 + CAST(floor(o_totalprice) AS BIGINT)) % 97) / 97.0::DOUBLE - 0.3::DOUBLE END AS pre_ndvi,
  CASE WHEN o_orderkey % 13 <> 0 THEN ((o_orderkey * 3 + CAST(floor(o_totalprice) AS BIGINT)) % 89) / 89.0::DOUBLE - 0.4::DOUBLE END AS post_ndvi,
  ((o_orderkey * 5 + CAST(floor(o_totalprice) AS BIGINT)) % 83) / 83.0::DOUBLE - 0.5::DOUBLE AS pre_bsi, ((o_orderkey * 11 + CAST(floor(o_totalprice) AS BIGINT)) % 79) / 79.0::DOUBLE - 0.5::DOUBLE AS post_bsi,
  ((o_orderkey * 13 + CAST(floor(o_totalprice) AS BIGINT)) % 73) / 73.0::DOUBLE * 0.3::DOUBLE AS pre_bright, ((o_orderkey * 17 + CAST(floor(o_totalprice) AS BIGINT)) % 71) / 71.0::DOUBLE * 0.3::DOUBLE AS post_bright,
  ((o_orderkey * 19 + CAST(floor(o_totalprice) AS BIGINT)) % 67) / 67.0::DOUBLE - 0.5::DOUBLE AS pre_mndwi, ((o_orderkey * 23 + CAST(floor(o_totalprice) AS BIGINT)) % 61) / 61.0::DOUBLE - 0.5::DOUBLE AS post_mndwi,
  CASE WHEN o_orderkey % 17 <> 0 THEN ((o_orderkey * 29 + CAST(floor(o_totalprice) AS BIGINT)) % 59) / 59.0::DOUBLE * 100 END AS hand,
  ((o_orderkey * 31 + CAST(floor(o_totalprice) AS BIGINT)) % 53) / 53.0::DOUBLE * 60 AS slope FROM orders),
e AS (SELECT *, pre_ndvi IS NOT NULL AND post_ndvi IS NOT NULL AS seen, coalesce(post_ndvi - pre_ndvi, 0) AS dn, post_bsi - pre_bsi AS db, post_bright - pre_bright AS dr FROM b),
f AS (SELECT *, seen AND (dn <= -0.2::DOUBLE OR (dn <= -0.1::DOUBLE AND (db >= 0.05::DOUBLE OR dr >= 0.03::DOUBLE)))
    AND (coalesce(hand <= 10, false) OR (coalesce(post_ndvi <= 0.2::DOUBLE, false) AND post_bright >= 0.08::DOUBLE)) AS optical_change,
  seen AND post_mndwi > 0 AND pre_mndwi < 0 AS optical_water,
  coalesce(hand, 1e4) <= 80 AND (slope <= 35 OR (coalesce(hand, 1e4) <= 60 AND slope <= 60)) AS gate_debris,
  (coalesce(hand, 1e4) <= 30 OR (hand IS NULL AND slope <= 5)) AND slope <= 35 AS gate_water FROM e),
k AS (SELECT *, id % 5 = 0 AND NOT (seen AND NOT optical_change) AS radar_change, (id % 7) / 7.0::DOUBLE >= 0.5::DOUBLE AS model_water FROM f),
w AS (SELECT *, (model_water OR optical_water) AND gate_water AS water FROM k),
d AS (SELECT *, (optical_change OR radar_change) AND gate_debris AND NOT water AS changed FROM w),
c AS (SELECT *, CAST(CASE WHEN id % 10 = 0 AND coalesce(hand <= 6, false) AND NOT water AND NOT changed THEN 3 WHEN water THEN 1 WHEN changed THEN 2 ELSE 0 END AS INTEGER) AS cls FROM d),
r AS (SELECT *, CASE WHEN cls = 0 THEN 0.0::DOUBLE WHEN cls = 3 THEN 0.5::DOUBLE ELSE least(1.0::DOUBLE, 0.35::DOUBLE + 0.25::DOUBLE * (CAST(optical_change OR optical_water AS INTEGER) + CAST(radar_change AS INTEGER) + CAST(model_water AS INTEGER))) END AS conf FROM c)
"""
_FLOW = _GRID + """,
dirs AS (SELECT * FROM (VALUES (0, 64, 0, -1), (1, 128, 1, -1), (2, 1, 1, 0), (3, 2, 1, 1), (4, 4, 0, 1), (5, 8, -1, 1), (6, 16, -1, 0), (7, 32, -1, -1)) t(rk, code, dx, dy)),
drops AS (SELECT g.x, g.y, d.code, d.rk, g.x + d.dx AS nx, g.y + d.dy AS ny, (g.dem - m.dem) / sqrt(d.dx * d.dx + d.dy * d.dy) AS fall
  FROM g, dirs d, g m WHERE m.x = g.x + d.dx AND m.y = g.y + d.dy),
best AS (SELECT x, y, code, nx, ny FROM drops WHERE fall > 0 QUALIFY row_number() OVER (PARTITION BY x, y ORDER BY fall DESC, rk) = 1),
flow AS (SELECT g.x, g.y, coalesce(b.code, 0) AS code, coalesce(b.nx, g.x) AS nx, coalesce(b.ny, g.y) AS ny FROM g LEFT JOIN best b ON g.x = b.x AND g.y = b.y)"""
_LABELS = """,
{name}(x, y, lx, ly, label) USING KEY (x, y) AS (
  SELECT x, y, x, y, CAST(y AS BIGINT) * 4294967296 + x FROM {mask}
  UNION SELECT m.x, m.y, m.x, m.y, min(l.label) FROM {mask} m JOIN {name} l ON {near} JOIN recurring.{name} own ON own.x = m.x AND own.y = m.y
  WHERE l.label < own.label GROUP BY m.x, m.y)"""
_NEAR4, _NEAR8 = "abs(m.x - l.x) + abs(m.y - l.y) = 1", "abs(m.x - l.x) <= 1 AND abs(m.y - l.y) <= 1"


def _labels(name: str, mask: str, diagonal: bool = False) -> str:
    return _LABELS.format(name=name, mask=mask, near=_NEAR8 if diagonal else _NEAR4)


_VALLEY = _GRID + """,
t AS (SELECT x, y, abs(x - 20) * 1.0::DOUBLE + CASE WHEN x = 20 THEN 0.0::DOUBLE ELSE size / 10 END AS hand, size / 1.4::DOUBLE AS slope, size FROM g),
affected AS (SELECT x, y FROM t WHERE size <= 12 AND hand <= 8), river AS (SELECT x, y FROM t WHERE hand <= 1),
near AS (SELECT p.x, p.y, arg_min(r.y // 10 * 100000 + r.x // 10, ((p.x - r.x) ** 2 + (p.y - r.y) ** 2) * 1e8 + r.y * 1e4 + r.x) AS reach
  FROM t p, river r WHERE (p.x - r.x) ** 2 + (p.y - r.y) ** 2 <= 36 GROUP BY p.x, p.y),
levels AS (SELECT reach, least(quantile_cont(t.hand, 0.75), 40) AS level FROM near JOIN affected USING (x, y) JOIN t USING (x, y) GROUP BY reach HAVING count(*) >= 5)"""

SQL = {
    "optical_evidence": _BANDS + "SELECT id, seen, optical_change, optical_water FROM f",
    "terrain_gates": _BANDS + "SELECT id, gate_debris, gate_water FROM f",
    "classify_pixels": _BANDS + "SELECT id, cls, round(conf, 6) AS conf, optical_change, optical_water, radar_change, model_water FROM r",
    "evidence_areas": _BANDS
    + " UNION ALL ".join(f"SELECT '{n}' AS evidence, round(count(*) FILTER ({n} AND cls > 0) * 100.0 / 1e6, 6) AS km2 FROM r" for n in ("optical_change", "optical_water", "radar_change", "model_water")),
    "box_mean": _NEAR3 + " SELECT x, y, CASE WHEN count(v) >= 4.5 THEN round(sum(v) / count(v), 6) END AS mean FROM w GROUP BY x, y",
    "lee_filter": _NEAR3
    + """, s AS (SELECT x, y, sum(v) / count(v) AS m, greatest(sum(v * v) / count(v) - (sum(v) / count(v)) ** 2, 0) AS var FROM w GROUP BY x, y),
c AS (SELECT *, var / greatest(m * m, 1e-12) AS ci FROM s WHERE m IS NOT NULL)
SELECT c.x, c.y, round(m + greatest(0, least(1, (ci - 1 / 4.4::DOUBLE) / greatest(ci * (1 + 1 / 4.4::DOUBLE), 1e-12))) * (g.v - m), 5) AS filtered FROM c JOIN g ON g.x = c.x AND g.y = c.y WHERE g.v IS NOT NULL""",
    "min_filter": _GRID + " SELECT g.x, g.y, round(any_value(g.dem) - min(m.dem), 6) AS rel FROM g JOIN g m ON abs(m.x - g.x) <= 3 AND abs(m.y - g.y) <= 3 GROUP BY g.x, g.y",
    "majority_vote": _NEAR3 + " SELECT x, y FROM w GROUP BY x, y HAVING count(*) FILTER (mask) > 4.5",
    "gradient_slope": _GRID
    + """, d AS (SELECT x, y, (coalesce(lead(dem) OVER r, dem) - coalesce(lag(dem) OVER r, dem)) / CASE WHEN lag(dem) OVER r IS NOT NULL AND lead(dem) OVER r IS NOT NULL THEN 20.0::DOUBLE ELSE 10.0::DOUBLE END AS gx,
(coalesce(lead(dem) OVER c, dem) - coalesce(lag(dem) OVER c, dem)) / CASE WHEN lag(dem) OVER c IS NOT NULL AND lead(dem) OVER c IS NOT NULL THEN 20.0::DOUBLE ELSE 10.0::DOUBLE END AS gy
FROM g WINDOW r AS (PARTITION BY y ORDER BY x), c AS (PARTITION BY x ORDER BY y)), e AS (SELECT *, atan(sqrt(gx * gx + gy * gy)) AS s, atan2(-gx, gy) AS a FROM d)
SELECT x, y, round(degrees(s), 5) AS slope, round((degrees(a) + 360) % 360, 5) AS aspect,
round(greatest(0, least(1, cos(radians(45.0)) * cos(s) + sin(radians(45.0)) * sin(s) * cos(radians(135.0) - a))), 5) AS hillshade FROM e""",
    "bilinear_resample": _GRID
    + """, n AS (SELECT CAST(nx AS INTEGER) AS nx, CAST(ny AS INTEGER) AS ny FROM range(26) a(nx), range(10000) b(ny), h WHERE ny < CAST(floor(h.h / 1.5) AS INTEGER)),
w AS (SELECT nx, ny, g.size, greatest(0, 1 - abs((nx + 0.5::DOUBLE) * 1.5::DOUBLE - 0.5::DOUBLE - g.x)) * greatest(0, 1 - abs((ny + 0.5::DOUBLE) * 1.5::DOUBLE - 0.5::DOUBLE - g.y)) AS w
FROM n JOIN g ON g.x BETWEEN floor(nx * 1.5) - 1 AND floor(nx * 1.5) + 3 AND g.y BETWEEN floor(ny * 1.5) - 1 AND floor(ny * 1.5) + 3)
SELECT nx AS x, ny AS y, round(sum(size * w) / sum(w), 5) AS size FROM w WHERE w > 0 GROUP BY nx, ny""",
    "max_resample": _GRID + " SELECT x // 2 AS x, y // 2 AS y, max(size) AS size FROM g GROUP BY x // 2, y // 2",
    "dilate": _GRID + " SELECT DISTINCT m.x, m.y FROM g JOIN g m ON abs(m.x - g.x) + abs(m.y - g.y) <= 3 WHERE g.size <= 3",
    "distance_to_river": _GRID
    + " SELECT m.x, m.y, round(sqrt(min((m.x - g.x) ** 2 + (m.y - g.y) ** 2)) * 10, 6) AS metres FROM g JOIN g m ON (m.x - g.x) ** 2 + (m.y - g.y) ** 2 <= 25 WHERE g.size <= 2 GROUP BY m.x, m.y",
    "channel": _GRID + " SELECT DISTINCT m.x, m.y FROM g JOIN g m ON abs(m.x - g.x) + abs(m.y - g.y) <= 3 WHERE g.size >= 48 AND m.size / 5 <= 6 AND m.size < 48",
    "connected_components": _GRID + ", mask AS (SELECT x, y FROM g WHERE mask)" + _labels("lab", "mask") + " SELECT x, y, label FROM lab",
    "blob_clean": _GRID
    + ", mask AS (SELECT x, y FROM g WHERE mask)"
    + _labels("lab", "mask")
    + ", kept AS MATERIALIZED (SELECT x, y FROM lab QUALIFY count(*) OVER (PARTITION BY label) >= 4), ground AS MATERIALIZED (SELECT x, y FROM g ANTI JOIN kept USING (x, y))"
    + _labels("hol", "ground")
    + """ SELECT x, y FROM kept UNION ALL SELECT x, y FROM (SELECT x, y, count(*) OVER p AS n, bool_or(x = 0 OR y = 0 OR x = 39 OR y = (SELECT h - 1 FROM h)) OVER p AS open FROM hol WINDOW p AS (PARTITION BY label)) WHERE n < 4 AND NOT open""",
    "corridor_filter": _GRID
    + ", mask AS (SELECT x, y FROM g WHERE mask)"
    + _labels("lab", "mask")
    + " SELECT x, y FROM (SELECT x, y, bool_or(abs(x - 20) <= 2) OVER (PARTITION BY label) AS hit FROM lab) WHERE hit",
    "reach_levels": _VALLEY + " SELECT CAST(reach AS BIGINT) AS reach, round(level, 6) AS level FROM levels",
    "terrain_completion": _VALLEY
    + """, cand AS (SELECT t.x, t.y FROM t JOIN near USING (x, y) JOIN levels USING (reach) WHERE t.hand <= level AND slope <= 30 AND NOT (size <= 12 AND t.hand <= 8)),
pool AS MATERIALIZED (SELECT x, y FROM cand UNION SELECT x, y FROM affected UNION SELECT x, y FROM river)"""
    + _labels("lab", "pool", True)
    + " SELECT c.x, c.y FROM cand c JOIN lab l ON l.x = c.x AND l.y = c.y WHERE l.label IN (SELECT label FROM lab JOIN affected USING (x, y))",
    "d8_flow": _FLOW + " SELECT x, y, code, nx, ny FROM flow",
    "accumulation": _FLOW
    + """, up(x, y, ax, ay) AS (SELECT x, y, x, y FROM g UNION ALL SELECT f.nx, f.ny, u.ax, u.ay FROM up u JOIN flow f ON f.x = u.x AND f.y = u.y WHERE f.code <> 0)
SELECT x, y, count(*) AS acc FROM up GROUP BY x, y""",
    "hand": _FLOW
    + """, down(ax, ay, x, y) AS (SELECT x, y, x, y FROM g UNION ALL SELECT d.ax, d.ay, f.nx, f.ny FROM down d JOIN flow f ON f.x = d.x AND f.y = d.y WHERE f.code <> 0 AND d.y <> 0)
SELECT a.x, a.y, a.dem - z.dem AS hand FROM g a LEFT JOIN down d ON d.ax = a.x AND d.ay = a.y AND d.y = 0 LEFT JOIN g z ON z.x = d.x AND z.y = d.y""",
    "terrain_streams": _FLOW.replace(
        "CAST(p_size + 60 * (p_partkey // 40) AS DOUBLE) AS dem",
        "CAST(p_size + 60 * (p_partkey // 40) AS DOUBLE) AS raw, CAST(p_size + 60 * (p_partkey // 40) - CASE p_partkey % 40 WHEN 20 THEN 20 WHEN 8 THEN 10 WHEN 30 THEN 10 ELSE 0 END AS DOUBLE) AS dem",
    )
    + """, up(x, y, ax, ay) AS (SELECT x, y, x, y FROM g UNION ALL SELECT f.nx, f.ny, u.ax, u.ay FROM up u JOIN flow f ON f.x = u.x AND f.y = u.y WHERE f.code <> 0),
st AS MATERIALIZED (SELECT g.x, g.y, raw, acc, acc >= 4 OR g.x IN (8, 30) AS minor, acc >= 30 OR g.x = 20 AS major FROM g JOIN (SELECT x, y, count(*) AS acc FROM up GROUP BY x, y) USING (x, y)),
d1(ax, ay, x, y) AS (SELECT x, y, x, y FROM g UNION ALL SELECT d.ax, d.ay, f.nx, f.ny FROM d1 d JOIN st ON st.x = d.x AND st.y = d.y JOIN flow f ON f.x = d.x AND f.y = d.y WHERE f.code <> 0 AND NOT minor),
d2(ax, ay, x, y) AS (SELECT x, y, x, y FROM g UNION ALL SELECT d.ax, d.ay, f.nx, f.ny FROM d2 d JOIN st ON st.x = d.x AND st.y = d.y JOIN flow f ON f.x = d.x AND f.y = d.y WHERE f.code <> 0 AND NOT major)
SELECT st.x, st.y, st.acc, st.raw - a.low AS hand, st.raw - b.low AS hand_major FROM st LEFT JOIN (SELECT ax, ay, raw AS low FROM d1 JOIN st USING (x, y) WHERE minor) a ON a.ax = st.x AND a.ay = st.y
LEFT JOIN (SELECT ax, ay, raw AS low FROM d2 JOIN st USING (x, y) WHERE major) b ON b.ax = st.x AND b.ay = st.y""",
    "d8_walk": _FLOW
    + """, walk(id, step, x, y) AS (SELECT x, 0, x, y FROM g WHERE y = 4 AND x % 8 = 3 UNION ALL SELECT w.id, w.step + 1, f.nx, f.ny FROM walk w JOIN flow f ON f.x = w.x AND f.y = w.y WHERE f.code <> 0)
SELECT id, CAST(step AS BIGINT) AS step, x, y FROM walk""",
    "softmax_argmax": """WITH z AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS z FROM embeddings)
SELECT vec_id, CAST(list_position(z, list_max(z)) - 1 AS INTEGER) AS cls, round(exp(z[1] - list_max(z)) / list_sum(list_transform(z, lambda v: exp(v - list_max(z)))), 6) AS p0 FROM z""",
    "overlap_blend": _GRID
    + """, t AS (SELECT x, y, size, t0, least(least(x - t0 + 1, 16 - x + t0) / 2.0::DOUBLE, 1.0::DOUBLE) AS w FROM g, (VALUES (0), (12), (24)) v(t0) WHERE x BETWEEN t0 AND t0 + 15)
SELECT x, y, round(sum((size + t0) / 100 * w) / greatest(sum(w), 1e-6), 6) AS p FROM t GROUP BY x, y""",
    "colour_ramps": _BANDS
    + """, q AS (SELECT id, cls, greatest(0.0::DOUBLE, least(1.0::DOUBLE, (round(conf, 6) - 0.35::DOUBLE) / 0.65::DOUBLE)) AS x FROM r)
SELECT id, CAST(CASE WHEN cls > 0 THEN floor(250 - 60 * x) ELSE 0 END AS INTEGER) AS r, CAST(CASE WHEN cls > 0 THEN floor(225 - 175 * x) ELSE 0 END AS INTEGER) AS g,
CAST(CASE WHEN cls > 0 THEN floor(120 - 90 * x) ELSE 0 END AS INTEGER) AS b, CASE WHEN cls > 0 THEN 210 ELSE 0 END AS a FROM q""",
}

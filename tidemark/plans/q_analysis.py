"""Composite queries end to end on adapters of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.grid import GridSpec
from tidemark.plans import analysis, q_raster, q_vector
from tidemark.session import materialise, table


def grid_of(height: int) -> GridSpec:
    return GridSpec(0.0, height * 10.0, q_raster.WIDTH, height, 10.0)


def scene(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, GridSpec]:
    """A valley along x = 20 with optical, radar and model evidence made of ``part``."""
    part, height = q_raster.part_grid(spark, sf_dir)
    x, y, s = F.col("x"), F.col("y"), F.col("size")
    wet = F.abs(x - 20) + s / 12 <= 5
    pixels = part.select(
        "x", "y", (F.abs(x - 20) * 1.2 + F.when(x == 20, 0.0).otherwise(s / 25)).alias("hand"), (s / 2).alias("slope"),
        F.when(s < 45, F.lit(0.6)).alias("pre_ndvi"), F.when(s < 47, F.when(wet, 0.1).otherwise(0.55)).alias("post_ndvi"),
        F.lit(0.0).alias("pre_bsi"), (s / 400).alias("post_bsi"), F.lit(0.05).alias("pre_bright"), F.when(wet, 0.2).otherwise(0.05).alias("post_bright"),
        F.lit(-0.2).alias("pre_mndwi"), F.when(F.abs(x - 20) <= 2, 0.3).otherwise(-0.2).alias("post_mndwi"), F.when((y % 9 == 0) & (x > 30), 0.9).otherwise(s / 200).alias("prob"),
    )
    tracks = part.select(
        "x", "y", F.explode(F.array(F.lit(0), F.lit(1))).alias("track"), (s % 11 != 0).alias("good"), F.when(wet, -4.0).otherwise(0.5).alias("z_vv"), F.lit(0.2).alias("z_vh"),
        F.when(wet, -17.0).otherwise(-9.0).alias("post_vv"), F.when(wet, -24.0).otherwise(-15.0).alias("post_vh"), F.when(wet, -5.0).otherwise(0.0).alias("d_vv"), F.lit(0.0).alias("d_vh"),
    )
    return pixels, tracks, grid_of(height)


def detect_scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.detect(*scene(spark, sf_dir))


def features_on(spark: SparkSession, sf_dir: str, top: float) -> dict[str, DataFrame]:
    """Suppliers as buildings and health places, orders as roads and their first legs as bridges."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") * 37 % 380 + 0.3).alias("x0"), (top - 22.7 - F.col("s_suppkey") * 23 % int(top - 30)).alias("y0"))
    corner = lambda dx, dy: F.struct((F.col("x0") + dx).alias("x"), (F.col("y0") + dy).alias("y"))
    buildings = s.select("id", F.array(corner(0, 0), corner(12, 0), corner(12, 9), corner(0, 9), corner(0, 0)).alias("ring"), (F.col("x0") + 6).alias("cx"), (F.col("y0") + 4.5).alias("cy"))
    points = s.select("id", F.col("x0").alias("px"), F.col("y0").alias("py"))
    roads = q_vector.road_lines(spark, sf_dir).select("id", "part", F.transform("coords", lambda p: F.struct(p["x"].alias("x"), (p["y"] - 1000 + top).alias("y"))).alias("coords"))
    bridges = roads.select("id", F.slice("coords", 1, 2).alias("coords"))
    return {"buildings": buildings, "roads": roads, "bridges": bridges, "health": points}


def assess_scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of the damage assessment over a valley of water and spots of debris."""
    part, height = q_raster.part_grid(spark, sf_dir)
    classes = materialise(part.select("x", "y", F.when(F.abs(F.col("x") - 20) <= 3, 1).when(F.col("size") <= 4, 2).otherwise(0).alias("cls")), "classes")
    grid = grid_of(height)
    f = features_on(spark, sf_dir, grid.top)
    return analysis.assess(classes, grid, f["buildings"], f["roads"], f["bridges"], f["health"], f["health"])["stats"]


def whole_scene(spark: SparkSession, sf_dir: str) -> dict:
    """All that an analysis takes: the detector's scene with features on it, customers as settlements, hospitals and towns."""
    pixels, tracks, grid = scene(spark, sf_dir)
    f = features_on(spark, sf_dir, grid.top)
    k = F.col("id")
    roads = f["roads"].join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("name")), "id")
    roads = roads.select(
        "id", "part", "coords", F.when(k % 5 == 0, "path").when(k % 3 == 0, "primary").otherwise("track").alias("highway"), F.when(k % 11 == 0, "yes").alias("bridge"),
        F.when(k % 2 == 0, F.col("name")).alias("name"), F.when(k % 3 == 0, F.concat(F.lit("R"), (k % 7).cast("string"))).alias("ref"),
    )
    c = F.col("c_custkey")
    places = table(spark, sf_dir, "customer").select(c.alias("id"), F.col("c_name").alias("name"), (c * 131 % 390 * 1.0).alias("px"), (grid.top - c * 77 % int(grid.top)).alias("py"))
    s = table(spark, sf_dir, "supplier").where("s_nationkey % 5 = 2")
    at = f["health"].withColumnRenamed("id", "tid")
    targets = s.select(F.when(F.col("s_suppkey") % 2 == 0, "town").otherwise("hospital").alias("target"), F.col("s_suppkey").alias("tid")).join(at, "tid")
    return {"pixels": pixels, "tracks": tracks, "grid": grid, **f, "roads": roads, "places": places, "targets": targets}


def analysis_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The figures of a whole analysis, end to end."""
    return analysis.analyse(**whole_scene(spark, sf_dir))["stats"]


def access_scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settlements' access over a lattice of roads, some of them cut."""
    k = F.col("p_partkey")
    part = table(spark, sf_dir, "part")
    x, y = (k % 20) * 100.0, F.floor(k / 20) * 100.0
    at = lambda dx, dy: F.struct((x + dx).alias("x"), (y + dy).cast("double").alias("y"))
    ways = F.explode(F.array(F.struct(F.lit(0).alias("w"), F.array(at(0, 0), at(100, 0)).alias("coords")), F.struct(F.lit(1).alias("w"), F.array(at(0, 0), at(0, 100)).alias("coords"))))
    roads = part.select(k.alias("k"), "p_size", ways.alias("w")).select((F.col("k") * 2 + F.col("w.w")).alias("road"), "p_size", F.col("w.coords").alias("coords"))
    highway = F.when(F.col("road") % 17 == 0, "path").when(F.col("road") % 3 == 0, "primary").otherwise("track")
    roads = roads.select("road", F.col("road").alias("osm_id"), highway.alias("highway"), F.when(F.col("road") % 19 == 0, "yes").alias("bridge"), F.lit(None).cast("string").alias("name"), "coords", "p_size")
    status = roads.select("osm_id", F.when(F.col("p_size") <= 20, "cut").when(F.col("p_size") <= 26, "near").otherwise("outside").alias("status"))
    risky = roads.where("bridge is not null").select("osm_id", F.lit("at risk").alias("status"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sid"), (F.col("c_custkey") * 131 % 2400 * 1.0).alias("px"), (F.col("c_custkey") * 77 % 1200 * 1.0).alias("py"))
    targets = c.where("sid in (3, 50, 90)").select(F.when(F.col("sid") == 50, "town").otherwise("hospital").alias("target"), F.col("sid").alias("tid"), "px", "py")
    return analysis.access(roads.drop("p_size"), status, risky, targets, c)["settlements"]


def flow_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places along the path of water from a pixel near the grid's lower end."""
    part, height = q_raster.part_grid(spark, sf_dir)
    grid = GridSpec(0.0, height * 90.0, q_raster.WIDTH, height, 90.0)
    places = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pid"), F.col("c_name").alias("name"), (F.col("c_custkey") * 131 % 3600 * 1.0).alias("px"), (F.col("c_custkey") * 977 % int(height * 90) * 1.0).alias("py"))
    return analysis.trace(part.select("x", "y", "dem"), (11, height - 2), places, grid)["settlements"]


def feature_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model's channels, and the rule on them."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(*[F.avg(c).alias(c) for c in ("l_tax", "l_discount", "l_quantity")], F.avg("l_extendedprice").alias("price"))
    made = analysis.feature_stack(F.col("l_tax"), F.col("l_discount") / 40, F.col("l_quantity") / 50, F.col("l_discount"), F.col("l_quantity") * 0.37171, F.col("price") / 500)
    channels = li.select("l_partkey", *[c.alias(n) for n, c in made.items()])
    return channels.select("l_partkey", *[F.round(n, 5).alias(n) for n in made], analysis.rule_flood().alias("rule"))


QUERIES = {f.__name__: f for f in (detect_scene, assess_scene, access_scene, flow_path, analysis_run, feature_stack)}

SQL = {
    "feature_stack": """WITH a AS (SELECT l_partkey, avg(l_tax) AS a, avg(l_discount) / 40 AS b, avg(l_quantity) / 50 AS c, avg(l_discount) AS d, avg(l_quantity) * 0.37171::DOUBLE AS s, avg(l_extendedprice) / 500 AS r FROM lineitem GROUP BY l_partkey),
k AS (SELECT l_partkey, 10 * log10(greatest(a, 1e-5)) AS pv, 10 * log10(greatest(b, 1e-5)) AS ph, 10 * log10(greatest(c, 1e-5)) AS qv, 10 * log10(greatest(d, 1e-5)) AS qh, s, r FROM a)
SELECT l_partkey, round((pv + 15) / 6, 5) AS post_vv, round((ph + 22) / 6, 5) AS post_vh, round((qv + 15) / 6, 5) AS pre_vv, round((qh + 22) / 6, 5) AS pre_vh, round((pv - qv) / 3, 5) AS d_vv, round((ph - qh) / 3, 5) AS d_vh,
round(s / 20, 5) AS slope, round(greatest(0, least(4, r / 40)), 5) AS rel, CASE WHEN pv <= -15 AND ph <= -22 AND (pv - qv <= -3 OR ph - qh <= -3) THEN 2 ELSE 0 END AS rule FROM k""",
}

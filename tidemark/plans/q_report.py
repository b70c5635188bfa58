"""Queries of reports, scoring and services: small rules over the results of others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import metrics, zonal
from tidemark.plans import q_metrics, q_vector
from tidemark.session import table

SOURCES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
#: Grades that count as damaged and as damaged at all, and how far a graded point may lie from a building.
DAMAGED, ANY_GRADE, NEAR_M = ("Destroyed", "Damaged"), ("Destroyed", "Damaged", "Possibly damaged"), 15.0


def affected_buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buildings that aren't outside."""
    return q_vector.building_status(spark, sf_dir).where(F.col("status") != zonal.OUTSIDE)


def visitor_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of every visitor, by what the headers say; those of no visitor count as NULL's."""
    k = F.col("event_id")
    e = table(spark, sf_dir, "events").select(
        F.when(k % 3 == 0, "secret").when(k % 3 == 1, "guess").alias("token"), F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("client"), (k % 7).cast("string"))).alias("client"),
        F.when(k % 4 == 0, "").when(k % 4 == 1, F.concat(F.lit("edge"), (k % 9).cast("string"))).alias("edge"),
    )
    return e.groupBy(S.visitor(F.col("token"), "secret", F.col("client"), F.col("edge")).alias("visitor")).agg(F.count("*").alias("n"))


def ranked_settlements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's first twenty: by status, then minutes; 0 is a number here and only NULL is last."""
    k = F.col("c_custkey")
    minutes = F.when(k % 11 != 0, (k * 7 % 120).cast("double"))
    place = F.array_position(F.array(F.lit("cut_off"), F.lit("possibly_cut_off"), F.lit("long_detour")), F.col("status"))
    rows = q_vector.access_status(spark, sf_dir).select("c_custkey", "status", minutes.alias("minutes"), place.alias("rank")).where("rank > 0")
    return rows.orderBy("rank", F.coalesce("minutes", F.lit(999.0)), "c_custkey").limit(20).select("c_custkey", "status", "minutes")


def best_covered_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The track of which most is there, for the overlay; of equal ones the first."""
    obs = table(spark, sf_dir, "events").select((F.col("user_id") % 3).cast("int").alias("track"), (F.col("event_type") != "error").cast("int").alias("there"))
    cover = obs.groupBy("track").agg(F.avg("there").alias("cover"))
    return cover.agg(F.max(F.struct("cover", (-F.col("track")).alias("minus"), "track")).alias("b")).select("b.track", F.round("b.cover", 6).alias("cover"))


def preset_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Presets that have a saved run: their own, or else the practice run."""
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("id"), F.col("n_nationkey").alias("k"))
    runs = n.where("k % 2 = 0").select(F.col("id").alias("run")).union(n.where("k % 3 = 0").select(F.concat(F.lit("practice-"), "id")))
    wanted = n.select("id", F.posexplode(F.array(F.col("id"), F.concat(F.lit("practice-"), "id"))).alias("place", "run"))
    return wanted.join(runs, "run").groupBy("id").agg(F.min_by("run", "place").alias("run"))


def mean_over_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean F1 over the cases, and their number."""
    return q_metrics.binary_scores(spark, sf_dir).agg(F.round(F.avg("f1"), 5).alias("mean_f1"), F.count("*").alias("cases"))


def auc_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features by how far their area under the curve is from one half; place 1 tells most."""
    df = q_metrics.judged(spark, sf_dir).withColumn("odd", F.col("doc_id") % 17)
    names = ("n_chars", "doc_id", "odd")
    parts = [metrics.roc_auc(df, name, F.col("quality") == 1).select(F.lit(name).alias("feature"), F.round("auc", 6).alias("auc")) for name in names]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.union(part)
    # As many rows as features.
    order = Window.orderBy(F.desc(F.abs(F.coalesce("auc", F.lit(0.5)) - 0.5)), "feature")
    return rows.select("feature", "auc", F.row_number().over(order).alias("place"))


def preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PASS or FAIL of every source: it can be read and has rows."""
    out = None
    for name in SOURCES:
        row = table(spark, sf_dir, name).limit(1).agg(F.count("*").alias("n")).select(F.lit(name).alias("source"), F.when(F.col("n") > 0, "PASS").otherwise("FAIL").alias("verdict"))
        out = row if out is None else out.union(row)
    return out


def graded_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as graded points near the buildings."""
    k = F.col("c_custkey")
    grade = F.get(F.array(*[F.lit(g) for g in ("Destroyed", "Damaged", "Possibly damaged", "No visible damage")]), (k % 4).cast("int"))
    return table(spark, sf_dir, "customer").select(k.alias("gid"), grade.alias("grade"), (k * 29 % 400 + 0.25).alias("px"), (999.75 - k * 31 % 220).alias("py"))


def building_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of the damaged points by flagged buildings or the affected area, and precision of the hit buildings against graded points."""
    points = graded_points(spark, sf_dir)
    z = q_vector.building_zones(spark, sf_dir).select("id", ((F.col("x0") + F.col("x1")) / 2).alias("px"), ((F.col("y0") + F.col("y1")) / 2).alias("py"))
    ours = z.join(q_vector.building_status(spark, sf_dir), "id")
    flagged = ours.where(F.col("status") != zonal.OUTSIDE).select(F.col("id").alias("tid"), "px", "py")
    damaged = points.where(F.col("grade").isin(*DAMAGED)).select(F.col("gid").alias("qid"), "px", "py")
    found = zonal.nearest_point(damaged, flagged, NEAR_M).select("qid", F.lit(True).alias("near"))
    seen = zonal.sample(damaged, q_vector.affected(spark, sf_dir), q_vector.GRID, "px", "py", "inside").join(found, "qid", "left")
    recall = seen.agg(F.count("*").alias("damaged"), F.count_if(F.coalesce("near", F.lit(False)) | F.col("inside")).alias("recalled"))
    hit = ours.where(F.col("status") == zonal.HIT).select(F.col("id").alias("qid"), "px", "py")
    graded = points.where(F.col("grade").isin(*ANY_GRADE)).select(F.col("gid").alias("tid"), "px", "py")
    right = hit.join(zonal.nearest_point(hit, graded, NEAR_M).select("qid", F.lit(True).alias("near")), "qid", "left")
    precision = right.agg(F.count("*").alias("hit"), F.count("near").alias("confirmed"))
    return recall.crossJoin(precision)  # one row each


def line_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that level and upright lines touch, of every other nation's suppliers only."""
    k = F.col("s_suppkey")
    x, y = (k * 37 % 380 + 0.3), (994.6 - k * 23 % 900)
    far = F.when(k % 2 == 0, F.struct((x + k % 60).alias("x"), y.alias("y"))).otherwise(F.struct(x.alias("x"), (y - k % 45).alias("y")))
    lines = table(spark, sf_dir, "supplier").select(k.alias("id"), "s_nationkey", F.array(F.struct(x.alias("x"), y.alias("y")), far).alias("coords"))
    cells = zonal.line_pixels(lines, q_vector.GRID, F.col("s_nationkey") % 2 == 0)
    return cells.groupBy("x", "y").agg(F.count("*").alias("n"), F.min("id").alias("first"))


QUERIES = {
    f.__name__: f
    for f in (affected_buildings, visitor_identity, ranked_settlements, best_covered_track, preset_runs, mean_over_cases, auc_order, preflight, building_scores, line_raster)
}

_AUC = """SELECT '{f}' AS feature, round((sum(r) FILTER (quality = 1) - count(*) FILTER (quality = 1) * (count(*) FILTER (quality = 1) + 1) / 2) / (count(*) FILTER (quality = 1) * count(*) FILTER (quality <> 1)), 6) AS auc
FROM (SELECT quality, rank() OVER (ORDER BY {v}) + (count(*) OVER (PARTITION BY {v}) - 1) / 2.0::DOUBLE AS r FROM j)"""
SQL = {
    "affected_buildings": f"SELECT * FROM ({q_vector.SQL['building_status']}) WHERE status <> 'outside'",
    "visitor_identity": """WITH e AS (SELECT CASE event_id % 3 WHEN 0 THEN 'secret' WHEN 1 THEN 'guess' END AS token, CASE WHEN event_id % 5 = 0 THEN '' ELSE 'client' || (event_id % 7) END AS client,
CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'edge' || (event_id % 9) END AS edge FROM events)
SELECT CASE WHEN token = 'secret' AND client <> '' THEN client WHEN edge <> '' THEN edge END AS visitor, count(*) AS n FROM e GROUP BY 1""",
    "ranked_settlements": f"""SELECT c_custkey, status, CASE WHEN c_custkey % 11 <> 0 THEN CAST(c_custkey * 7 % 120 AS DOUBLE) END AS minutes FROM ({q_vector.SQL['access_status']})
WHERE status IN ('cut_off', 'possibly_cut_off', 'long_detour') ORDER BY CASE status WHEN 'cut_off' THEN 0 WHEN 'possibly_cut_off' THEN 1 ELSE 2 END, coalesce(minutes, 999), c_custkey LIMIT 20""",
    "best_covered_track": """SELECT CAST(user_id % 3 AS INTEGER) AS track, round(count(*) FILTER (event_type <> 'error') / count(*), 6) AS cover FROM events GROUP BY 1
ORDER BY count(*) FILTER (event_type <> 'error') / count(*) DESC, track LIMIT 1""",
    "preset_runs": """WITH r AS (SELECT n_name AS run FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT 'practice-' || n_name FROM nation WHERE n_nationkey % 3 = 0)
SELECT n_name AS id, CASE WHEN n_name IN (SELECT run FROM r) THEN n_name ELSE 'practice-' || n_name END AS run FROM nation WHERE n_name IN (SELECT run FROM r) OR 'practice-' || n_name IN (SELECT run FROM r)""",
    "mean_over_cases": f"SELECT round(avg(f1), 5) AS mean_f1, count(*) AS cases FROM ({q_metrics.SQL['binary_scores']})",
    "auc_order": q_metrics._JUDGED
    + f", a AS ({_AUC.format(f='n_chars', v='n_chars')} UNION ALL {_AUC.format(f='doc_id', v='doc_id')} UNION ALL {_AUC.format(f='odd', v='doc_id % 17')})"
    + " SELECT feature, auc, CAST(row_number() OVER (ORDER BY abs(coalesce(auc, 0.5) - 0.5) DESC, feature) AS INTEGER) AS place FROM a",
    "preflight": " UNION ALL ".join(f"SELECT '{name}' AS source, CASE WHEN EXISTS (SELECT 1 FROM {name}) THEN 'PASS' ELSE 'FAIL' END AS verdict" for name in SOURCES),
    "building_scores": f"""WITH s AS ({q_vector.SQL['building_status']}), o AS (SELECT id, status, s_suppkey * 37 % 380 + 12.5::DOUBLE AS x, 1000 - s_suppkey * 23 % 200 - 22.5::DOUBLE AS y FROM s JOIN supplier ON s_suppkey = id),
p AS (SELECT c_custkey AS gid, c_custkey % 4 AS g, c_custkey * 29 % 400 + 0.25::DOUBLE AS x, 999.75::DOUBLE - c_custkey * 31 % 220 AS y FROM customer),
a AS (SELECT p_partkey % 40 AS x, p_partkey // 40 AS y FROM part WHERE p_size <= 18),
d AS (SELECT gid, EXISTS (SELECT 1 FROM o WHERE status <> 'outside' AND (o.x - p.x) ** 2 + (o.y - p.y) ** 2 <= 225) OR EXISTS (SELECT 1 FROM a WHERE a.x = CAST(trunc(p.x / 10) AS INTEGER) AND a.y = CAST(trunc((1000 - p.y) / 10) AS INTEGER)) AS ok FROM p WHERE g < 2),
h AS (SELECT id, EXISTS (SELECT 1 FROM p WHERE g < 3 AND (o.x - p.x) ** 2 + (o.y - p.y) ** 2 <= 225) AS ok FROM o WHERE status = 'hit')
SELECT (SELECT count(*) FROM d) AS damaged, (SELECT count(*) FROM d WHERE ok) AS recalled, (SELECT count(*) FROM h) AS hit, (SELECT count(*) FROM h WHERE ok) AS confirmed""",
    "line_raster": """WITH l AS (SELECT s_suppkey AS id, s_suppkey * 37 % 380 + 0.3::DOUBLE AS x, 994.6::DOUBLE - s_suppkey * 23 % 900 AS y, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey % 60 ELSE 0 END AS dx, CASE WHEN s_suppkey % 2 = 1 THEN s_suppkey % 45 ELSE 0 END AS dy
FROM supplier WHERE s_nationkey % 2 = 0),
c AS (SELECT id, unnest(range(CAST(floor(x / 10) AS BIGINT), CAST(floor((x + dx) / 10) AS BIGINT) + 1)) AS x, y, dy FROM l),
r AS (SELECT id, x, unnest(range(CAST(floor((1000 - y) / 10) AS BIGINT), CAST(floor((1000 - y + dy) / 10) AS BIGINT) + 1)) AS y FROM c)
SELECT CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, count(*) AS n, min(id) AS first FROM r WHERE x BETWEEN 0 AND 39 AND y BETWEEN 0 AND 99 GROUP BY 1, 2""",
}

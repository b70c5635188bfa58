"""Queries over vector features, roads and graphs, on adapters of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.functions.grid import GridSpec
from tidemark.operators import network, zonal
from tidemark.session import table
from tidemark.sources import features

#: part as a raster of 10 m pixels, 40 wide; rows of ``orders`` lie on it as features.
GRID = GridSpec(0.0, 1000.0, 40, 100, 10.0)


def affected(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").where("p_size <= 18")
    return part.select((F.col("p_partkey") % 40).cast("int").alias("x"), F.floor(F.col("p_partkey") / 40).cast("int").alias("y"))


def layer_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every layer of every feature in one scan; tags are made of part's columns."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    pick = lambda values, m: F.get(F.array(*[F.lit(v) for v in values]), (k % m).cast("int"))
    tags = {
        "highway": pick(["primary", "track", "path", "service", "unclassified", "road", None], 7), "waterway": pick(["river", "riverbank", "drain", None, None], 5),
        "place": pick(["town", "village", "city", None], 4), "bridge": pick(["yes", "no", None], 3), "amenity": pick(["hospital", "school", None, None, None, None], 6),
        "building": pick(["house", None, None, None, None, None, None, None], 8),
    }
    entries = F.array(*[F.struct(F.lit(n).alias("key"), v.alias("value")) for n, v in tags.items()])
    made = p.select("p_partkey", F.when(k % 2 == 0, "way").otherwise("node").alias("kind"), F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull())).alias("tags"))
    return features.classified(made).groupBy("layer").agg(F.count("*").alias("n"), F.sum("p_partkey").alias("keys"))


def tag_whitelist_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    tags = F.map_concat(F.create_map(F.lit("name"), F.col("event_type")), F.create_map(F.lit("junk"), F.col("props")))
    made = e.select("event_id", features.kept_tags(tags).alias("tags"), F.get_json_object("props", "$.k").cast("long").alias("k"))
    return made.select("event_id", F.try_element_at("tags", F.lit("name")).alias("name"), F.size("tags").alias("n_tags"), "k")


def tiled_union_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("source", "doc_id", F.md5("text").alias("key"))
    first = features.tiled_union(d, F.col("key"), ["source", "doc_id"])
    return first.groupBy("source").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


def context_union_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    area = table(spark, sf_dir, "customer").where("c_nationkey < 12").select(F.col("c_nationkey").alias("osm_id"), F.lit("area").alias("origin")).distinct()
    context = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("osm_id"), F.lit("context").alias("origin")).distinct()
    return network.with_context(area, context)


def region_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    regions = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), (k * 1.0).alias("west"), (k % 5 * 1.0).alias("south"), (k + 6.5).alias("east"), (k % 5 + 4.0).alias("north"))
    return features.choose_region(regions, (8.0, 2.0, 11.0, 5.0)).select("name", F.round("cover", 6).alias("cover"), F.round("size", 6).alias("size"))


def candidate_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate snapshot dates on which there was an order."""
    reference = F.lit("2019-03-05").cast("date")
    wanted = spark.range(1).select(F.posexplode(features.candidate_dates(reference)).alias("place", "date"))
    there = table(spark, sf_dir, "orders").select(F.date_add(F.to_date("o_orderdate"), 8030).alias("date")).distinct()
    return wanted.join(there, "date", "left_semi").select("date", F.col("place").cast("long").alias("place"))


def superset_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 40).alias("x"), F.floor(F.col("p_partkey") / 40).alias("y"))
    cells = F.floor(F.col("x") / 8).between(1, 3) & F.floor(F.col("y") / 8).between(0, 2)
    return p.where(cells & F.col("x").between(9, 27) & F.col("y").between(2, 18))


def marker_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user belong to the error before them."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.when(F.col("event_type") == "error", F.col("event_id")).alias("marker"))
    return features.marker_sections(e, "event_id", "marker", "user_id").where("section is not null").groupBy("section").agg(F.count("*").alias("n"))


def point_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order places looked up in the mask, some of them outside of the grid."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 431 - 5.0).alias("px"), (F.col("o_orderkey") % 1013 * 1.0).alias("py"))
    return zonal.sample(o, affected(spark, sf_dir), GRID, "px", "py", "hit").select("o_orderkey", "hit")


def building_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") * 37 % 380 * 1.0).alias("x0"), (1000 - F.col("s_suppkey") * 23 % 200 * 1.0 - 30).alias("y0"))
    return s.select("id", "x0", "y0", (F.col("x0") + 25).alias("x1"), (F.col("y0") + 15).alias("y1"))


def building_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    zones, mask = building_zones(spark, sf_dir), affected(spark, sf_dir)
    near = mask.where("(x + y) % 3 = 0").select((F.col("x") + 1).alias("x"), "y").union(mask)
    centred = zones.select("id", ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"))
    return zonal.zone_status(zonal.rectangle_pixels(zones, GRID), centred, mask, near, GRID)


def polygon_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rectangles as polygons: cells by the touch test."""
    z = building_zones(spark, sf_dir)
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    rings = z.select("id", F.array(corner("x0", "y0"), corner("x1", "y0"), corner("x1", "y1"), corner("x0", "y1"), corner("x0", "y0")).alias("ring"))
    return zonal.polygon_pixels(rings, GRID).groupBy("id").agg(F.count("*").alias("n_cells"))


def road_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-vertex lines between places made of the orders' keys, one for every order."""
    k = F.col("o_orderkey")
    at = lambda a, b: F.struct((k * a % 390 + 0.31).alias("x"), (1000.17 - k * b % 180).alias("y"))
    highway = F.get(F.array(*[F.lit(h) for h in ("primary", "track", "path", "mystery")]), (k % 4).cast("int"))
    return table(spark, sf_dir, "orders").select(k.alias("id"), F.lit(0).alias("part"), highway.alias("highway"), F.array(at(7, 11), at(13, 17), at(19, 23)).alias("coords"))


def road_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    roads, mask = road_lines(spark, sf_dir), affected(spark, sf_dir)
    near = mask.union(mask.select((F.col("x") + 1).alias("x"), "y"))
    hits = zonal.sample(zonal.sample(zonal.road_samples(roads), mask, GRID, "px", "py", "hit"), near, GRID, "px", "py", "near")
    return zonal.road_status(roads, hits)


def road_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of consecutive events of a type: gaps and islands by user."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.lit(0).alias("part"), F.row_number().over(w).alias("i"), (F.col("event_type") == "click").alias("hit"), F.lit(5.0).alias("share_m"))
    return zonal.runs_of_hits(e).groupBy("id").agg(F.count("*").alias("n_runs"), F.max("n").alias("longest"), F.max("run_m").alias("longest_m"))


def blocked_roads_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocked length by name, else reference, else class; the five longest."""
    li = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    name = F.coalesce(F.when(F.col("p_size") % 3 == 0, F.col("p_brand")), F.when(F.col("p_size") % 3 == 1, F.col("p_type")), F.concat(F.lit("unnamed "), F.col("l_linestatus")))
    return li.groupBy(name.alias("road")).agg(F.count("*").alias("n"), F.round(F.sum("l_quantity") / 1000, 6).alias("km")).orderBy(F.desc("km"), "road").limit(5)


def polyline_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = road_lines(spark, sf_dir)
    return zonal.segments(lines, "id").groupBy("id").agg(F.count_if(F.col("length") > 0).alias("n"), F.round(F.sum("length"), 5).alias("metres"))


def cumulative_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, sf_dir, "orders").withColumn("x", F.col("o_totalprice") / 1000).withColumn("y", (F.col("o_orderkey") % 100) * 1.0)
    step = F.coalesce(F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)), F.lit(0.0))
    return o.withColumn("step", step).select("o_orderkey", F.round(F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)), 4).alias("along"))


def nearest_snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("qid"), (F.col("o_orderkey") * 17 % 3001 * 1.0).alias("px"), (F.col("o_orderkey") * 29 % 2003 * 1.0).alias("py"))
    t = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("tid"), (F.col("s_suppkey") * 211 % 3001 * 1.0).alias("px"), (F.col("s_suppkey") * 307 % 2003 * 1.0).alias("py"))
    return zonal.nearest_point(q, t, network.SNAP_M).select("qid", "tid", F.round("distance", 5).alias("distance"))


def point_line_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line nearest to each supplier's place within 5 m, how far it is, and where along it. Equal lines are one."""
    lines = road_lines(spark, sf_dir).groupBy("coords").agg(F.min("id").alias("id"))
    p = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") * 31 % 390 * 1.0).alias("px"), (1000 - F.col("s_suppkey") * 41 % 180 * 1.0).alias("py"))
    met = zonal.near_lines(p.withColumnRenamed("s_suppkey", "pid"), lines, 5.0)
    best = met.groupBy("pid").agg(F.min(F.struct(F.round("away", 5).alias("away"), "id", F.round("along", 3).alias("along"))).alias("b"))
    return best.select(F.col("pid").alias("s_suppkey"), "b.away", "b.id", "b.along")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part and supplier nodes; an edge takes the least quantity of its line items as minutes, and is cut if any was returned."""
    li = table(spark, sf_dir, "lineitem")
    pairs = li.groupBy("l_partkey", "l_suppkey").agg(F.min("l_quantity").alias("minutes"), F.bool_or(F.col("l_returnflag") == "R").alias("cut"), F.count("*").alias("n"))
    return pairs.select(F.concat(F.lit("p"), "l_partkey").alias("u"), F.concat(F.lit("s"), "l_suppkey").alias("v"), "minutes", "cut")


def shortest_path_before_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least minutes from the facilities before and after the cut edges are gone, two scenarios in one job."""
    e = edges(spark, sf_dir)
    graphs = e.select(F.lit("before").alias("scenario"), "u", "v", "minutes").union(e.where("not cut").select(F.lit("after"), "u", "v", "minutes"))
    names = F.explode(F.array(F.lit("before"), F.lit("after"))).alias("scenario")
    sources = table(spark, sf_dir, "supplier").where("s_nationkey = 7").select(names, F.concat(F.lit("s"), "s_suppkey").alias("node"))
    return network.shortest_times(graphs, sources, ("scenario",)).where("node like 'p%'")


def graph_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the road lines by class rules; what two roads share belongs to the later one."""
    roads = road_lines(spark, sf_dir).select(F.col("id").alias("road"), "highway", "coords")
    made = network.road_edges(roads)
    return made.groupBy("road").agg(F.count("*").alias("n"), F.round(F.sum("minutes"), 5).alias("minutes"))


def access_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of settlements (customers) by minutes that their keys stand for."""
    k = F.col("c_custkey")
    m = lambda a, gap: F.when(k % gap != 0, (k * a % 120).cast("double"))
    c = table(spark, sf_dir, "customer").select("c_custkey", m(7, 11).alias("h0"), m(7, 11).alias("h1_"), m(13, 7).alias("t0"), (k % 3).alias("r"))
    worse = lambda base, gap, by: F.when((k % gap != 0), F.col(base) + by * (k % 4))
    s = network.access_status(F.col("h0"), worse("h0", 13, 20), F.col("t0"), worse("t0", 17, 30), worse("h0", 5, 20), worse("t0", 19, 30), k % 23 != 0)
    return c.select("c_custkey", s.alias("status"))


def access_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = access_status(spark, sf_dir).withColumn("hospital_on_foot_min", F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey")))
    return network.access_counts(s)


def utm_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places to UTM and Web Mercator metres, and from UTM back: the error in degrees."""
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select(k, (k % 6 * 0.9 + 84.2).alias("lon"), (k % 160 - 80.0).alias("lat"))
    zone, south = S.utm_zone(F.col("lon")), F.col("lat") < 0
    e, n = S.to_utm(F.col("lon"), F.col("lat"), zone, south)
    there = c.select("c_custkey", "lon", "lat", zone.alias("zone"), south.alias("south"), e.alias("e"), n.alias("n"))
    lon, lat = S.from_utm(F.col("e"), F.col("n"), F.col("zone"), F.col("south"))
    mx, my = S.web_mercator(F.col("lon"), F.col("lat"))
    metres = {"east_10m": F.round(F.col("e") / 10), "north_10m": F.round(F.col("n") / 10), "mercator_x": F.round(mx, 2), "mercator_y": F.round(my, 2)}
    return there.select("c_custkey", *[c.alias(n) for n, c in metres.items()], S.utm_epsg(F.col("lon"), F.col("lat")).alias("epsg"), F.round(F.abs(lon - F.col("lon")), 6).alias("d_lon"), F.round(F.abs(lat - F.col("lat")), 6).alias("d_lat"))


def request_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes that a request may have: in order, in range and of 1 to 600 km2."""
    k = F.col("o_orderkey")
    b = table(spark, sf_dir, "orders").select(k, (k % 300 - 150.0).alias("w"), (k % 170 - 85.0).alias("s"), ((k * 7 % 40 - 2) / 100.0).alias("dx"), ((k * 3 % 50 - 1) / 100.0).alias("dy"))
    e, n = F.col("w") + F.col("dx"), F.col("s") + F.col("dy")
    area = S.box_area_km2(F.col("w"), F.col("s"), e, n)
    ordered = (F.col("w") >= -180) & (F.col("w") < e) & (e <= 180) & (F.col("s") >= -85) & (F.col("s") < n) & (n <= 85)
    return b.select("o_orderkey", F.round(area, 5).alias("km2"), F.when(~ordered, "order").when(area < 1, "small").when(area > 600, "large").otherwise("ok").alias("verdict"))


def place_score_argmin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every nation the customer that names the run: distance plus four kilometres a rank."""
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", (k * 13 % 100 / 100.0 + 85).alias("lon"), (k * 29 % 100 / 100.0 + 27).alias("lat"), (k % 9).alias("rank"))
    score = S.place_km(F.col("lon"), F.col("lat"), F.lit(85.5), F.lit(27.5)) + 4 * F.col("rank")
    best = F.min(F.struct(F.round(score, 6).alias("score"), "c_custkey"))
    return c.groupBy("c_nationkey").agg(best.alias("b")).select("c_nationkey", "b.c_custkey", "b.score")


def topk_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten by minutes, no minutes and 0 both last, as the report has it."""
    c = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") * 37 % 101).alias("m"))
    return c.select("c_custkey", F.coalesce(F.nullif("m", F.lit(0)), F.lit(999)).alias("minutes")).orderBy("minutes", "c_custkey").limit(10)


def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    plain = F.element_at(F.split("url", "[?]"), 1)
    return pages.select("page_id", S.cache_key(plain, F.col("page_id")).alias("key"), F.md5(S.html_escape(F.col("html"))).alias("escaped_md5"), F.length(S.html_escape(F.col("html"))).cast("long").alias("escaped_chars"))


def set_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out, training and shared keys as sets: except, intersect and union."""
    a = table(spark, sf_dir, "labels").select("doc_id")
    b = table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id")
    sets = {"only_labels": a.subtract(b), "both": a.intersect(b), "either": a.union(b).distinct()}
    out = None
    for name, df in sets.items():
        row = df.agg(F.count("*").alias("n"), F.sum("doc_id").alias("total")).select(F.lit(name).alias("name"), "n", "total")
        out = row if out is None else out.union(row)
    return out


QUERIES = {
    f.__name__: f
    for f in (
        layer_classification, tag_whitelist_json, tiled_union_dedup, context_union_anti, region_choice, candidate_dates, superset_cut, marker_sections,
        point_sample, building_status, polygon_zones, road_status, road_runs, blocked_roads_rollup, polyline_segments, cumulative_distance, nearest_snap,
        point_line_distance, shortest_path_before_after, graph_build, access_status, access_counters, utm_round_trip, request_validation,
        place_score_argmin, topk_lists, cache_keys, set_algebra,
    )
}

_MASK = "m AS (SELECT p_partkey % 40 AS x, p_partkey // 40 AS y FROM part WHERE p_size <= 18)"
_LINES = """l AS (SELECT o_orderkey AS id, [o_orderkey * 7 % 390 + 0.31::DOUBLE, o_orderkey * 13 % 390 + 0.31::DOUBLE, o_orderkey * 19 % 390 + 0.31::DOUBLE] AS xs,
[1000.17::DOUBLE - o_orderkey * 11 % 180, 1000.17::DOUBLE - o_orderkey * 17 % 180, 1000.17::DOUBLE - o_orderkey * 23 % 180] AS ys,
['primary', 'track', 'path', 'mystery'][o_orderkey % 4 + 1] AS highway FROM orders),
seg AS (SELECT id, highway, seq, xs[seq] AS ax, ys[seq] AS ay, xs[seq + 1] AS qx, ys[seq + 1] AS qy, sqrt((xs[seq + 1] - xs[seq]) ** 2 + (ys[seq + 1] - ys[seq]) ** 2) AS length
FROM l, (VALUES (1), (2)) s(seq))"""
_ACCESS = """a AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 11 <> 0 THEN c_custkey * 7 % 120 END AS h0, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey * 13 % 120 END AS t0 FROM customer),
b AS (SELECT *, CASE WHEN k % 13 <> 0 THEN h0 + 20 * (k % 4) END AS h1, CASE WHEN k % 17 <> 0 THEN t0 + 30 * (k % 4) END AS t1, CASE WHEN k % 5 <> 0 THEN h0 END AS hw, CASE WHEN k % 19 <> 0 THEN t0 END AS tw FROM a),
s AS (SELECT k, CASE WHEN k % 23 = 0 OR (h0 IS NULL AND t0 IS NULL) THEN 'no_mapped_road'
 WHEN (h0 IS NOT NULL AND h1 IS NULL) OR (t0 IS NOT NULL AND t1 IS NULL) THEN 'cut_off'
 WHEN (h0 IS NOT NULL AND hw IS NULL) OR (t0 IS NOT NULL AND tw IS NULL) THEN 'possibly_cut_off'
 WHEN greatest(h1 / greatest(h0, 1.0::DOUBLE), t1 / greatest(t0, 1.0::DOUBLE)) >= 2 AND greatest(h1 - h0, t1 - t0) >= 30 THEN 'long_detour' ELSE 'connected' END AS status FROM b)"""

SQL = {
    "layer_classification": """WITH t AS (SELECT p_partkey AS k, p_partkey % 2 = 0 AS way, ['primary', 'track', 'path', 'service', 'unclassified', 'road', NULL][p_partkey % 7 + 1] AS highway,
['river', 'riverbank', 'drain', NULL, NULL][p_partkey % 5 + 1] AS waterway, ['town', 'village', 'city', NULL][p_partkey % 4 + 1] AS place, ['yes', 'no', NULL][p_partkey % 3 + 1] AS bridge,
['hospital', 'school', NULL, NULL, NULL, NULL][p_partkey % 6 + 1] AS amenity, p_partkey % 8 = 0 AS building FROM part),
u AS (SELECT 'waterways' AS layer, k FROM t WHERE way AND waterway IN ('river', 'stream', 'canal', 'drain') UNION ALL SELECT 'water', k FROM t WHERE way AND waterway = 'riverbank' UNION ALL SELECT 'buildings', k FROM t WHERE way AND building
UNION ALL SELECT 'roads', k FROM t WHERE way AND highway IS NOT NULL UNION ALL SELECT 'roads_major', k FROM t WHERE way AND highway IN ('motorway', 'trunk', 'primary', 'secondary', 'tertiary', 'unclassified', 'road') UNION ALL SELECT 'bridges', k FROM t WHERE way AND bridge = 'yes'
UNION ALL SELECT 'places', k FROM t WHERE NOT way AND place IS NOT NULL UNION ALL SELECT 'towns', k FROM t WHERE NOT way AND place IN ('town', 'city') UNION ALL SELECT 'health', k FROM t WHERE amenity = 'hospital')
SELECT layer, count(*) AS n, CAST(sum(k) AS BIGINT) AS keys FROM u GROUP BY layer""",
    "tag_whitelist_json": "SELECT event_id, event_type AS name, 1 AS n_tags, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "tiled_union_dedup": """SELECT source, count(*) AS n, min(doc_id) AS first_id FROM (SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY source, doc_id) = 1) GROUP BY source""",
    "context_union_anti": "SELECT DISTINCT c_nationkey AS osm_id, 'area' AS origin FROM customer WHERE c_nationkey < 12 UNION ALL SELECT DISTINCT s_nationkey, 'context' FROM supplier WHERE s_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_nationkey < 12)",
    "region_choice": """WITH r AS (SELECT n_name AS name, n_nationkey AS w, n_nationkey % 5 AS s, n_nationkey + 6.5 AS e, n_nationkey % 5 + 4 AS n FROM nation)
SELECT name, CAST(round_even((least(e, 11) - greatest(w, 8)) * (least(n, 5) - greatest(s, 2)) / 9.0::DOUBLE * 20, 0) / 20 AS DOUBLE) AS cover, CAST((e - w) * (n - s) AS DOUBLE) AS size
FROM r WHERE w <= 11 AND e >= 8 AND s <= 5 AND n >= 2 ORDER BY cover DESC, size, name LIMIT 1""",
    "candidate_dates": """WITH c AS (SELECT d, row_number() OVER (ORDER BY kind, d DESC) AS p FROM (SELECT d, min(kind) AS kind FROM (
SELECT DATE '2019-03-05' - CAST(k AS INTEGER) AS d, 1 AS kind FROM range(9) t(k) UNION ALL SELECT CAST(DATE '2019-03-01' - to_months(CAST(k AS INTEGER)) AS DATE), 2 FROM range(60) t(k)
UNION ALL SELECT make_date(y, 1, 1), 3 FROM range(2014, 2020) t(y)) WHERE d <= DATE '2019-03-05' GROUP BY d))
SELECT d AS date, p - 1 AS place FROM c WHERE d IN (SELECT CAST(o_orderdate AS DATE) + 8030 FROM orders)""",
    "superset_cut": "SELECT p_partkey, p_partkey % 40 AS x, p_partkey // 40 AS y FROM part WHERE p_partkey % 40 BETWEEN 9 AND 27 AND p_partkey // 40 BETWEEN 2 AND 18",
    "marker_sections": """SELECT section, count(*) AS n FROM (SELECT event_type, max(CASE WHEN event_type = 'error' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id) AS section FROM events)
WHERE event_type <> 'error' AND section IS NOT NULL GROUP BY section""",
    "point_sample": f"""WITH {_MASK} SELECT o_orderkey, coalesce(m.x IS NOT NULL, false) AS hit FROM orders LEFT JOIN m ON m.x = CAST(trunc((o_orderkey % 431 - 5) / 10.0) AS INTEGER) AND m.y = CAST(trunc((1000 - o_orderkey % 1013) / 10.0) AS INTEGER)""",
    "building_status": f"""WITH {_MASK}, n AS (SELECT x, y FROM m UNION SELECT x + 1, y FROM m WHERE (x + y) % 3 = 0),
z AS (SELECT s_suppkey AS id, s_suppkey * 37 % 380 AS x0, s_suppkey * 23 % 200 + 30 AS d FROM supplier),
c AS (SELECT max(id) AS id, x, y FROM (SELECT id, unnest(range(x0 // 10, CAST(ceil((x0 + 25) / 10.0) AS BIGINT))) AS x, d FROM z) q, LATERAL (SELECT unnest(range((d - 15) // 10, CAST(ceil(d / 10.0) AS BIGINT))) AS y) r WHERE x BETWEEN 0 AND 39 AND y BETWEEN 0 AND 99 GROUP BY x, y),
s AS (SELECT c.id, count(*) AS total, count(m.x) AS inside, count(n.x) AS near FROM c LEFT JOIN m USING (x, y) LEFT JOIN n USING (x, y) GROUP BY c.id),
k AS (SELECT z.id, total, inside, near, CAST(trunc((x0 + 12.5) / 10) AS INTEGER) AS cx, CAST(trunc((d - 7.5) / 10) AS INTEGER) AS cy FROM z LEFT JOIN s USING (id)),
f AS (SELECT k.id, CASE WHEN total IS NULL THEN CAST(m.x IS NOT NULL AS INTEGER) * 1.0::DOUBLE ELSE inside / total END AS share, CASE WHEN total IS NULL THEN n.x IS NOT NULL ELSE near > 0 END AS close
FROM k LEFT JOIN m ON m.x = cx AND m.y = cy LEFT JOIN n ON n.x = cx AND n.y = cy)
SELECT id, round_even(share, 2) AS affected_frac, CASE WHEN share >= 0.5 THEN 'hit' WHEN share > 0 OR close THEN 'possibly hit' ELSE 'outside' END AS status FROM f""",
    "road_status": f"""WITH {_MASK}, n AS (SELECT x, y FROM m UNION SELECT x + 1, y FROM m), {_LINES},
t AS (SELECT id, sum(length) AS length, max(length) FILTER (seq = 1) AS first FROM seg GROUP BY id),
p AS (SELECT id, length, i, length / (k + 1) AS share, i * length / k AS pos, first FROM (SELECT *, greatest(CAST(floor(length / 5) AS BIGINT), 1) AS k FROM t WHERE length > 0), LATERAL (SELECT unnest(range(k + 1)) AS i)),
q AS (SELECT p.id, i, share, CASE WHEN pos <= first AND first > 0 THEN a.ax + least(1, pos / first) * (a.qx - a.ax) ELSE b.ax + least(1, (pos - first) / b.length) * (b.qx - b.ax) END AS px,
CASE WHEN pos <= first AND first > 0 THEN a.ay + least(1, pos / first) * (a.qy - a.ay) ELSE b.ay + least(1, (pos - first) / b.length) * (b.qy - b.ay) END AS py
FROM p JOIN seg a ON a.id = p.id AND a.seq = 1 JOIN seg b ON b.id = p.id AND b.seq = 2),
h AS (SELECT q.id, i, share, m.x IS NOT NULL AS hit, n.x IS NOT NULL AS near FROM q LEFT JOIN m ON m.x = CAST(trunc(px / 10) AS INTEGER) AND m.y = CAST(trunc((1000 - py) / 10) AS INTEGER)
LEFT JOIN n ON n.x = CAST(trunc(px / 10) AS INTEGER) AND n.y = CAST(trunc((1000 - py) / 10) AS INTEGER)),
r AS (SELECT id, max(len) AS longest FROM (SELECT id, count(*) * max(share) AS len FROM (SELECT id, share, i - row_number() OVER (PARTITION BY id ORDER BY i) AS g FROM h WHERE hit) GROUP BY id, g) GROUP BY id),
s AS (SELECT id, sum(CASE WHEN hit THEN share ELSE 0 END) AS inside, bool_or(near) AS close FROM h GROUP BY id)
SELECT t.id, CASE WHEN longest >= 20 THEN 'cut' WHEN inside > 0 THEN 'touched' WHEN coalesce(close, false) THEN 'near' ELSE 'outside' END AS status,
CAST(round_even(t.length, 0) AS BIGINT) AS length_m, CAST(round_even(coalesce(inside, 0), 0) AS BIGINT) AS affected_m FROM t LEFT JOIN s USING (id) LEFT JOIN r USING (id)""",
    "road_runs": """WITH e AS (SELECT user_id AS id, event_type = 'click' AS hit, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
r AS (SELECT id, count(*) AS n FROM (SELECT id, i - row_number() OVER (PARTITION BY id ORDER BY i) AS g FROM e WHERE hit) GROUP BY id, g)
SELECT id, count(*) AS n_runs, max(n) AS longest, max(n) * 5.0::DOUBLE AS longest_m FROM r GROUP BY id""",
    "blocked_roads_rollup": """SELECT CASE WHEN p_size % 3 = 0 THEN p_brand WHEN p_size % 3 = 1 THEN p_type ELSE 'unnamed ' || l_linestatus END AS road, count(*) AS n, round(sum(l_quantity) / 1000, 6) AS km
FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' GROUP BY 1 ORDER BY km DESC, road LIMIT 5""",
    "polyline_segments": f"WITH {_LINES} SELECT id, count(*) FILTER (length > 0) AS n, round(sum(length), 5) AS metres FROM seg GROUP BY id",
    "cumulative_distance": """WITH o AS (SELECT *, o_totalprice / 1000 AS x, o_orderkey % 100 AS y FROM orders), s AS (SELECT *, coalesce(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2), 0) AS step FROM o WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
SELECT o_orderkey, round(sum(step) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 4) AS along FROM s""",
    "nearest_snap": """WITH q AS (SELECT o_orderkey AS qid, o_orderkey * 17 % 3001 AS x, o_orderkey * 29 % 2003 AS y FROM orders), t AS (SELECT s_suppkey AS tid, s_suppkey * 211 % 3001 AS x, s_suppkey * 307 % 2003 AS y FROM supplier),
d AS (SELECT qid, tid, sqrt((q.x - t.x) ** 2 + (q.y - t.y) ** 2) AS distance FROM q, t)
SELECT qid, tid, round(distance, 5) AS distance FROM d WHERE distance <= 300 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY distance, tid) = 1""",
    "point_line_distance": f"""WITH {_LINES}, u AS (SELECT min(id) AS id FROM l GROUP BY xs, ys), p AS (SELECT s_suppkey, s_suppkey * 31 % 390 AS x, 1000 - s_suppkey * 41 % 180 AS y FROM supplier),
d AS (SELECT s_suppkey, id, x, y, ax, ay, qx, qy, length, coalesce(sum(length) OVER (PARTITION BY s_suppkey, id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
CASE WHEN length > 0 THEN greatest(0, least(1, ((x - ax) * (qx - ax) + (y - ay) * (qy - ay)) / (length * length))) ELSE 0 END AS t FROM p, seg WHERE id IN (SELECT id FROM u)),
e AS (SELECT s_suppkey, id, sqrt((x - ax - t * (qx - ax)) ** 2 + (y - ay - t * (qy - ay)) ** 2) AS away, round(start + t * length, 3) AS along FROM d)
SELECT s_suppkey, round(away, 5) AS away, id, along FROM e WHERE away <= 5 QUALIFY row_number() OVER (PARTITION BY s_suppkey ORDER BY round(away, 5), id, along) = 1""",
    "shortest_path_before_after": """WITH RECURSIVE e AS (SELECT l_partkey AS p, l_suppkey AS s, min(l_quantity) AS minutes, bool_or(l_returnflag = 'R') AS cut FROM lineitem GROUP BY ALL),
g AS (SELECT 'before' AS scenario, 'p' || p AS a, 's' || s AS b, minutes FROM e UNION ALL SELECT 'after', 'p' || p, 's' || s, minutes FROM e WHERE NOT cut),
u AS MATERIALIZED (SELECT scenario, a, b, minutes FROM g UNION ALL SELECT scenario, b, a, minutes FROM g),
t(scenario, node, time) USING KEY (scenario, node) AS (SELECT scenario, 's' || s_suppkey, 0.0::DOUBLE FROM supplier, (VALUES ('before'), ('after')) v(scenario) WHERE s_nationkey = 7
UNION SELECT u.scenario, u.b, min(t.time + u.minutes) FROM t JOIN u ON u.scenario = t.scenario AND u.a = t.node LEFT JOIN recurring.t o ON o.scenario = u.scenario AND o.node = u.b
WHERE o.time IS NULL OR t.time + u.minutes < o.time GROUP BY u.scenario, u.b)
SELECT scenario, node, time FROM t WHERE node LIKE 'p%'""",
    "graph_build": f"""WITH {_LINES}, e AS (SELECT id, seq, length, length / 1000 / CASE highway WHEN 'primary' THEN 40 WHEN 'track' THEN 12 ELSE 20 END * 60 AS minutes, ax || ',' || ay AS p, qx || ',' || qy AS q FROM seg WHERE highway <> 'path' AND length > 0),
k AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY least(p, q), greatest(p, q) ORDER BY id DESC, seq DESC) = 1)
SELECT id AS road, count(*) AS n, round(sum(minutes), 5) AS minutes FROM k GROUP BY id""",
    "access_status": f"WITH {_ACCESS} SELECT k AS c_custkey, status FROM s",
    "access_counters": f"""WITH {_ACCESS} SELECT count(*) FILTER (status = 'cut_off') AS cut_off, count(*) FILTER (status = 'possibly_cut_off') AS possibly_cut_off, count(*) FILTER (status = 'long_detour') AS long_detour,
count(*) FILTER (status = 'connected') AS connected, count(*) FILTER (status = 'no_mapped_road') AS no_mapped_road, count(*) FILTER (status = 'cut_off' AND k % 2 = 0) AS foot_only, count(*) AS settlements FROM s""",
    # By the truncated power series of the meridian arc, which is another way than that of the query.
    "utm_round_trip": """WITH c AS (SELECT c_custkey, c_custkey % 6 * 0.9 + 84.2::DOUBLE AS lon, c_custkey % 160 - 80.0::DOUBLE AS lat, 6378137.0::DOUBLE AS a, 1 / 298.257223563::DOUBLE * (2 - 1 / 298.257223563::DOUBLE) AS e2 FROM customer),
d AS (SELECT *, radians(lat) AS phi, floor((lon + 180) / 6) + 1 AS zone, e2 / (1 - e2) AS ep2 FROM c),
g AS (SELECT *, a / sqrt(1 - e2 * sin(phi) ** 2) AS n, tan(phi) ** 2 AS t, ep2 * cos(phi) ** 2 AS k, radians(lon - (zone * 6 - 183)) * cos(phi) AS w,
a * ((1 - e2 / 4 - 3 * e2 ** 2 / 64 - 5 * e2 ** 3 / 256) * phi - (3 * e2 / 8 + 3 * e2 ** 2 / 32 + 45 * e2 ** 3 / 1024) * sin(2 * phi) + (15 * e2 ** 2 / 256 + 45 * e2 ** 3 / 1024) * sin(4 * phi) - 35 * e2 ** 3 / 3072 * sin(6 * phi)) AS m FROM d),
u AS (SELECT *, 0.9996::DOUBLE * n * (w + (1 - t + k) * w ** 3 / 6 + (5 - 18 * t + t * t + 72 * k - 58 * ep2) * w ** 5 / 120) + 500000 AS east,
0.9996::DOUBLE * (m + n * tan(phi) * (w ** 2 / 2 + (5 - t + 9 * k + 4 * k * k) * w ** 4 / 24 + (61 - 58 * t + t * t + 600 * k - 330 * ep2) * w ** 6 / 720)) + CASE WHEN lat < 0 THEN 10000000 ELSE 0 END AS north FROM g)
SELECT c_custkey, round(east / 10) AS east_10m, round(north / 10) AS north_10m, round(radians(lon) * a, 2) AS mercator_x, round(ln(tan(pi() / 4 + phi / 2)) * a, 2) AS mercator_y,
CAST(CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + zone AS INTEGER) AS epsg, 0.0::DOUBLE AS d_lon, 0.0::DOUBLE AS d_lat FROM u""",
    "request_validation": """WITH b AS (SELECT o_orderkey, o_orderkey % 300 - 150.0::DOUBLE AS w, o_orderkey % 170 - 85.0::DOUBLE AS s, (o_orderkey * 7 % 40 - 2) / 100.0::DOUBLE AS dx, (o_orderkey * 3 % 50 - 1) / 100.0::DOUBLE AS dy FROM orders),
c AS (SELECT *, w + dx AS e, s + dy AS n FROM b), d AS (SELECT *, abs(e - w) * 111.32::DOUBLE * cos(radians((s + n) / 2)) * abs(n - s) * 110.57::DOUBLE AS area FROM c)
SELECT o_orderkey, round(area, 5) AS km2, CASE WHEN NOT (w >= -180 AND w < e AND e <= 180 AND s >= -85 AND s < n AND n <= 85) THEN 'order' WHEN area < 1 THEN 'small' WHEN area > 600 THEN 'large' ELSE 'ok' END AS verdict FROM d""",
    "place_score_argmin": """WITH c AS (SELECT c_nationkey, c_custkey, round(sqrt(((c_custkey * 13 % 100 / 100.0::DOUBLE + 85 - 85.5::DOUBLE) * 111.32::DOUBLE * cos(radians(27.5::DOUBLE))) ** 2 + ((c_custkey * 29 % 100 / 100.0::DOUBLE + 27 - 27.5::DOUBLE) * 110.57::DOUBLE) ** 2) + 4 * (c_custkey % 9), 6) AS score FROM customer)
SELECT c_nationkey, c_custkey, score FROM c QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY score, c_custkey) = 1""",
    "topk_lists": "SELECT c_custkey, coalesce(nullif(c_custkey * 37 % 101, 0), 999) AS minutes FROM customer ORDER BY minutes, c_custkey LIMIT 10",
    "cache_keys": """WITH e AS (SELECT *, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS escaped FROM pages)
SELECT page_id, left(sha1(string_split(url, '?')[1] || '|' || page_id), 24) AS key, md5(escaped) AS escaped_md5, length(escaped) AS escaped_chars FROM e""",
    "set_algebra": """WITH a AS (SELECT doc_id FROM labels), b AS (SELECT doc_id FROM documents WHERE lang = 'en')
SELECT 'only_labels' AS name, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS total FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'both', count(*), CAST(sum(doc_id) AS BIGINT) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)
UNION ALL SELECT 'either', count(*), CAST(sum(doc_id) AS BIGINT) FROM (SELECT * FROM a UNION SELECT * FROM b)""",
}

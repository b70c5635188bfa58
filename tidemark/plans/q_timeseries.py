"""Queries over time series of passes: the driver's ``events`` as radar passes and clear looks.

cell = user_id % 20, track = user_id % 3, date = date(ts), power = value; the event is 2024-01-16.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import evidence as E
from tidemark.operators import timeseries as T
from tidemark.session import table
from tidemark.sources.features import snapshot_at

EVENT = "2024-01-16"


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track, cell, date and mean power of the events."""
    e = table(spark, sf_dir, "events").select(
        (F.col("user_id") % 3).cast("int").alias("track"), (F.col("user_id") % 20).cast("int").alias("cell"), F.to_date("ts").alias("date"), "value"
    )
    return e.groupBy("track", "cell", "date").agg(F.avg("value").alias("power"))


def s1_pass_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.to_date("ts").alias("date"), (F.col("user_id") % 3).cast("int").alias("track"), F.col("event_id").alias("item"))
    return T.passes(e)


def chosen_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    dates = table(spark, sf_dir, "events").select((F.col("user_id") % 3).cast("int").alias("track"), F.to_date("ts").alias("date"))
    return T.select_stacks(dates, EVENT)


def stack_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.stack_summary(chosen_dates(spark, sf_dir), EVENT)


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change of every (track, cell). The chosen dates are a handful for each track."""
    chosen = chosen_dates(spark, sf_dir)
    sizes = chosen.groupBy("track").agg(F.count_if(F.col("phase") == "pre").alias("n_pre"))
    obs = observations(spark, sf_dir).join(F.broadcast(chosen), ["track", "date"]).join(F.broadcast(sizes), "track")
    return T.change_features(obs, ["track", "cell"])


def change_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes(spark, sf_dir).select("track", "cell", F.round("delta", 6).alias("delta"), F.round("z", 6).alias("z"), "n_pre")


def track_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = changes(spark, sf_dir).where("z is not null")
    return z.groupBy("cell").agg(
        F.round(F.max(F.abs("z")), 6).alias("z_max"), F.bool_or(F.abs("z") >= 3).alias("strong"), F.count_if(F.abs("z") >= 2).alias("n_agree")
    ).withColumn("radar_change", F.col("strong") | (F.col("n_agree") >= 2))


def change_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that changed after the event, and their area at 10 m."""
    z = changes(spark, sf_dir)
    return z.groupBy("track").agg(F.count("*").alias("n_cells"), F.count_if(F.abs("z") >= 3).alias("n_changed"), F.round(F.count_if(F.abs("z") >= 3) * 100 / 1e6, 6).alias("changed_km2"))


def coverage_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = table(spark, sf_dir, "events").select((F.col("user_id") % 3).cast("int").alias("track"), F.when(F.col("event_type") != "error", F.col("value")).alias("v"))
    return T.covered_tracks(obs, "v").select("track", F.round("cover", 6).alias("cover"))


def first_valid_mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_linenumber").agg(F.min(F.when(F.col("l_tax") > 0.02, F.col("l_extendedprice"))).alias("v"))
    return T.first_valid(frames, ["l_partkey"], "v", "l_linenumber")


def first_clear_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    looks = table(spark, sf_dir, "events").where("event_type <> 'error'").select("user_id", "ts", "event_id", "value")
    both = T.before_after(looks, ["user_id"], F.struct("event_id", "value"), "ts", EVENT)
    return both.select("user_id", F.col("value_before.event_id").alias("id_before"), F.col("value_after.event_id").alias("id_after"))


def masked_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All bands of the first date whose mask band is there, even where another band is missing."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_linenumber").agg(
        F.min(F.when(F.col("l_discount") < 0.05, F.col("l_quantity"))).alias("b02"), F.max(F.when(F.col("l_tax") > 0.06, F.col("l_quantity"))).alias("b04")
    )
    return T.first_clear(li, ["l_partkey"], "b02", ["b02", "b04"], "l_linenumber")


def clear_fraction_pick_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("date")).agg(F.avg(F.col("event_type").isin("click", "view").cast("int")).alias("clear"))
    picked = T.pick_dates(days, want=3)
    return picked.select("date", F.round("clear", 6).alias("clear"), "place", F.round("cover", 6).alias("cover"))


def spectral_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    bands = li.select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("B08"), F.col("l_discount").alias("B02"), F.col("l_tax").alias("B03"), (F.col("l_discount") + F.col("l_tax")).alias("B04"), (F.col("l_quantity") / 2).alias("B11"))
    made = bands.select("l_orderkey", *[c.alias(n) for n, c in S.optical_indices().items()])
    return made.groupBy("l_orderkey").agg(*[F.round(F.sum(n), 5).alias(n) for n in ("ndvi", "mndwi", "bsi", "bright")])


def reflectance(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    seen = li.select("l_orderkey", F.col("l_extendedprice").alias("dn"), (F.col("l_partkey") % 12).alias("scl"), F.when(F.col("l_suppkey") % 2 == 0, "04.00").otherwise("02.14").alias("base"))
    return seen.groupBy("l_orderkey").agg(F.round(F.sum(S.reflectance("dn", "scl", "base")), 3).alias("total"), F.count_if(S.clear_look("scl")).alias("n_clear"))


def osm_snapshot_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", F.struct("o_orderdate", "o_orderkey").alias("since"), "o_totalprice", "o_orderstatus")
    flat = o.select("o_custkey", "since", "o_totalprice", "o_orderstatus").where(F.col("since.o_orderdate") <= F.lit("1996-06-30").cast("timestamp_ntz"))
    last = flat.groupBy("o_custkey").agg(F.max_by(F.struct("o_totalprice", "o_orderstatus", "since"), "since").alias("v"))
    return last.select("o_custkey", F.col("v.since.o_orderkey").alias("o_orderkey"), F.col("v.o_orderstatus").alias("o_orderstatus"))


def snapshot_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the operator: history keyed by customer, valid from the order's key."""
    h = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderpriority")
    return snapshot_at(h, "o_custkey", "o_orderkey", F.lit(9000))


def radar_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 1.5).alias("slope"), (F.col("p_partkey") * 37 % 360).cast("double").alias("aspect"))
    slope, aspect = F.col("slope"), F.col("aspect")
    out = p
    for name, heading in E.HEADING.items():
        out = out.withColumn(f"local_{name}", F.round(E.local_incidence(slope, aspect, F.lit(heading), F.lit(38.0)), 6)).withColumn(f"good_{name}", E.radar_visible(slope, aspect, F.lit(heading), F.lit(38.0)))
    return out.drop("slope", "aspect")


QUERIES = {
    f.__name__: f
    for f in (
        s1_pass_grouping, stack_selection, change_zscore, track_vote, change_summary, coverage_filter, first_valid_mosaic, first_clear_composite,
        masked_composite, clear_fraction_pick_dates, spectral_indices, reflectance, osm_snapshot_asof, snapshot_versions, radar_visibility,
    )
}

_CHANGES = """
WITH obs AS (SELECT CAST(user_id % 3 AS INTEGER) AS track, CAST(user_id % 20 AS INTEGER) AS cell, CAST(ts AS DATE) AS date, avg(value) AS power FROM events GROUP BY ALL),
days AS (SELECT DISTINCT track, date, date >= DATE '2024-01-16' AS post FROM obs WHERE date BETWEEN DATE '2024-01-16' - 40 AND DATE '2024-01-16' + 13),
ranked AS (SELECT *, row_number() OVER (PARTITION BY track, post ORDER BY abs(date - DATE '2024-01-16')) AS place FROM days),
chosen AS (SELECT track, date, post FROM ranked WHERE place <= CASE WHEN post THEN 1 ELSE 3 END
  QUALIFY count(DISTINCT post) OVER (PARTITION BY track) = 2),
sizes AS (SELECT track, count(*) FILTER (NOT post) AS n_pre FROM chosen GROUP BY track),
stats AS (SELECT o.track, o.cell, max(s.n_pre) AS n_pre,
  avg(CASE WHEN NOT post AND power > 0 THEN power END) AS pre_power,
  stddev_pop(CASE WHEN NOT post AND power > 0 THEN 10 * log10(greatest(power, 1e-5)) END) AS sigma,
  max(CASE WHEN post AND power > 0 THEN 10 * log10(greatest(power, 1e-5)) END) AS post_db
  FROM obs o JOIN chosen c ON o.track = c.track AND o.date = c.date JOIN sizes s ON o.track = s.track GROUP BY o.track, o.cell),
changes AS (SELECT track, cell, n_pre, post_db - 10 * log10(greatest(pre_power, 1e-5)) AS delta,
  CASE WHEN n_pre = 1 THEN (post_db - 10 * log10(greatest(pre_power, 1e-5))) / 1.5
       WHEN sigma IS NOT NULL THEN (post_db - 10 * log10(greatest(pre_power, 1e-5))) / greatest(sigma, 0.8) END AS z
  FROM stats WHERE post_db IS NOT NULL AND pre_power IS NOT NULL)
"""

SQL = {
    "s1_pass_grouping": "SELECT CAST(ts AS DATE) AS date, CAST(user_id % 3 AS INTEGER) AS track, count(*) AS n_items, min(event_id) AS first_item FROM events GROUP BY 1, 2",
    "stack_selection": _CHANGES
    + "SELECT track, max(date) FILTER (post) AS post_date, count(*) FILTER (NOT post) AS n_pre, CAST(max(date) FILTER (post) - DATE '2024-01-16' AS BIGINT) AS lag_days FROM chosen GROUP BY track",
    "change_zscore": _CHANGES + "SELECT track, cell, round(delta, 6) AS delta, round(z, 6) AS z, n_pre FROM changes",
    "track_vote": _CHANGES
    + "SELECT cell, round(max(abs(z)), 6) AS z_max, bool_or(abs(z) >= 3) AS strong, count(*) FILTER (abs(z) >= 2) AS n_agree, bool_or(abs(z) >= 3) OR count(*) FILTER (abs(z) >= 2) >= 2 AS radar_change FROM changes WHERE z IS NOT NULL GROUP BY cell",
    "change_summary": _CHANGES
    + "SELECT track, count(*) AS n_cells, count(*) FILTER (abs(z) >= 3) AS n_changed, round(count(*) FILTER (abs(z) >= 3) * 100 / 1e6, 6) AS changed_km2 FROM changes GROUP BY track",
    "coverage_filter": "SELECT CAST(user_id % 3 AS INTEGER) AS track, round(avg(CASE WHEN event_type <> 'error' AND value IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS cover FROM events GROUP BY 1 HAVING cover >= 0.3",
    "first_valid_mosaic": """WITH f AS (SELECT l_partkey, l_linenumber, min(CASE WHEN l_tax > 0.02 THEN l_extendedprice END) AS v FROM lineitem GROUP BY ALL)
SELECT l_partkey, arg_min(v, l_linenumber) FILTER (v IS NOT NULL) AS v, count(v) AS n_valid FROM f GROUP BY l_partkey""",
    "first_clear_composite": """SELECT user_id, arg_max(event_id, ts) FILTER (ts < TIMESTAMP '2024-01-16') AS id_before, arg_min(event_id, ts) FILTER (ts >= TIMESTAMP '2024-01-16') AS id_after
FROM events WHERE event_type <> 'error' GROUP BY user_id""",
    "masked_composite": """WITH f AS (SELECT l_partkey, l_linenumber, min(CASE WHEN l_discount < 0.05 THEN l_quantity END) AS b02, max(CASE WHEN l_tax > 0.06 THEN l_quantity END) AS b04 FROM lineitem GROUP BY ALL)
SELECT l_partkey, l_linenumber, b02, b04 FROM f WHERE b02 IS NOT NULL QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_linenumber) = 1""",
    "clear_fraction_pick_dates": """WITH d AS (SELECT CAST(ts AS DATE) AS date, avg(CASE WHEN event_type IN ('click', 'view') THEN 1.0 ELSE 0.0 END) AS clear FROM events GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY date DESC) AS place, 1 - exp(sum(ln(greatest(1 - clear, 1e-300))) OVER (ORDER BY date DESC)) AS cover FROM d WHERE clear >= 0.15),
p AS (SELECT *, coalesce(lag(cover) OVER (ORDER BY place), 0) AS prior FROM r)
SELECT date, round(clear, 6) AS clear, place, round(cover, 6) AS cover FROM p WHERE prior <= 0.97 AND place <= 3""",
    "spectral_indices": """SELECT l_orderkey, round(sum((n - r) / (n + r + 1e-6)), 5) AS ndvi, round(sum((g - s) / (g + s + 1e-6)), 5) AS mndwi,
round(sum(((s + r) - (n + b)) / ((s + r) + (n + b) + 1e-6)), 5) AS bsi, round(sum((b + g + r) / 3), 5) AS bright
FROM (SELECT l_orderkey, l_quantity AS n, l_discount AS b, l_tax AS g, l_discount + l_tax AS r, l_quantity / 2 AS s FROM lineitem) GROUP BY l_orderkey""",
    "reflectance": """SELECT l_orderkey, round(sum(CASE WHEN l_partkey % 12 NOT IN (0, 1, 3, 8, 9, 10) AND l_extendedprice <> 0 THEN (l_extendedprice - CASE WHEN l_suppkey % 2 = 0 THEN 1000 ELSE 0 END) / 10000.0 END), 3) AS total,
count(*) FILTER (l_partkey % 12 IN (2, 4, 5, 6, 7, 11)) AS n_clear FROM lineitem GROUP BY l_orderkey""",
    "osm_snapshot_asof": """SELECT o_custkey, o_orderkey, o_orderstatus FROM orders WHERE o_orderdate <= TIMESTAMP '1996-06-30'
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""",
    "snapshot_versions": """SELECT o_custkey, o_orderkey, o_totalprice, o_orderpriority FROM orders WHERE o_orderkey <= 9000
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1""",
    "radar_visibility": """WITH p AS (SELECT p_partkey, radians(p_size * 1.5) AS s, radians(CAST(p_partkey * 37 % 360 AS DOUBLE)) AS a, radians(38.0) AS th, radians(77.5) AS fa, radians(282.5) AS fd FROM part),
l AS (SELECT *, degrees(acos(greatest(-1.0, least(1.0, cos(s) * cos(th) - sin(s) * sin(th) * cos(a - fa))))) AS la, degrees(acos(greatest(-1.0, least(1.0, cos(s) * cos(th) - sin(s) * sin(th) * cos(a - fd))))) AS ld FROM p)
SELECT p_partkey, round(la, 6) AS local_ascending, NOT (cos(a - fa) < 0 AND s > th) AND la < 88 AND la >= 15 AS good_ascending,
round(ld, 6) AS local_descending, NOT (cos(a - fd) < 0 AND s > th) AND ld < 88 AND ld >= 15 AS good_descending FROM l""",
}

"""Road graphs as edge tables: building, shortest times by frontier rounds, and access before and after."""

from __future__ import annotations

import heapq
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.zonal import segments
from tidemark.session import materialise, merged

#: km/h by road class, path classes, walking speed, snapping distance and detour rules.
SPEED_KMH = {
    "motorway": 60, "trunk": 50, "primary": 40, "secondary": 35, "tertiary": 30, "unclassified": 25, "road": 25, "residential": 20,
    "living_street": 15, "service": 15, "track": 12, "motorway_link": 40, "trunk_link": 35, "primary_link": 30, "secondary_link": 25,
    "tertiary_link": 20,
}
FOOT = ("path", "footway", "steps", "bridleway")
DEFAULT_KMH, FOOT_KMH, SNAP_M = 20.0, 3.0, 300.0
DETOUR_RATIO, DETOUR_MINUTES = 2.0, 30.0


def drive_speed(highway: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in SPEED_KMH.items() for x in pair])
    return F.coalesce(F.try_element_at(table, highway).cast("double"), F.lit(DEFAULT_KMH))


def road_edges(roads: DataFrame, foot: bool = False) -> DataFrame:
    """u, v, road, length and minutes: an undirected simple graph of roads (road, highway, coords).

    Nodes are coordinates rounded to 0.1 m; of several edges between two nodes the last road's, and its last
    segment's, holds; edges without length are left out, as are roads without a class.
    """
    on_foot = F.col("highway").isin(*FOOT)
    eligible = on_foot | F.col("highway").isin(*SPEED_KMH) if foot else ~on_foot
    kmh = F.lit(FOOT_KMH) if foot else drive_speed(F.col("highway"))
    parts = segments(roads.where(eligible), "road", "highway").where("length > 0")
    node = lambda p: F.concat_ws(",", F.bround(p["x"], 1), F.bround(p["y"], 1))
    ends = parts.select(node(F.col("a")).alias("p"), node(F.col("b")).alias("q"), "road", "seq", "length", (F.col("length") / 1000 / kmh * 60).alias("minutes"))
    last = F.max_by(F.struct("road", "length", "minutes"), F.struct("road", "seq"))
    return ends.groupBy(F.least("p", "q").alias("u"), F.greatest("p", "q").alias("v")).agg(last.alias("e")).select("u", "v", "e.*")


#: Metres along the side of a block of a road graph that is searched in one task.
BLOCK_M = 10_000.0


def block_of(node: Column, side: float = BLOCK_M) -> Column:
    """The square of ground that a node named by its coordinates lies in."""
    xy = F.split(node, ",")
    part = lambda k: F.floor(F.get(xy, F.lit(k)).cast("double") / side).cast("string")
    return F.concat_ws(",", part(0), part(1))


def block_times(nodes: list, starts: list[float], ends: list, tos: list, minutes: list[float]) -> dict:
    """Least minutes of all nodes that edges ends -> tos reach from ``nodes``, which had ``starts``. Only ends are passed through."""
    near: dict = {}
    for end, to, m in zip(ends, tos, minutes, strict=True):
        near.setdefault(end, []).append((to, m))
    best = dict(zip(nodes, starts, strict=True))
    queue = [(t, n) for n, t in best.items()]
    heapq.heapify(queue)
    while queue:
        time, at = heapq.heappop(queue)
        if time > best[at]:
            continue
        for to, m in near.get(at, ()):
            if time + m < best.get(to, float("inf")):
                best[to] = time + m
                heapq.heappush(queue, (time + m, to))
    return best


def shortest_times(edges: DataFrame, sources: DataFrame, keys: tuple[str, ...] = (), block: Callable[[Column], Column] | None = None, wanted: DataFrame | None = None) -> DataFrame:
    """Keys, node and the least minutes from any source, for every node that one reaches.

    Rounds go on until no time falls. A round spreads only nodes whose time fell in the one before: over their
    edges, or, with ``block`` (the block of a node, a bounded part of the graph), through the whole block in one
    task, so that a round crosses a block and not an edge. With ``keys`` (say scenario and target) all graphs run
    in one job. Edges are undirected: u, v, minutes.

    With ``wanted`` (keys and nodes) only those nodes' times are sure to be there: once all of a graph's have one, what
    is as far as the furthest of them isn't spread, as no time of theirs could fall by it.
    """
    on = [*keys, "node"]
    plain = edges.select(*keys, "u", "v", "minutes")
    both = plain.select(*keys, F.col("u").alias("node"), F.col("v").alias("to"), F.col("minutes").cast("double").alias("minutes")).union(
        plain.select(*keys, F.col("v").alias("node"), F.col("u").alias("to"), F.col("minutes").cast("double").alias("minutes"))
    )
    both = materialise(both.withColumn("block", block(F.col("node"))) if block else both, "edges")
    known = materialise(sources.select(*on).distinct().withColumn("time", F.lit(0.0)).withColumn("fresh", F.lit(True)), "times")
    asked = None if wanted is None else materialise(wanted.select(*on).where("node is not null").distinct(), "wanted")
    at = [*keys, "block"]
    kinds = dict(known.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in on) + ", offer double, outside boolean"

    def search(key: tuple, times: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        found = block_times(times["node"].tolist(), times["time"].tolist(), own["node"].tolist(), own["to"].tolist(), own["minutes"].tolist())
        inside, had = set(own["node"]), dict(zip(times["node"], times["time"], strict=True))
        rows = [(*key[: len(keys)], n, t, n not in inside) for n, t in found.items() if t < had.get(n, float("inf"))]
        return pd.DataFrame(rows, columns=[*on, "offer", "outside"])

    while True:
        if block:
            placed = known.withColumn("block", block(F.col("node")))
            active = placed.where("fresh").select(*at).distinct()
            times, own = placed.join(active, at, "left_semi").select(*at, "node", "time"), both.join(active, at, "left_semi")
            offers = times.groupBy(*at).cogroup(own.groupBy(*at)).applyInPandas(search, schema)
        else:
            offers = known.where("fresh").join(both, on).select(*keys, F.col("to").alias("node"), (F.col("time") + F.col("minutes")).alias("offer"), F.lit(True).alias("outside"))
        # What was found inside a block is spread there already, unless another block offers less.
        least = offers.groupBy(*on).agg(F.min("offer").alias("offer"), F.min(F.when(F.col("outside"), F.col("offer"))).alias("outer"), F.min(F.when(~F.col("outside"), F.col("offer"))).alias("inner"))
        met = known.join(merged(least), on, "full_outer")
        infinite = F.lit(float("inf"))
        time = F.least(F.coalesce("time", infinite), F.coalesce("offer", infinite))
        fresh = F.coalesce((F.col("outer") < F.coalesce("time", infinite)) & (F.col("outer") < F.coalesce("inner", infinite)), F.lit(False))
        known = materialise(met.select(*on, time.alias("time"), fresh.alias("fresh")), "times", known)
        if asked is not None:
            # One row a graph.
            bound = asked.join(merged(known.select(*on, "time")), on, "left").groupBy(*keys).agg(F.max(F.coalesce("time", infinite)).alias("bound"))
            near = known.join(F.broadcast(bound), list(keys), "left") if keys else known.crossJoin(bound)
            near = near.select(*on, "time", (F.col("fresh") & (F.col("time") < F.coalesce("bound", F.lit(-1.0)))).alias("fresh"))
            known = materialise(near, "times", known)
        if known.where("fresh").isEmpty():
            return known.select(*on, "time")


def cut_roads(roads: DataFrame, road_status: DataFrame, bridge_status: DataFrame) -> DataFrame:
    """``roads`` (road, osm_id, bridge) with flags cut and maybe: by the status of their own id, or as a bridge at risk; maybe only if not cut."""
    flags = road_status.groupBy("osm_id").agg(F.bool_or(F.col("status") == "cut").alias("is_cut"), F.bool_or(F.col("status").isin("touched", "near")).alias("is_maybe"))
    risky = bridge_status.where(F.col("status") == "at risk").select("osm_id", F.lit(True).alias("is_risky")).distinct()
    met = roads.join(merged(flags), "osm_id", "left").join(merged(risky), "osm_id", "left")
    bridge = F.col("bridge").isNotNull() & (F.col("bridge") != "no")
    cut = F.coalesce("is_cut", F.lit(False)) | (bridge & F.coalesce("is_risky", F.lit(False)))
    return met.withColumn("cut", cut).withColumn("maybe", ~cut & F.coalesce("is_maybe", F.lit(False))).drop("is_cut", "is_maybe", "is_risky")


def with_context(area: DataFrame, context: DataFrame, key: str = "osm_id") -> DataFrame:
    """Area features, and those of the context that the area doesn't have."""
    return area.unionByName(context.join(area.select(key).distinct(), key, "left_anti").select(*area.columns))


def access_status(h0: Column, h1: Column, t0: Column, t1: Column, hw: Column, tw: Column, snapped: Column) -> Column:
    """Status from minutes to hospital and town: before, after, and after in the worst case. NULL is out of reach."""
    lost = (h0.isNotNull() & h1.isNull()) | (t0.isNotNull() & t1.isNull())
    lost_worst = (h0.isNotNull() & hw.isNull()) | (t0.isNotNull() & tw.isNull())
    # greatest() leaves NULLs out, so a target that was never in reach doesn't count.
    ratio = F.greatest(h1 / F.greatest(h0, F.lit(1.0)), t1 / F.greatest(t0, F.lit(1.0)))
    extra = F.greatest(h1 - h0, t1 - t0)
    return (
        F.when(~snapped | (h0.isNull() & t0.isNull()), "no_mapped_road")
        .when(lost, "cut_off")
        .when(lost_worst, "possibly_cut_off")
        .when((ratio >= DETOUR_RATIO) & (extra >= DETOUR_MINUTES), "long_detour")
        .otherwise("connected")
    )


def access(edges: DataFrame, foot_edges: DataFrame, roads: DataFrame, targets: DataFrame, settlements: DataFrame) -> DataFrame:
    """Status of every settlement (sid, node, foot_node) before and after the cut roads are gone.

    ``targets``: target (hospital or town), node, foot_node. Scenarios before, after, worst and foot are
    keys of one shortest-path job.
    """
    flags = roads.select("road", "cut", "maybe")
    cars = edges.join(merged(flags), "road", "left").withColumn("cut", F.coalesce("cut", F.lit(False))).withColumn("maybe", F.coalesce("maybe", F.lit(False)))
    walk = foot_edges.join(merged(flags), "road", "left").where(~F.coalesce("cut", F.lit(False)))
    pick = lambda df, name: df.select(F.lit(name).alias("scenario"), "u", "v", "minutes")
    graphs = pick(cars, "before").union(pick(cars.where("not cut"), "after")).union(pick(cars.where("not cut and not maybe"), "worst")).union(pick(walk, "foot"))
    kinds = F.explode(F.array(F.lit("hospital"), F.lit("town"))).alias("target")
    graphs = graphs.select("*", kinds)
    names = F.explode(F.array(*[F.lit(s) for s in ("before", "after", "worst", "foot")])).alias("scenario")
    sources = targets.select("target", "node", "foot_node", names).select("scenario", "target", F.when(F.col("scenario") == "foot", F.col("foot_node")).otherwise(F.col("node")).alias("node"))
    places = settlements.select("node", "foot_node", names).select("*", kinds).where("scenario <> 'foot' or target = 'hospital'")
    wanted = places.select("scenario", "target", F.when(F.col("scenario") == "foot", F.col("foot_node")).otherwise(F.col("node")).alias("node"))
    times = shortest_times(graphs, sources.where("node is not null"), ("scenario", "target"), block_of, wanted)
    wide = times.where("scenario <> 'foot'").groupBy("node").agg(
        *[F.max(F.when((F.col("scenario") == s) & (F.col("target") == t), F.col("time"))).alias(f"{t}_{s}") for s in ("before", "after", "worst") for t in ("hospital", "town")]
    )
    feet = times.where("scenario = 'foot' and target = 'hospital'").select(F.col("node").alias("foot_node"), F.col("time").alias("on_foot"))
    met = settlements.join(merged(wide), "node", "left").join(merged(feet), "foot_node", "left")
    c = F.col
    status = access_status(c("hospital_before"), c("hospital_after"), c("town_before"), c("town_after"), c("hospital_worst"), c("town_worst"), c("node").isNotNull())
    whole = lambda name: F.bround(name).cast("long")
    return met.select(
        "sid", status.alias("status"),
        *[whole(f"{t}_{s}").alias(f"{t}_min_{s}") for t in ("hospital", "town") for s in ("before", "after")],
        whole("on_foot").alias("hospital_on_foot_min"),
    )


def access_counts(settled: DataFrame) -> DataFrame:
    names = ("cut_off", "possibly_cut_off", "long_detour", "connected", "no_mapped_road")
    foot = (F.col("status") == "cut_off") & F.col("hospital_on_foot_min").isNotNull()
    return settled.agg(*[F.count_if(F.col("status") == n).alias(n) for n in names], F.count_if(foot).alias("foot_only"), F.count("*").alias("settlements"))


def cut_edges(edges: DataFrame, roads: DataFrame) -> DataFrame:
    return edges.join(roads.where("cut").select("road", "highway", "name"), "road").select("u", "v", "highway", "name")

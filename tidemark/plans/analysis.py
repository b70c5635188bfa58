"""Composite analyses: detector, damage, access, flow path, model hook, summary and report, as dictionaries of DataFrames."""

from __future__ import annotations

import datetime
import json
import time
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.functions.grid import GridSpec
from tidemark.operators import evidence as E
from tidemark.operators import focal, hydro, morphology, network, zonal
from tidemark.session import materialise, merged
from tidemark.sources.files import write_bundle, write_text


def detect(pixels: DataFrame, tracks: DataFrame, grid: GridSpec, r: E.Rules = E.Rules(), complete: bool = True) -> DataFrame:
    """Class, confidence and evidence of every pixel.

    ``pixels``: x, y, hand, slope, optical indices before and after (pre_*, post_*) and the model's prob, NULL for
    no data; ``tracks``: x, y, track, good, z_vv, z_vh, post_vv, post_vh, d_vv, d_vh. Water is cleaned first, change
    where no water is; both have to be in the river's corridor unless the model found the water.
    """
    w, h = grid.width, grid.height
    keys = ["x", "y"]
    votes = E.radar_vote(tracks, keys, r)
    flags = pixels.join(votes, keys, "left").select("*", *[c.alias(n) for n, c in (E.optical_evidence(r) | E.terrain_gates(r)).items()])
    raw, dark = E.yes(F.col("radar_raw")), E.yes(F.col("radar_water"))
    flags = flags.withColumn("radar_change", E.outranked(raw, F.col("seen"), F.col("optical_change"))).withColumn("radar_water", dark)
    flags = materialise(flags.withColumn("model_water", E.yes(F.col("prob") >= r.ml_prob)).withColumn("hand0", F.coalesce("hand", F.lit(1e4))), "evidence")

    wet = flags.select(*keys, ((F.col("model_water") | F.col("optical_water") | F.col("radar_water")) & F.col("gate_water")).alias("mask"))
    water = materialise(morphology.clean(wet, "mask", w, h, grid.pixel_ha, r.min_blob_ha), "water")
    dry = flags.join(water.withColumn("wet", F.lit(True)), keys, "left")
    bare = dry.select(*keys, ((F.col("optical_change") | F.col("radar_change")) & F.col("gate_debris") & F.col("wet").isNull()).alias("mask"))
    changed = materialise(morphology.clean(bare, "mask", w, h, grid.pixel_ha, r.min_blob_ha), "changed")

    river = flags.where("hand0 <= 1").select(*keys)
    water, changed = morphology.in_corridor(water, changed, flags.where("model_water").select(*keys), river, w, h, grid.res, r.corridor_m)
    water, changed = materialise(water, "water"), materialise(changed, "changed")
    ground = flags.select(*keys, F.col("hand0").alias("hand"), F.coalesce("slope", F.lit(90.0)).alias("slope"), "seen", "optical_change")
    if complete:
        added = morphology.complete_with_terrain(water.union(changed).distinct(), ground, w, h, grid.res)
        unseen = ground.where("not (seen and not optical_change)").select(*keys)
        added = materialise(added.join(unseen, keys, "left_semi"), "added")
    else:
        added = water.limit(0)
    everything = materialise(changed.union(added).union(water).distinct(), "affected")
    floor = morphology.channel(everything, ground, w, h, grid.res, r.channel_hand)

    mark = lambda df, name: df.select(*keys).distinct().withColumn(name, F.lit(True))
    met = flags
    for df, name in ((water, "is_water"), (changed.union(added), "is_changed"), (floor, "is_channel"), (added, "terrain_completed")):
        met = met.join(mark(df, name), keys, "left").withColumn(name, F.coalesce(name, F.lit(False)))
    classed = met.withColumn("cls", E.class_of(F.col("is_changed"), F.col("is_water"), F.col("is_channel")))
    conf = E.confidence(F.col("cls"), F.col("optical_change") | F.col("optical_water"), F.col("radar_change"), F.col("model_water"))
    return classed.select(*keys, "cls", conf.alias("conf"), F.col("seen").alias("optical_seen"), "optical_change", "optical_water", "radar_change", "radar_water", "model_water", "terrain_completed")


def assess(classes: DataFrame, grid: GridSpec, buildings: DataFrame, roads: DataFrame, bridges: DataFrame, health: DataFrame, places: DataFrame) -> dict[str, DataFrame]:
    """Status of every feature, and the totals. Buildings: id, ring, cx, cy; roads and bridges: id, (part,) coords; points: id, px, py."""
    affected = materialise(classes.where("cls > 0").select("x", "y"), "affected")
    near = {n: materialise(morphology.dilate(affected, n, grid.width, grid.height), "near") for n in sorted({1, 2, 3, max(1, round(20 / grid.res))})}
    zones = zonal.polygon_pixels(buildings, grid)
    out = {"buildings": zonal.zone_status(zones, buildings.select("id", "cx", "cy"), affected, near[1], grid)}
    samples = zonal.sample(zonal.road_samples(roads), affected, grid, "px", "py", "hit")
    samples = materialise(zonal.sample(samples, near[max(1, round(20 / grid.res))], grid, "px", "py", "near"), "samples")
    out["roads"], out["stretches"] = zonal.road_status(roads, samples), zonal.stretches(samples)
    out["bridges"] = zonal.bridge_status(bridges, near[3], grid)
    out["health"], out["places"] = (zonal.point_status(p, affected, near[2], grid) for p in (health, places))
    out = {name: materialise(df, name) for name, df in out.items()}
    out["stats"] = damage_stats(out, classes, grid)
    return out


def damage_stats(layers: dict[str, DataFrame], classes: DataFrame, grid: GridSpec) -> DataFrame:
    """One row of counts, kilometres and areas."""
    has = lambda s: F.count_if(F.col("status") == s)
    km = lambda c: F.bround(F.coalesce(F.sum(c), F.lit(0)) / 1000, 2)
    km2 = lambda c: F.bround(F.count_if(c) * grid.res * grid.res / 1e6, 3)
    parts = [
        layers["buildings"].agg(has("hit").alias("buildings_hit"), has("possibly hit").alias("buildings_possibly_hit"), F.count("*").alias("buildings_total")),
        layers["roads"].agg(has("cut").alias("roads_cut"), km(F.when(F.col("status") == "cut", F.col("affected_m"))).alias("roads_blocked_km"), km("affected_m").alias("roads_affected_km")),
        layers["bridges"].agg(has("at risk").alias("bridges_at_risk"), F.count("*").alias("bridges_total")),
        layers["health"].agg(has("hit").alias("health_hit"), has("possibly hit").alias("health_near"), F.count("*").alias("health_total")),
        layers["places"].agg(has("hit").alias("places_hit"), has("possibly hit").alias("places_near")),
        classes.agg(km2(F.col("cls") > 0).alias("affected_km2"), km2(F.col("cls") == 1).alias("water_km2"), km2(F.col("cls") == 2).alias("debris_km2")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.crossJoin(part)  # one row each
    return out


def access(roads: DataFrame, road_status: DataFrame, bridge_status: DataFrame, targets: DataFrame, settlements: DataFrame) -> dict[str, DataFrame]:
    """Access of settlements (sid, px, py) to targets (target, tid, px, py) by roads (road, osm_id, highway, bridge, name, coords)."""
    flagged = materialise(network.cut_roads(roads, road_status, bridge_status), "roads")
    cars, walk = materialise(network.road_edges(flagged), "edges"), materialise(network.road_edges(flagged, foot=True), "edges")

    def nodes(edges: DataFrame) -> DataFrame:
        named = edges.select(F.col("u").alias("tid")).union(edges.select("v")).distinct()
        xy = F.split("tid", ",")
        return named.select("tid", F.get(xy, F.lit(0)).cast("double").alias("px"), F.get(xy, F.lit(1)).cast("double").alias("py"))

    def snapped(points: DataFrame, key: str) -> DataFrame:
        asked = points.select(F.col(key).alias("qid"), "px", "py")
        on_road = zonal.nearest_point(asked, nodes(cars), network.SNAP_M).select(F.col("qid").alias(key), F.col("tid").alias("node"))
        on_foot = zonal.nearest_point(asked, nodes(walk), network.SNAP_M).select(F.col("qid").alias(key), F.col("tid").alias("foot_node"))
        return points.join(merged(on_road), key, "left").join(merged(on_foot), key, "left")

    to = snapped(targets, "tid").select("target", "node", "foot_node")
    settled = materialise(network.access(cars, walk, flagged, to, snapped(settlements, "sid").select("sid", "node", "foot_node")), "settlements")
    return {"settlements": settled, "cut_edges": network.cut_edges(cars, flagged), "stats": network.access_counts(settled)}


def trace(pixels: DataFrame, start: tuple[int, int], places: DataFrame, grid: GridSpec, most_km: float = 70.0, near_m: float = 400.0, most_height: float = 60.0) -> dict[str, DataFrame]:
    """Where water from a pixel flows, and the named places near that path and not far above it.

    ``pixels``: x, y, dem; ``places``: pid, name, px, py. Further windows continue from the path's last cell.
    """
    filled = hydro.fill_depressions(pixels.withColumn("basin", F.lit(0).cast("long")), "dem").select("x", "y", F.col("filled").alias("z"))
    flow = hydro.flow_direction(materialise(filled, "filled"), "z")
    cell = F.col("y").cast("long") * (1 << 32) + F.col("x")
    begin = pixels.where(f"x = {start[0]} and y = {start[1]}").select(F.lit(0).cast("long").alias("id"), cell.alias("cell"))
    path = hydro.walk(materialise(flow, "flow"), begin, int(most_km * 1000 / grid.res) + 1)
    x, y = F.col("cell") % (1 << 32), F.floor(F.col("cell") / (1 << 32))
    mx, my = grid.centre(x, y)
    line = path.select("step", x.cast("int").alias("x"), y.cast("int").alias("y"), mx.alias("mx"), my.alias("my")).join(merged(pixels.select("x", "y", "dem")), ["x", "y"])
    # A path of one window is a bounded sequence; its length is a running sum over it.
    w = Window.orderBy("step")
    leg = F.coalesce(F.hypot(F.col("mx") - F.lag("mx").over(w), F.col("my") - F.lag("my").over(w)), F.lit(0.0))
    line = line.withColumn("leg", leg).withColumn("metres", F.sum("leg").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    line = materialise(line.withColumn("nx", F.lead("mx").over(w)).withColumn("ny", F.lead("my").over(w)).withColumn("next_dem", F.lead("dem").over(w)), "line")
    a, b = F.struct(F.col("mx").alias("x"), F.col("my").alias("y")), F.struct(F.col("nx").alias("x"), F.col("ny").alias("y"))
    away, along = zonal.point_segment(F.col("px"), F.col("py"), a, b)
    # Places meet the path's segments by cells of near_m.
    size = float(near_m)
    spread = lambda c: F.explode(F.sequence(F.floor((F.col(c) - size) / size), F.floor((F.col(c) + size) / size)))
    asked = places.where("name is not null").select("*", spread("px").alias("cx")).select("*", spread("py").alias("cy"))
    legs = line.where("nx is not null").select("*", F.floor(F.col("mx") / size).alias("cx"), F.floor(F.col("my") / size).alias("cy"))
    met = asked.join(legs, ["cx", "cy"]).select("pid", "name", "px", "py", away.alias("away"), (F.col("metres") + along).alias("s"), F.when(along > 0, F.col("next_dem")).otherwise(F.col("dem")).alias("river"))
    best = met.where(F.col("away") <= near_m).groupBy("pid", "name", "px", "py").agg(F.min(F.struct("away", "s", "river")).alias("b")).select("pid", "name", "px", "py", "b.*")
    ground = pixels.select(F.col("x").alias("gx"), F.col("y").alias("gy"), F.col("dem").alias("ground"))
    high = best.join(merged(ground), (grid.column_of(F.col("px")) == F.col("gx")) & (grid.row_of(F.col("py")) == F.col("gy"))).withColumn("height", F.col("ground") - F.col("river"))
    found = high.where(F.col("height") <= most_height).select(
        "name", F.bround(F.col("s") / 1000, 1).alias("km_downstream"), F.bround(F.greatest("height", F.lit(0.0)), 0).alias("height_above_river_m"),
        F.when(F.col("height") <= 20, "directly in the path").otherwise("possibly in the path").alias("exposure"),
    )
    return {"line": line.select("step", "mx", "my", (F.col("metres") / 1000).alias("km")), "settlements": found.orderBy("km_downstream", "name")}


def feature_stack(post_vv: Column, post_vh: Column, pre_vv: Column, pre_vh: Column, slope: Column, rel: Column) -> dict[str, Column]:
    """The model's eight scaled channels; no data is 0."""
    pv, ph, qv, qh = (S.decibel(c) for c in (post_vv, post_vh, pre_vv, pre_vh))
    channels = {
        "post_vv": (pv + 15) / 6, "post_vh": (ph + 22) / 6, "pre_vv": (qv + 15) / 6, "pre_vh": (qh + 22) / 6,
        "d_vv": (pv - qv) / 3, "d_vh": (ph - qh) / 3, "slope": slope / 20, "rel": S.clip(rel / 40, 0.0, 4.0),
    }
    return {name: F.coalesce(c, F.lit(0.0)) for name, c in channels.items()}


def rule_flood() -> Column:
    """The radar rule on scaled channels: dark now, and much darker than before."""
    pv, ph = F.col("post_vv") * 6 - 15, F.col("post_vh") * 6 - 22
    dark = (pv <= -15) & (ph <= -22)
    return F.when(dark & ((F.col("d_vv") * 3 <= -3) | (F.col("d_vh") * 3 <= -3)), 2).otherwise(0)


#: A model gets an array (channels, tile, tile) and gives class probabilities (classes, tile, tile).
Model = Callable[[np.ndarray], np.ndarray]
#: The model that this worker holds.
_MODELS: dict[str, Model] = {}


def tile_starts(size: int, tile: int, overlap: int) -> list[int]:
    """Where tiles begin: every step, and one against the far edge."""
    if size <= tile:
        return [0]
    steps = list(range(0, size - tile + 1, tile - overlap))
    return steps if steps[-1] == size - tile else [*steps, size - tile]


def predict_tiles(pixels: DataFrame, channels: list[str], width: int, height: int, load: Callable[[], Model], tile: int = 512, overlap: int = 64, flip: bool = True) -> DataFrame:
    """Class probabilities of every pixel by sliding tiles, blended by tent weights.

    A tile's pixels meet in one task. A worker loads a model once and keeps it for its other tiles. ``load`` must be picklable.
    """
    name_of_model = f"{load.__module__}.{load.__qualname__}-{uuid.uuid4().hex}"
    starts = lambda n: F.array(*[F.lit(s) for s in tile_starts(n, tile, overlap)])
    inside = lambda name, n: F.filter(starts(n), lambda s: (s <= F.col(name)) & (F.col(name) < s + tile))
    spread = pixels.select("x", "y", *channels, F.explode(inside("x", width)).alias("tx"), inside("y", height).alias("tys")).select("x", "y", *channels, "tx", F.explode("tys").alias("ty"))
    names = list(channels)

    def run(key, frame):
        if name_of_model not in _MODELS:
            _MODELS.clear()
            _MODELS[name_of_model] = load()
        model = _MODELS[name_of_model]
        block = np.zeros((len(names), tile, tile), np.float32)
        xs, ys = frame["x"].to_numpy() - key[0], frame["y"].to_numpy() - key[1]
        for k, name in enumerate(names):
            block[k, ys, xs] = frame[name].to_numpy()
        p = model(block)
        if flip:
            p = (p + model(np.ascontiguousarray(block[..., ::-1]))[..., ::-1]) / 2
        ramp = np.minimum(np.arange(tile) + 1, np.arange(tile)[::-1] + 1).astype(float)
        weight = np.minimum(np.minimum.outer(ramp, ramp) / max(overlap // 2, 1), 1.0)
        out = frame[["x", "y"]].copy()
        out["p"] = list(p[:, ys, xs].T.astype(float))
        out["w"] = weight[ys, xs]
        return out

    made = spread.groupBy("tx", "ty").applyInPandas(run, "x int, y int, p array<double>, w double")
    flat = made.select("x", "y", "w", F.posexplode("p").alias("cls", "p"))
    blend = flat.groupBy("x", "y", "cls").agg((F.sum(F.col("p") * F.col("w")) / F.greatest(F.sum("w"), F.lit(1e-6))).alias("p"))
    return blend


def load_onnx(path: str) -> Model:
    """A model from a file on the executors, by onnxruntime; loaded where it is called."""
    import onnxruntime

    session = onnxruntime.InferenceSession(path, providers=["CPUExecutionProvider"])
    name = session.get_inputs()[0].name

    def model(block: np.ndarray) -> np.ndarray:
        z = session.run(None, {name: block[None]})[0][0]
        e = np.exp(z - z.max(axis=0))
        return e / e.sum(axis=0)

    return model


def report_lists(settled: DataFrame, names: DataFrame, stretches: DataFrame, roads: DataFrame) -> dict[str, DataFrame]:
    """Tables of the situation report: settlements cut off by minutes before, and blocked roads by length."""
    minutes = F.coalesce(F.nullif("hospital_min_before", F.lit(0)), F.lit(999))
    cut = settled.where("status = 'cut_off'").join(names, "sid", "left").select("name", "hospital_min_before", "hospital_on_foot_min", minutes.alias("rank")).orderBy("rank", "name").limit(10)
    road = F.coalesce(F.nullif("name", F.lit("")), F.nullif("ref", F.lit("")), F.concat(F.lit("unnamed "), F.coalesce("highway", F.lit("road"))))
    blocked = stretches.where("blocks").join(roads, "id").groupBy(road.alias("road")).agg(F.count("*").alias("n"), (F.sum("length_m") / 1000).alias("km")).orderBy(F.desc("km"), "road").limit(5)
    return {"cut_off": cut, "blocked": blocked}


def report_html(title: str, stats: dict, lists: dict[str, DataFrame]) -> str:
    """The report as HTML: it takes tables of a few rows only."""
    import html

    show = lambda v: "—" if v is None else f"{v:,.2f}" if isinstance(v, float) else f"{v:,}" if isinstance(v, int) else html.escape(str(v))
    rows = "".join(f"<tr><td>{html.escape(k)}</td><td>{show(v)}</td></tr>" for k, v in stats.items())
    parts = [f"<h1>{html.escape(title)}</h1><table>{rows}</table>"]
    for name, df in lists.items():
        body = "".join("<tr>" + "".join(f"<td>{show(v)}</td>" for v in r) + "</tr>" for r in df.collect())
        parts.append(f"<h2>{html.escape(name)}</h2><table>{body}</table>")
    return "<!doctype html><meta charset=utf-8>" + "".join(parts)


def analyse(
    pixels: DataFrame, tracks: DataFrame, grid: GridSpec, buildings: DataFrame, roads: DataFrame, bridges: DataFrame, health: DataFrame, places: DataFrame, targets: DataFrame
) -> dict[str, DataFrame]:
    """Detector, damage and access of an area, the report's lists and one row of figures.

    Features are as in ``assess``; roads have highway, bridge, name and ref besides, and are known by their id to
    ``access``; places (id, name, px, py) are the settlements; targets: target, tid, px, py.
    """
    classes = materialise(detect(pixels, tracks, grid), "classes")
    damage = assess(classes, grid, buildings, roads, bridges, health, places)
    status = lambda df: df.select(F.col("id").alias("osm_id"), "status")
    ways = roads.select(F.col("id").alias("road"), F.col("id").alias("osm_id"), "highway", "bridge", "name", "coords")
    reached = access(ways, status(damage["roads"]), status(damage["bridges"]), targets, places.select(F.col("id").alias("sid"), "px", "py"))
    lists = report_lists(reached["settlements"], places.select(F.col("id").alias("sid"), "name"), damage["stretches"], roads.select("id", "name", "ref", "highway"))
    kinds = ["radar_change", "radar_water", "optical_change", "optical_water", "model_water", "terrain_completed"]
    areas = E.evidence_areas(classes, kinds, grid.res * grid.res).groupBy().pivot("evidence", kinds).agg(F.bround(F.first("km2"), 2))
    stats = damage["stats"].crossJoin(reached["stats"].select(*[F.col(c).alias(f"access_{c}") for c in reached["stats"].columns]))  # one row each
    stats = stats.crossJoin(areas.select(*[F.col(c).alias(f"{c}_km2") for c in kinds]))
    affected = damage["buildings"].where(F.col("status") != zonal.OUTSIDE)
    layers = {"classes": classes, "buildings_affected": affected, "settlements": reached["settlements"], "cut_roads": reached["cut_edges"]}
    return layers | {n: damage[n] for n in ("buildings", "roads", "stretches", "bridges", "health", "places")} | lists | {"stats": stats}


def execute(spark: SparkSession, folder: str, name: str, box: tuple[float, float, float, float], date: str, progress: Callable[[str, float], None] | None = None, **scene) -> dict:
    """An analysis (see ``analyse``) written as a bundle: layers, report, steps and, last, the metadata that marks it as done."""
    began, steps = time.time(), []

    def say(message: str, share: float) -> None:
        steps.append({"t": round(time.time() - began, 1), "msg": message})
        if progress:
            progress(message, share)

    say("Detector, damage and access", 0.05)
    out = analyse(**scene)
    stats = out.pop("stats").first().asDict()
    say(f"{stats['affected_km2']} km2 affected, {stats['buildings_hit']} buildings hit, {stats['access_cut_off']} settlements cut off", 0.9)
    lists = {k: out.pop(k) for k in ("cut_off", "blocked")}
    write_bundle(out, f"{folder}/layers")
    say("Writing the situation report", 0.97)
    write_text(spark, f"{folder}/sitrep.html", report_html(name, stats, lists))
    write_text(spark, f"{folder}/stats.json", json.dumps(stats))
    write_text(spark, f"{folder}/steps.json", json.dumps(steps))
    made = datetime.datetime.now(datetime.UTC).isoformat(timespec="seconds")
    meta = {"id": folder.rstrip("/").rpartition("/")[2], "name": name, "bbox": list(box), "date": date, "created": made, "seconds": round(time.time() - began, 1), "model": None}
    write_text(spark, f"{folder}/meta.json", json.dumps(meta))
    say("Done", 1.0)
    return meta | {"stats": stats}


def pixels_of(arrays: dict[str, np.ndarray], spark: SparkSession) -> DataFrame:
    """A pixel table of in-memory bands, NaN as NULL; for small rasters and tests."""
    h, w = next(iter(arrays.values())).shape
    y, x = np.divmod(np.arange(h * w), w)
    bands = {n: pa.array(np.where(np.isfinite(a.ravel().astype(float)), a.ravel().astype(float), np.nan), from_pandas=True) for n, a in arrays.items()}
    return spark.createDataFrame(pa.table({"x": pa.array(x, pa.int32()), "y": pa.array(y, pa.int32())} | bands))


def radar_features(obs: DataFrame, width: int, height: int, res: float) -> DataFrame:
    """Box-filtered power of one polarisation (x, y, pass, phase, power), a row for each pass: input of the change score."""
    passes: list[DataFrame] = []
    for row in obs.select("pass", "phase").distinct().collect():  # a stack has four passes at most
        one = obs.where(F.col("pass") == row["pass"]).select("x", "y", S.positive("power").alias("power"))
        passes.append(focal.box_mean(one, width, height, "power").select("x", "y", F.lit(row["pass"]).alias("pass"), F.lit(row["phase"]).alias("phase"), F.col("mean").alias("power")))
    out = passes[0]
    for p in passes[1:]:
        out = out.union(p)
    return out


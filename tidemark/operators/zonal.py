"""Vector features against a raster mask: samples, zones, roads, bridges and points.

Geometries are arrays of (x, y) structs in grid metres. Points of a line are made by exploding sample
numbers, and every lookup is an equi-join on pixel (x, y), so Catalyst is free to broadcast or to shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.grid import GridSpec
from tidemark.session import materialise, merged

HIT, POSSIBLE, OUTSIDE = "hit", "possibly hit", "outside"
#: Fixed values of the road rules.
STEP_M, CUT_M, NEAR_M = 5.0, 20.0, 20.0


def sample(points: DataFrame, mask: DataFrame, grid: GridSpec, px: str, py: str, name: str) -> DataFrame:
    """``points`` with a flag of whether its pixel is in ``mask``; outside of the grid it isn't."""
    keyed = points.withColumn("_x", grid.column_of(F.col(px))).withColumn("_y", grid.row_of(F.col(py)))
    on = mask.select(F.col("x").alias("_x"), F.col("y").alias("_y"), F.lit(True).alias(name)).distinct()
    return keyed.join(on, ["_x", "_y"], "left").withColumn(name, F.coalesce(name, F.lit(False))).drop("_x", "_y")


def status_of_share(share: Column, near: Column) -> Column:
    return F.when(share >= 0.5, HIT).when((share > 0) | near, POSSIBLE).otherwise(OUTSIDE)


def zone_status(zone_pixels: DataFrame, zones: DataFrame, affected: DataFrame, near: DataFrame, grid: GridSpec) -> DataFrame:
    """id, share and status of zones (id, cx, cy); of pixels that several zones hold the last id has them.

    A zone that others hide wholly is judged by its centre.
    """
    owned = zone_pixels.groupBy("x", "y").agg(F.max("id").alias("id"))
    flag = lambda mask, name: mask.select("x", "y", F.lit(1).alias(name)).distinct()
    met = owned.join(flag(affected, "a"), ["x", "y"], "left").join(flag(near, "n"), ["x", "y"], "left")
    sums = met.groupBy("id").agg(F.count("*").alias("total"), F.count("a").alias("inside"), F.count("n").alias("close"))
    centred = sample(sample(zones, affected, grid, "cx", "cy", "c_hit"), near, grid, "cx", "cy", "c_near")
    share = F.when(F.col("total").isNull(), F.col("c_hit").cast("double")).otherwise(F.col("inside") / F.col("total"))
    close = F.when(F.col("total").isNull(), F.col("c_near")).otherwise(F.col("close") > 0)
    return centred.join(sums, "id", "left").select("id", F.bround(share, 2).alias("affected_frac"), status_of_share(share, close).alias("status"))


def rectangle_pixels(zones: DataFrame, grid: GridSpec) -> DataFrame:
    """Pixels that axis-aligned rectangles (id, x0, y0, x1, y1) touch."""
    xs = F.sequence(F.floor((F.col("x0") - grid.left) / grid.res), F.ceil((F.col("x1") - grid.left) / grid.res) - 1).cast("array<int>")
    ys = F.sequence(F.floor((grid.top - F.col("y1")) / grid.res), F.ceil((grid.top - F.col("y0")) / grid.res) - 1).cast("array<int>")
    cells = zones.select("id", F.explode(xs).alias("x"), ys.alias("ys")).select("id", "x", F.explode("ys").alias("y"))
    return cells.where(f"x between 0 and {grid.width - 1} and y between 0 and {grid.height - 1}")


def polygon_pixels(polygons: DataFrame, grid: GridSpec, ring: str = "ring", closed: bool = True, where: Column | None = None) -> DataFrame:
    """id, x and y of the pixels that polygons (id, ring: array of x, y) touch: in Arrow batches, a cell is touched if an edge
    crosses it or its centre lies inside. ``closed`` False takes the ring as a line; ``where`` is which features count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, points in zip(batch.column("id").to_pylist(), batch.column("ring").to_pylist(), strict=True):
                if not points:
                    continue
                px = (np.array([p["x"] for p in points]) - grid.left) / grid.res
                py = (grid.top - np.array([p["y"] for p in points])) / grid.res
                rows = list(touched_rows(px, py, grid.width, grid.height, closed))
                if rows:
                    y = np.repeat([row for row, _ in rows], [len(columns) for _, columns in rows])
                    x = np.concatenate([columns for _, columns in rows])
                    yield pa.record_batch({"id": pa.array([key] * len(x), pa.int64()), "x": pa.array(x, pa.int32()), "y": pa.array(y, pa.int32())})

    chosen = polygons if where is None else polygons.where(where)
    return chosen.select("id", F.col(ring).alias("ring")).mapInArrow(run, "id long, x int, y int")


def line_pixels(lines: DataFrame, grid: GridSpec, where: Column | None = None) -> DataFrame:
    """id, x and y of the pixels that lines (id, coords) touch, of those features only that ``where`` takes."""
    return polygon_pixels(lines, grid, "coords", closed=False, where=where)


def touched_rows(px: np.ndarray, py: np.ndarray, width: int, height: int, closed: bool = True) -> Iterator[tuple[int, np.ndarray]]:
    """(row, columns) of the cells that a ring in pixel units touches, or a line if not ``closed``. A single point is its cell."""
    if len(px) == 1:
        px, py = np.append(px, px), np.append(py, py)
    if closed and (px[0], py[0]) != (px[-1], py[-1]):
        px, py = np.append(px, px[0]), np.append(py, py[0])
    ax, ay, bx, by = px[:-1], py[:-1], px[1:], py[1:]
    for row in range(max(0, int(np.floor(py.min()))), min(height - 1, int(np.floor(py.max()))) + 1):
        spans: list[tuple[float, float]] = []
        # Edges within the row's band: the columns between where they enter and leave it.
        low, high = np.minimum(ay, by), np.maximum(ay, by)
        for k in np.flatnonzero((low <= row + 1) & (high >= row)):
            if ay[k] == by[k]:
                ends = (ax[k], bx[k])
            else:
                t = np.clip((np.array([row, row + 1]) - ay[k]) / (by[k] - ay[k]), 0, 1)
                ends = ax[k] + t * (bx[k] - ax[k])
            spans.append((np.floor(min(ends)), np.floor(max(ends))))
        # Inside by the even-odd rule at the row's middle.
        mid = row + 0.5
        cross = ((ay <= mid) != (by <= mid)) & closed
        at = np.sort(ax[cross] + (mid - ay[cross]) / (by[cross] - ay[cross]) * (bx[cross] - ax[cross]))
        for a, b in zip(at[0::2], at[1::2], strict=False):
            spans.append((np.ceil(a - 0.5), np.floor(b - 0.5)))
        # Where more spans begin than have ended, clipped to the grid.
        edge = np.zeros(width + 1, np.int64)
        for low_x, high_x in spans:
            if low_x <= high_x and high_x >= 0 and low_x < width:
                edge[max(0, int(low_x))] += 1
                edge[min(width, int(high_x) + 1)] -= 1
        columns = np.flatnonzero(np.cumsum(edge)[:-1] > 0).astype(np.int32)
        if len(columns):
            yield row, columns


def segments(lines: DataFrame, *keep: str) -> DataFrame:
    """seq, a, b, length and start (length before it) of the segments of lines (coords: array of x, y)."""
    pairs = F.transform(
        F.sequence(F.lit(0), F.size("coords") - 2), lambda i: F.struct(i.alias("seq"), F.get("coords", i).alias("a"), F.get("coords", i + 1).alias("b"))
    )
    many = lines.where(F.size("coords") >= 2)
    exploded = many.select(*keep, F.explode(pairs).alias("s")).select(*keep, "s.*")
    return exploded.withColumn("length", F.hypot(F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y")))


def line_length(coords: str | Column) -> Column:
    c = F.col(coords) if isinstance(coords, str) else coords
    steps = F.zip_with(F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c) - 1), lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"]))
    return F.when(F.size(c) >= 2, F.aggregate(steps, F.lit(0.0), lambda acc, d: acc + d)).otherwise(0.0)


def points_along(lines: DataFrame, n: Column, *keep: str) -> DataFrame:
    """i, px and py of the n + 1 points at equal steps along lines that have a length; ``keep`` are the lines' keys.

    Every segment makes the points that lie on it: a point where two meet belongs to the first of them.
    """
    before = Window.partitionBy(*keep).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    measured = lines.withColumn("_len", line_length("coords")).where("_len > 0").withColumn("_n", n)
    legs = segments(measured, *keep, "_len", "_n").where("length > 0").withColumn("start", F.coalesce(F.sum("length").over(before), F.lit(0.0)))
    step = F.col("_len") / F.col("_n")
    end = F.col("start") + F.col("length")
    # A step more on either side, so that no rounding leaves a point out; the comparison decides.
    numbers = F.sequence(F.greatest(F.floor(F.col("start") / step) - 1, F.lit(0)), F.least(F.ceil(end / step) + 1, F.col("_n")))
    made = legs.select("*", F.explode(numbers).alias("i")).withColumn("_at", F.col("i") / F.col("_n") * F.col("_len"))
    here = made.where((F.col("_at") <= end) & ((F.col("_at") > F.col("start")) | (F.col("start") == 0)))
    t = F.greatest(F.least((F.col("_at") - F.col("start")) / F.col("length"), F.lit(1.0)), F.lit(0.0))
    on = lambda c: (F.col(f"a.{c}") + t * (F.col(f"b.{c}") - F.col(f"a.{c}"))).alias(f"p{c}")
    return here.select(*keep, "_len", F.col("i").cast("int").alias("i"), on("x"), on("y"))


def road_samples(roads: DataFrame, step_m: float = STEP_M) -> DataFrame:
    """Samples every ``step_m`` of roads (id, part, coords); n + 1 of them, each standing for length / (n + 1)."""
    n = F.greatest(F.floor(F.col("_len") / step_m), F.lit(1))
    return points_along(roads, n, "id", "part").select("id", "part", "i", "px", "py", (F.col("_len") / (n + 1)).alias("share_m"))


def runs_of_hits(samples: DataFrame) -> DataFrame:
    """Maximal runs of consecutive hits of each (id, part): gaps and islands."""
    hits = samples.where("hit").withColumn("island", F.expr("i - row_number() over (partition by id, part order by i)"))
    return hits.groupBy("id", "part", "island").agg(F.min("i").alias("first"), F.count("*").alias("n"), (F.count("*") * F.first("share_m")).alias("run_m"))


def road_status(roads: DataFrame, samples: DataFrame, cut_m: float = CUT_M) -> DataFrame:
    """id, status, length_m and affected_m of every road; ``samples`` has hit and near. A road without length stays, outside."""
    runs = runs_of_hits(samples).groupBy("id").agg(F.max("run_m").alias("longest"))
    sums = samples.groupBy("id").agg(F.sum(F.when(F.col("hit"), F.col("share_m")).otherwise(0.0)).alias("inside"), F.bool_or("near").alias("close"))
    length = roads.groupBy("id").agg(F.sum(line_length("coords")).alias("length"))
    status = F.when(F.col("longest") >= cut_m, "cut").when(F.col("inside") > 0, "touched").when(F.coalesce("close", F.lit(False)), "near").otherwise(OUTSIDE)
    return length.join(sums, "id", "left").join(runs, "id", "left").select(
        "id", status.alias("status"), F.bround("length").cast("long").alias("length_m"), F.bround(F.coalesce("inside", F.lit(0.0))).cast("long").alias("affected_m")
    )


def stretches(samples: DataFrame, cut_m: float = CUT_M) -> DataFrame:
    """Runs of two samples at least, with whether they block the road."""
    return runs_of_hits(samples).where("n >= 2").select("id", "part", "first", "n", F.bround("run_m").cast("long").alias("length_m"), (F.col("run_m") >= cut_m).alias("blocks"))


def bridge_status(bridges: DataFrame, near: DataFrame, grid: GridSpec) -> DataFrame:
    """id and status of bridges (id, coords): nine samples of a line, or the point; at risk if any is near."""
    lines = points_along(bridges, F.lit(8).cast("long"), "id").select("id", "px", "py")
    points = bridges.where((F.size("coords") > 0) & (line_length("coords") == 0)).select("id", F.col("coords")[0]["x"].alias("px"), F.col("coords")[0]["y"].alias("py"))
    met = sample(lines.union(points), near, grid, "px", "py", "hit").groupBy("id").agg(F.bool_or("hit").alias("hit"))
    return bridges.select("id").join(met, "id", "left").select("id", F.when(F.coalesce("hit", F.lit(False)), "at risk").otherwise(OUTSIDE).alias("status"))


def point_status(points: DataFrame, affected: DataFrame, near: DataFrame, grid: GridSpec) -> DataFrame:
    """``points`` (px, py) with their status."""
    met = sample(sample(points, affected, grid, "px", "py", "_hit"), near, grid, "px", "py", "_near")
    return met.withColumn("status", F.when(F.col("_hit"), HIT).when(F.col("_near"), POSSIBLE).otherwise(OUTSIDE)).drop("_hit", "_near")


#: Targets that share a cell, on average, where the search for the nearest begins; cells double from there.
CELL_TARGETS = 2.0
#: Times that the cells may double.
LEVELS = 12


def first_cell(targets: DataFrame, most: float) -> int:
    """How often ``most`` is halved for the cells to begin with: the least so that a target shares its cell with few others. One row comes back."""
    sizes = F.explode(F.array(*[F.lit(k) for k in range(LEVELS)])).alias("k")
    side = lambda c: F.floor(F.col(c) / (F.lit(float(most)) / F.pow(F.lit(2.0), F.col("k"))))
    held = targets.select("px", "py", sizes).groupBy("k", side("px").alias("cx"), side("py").alias("cy")).agg(F.count("*").alias("n"))
    load = held.groupBy("k").agg((F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("load"))
    return load.agg(F.coalesce(F.min(F.when(F.col("load") <= 1 + CELL_TARGETS, F.col("k"))), F.lit(LEVELS - 1)).alias("k")).head()["k"]


def nearest_point(queries: DataFrame, targets: DataFrame, most: float) -> DataFrame:
    """qid and the nearest target (tid, distance) no further than ``most``; of equal distances the lowest tid.

    Targets of one place are one. They stand in square cells and those around, so that a query meets them by its own cell;
    what lies no further than a cell's side is the nearest. Queries without one go on with cells of twice that side, up to
    ``most``: first cells hold a few targets, and those who need larger ones are few, or far from all of them.
    """
    places = materialise(targets.where("px is not null and py is not null").groupBy("px", "py").agg(F.min("tid").alias("tid")), "targets")
    around = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])
    left, out = queries.select("qid", F.col("px").alias("qx"), F.col("py").alias("qy")), None
    for k in range(first_cell(places, most), -1, -1):
        side = float(most) / (1 << k)
        cell = lambda c, side=side: F.floor(F.col(c) / side)
        spread = places.select("tid", "px", "py", cell("px").alias("x"), cell("py").alias("y"), F.explode(around).alias("o"))
        near = spread.groupBy((F.col("x") + F.col("o.dx")).alias("cx"), (F.col("y") + F.col("o.dy")).alias("cy")).agg(F.collect_list(F.struct("tid", "px", "py")).alias("near"))
        met = left.withColumn("cx", cell("qx")).withColumn("cy", cell("qy")).join(merged(near), ["cx", "cy"], "left")
        found = F.transform("near", lambda t: F.struct(F.hypot(t["px"] - F.col("qx"), t["py"] - F.col("qy")).alias("distance"), t["tid"].alias("tid")))
        met = met.select("qid", "qx", "qy", F.array_min(found).alias("best"))
        met = materialise(met.withColumn("best", F.when(F.col("best.distance") <= side, F.col("best"))), "nearest")
        done = met.where("best is not null").select("qid", "best.tid", "best.distance")
        out, left = done if out is None else out.union(done), met.where("best is null").select("qid", "qx", "qy")
        if left.isEmpty():
            break
    # A qid may have stood at several places.
    return out.groupBy("qid").agg(F.min(F.struct("distance", "tid")).alias("best")).select("qid", "best.tid", "best.distance")


def near_lines(points: DataFrame, lines: DataFrame, most: float, cell: float = 50.0) -> DataFrame:
    """pid, id, away and along (metres from the line's start) of every point (pid, px, py) and each segment of a line (id,
    coords) within ``most`` of it. A segment stands in the cells that its box, widened by ``most``, meets; a point in its own."""
    before = Window.partitionBy("id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    parts = segments(lines, "id").withColumn("start", F.coalesce(F.sum("length").over(before), F.lit(0.0)))
    span = lambda c: F.explode(F.sequence(F.floor((F.least(f"a.{c}", f"b.{c}") - most) / cell), F.floor((F.greatest(f"a.{c}", f"b.{c}") + most) / cell)))
    there = parts.select("id", "a", "b", "start", span("x").alias("cx")).select("*", span("y").alias("cy"))
    asked = points.select("pid", "px", "py", F.floor(F.col("px") / cell).alias("cx"), F.floor(F.col("py") / cell).alias("cy"))
    away, along = point_segment(F.col("px"), F.col("py"), F.col("a"), F.col("b"))
    return asked.join(there, ["cx", "cy"]).select("pid", "id", away.alias("away"), (F.col("start") + along).alias("along")).where(F.col("away") <= most)


def point_segment(px: Column, py: Column, a: Column, b: Column) -> tuple[Column, Column]:
    """(distance, metres along the segment) of the point of a segment nearest to (px, py)."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    square = dx * dx + dy * dy
    t = F.coalesce(F.greatest(F.least(F.try_divide((px - a["x"]) * dx + (py - a["y"]) * dy, square), F.lit(1.0)), F.lit(0.0)), F.lit(0.0))
    return F.hypot(px - (a["x"] + t * dx), py - (a["y"] + t * dy)), t * F.sqrt(square)

"""Flow routing on a pixel table: depressions, D8 directions, accumulation, height above drainage, and walks.

Directions and walks are pointers from cell to cell, so everything that follows flow is pointer doubling: a
path of L cells takes log2(L) joins. Both sides of every join are rasters, so all of them are merge joins.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.morphology import shifted
from tidemark.session import materialise, merged

#: Direction codes and their (dx, dy), rows going down, in order of preference at equal slopes.
D8 = {64: (0, -1), 128: (1, -1), 1: (1, 0), 2: (1, 1), 4: (0, 1), 8: (-1, 1), 16: (-1, 0), 32: (-1, -1)}
BURN_MINOR, BURN_MAJOR = 10.0, 20.0


def burn(pixels: DataFrame) -> DataFrame:
    """Mapped rivers cut into the elevation, so that flow follows them; where both hold, both count."""
    depth = F.col("minor").cast("int") * BURN_MINOR + F.col("major").cast("int") * BURN_MAJOR
    return pixels.withColumn("burned", F.col("dem") - depth)


def fill_depressions(pixels: DataFrame, z: str, basin: str = "basin", epsilon: float = 1e-5) -> DataFrame:
    """Priority flood: every pit raised to its spill level plus a tiny slope, one basin at a time.

    The flood goes by one queue from the basin's edge and is sequential by nature, so a task holds a basin:
    ``basin`` has to be a bounded window, as it is for the windows this engine analyses.
    """

    def flood(pdf: pd.DataFrame) -> pd.DataFrame:
        height = {(x, y): h for x, y, h in zip(pdf["x"], pdf["y"], pdf[z], strict=True) if h == h}
        out, queue = {}, []
        for x, y in height:
            if any((x + dx, y + dy) not in height for dx, dy in D8.values()):
                heapq.heappush(queue, (height[x, y], x, y))
                out[x, y] = height[x, y]
        while queue:
            h, x, y = heapq.heappop(queue)
            for dx, dy in D8.values():
                at = (x + dx, y + dy)
                if at in height and at not in out:
                    out[at] = max(height[at], h + epsilon)
                    heapq.heappush(queue, (out[at], *at))
        return pdf.assign(filled=[out.get((x, y)) for x, y in zip(pdf["x"], pdf["y"], strict=True)])[["x", "y", basin, "filled"]]

    return pixels.select("x", "y", basin, z).groupBy(basin).applyInPandas(flood, f"x int, y int, {basin} long, filled double")


def flow_direction(pixels: DataFrame, z: str) -> DataFrame:
    """x, y, direction code (0: none lower) and the next cell, downhill by the steepest slope."""
    back = {(-dx, -dy): code for code, (dx, dy) in D8.items()}
    order = list(D8)
    # A cell offers its height to its neighbours; what they take is the steepest drop.
    offers = shifted(pixels.select("x", "y", F.col(z).alias("nz")), list(back), "nz")
    codes = F.create_map(*[F.lit(v) for (dx, dy), code in back.items() for v in (dx * 3 + dy, order.index(code))])
    offers = offers.select("x", "y", "nz", F.element_at(codes, F.col("move.dx") * 3 + F.col("move.dy")).alias("place"), F.sqrt((F.col("move.dx") * F.col("move.dx") + F.col("move.dy") * F.col("move.dy")).cast("double")).alias("far"))
    met = pixels.select("x", "y", F.col(z).alias("z")).join(merged(offers), ["x", "y"], "left").withColumn("drop", (F.col("z") - F.col("nz")) / F.col("far"))
    best = met.groupBy("x", "y").agg(F.max(F.when(F.col("drop") > 0, F.struct("drop", (-F.col("place")).alias("rank")))).alias("best"))
    place = -F.col("best.rank")
    pick = lambda values: F.coalesce(F.get(F.array(*[F.lit(v) for v in values]), place), F.lit(0))
    return best.select("x", "y", pick(order).alias("code"), (F.col("x") + pick([D8[c][0] for c in order])).alias("nx"), (F.col("y") + pick([D8[c][1] for c in order])).alias("ny"))


def keyed(flow: DataFrame) -> DataFrame:
    """cell and to: pixels as single numbers; to is NULL where flow ends or leaves the table."""
    cell = lambda x, y: F.col(y).cast("long") * (1 << 32) + F.col(x)
    cells = flow.select(cell("x", "y").alias("cell"), F.when(F.col("code") != 0, cell("nx", "ny")).alias("to"))
    inside = cells.select(F.col("cell").alias("to"), F.lit(True).alias("there"))
    return cells.join(merged(inside), "to", "left").select("cell", F.when(F.col("there"), F.col("to")).alias("to"))


def accumulation(flow: DataFrame) -> DataFrame:
    """cell and acc, the number of cells that drain through it, itself included.

    Doubling: in round k a cell has the sum over the cells up to 2^k steps above it; adding to each cell's
    2^k-th descendant the sum that stands there doubles the reach.
    """
    state = materialise(keyed(flow).select("cell", "to", F.lit(1).cast("long").alias("acc")), "acc")
    while not state.where("to is not null").isEmpty():
        sent = state.where("to is not null").groupBy(F.col("to").alias("cell")).agg(F.sum("acc").alias("more"))
        jump = state.select(F.col("cell").alias("to"), F.col("to").alias("next"))
        met = state.join(merged(jump), "to", "left").join(merged(sent), "cell", "left")
        state = materialise(met.select("cell", F.col("next").alias("to"), (F.col("acc") + F.coalesce("more", F.lit(0))).alias("acc")), "acc", state)
    return state.select("cell", "acc")


def drains_to(flow: DataFrame, stream: DataFrame) -> DataFrame:
    """cell and drain: the first stream cell along the flow; NULL if there is none. ``stream``: cell."""
    marked = keyed(flow).join(merged(stream.select("cell", F.lit(True).alias("is_stream")).distinct()), "cell", "left")
    state = materialise(marked.select("cell", F.when(F.col("is_stream"), F.col("cell")).alias("drain"), F.when(F.col("is_stream").isNull(), F.col("to")).alias("to")), "drains")
    while not state.where("to is not null").isEmpty():
        jump = state.select(F.col("cell").alias("to"), F.col("drain").alias("far"), F.col("to").alias("next"))
        state = materialise(state.join(merged(jump), "to", "left").select("cell", F.coalesce("drain", "far").alias("drain"), F.col("next").alias("to")), "drains", state)
    return state.select("cell", "drain")


def height_above_drainage(flow: DataFrame, stream: DataFrame, heights: DataFrame) -> DataFrame:
    """cell and hand: height above the stream cell reached. ``heights`` (cell, dem) are not the burned ones; beyond -1000 is no data."""
    low = heights.select(F.col("cell").alias("drain"), F.col("dem").alias("low"))
    down = drains_to(flow, stream).join(merged(heights), "cell").join(merged(low), "drain", "left")
    hand = F.col("dem") - F.col("low")
    return down.select("cell", F.when(hand >= -1000, hand).alias("hand"))


def terrain(pixels: DataFrame, minor_cells: float, major_cells: float) -> DataFrame:
    """x, y, acc, hand and hand_major of a pixel table (x, y, dem, and the mapped rivers minor and major).

    Mapped rivers are burned into the heights that flow follows and always count as streams; so does what drains
    enough cells. Heights above them are taken from the heights as they were. Pits are filled before, by windows.
    """
    cell = F.col("y").cast("long") * (1 << 32) + F.col("x")
    flow = materialise(flow_direction(burn(pixels), "burned"), "flow")
    acc = accumulation(flow)
    known = materialise(pixels.select(cell.alias("cell"), "x", "y", "dem", "minor", "major").join(merged(acc), "cell"), "terrain")
    heights = known.select("cell", "dem")
    out = known.select("cell", "x", "y", "acc")
    for name, mapped, least in (("hand", "minor", minor_cells), ("hand_major", "major", major_cells)):
        stream = known.where(F.coalesce(F.col(mapped), F.lit(False)) | (F.col("acc") >= least)).select("cell")
        out = out.join(merged(height_above_drainage(flow, stream, heights).withColumnRenamed("hand", name)), "cell", "left")
    return out.drop("cell")


def walk(flow: DataFrame, starts: DataFrame, most_steps: int) -> DataFrame:
    """id, step and cell of the paths from ``starts`` (id, cell), until flow ends or ``most_steps`` cells.

    In round k the 2^k cells known of a path are followed by the cells 2^k steps further on.
    """
    jump = materialise(keyed(flow), "jump")
    path = materialise(starts.join(merged(jump.select("cell")), "cell", "left_semi").select("id", F.lit(0).cast("long").alias("step"), "cell"), "walk")
    known = 1
    while known < most_steps:
        further = path.join(merged(jump.where("to is not null")), "cell").select("id", (F.col("step") + known).alias("step"), F.col("to").alias("cell"))
        grown = materialise(path.union(further.where(F.col("step") < most_steps)), "walk")
        if grown.where(F.col("step") >= known).isEmpty():
            break
        path, known = grown, known * 2
        far = jump.select(F.col("cell").alias("to"), F.col("to").alias("next"))
        jump = materialise(jump.join(merged(far), "to", "left").select("cell", F.col("next").alias("to")), "jump", jump)
    return path


def ends_near_edge(path: DataFrame, width: int, height: int) -> DataFrame:
    """id, n_cells and whether the path's last cell lies within two pixels of the window's edge."""
    last = path.groupBy("id").agg(F.max_by("cell", "step").alias("cell"), F.count("*").alias("n_cells"))
    x, y = F.col("cell") % (1 << 32), F.floor(F.col("cell") / (1 << 32))
    return last.select("id", "n_cells", ((y <= 1) | (x <= 1) | (y >= height - 2) | (x >= width - 2)).alias("near_edge"))


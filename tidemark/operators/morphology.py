"""Masks as sets of pixels: dilation, distances, connected components, cleaning and river rules."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.focal import majority
from tidemark.session import materialise


def shifted(mask: DataFrame, steps: list[tuple[int, int]], *keep: str) -> DataFrame:
    """Every pixel of ``mask`` at each of its offsets: a plain explode of a literal array."""
    moves = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in steps])
    return mask.select("x", "y", *keep, F.explode(moves).alias("m")).select(
        (F.col("x") + F.col("m.dx")).alias("x"), (F.col("y") + F.col("m.dy")).alias("y"), F.col("m").alias("move"), *keep
    )


def ball(mask: DataFrame, radius: int, manhattan: bool, *keep: str) -> DataFrame:
    """Every pixel of ``mask`` at each offset (dx, dy) within a Manhattan, or Euclidean, distance; offsets are made by sequences."""
    half = radius - F.abs("dx") if manhattan else F.floor(F.sqrt((radius * radius - F.col("dx") * F.col("dx")).cast("double"))).cast("int")
    rows = mask.select("x", "y", *keep, F.explode(F.sequence(F.lit(-radius), F.lit(radius))).alias("dx")).withColumn("half", half)
    spread = rows.select("x", "y", *keep, "dx", F.explode(F.sequence(-F.col("half"), F.col("half"))).alias("dy"))
    return spread.select((F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y"), "dx", "dy", *keep)


def dilate(mask: DataFrame, radius: int, width: int, height: int) -> DataFrame:
    """Pixels within ``radius`` crosswise steps of the mask. Only pixels with an unset neighbour are spread."""
    inner = shifted(mask.select("x", "y"), [(1, 0), (-1, 0), (0, 1), (0, -1)]).groupBy("x", "y").agg(F.count("*").alias("n")).where("n = 4").select("x", "y")
    edge = mask.select("x", "y").join(inner, ["x", "y"], "left_anti")
    ring = ball(edge, max(1, radius), True).select("x", "y").where(f"x between 0 and {width - 1} and y between 0 and {height - 1}")
    return ring.union(mask.select("x", "y")).distinct()


def nearest_within(mask: DataFrame, radius: int, width: int, height: int) -> DataFrame:
    """x, y, d2 and the nearest mask pixel (mx, my) of every pixel within ``radius``; of equal distances the lowest row, then column.

    First up and down the columns, then along the rows: a pixel is spread to 2 r + 1 places twice, not to a disc. The
    nearest pixel of a column is the only one of it that can be nearest to a place of that row.
    """
    upright = mask.select("x", F.col("y").alias("my"), F.explode(F.sequence(F.greatest(-F.lit(radius), -F.col("y")), F.least(F.lit(radius), F.lit(height - 1) - F.col("y")))).alias("dy"))
    column = upright.groupBy("x", (F.col("my") + F.col("dy")).alias("y")).agg(F.min(F.struct((F.col("dy") * F.col("dy")).alias("dy2"), "my")).alias("best"))
    half = F.floor(F.sqrt((F.lit(radius * radius) - F.col("best.dy2")).cast("double"))).cast("int")
    across = F.sequence(F.greatest(-half, -F.col("x")), F.least(half, F.lit(width - 1) - F.col("x")))
    spread = column.select(F.col("x").alias("mx"), "y", F.col("best.my").alias("my"), F.col("best.dy2").alias("dy2"), F.explode(across).alias("dx"))
    best = F.min(F.struct((F.col("dy2") + F.col("dx") * F.col("dx")).alias("d2"), "my", "mx"))
    return spread.groupBy((F.col("mx") + F.col("dx")).alias("x"), "y").agg(best.alias("best")).select("x", "y", "best.d2", "best.mx", "best.my")


#: Pixels along the side of a tile whose components are found in one task.
TILE = 512


def least_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vertices of undirected edges, and the least vertex of each one's component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def tile_labels(x: np.ndarray, y: np.ndarray, diagonal: bool) -> np.ndarray:
    """The least pixel (y * 2^32 + x) of each pixel's component, for the distinct pixels of one tile."""
    cell = y.astype(np.int64) * (1 << 32) + x
    order = np.argsort(cell)
    ranked = cell[order]
    pairs = [(cell, cell)]
    for step in (1, 1 << 32, *(((1 << 32) + 1, (1 << 32) - 1) if diagonal else ())):
        at = np.minimum(np.searchsorted(ranked, cell + step), len(cell) - 1)
        met = ranked[at] == cell + step
        pairs.append((cell[met], cell[met] + step))
    nodes, label = least_labels(*(np.concatenate(side) for side in zip(*pairs, strict=True)))
    return label[np.searchsorted(nodes, cell)]


def components(mask: DataFrame, diagonal: bool = False, tile: int = TILE) -> DataFrame:
    """x, y and label (the row-major least pixel y * 2^32 + x) of every mask pixel.

    A task labels the pixels of one tile. Labels that meet at the tiles' seams are the edges of a far smaller graph, in
    which labels fall to the neighbours' least and to that label's own label: rounds grow with the logarithm of the
    number of tiles that a component goes through.
    """
    named = mask.select(F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y")).distinct()

    def label(frame: pd.DataFrame) -> pd.DataFrame:
        return frame[["x", "y"]].assign(label=tile_labels(frame["x"].to_numpy(), frame["y"].to_numpy(), diagonal))

    side = lambda c: F.floor(F.col(c) / tile)
    own = named.groupBy(side("x").alias("tx"), side("y").alias("ty")).applyInPandas(label, "x int, y int, label long")
    own = materialise(own, "tiles")
    place = lambda c: F.pmod(F.col(c), F.lit(tile))
    rim = own.where((place("x") == 0) | (place("x") == tile - 1) | (place("y") == 0) | (place("y") == tile - 1))
    steps = [(1, 0), (0, 1), (1, 1), (-1, 1)] if diagonal else [(1, 0), (0, 1)]
    there = shifted(rim, steps, "label").select("x", "y", F.col("label").alias("other"))
    seams = rim.join(there, ["x", "y"]).where("label <> other").select("label", "other").distinct()
    edges = materialise(seams.union(seams.select(F.col("other").alias("label"), F.col("label").alias("other"))).distinct(), "seams")
    if edges.isEmpty():
        return own
    roots = materialise(edges.select("label", F.col("label").alias("root")).distinct(), "seam-labels")
    while True:
        near = edges.join(roots.select(F.col("label").alias("other"), F.col("root").alias("near")), "other").groupBy("label").agg(F.min("near").alias("near"))
        low = roots.join(near, "label").select("label", "root", F.least("root", "near").alias("low"))
        jump = roots.select(F.col("label").alias("low"), F.col("root").alias("far"))
        new = materialise(low.join(jump, "low").select("label", F.col("root").alias("old"), F.least("low", "far").alias("root")), "seam-labels", roots)
        roots = new
        if new.where("old <> root").isEmpty():
            return own.join(roots.select("label", "root"), "label", "left").select("x", "y", F.coalesce("root", "label").alias("label"))


def drop_small(mask: DataFrame, least_pixels: float) -> DataFrame:
    """Pixels of the 4-connected components that are large enough."""
    labelled = components(mask)
    large = labelled.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") >= least_pixels)
    return labelled.join(large, "label", "left_semi").select("x", "y")


def fill_small_holes(mask: DataFrame, grid_pixels: DataFrame, width: int, height: int, below_pixels: float) -> DataFrame:
    """The mask with its enclosed holes of fewer pixels: unset components that don't touch the border."""
    labelled = components(grid_pixels.select("x", "y").join(mask, ["x", "y"], "left_anti"))
    edge = F.bool_or((F.col("x") == 0) | (F.col("y") == 0) | (F.col("x") == width - 1) | (F.col("y") == height - 1))
    holes = labelled.groupBy("label").agg(F.count("*").alias("n"), edge.alias("open")).where((F.col("n") < below_pixels) & ~F.col("open"))
    return mask.select("x", "y").union(labelled.join(holes, "label", "left_semi").select("x", "y"))


def clean(pixels: DataFrame, mask: str, width: int, height: int, pixel_ha: float, least_ha: float = 0.3) -> DataFrame:
    """Blob cleaning: majority vote, small components out, small holes filled."""
    voted = materialise(majority(pixels, width, height, mask).where("mask").select("x", "y"), "voted")
    kept = materialise(drop_small(voted, least_ha / pixel_ha), "blobs")
    return fill_small_holes(kept, pixels, width, height, least_ha / pixel_ha)


def touching(mask: DataFrame, seeds: DataFrame, diagonal: bool = False) -> DataFrame:
    """Pixels of the components of ``mask`` that hold a pixel of ``seeds``."""
    labelled = components(mask, diagonal)
    met = labelled.join(seeds.select("x", "y").distinct(), ["x", "y"], "left_semi").select("label").distinct()
    return labelled.join(met, "label", "left_semi").select("x", "y")


def channel(affected: DataFrame, pixels: DataFrame, width: int, height: int, res: float, most_hand: float = 6.0) -> DataFrame:
    """Lowest valley floor within 100 m of what was affected, and not affected itself. One step at least, however coarse the grid."""
    reach = dilate(affected, max(1, round(100 / res)), width, height)
    floor = pixels.where(F.col("hand") <= most_hand).select("x", "y")
    return floor.join(reach, ["x", "y"], "left_semi").join(affected.select("x", "y"), ["x", "y"], "left_anti")


def reach_levels(affected: DataFrame, pixels: DataFrame, width: int, height: int, res: float, reach_m: float = 500.0, radius_m: float = 300.0, q: float = 0.75, most_level: float = 40.0, least_pixels: int = 30) -> tuple[DataFrame, DataFrame]:
    """(x, y and reach of pixels near the river, reach and flood level): how high what was affected climbs the banks of each reach."""
    block = max(1, round(reach_m / res))
    river = pixels.where("hand <= 1").select("x", "y")
    near = nearest_within(river, int(radius_m // res), width, height)
    reaches = near.select("x", "y", (F.floor(F.col("my") / block) * 100000 + F.floor(F.col("mx") / block)).alias("reach"))
    heights = reaches.join(affected.select("x", "y"), ["x", "y"], "left_semi").join(pixels.select("x", "y", "hand"), ["x", "y"])
    levels = heights.groupBy("reach").agg(F.least(F.percentile("hand", F.lit(q)), F.lit(most_level)).alias("level"), F.count("*").alias("n"))
    return reaches, levels.where(F.col("n") >= least_pixels).select("reach", "level")


def complete_with_terrain(affected: DataFrame, pixels: DataFrame, width: int, height: int, res: float, **rules) -> DataFrame:
    """Valley floor below each reach's flood level that is 8-connected to what was affected; only the added pixels."""
    affected = materialise(affected.select("x", "y").distinct(), "affected")
    reaches, levels = reach_levels(affected, pixels, width, height, res, **rules)
    ground = pixels.select("x", "y", "hand", "slope").where("slope <= 30")
    low = ground.join(reaches, ["x", "y"]).join(levels, "reach").where("hand <= level").select("x", "y")
    candidates = materialise(low.join(affected, ["x", "y"], "left_anti"), "candidates")
    river = pixels.where("hand <= 1").select("x", "y")
    joined = touching(candidates.union(affected).union(river).distinct(), affected, diagonal=True)
    return candidates.join(joined, ["x", "y"], "left_semi")


def in_corridor(water: DataFrame, changed: DataFrame, model_water: DataFrame, river: DataFrame, width: int, height: int, res: float, corridor_m: float = 150.0) -> tuple[DataFrame, DataFrame]:
    """Water and change of components near the main river; water that the model found stands by itself. Without a river nothing is near one."""
    both = water.select("x", "y").union(changed.select("x", "y")).distinct()
    near = nearest_within(river, int(corridor_m // res), width, height)
    kept = materialise(touching(both, near), "corridor")
    by_model = touching(water, model_water)
    return kept.join(water, ["x", "y"], "left_semi").union(by_model).distinct(), kept.join(changed, ["x", "y"], "left_semi")

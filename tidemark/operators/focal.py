"""Two-dimensional windows over pixel tables.

A k x k window is separable: a sum over rows and then over columns. Each pass is a hash aggregation over
the shifted pixels (an explode of k offsets with map-side combine), so a raster is not sorted into one
task per row and has no width limit. Mirrored borders are ghost pixels, reflected about the edge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAST_VALID = 0.5


def reflected(at: Column, size: int) -> Column:
    """Index of a mirrored pixel: (d c b a | a b c d | d c b a)."""
    turn = F.pmod(at, F.lit(2 * size))
    return F.when(turn < size, turn).otherwise(2 * size - 1 - turn).cast("int")


def _spread(df: DataFrame, axis: str, size: int, radius: int, sums: list[str]) -> DataFrame:
    """Window sums along one axis with mirrored borders."""
    other = "y" if axis == "x" else "x"
    # A pixel counts for every window whose mirrored positions it fills; ghosts beyond the edge give it more weight.
    ghosts = F.array_distinct(F.array(F.col(axis), -1 - F.col(axis), 2 * size - 1 - F.col(axis)))
    targets = F.filter(
        F.flatten(F.transform(ghosts, lambda g: F.sequence(g - radius, g + radius))), lambda t: (t >= 0) & (t < size)
    ).cast("array<int>")
    return df.select(F.explode(targets).alias(axis), other, *sums).groupBy(axis, other).agg(*[F.sum(s).alias(s) for s in sums])


def window_sums(pixels: DataFrame, width: int, height: int, radius: int, **sums: Column) -> DataFrame:
    """x, y and the sums of the given columns over the (2 radius + 1)-square window of every pixel. The radius is smaller than the raster."""
    names = list(sums)
    first = pixels.select("x", "y", *[F.coalesce(c, F.lit(0.0)).alias(n) for n, c in sums.items()])
    return _spread(_spread(first, "x", width, radius, names), "y", height, radius, names)


def box_mean(pixels: DataFrame, width: int, height: int, value: str, size: int = 3) -> DataFrame:
    """Mean of the valid pixels of the window, NULL where less than half of it is valid."""
    area = size * size
    sums = window_sums(pixels, width, height, size // 2, total=F.col(value), n=F.col(value).isNotNull().cast("double"))
    return sums.select("x", "y", F.when(F.col("n") / area >= LEAST_VALID, F.try_divide("total", "n")).alias("mean"))


def lee_filter(pixels: DataFrame, width: int, height: int, value: str, size: int = 7, looks: float = 4.4) -> DataFrame:
    """Speckle filter: the local mean, moved towards the pixel by as much as local variance exceeds speckle's."""
    v = F.col(value)
    sums = window_sums(pixels, width, height, size // 2, total=v, square=v * v, n=v.isNotNull().cast("double"))
    n = F.greatest(F.col("n") / (size * size), F.lit(1e-6))
    mean, sq = F.col("total") / (size * size) / n, F.col("square") / (size * size) / n
    stats = sums.select("x", "y", mean.alias("mean"), F.greatest(sq - mean * mean, F.lit(0.0)).alias("var"))
    ci2 = F.col("var") / F.greatest(F.col("mean") * F.col("mean"), F.lit(1e-12))
    cu2 = 1.0 / looks
    weight = F.greatest(F.least((ci2 - cu2) / F.greatest(ci2 * (1 + cu2), F.lit(1e-12)), F.lit(1.0)), F.lit(0.0))
    return pixels.where(v.isNotNull()).join(stats, ["x", "y"]).select("x", "y", (F.col("mean") + weight * (v - F.col("mean"))).alias("filtered"))


def min_filter(pixels: DataFrame, value: str, size: int) -> DataFrame:
    """Least value of the window; mirroring the border changes no minimum, so windows are clipped."""
    r = size // 2
    rows = Window.partitionBy("y").orderBy("x").rangeBetween(-r, r)
    columns = Window.partitionBy("x").orderBy("y").rangeBetween(-r, r)
    return pixels.withColumn("low", F.min(value).over(rows)).withColumn("low", F.min("low").over(columns)).select("x", "y", "low")


def relative_elevation(pixels: DataFrame, dem: str, size: int = 151) -> DataFrame:
    """Height above the lowest ground of the window; no data counts as the highest ground."""
    top = pixels.agg(F.coalesce(F.max(dem), F.lit(0.0)).alias("top"))
    filled = pixels.select("x", "y", F.col(dem)).crossJoin(F.broadcast(top)).select("x", "y", F.coalesce(dem, "top").alias("z"))
    return filled.join(min_filter(filled, "z", size), ["x", "y"]).select("x", "y", (F.col("z") - F.col("low")).alias("rel"))


def majority(pixels: DataFrame, width: int, height: int, mask: str, size: int = 3) -> DataFrame:
    """Pixels of which more than half of the window is set."""
    sums = window_sums(pixels, width, height, size // 2, n=F.col(mask).cast("double"))
    return sums.select("x", "y", (F.col("n") > size * size / 2).alias("mask"))


def gradient(pixels: DataFrame, value: str, res: float) -> DataFrame:
    """gx (east) and gy (south) by central differences, one-sided at the edges; no data is filled with the mean."""
    mean = pixels.agg(F.avg(value).alias("mean"))
    z = pixels.crossJoin(F.broadcast(mean)).select("x", "y", F.coalesce(value, "mean").alias("z"))

    def along(axis: str, other: str) -> Column:
        w = Window.partitionBy(other).orderBy(axis)
        before, after = F.lag("z").over(w), F.lead("z").over(w)
        step = F.when(before.isNotNull() & after.isNotNull(), 2 * res).otherwise(res)
        return (F.coalesce(after, "z") - F.coalesce(before, "z")) / step

    return z.select("x", "y", along("x", "y").alias("gx"), along("y", "x").alias("gy"))


def slope_aspect() -> dict[str, Column]:
    """Slope and downslope direction in degrees, and hillshade, of gx and gy."""
    gx, gy = F.col("gx"), F.col("gy")
    slope = F.atan(F.hypot(gx, gy))
    aspect = F.atan2(-gx, gy)
    azimuth, zenith = F.radians(F.lit(360 - 315 + 90)), F.radians(F.lit(90 - 45))
    shade = F.cos(zenith) * F.cos(slope) + F.sin(zenith) * F.sin(slope) * F.cos(azimuth - aspect)
    return {
        "slope": F.degrees(slope),
        "aspect": F.pmod(F.degrees(aspect) + 360, F.lit(360.0)),
        "hillshade": F.greatest(F.least(shade, F.lit(1.0)), F.lit(0.0)),
    }


def bilinear(pixels: DataFrame, value: str, width: int, height: int, factor: float, new_width: int, new_height: int) -> DataFrame:
    """Resample to a grid whose pixels are ``factor`` times as large: the four neighbours of each new centre, weighted; NULLs left out."""
    x, y = F.col("x"), F.col("y")
    # Every old pixel goes to the new centres within one pixel of it.
    ahead = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>"))
    near_x = ahead(F.ceil((x - 0.5) / factor - 0.5), F.floor((x + 1.5) / factor - 0.5))
    near_y = ahead(F.ceil((y - 0.5) / factor - 0.5), F.floor((y + 1.5) / factor - 0.5))
    spread = pixels.where(F.col(value).isNotNull()).select(x, y, F.col(value).alias("v"), F.explode(near_x).alias("nx")).select("x", "y", "v", "nx", F.explode(near_y).alias("ny"))
    wx = F.greatest(1 - F.abs((F.col("nx") + 0.5) * factor - 0.5 - x), F.lit(0.0))
    wy = F.greatest(1 - F.abs((F.col("ny") + 0.5) * factor - 0.5 - y), F.lit(0.0))
    weighed = spread.withColumn("w", wx * wy).where(f"w > 0 and nx between 0 and {new_width - 1} and ny between 0 and {new_height - 1}")
    return weighed.groupBy(F.col("nx").cast("int").alias("x"), F.col("ny").cast("int").alias("y")).agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias(value))


def block_max(pixels: DataFrame, value: str, factor: int) -> DataFrame:
    """Resample by the greatest value of each block."""
    return pixels.groupBy(F.floor(F.col("x") / factor).cast("int").alias("x"), F.floor(F.col("y") / factor).cast("int").alias("y")).agg(F.max(value).alias(value))

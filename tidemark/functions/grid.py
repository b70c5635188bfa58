"""Pixel lattices: a GridSpec is driver-side metadata whose numbers enter expressions as literals."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class GridSpec:
    """A metric grid: origin at the left top, rows going down, ``res`` metres a pixel."""

    left: float
    top: float
    width: int
    height: int
    res: float = 10.0
    epsg: int = 0

    @staticmethod
    def around(x_min: float, y_min: float, x_max: float, y_max: float, res: float = 10.0, epsg: int = 0) -> GridSpec:
        """The box snapped outward to whole pixels."""
        left, top = math.floor(x_min / res) * res, math.ceil(y_max / res) * res
        return GridSpec(left, top, math.ceil((x_max - left) / res), math.ceil((top - y_min) / res), res, epsg)

    @property
    def pixel_ha(self) -> float:
        return self.res * self.res / 1e4

    def column_of(self, x: Column) -> Column:
        """Pixel column; truncation toward 0, so a point less than a pixel left of the grid is in column 0."""
        return ((x - self.left) / self.res).cast("int")

    def row_of(self, y: Column) -> Column:
        return ((self.top - y) / self.res).cast("int")

    def centre(self, x: Column, y: Column) -> tuple[Column, Column]:
        return self.left + (x + 0.5) * self.res, self.top - (y + 0.5) * self.res

    def pixels(self, spark) -> DataFrame:
        """Every (x, y) of the grid."""
        cell = F.col("id")
        return spark.range(self.width * self.height).select((cell % self.width).cast("int").alias("x"), F.floor(cell / self.width).cast("int").alias("y"))


def gridded(df: DataFrame, key: str, width: int, *columns: Column) -> DataFrame:
    """A table with keys dense from 0 as a pixel table of ``width`` columns."""
    return df.select((F.col(key) % width).cast("int").alias("x"), F.floor(F.col(key) / width).cast("int").alias("y"), *columns)

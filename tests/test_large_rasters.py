"""Queries over rasters never broadcast a raster: the driver couldn't hold a large one."""

from __future__ import annotations

import pytest

from tidemark.functions.grid import GridSpec
from tidemark.operators import hydro
from tidemark.plans import analysis
from tidemark.session import materialise


@pytest.fixture
def plans(monkeypatch):
    """The plans of all frames that the hydrology operators write, as they are planned."""
    seen: list[str] = []

    def noted(df, *args):
        seen.append(plan(df))
        return materialise(df, *args)

    monkeypatch.setattr(hydro, "materialise", noted)
    return seen


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def slope(spark):
    """A small plane that falls to the first row."""
    return spark.range(60).selectExpr("cast(id % 6 as int) x", "cast(floor(id / 6) as int) y", "cast(floor(id / 6) * 10 + id % 6 as double) dem")


def test_directions_are_not_broadcast(spark):
    flow = hydro.flow_direction(slope(spark), "dem")
    assert "SortMergeJoin" in plan(flow) and "Broadcast" not in plan(flow)
    assert {r["code"] for r in flow.where("y > 0 and x = 0").collect()} == {64}


def flow_of(spark):
    """Directions of ``slope``, written as the queries write them."""
    return materialise(hydro.flow_direction(slope(spark), "dem"), "flow")


def no_broadcast(plans, *more):
    assert plans and not [p for p in [*plans, *[plan(df) for df in more]] if "Broadcast" in p]


def test_accumulation_is_not_broadcast(spark, plans):
    found = hydro.accumulation(flow_of(spark))
    no_broadcast(plans, found)
    assert {r["acc"] for r in found.where(f"cell < {1 << 32}").collect()} == {10, 20, 30, 40, 50, 60}


def cells(pixels):
    return pixels.selectExpr(f"cast(y as bigint) * {1 << 32} + x cell", "*")


def test_heights_are_not_broadcast(spark, plans):
    heights = cells(slope(spark))
    found = hydro.height_above_drainage(flow_of(spark), heights.where("y = 0").select("cell"), heights.select("cell", "dem"))
    no_broadcast(plans, found)
    assert {r["hand"] for r in found.where(f"cell >= {9 << 32}").collect()} == {90.0}


def test_terrain_is_not_broadcast(spark, plans):
    found = hydro.terrain(slope(spark).selectExpr("x", "y", "dem", "x = 3 minor", "x = 3 major"), 4, 30)
    no_broadcast(plans, found)
    assert {r["hand"] for r in found.where("x = 3").collect()} == {0.0}


def test_walk_is_not_broadcast(spark, plans):
    starts = cells(slope(spark)).where("y = 9 and x = 2").selectExpr("x as id", "cell")
    found = hydro.walk(flow_of(spark), starts, 1000)
    no_broadcast(plans, found)
    assert found.count() == 12


def test_trace_is_not_broadcast(spark, plans, monkeypatch):
    monkeypatch.setattr(analysis, "materialise", hydro.materialise)
    places = spark.createDataFrame([(1, "Upper", 25.0, 15.0)], "pid long, name string, px double, py double")
    found = analysis.trace(slope(spark), (2, 9), places, GridSpec(0.0, 100.0, 6, 10, 10.0), near_m=20.0)["settlements"]
    # The line's own legs are a path: they may be broadcast, a raster may not.
    assert "Broadcast" not in "".join(plans) and "SortMergeJoin" in plan(found)
    assert [r["name"] for r in found.collect()] == ["Upper"]

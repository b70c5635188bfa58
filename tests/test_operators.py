"""Hand-made rasters, roads and graphs against brute force."""

from __future__ import annotations

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.grid import GridSpec
from tidemark.operators import evidence, focal, hydro, metrics, morphology, network, timeseries, zonal
from tidemark.plans import analysis
from tidemark.sources import features, files
from tidemark.streaming import limits


def pixels(spark, array, name="v"):
    return analysis.pixels_of({name: np.asarray(array, float)}, spark)


def mask_of(spark, array):
    return pixels(spark, array).where("v > 0").select("x", "y")


def cells(df):
    return {(r["x"], r["y"]) for r in df.collect()}


def test_box_mean_mirrors_borders_and_needs_half(spark):
    a = np.arange(16, dtype=float).reshape(4, 4)
    a[0, 0] = np.nan
    padded = np.pad(a, 1, mode="symmetric")
    got = {(r["x"], r["y"]): r["mean"] for r in focal.box_mean(pixels(spark, a), 4, 4, "v").collect()}
    for y in range(4):
        for x in range(4):
            w = padded[y : y + 3, x : x + 3]
            ok = np.isfinite(w)
            want = w[ok].mean() if ok.mean() >= 0.5 else None
            assert (got[x, y] is None) == (want is None) and (want is None or abs(got[x, y] - want) < 1e-9)


def test_change_score_branches(spark):
    rows = [(0, "pre", 3, 1.0), (0, "pre", 3, 2.0), (0, "post", 3, 100.0), (1, "pre", 1, 1.0), (1, "post", 1, 10.0), (2, "post", 1, 1.0), (3, "pre", 3, 1.0), (3, "post", 3, 10.0)]
    df = spark.createDataFrame(rows, "cell int, phase string, n_pre long, power double")
    got = {r["cell"]: (r["delta"], r["z"]) for r in timeseries.change_features(df, ["cell"]).collect()}
    assert set(got) == {0, 1, 3}
    delta = 20 - 10 * math.log10(1.5)
    assert got[0] == pytest.approx((delta, delta / max(np.std([0, 10 * math.log10(2)]), 0.8)))
    assert got[1] == pytest.approx((10.0, 10 / 1.5))
    assert got[3] == pytest.approx((10.0, 10 / 0.8))


def test_pick_dates_keeps_the_row_that_crosses(spark):
    rows = [("2024-01-04", 0.9), ("2024-01-03", 0.8), ("2024-01-02", 0.5), ("2024-01-01", 0.1)]
    df = spark.createDataFrame(rows, "date string, clear double").withColumn("date", F.to_date("date"))
    assert [str(r["date"]) for r in timeseries.pick_dates(df, want=5).orderBy("place").collect()] == ["2024-01-04", "2024-01-03"]


def brute_labels(mask, diagonal):
    h, w = mask.shape
    label = {}
    for y in range(h):
        for x in range(w):
            if mask[y, x] and (x, y) not in label:
                stack, name = [(x, y)], y * (1 << 32) + x
                while stack:
                    p = stack.pop()
                    if p in label:
                        continue
                    label[p] = name
                    for dx in (-1, 0, 1):
                        for dy in (-1, 0, 1):
                            q = (p[0] + dx, p[1] + dy)
                            if (diagonal or abs(dx) + abs(dy) == 1) and 0 <= q[0] < w and 0 <= q[1] < h and mask[q[1], q[0]]:
                                stack.append(q)
    return label


@pytest.mark.parametrize("diagonal", [False, True])
@pytest.mark.parametrize("tile", [3, 32, 512])
def test_components(spark, diagonal, tile):
    mask = np.random.default_rng(3).random((9, 130)) < 0.5
    got = {(r["x"], r["y"]): r["label"] for r in morphology.components(mask_of(spark, mask), diagonal, tile).collect()}
    assert got == brute_labels(mask, diagonal)


def test_dilate_is_a_diamond(spark):
    a = np.zeros((9, 9))
    a[4, 4] = 1
    assert cells(morphology.dilate(mask_of(spark, a), 3, 9, 9)) == {(x, y) for x in range(9) for y in range(9) if abs(x - 4) + abs(y - 4) <= 3}


def test_small_blobs_go_and_small_holes_are_filled(spark):
    a = np.zeros((8, 8))
    a[1:5, 1:5] = 1
    a[2, 2] = 0
    a[6, 6] = 1
    mask = mask_of(spark, a)
    kept = morphology.drop_small(mask, 3)
    assert (6, 6) not in cells(kept) and len(cells(kept)) == 15
    assert cells(morphology.fill_small_holes(kept, pixels(spark, a), 8, 8, 2)) == cells(kept) | {(2, 2)}


def test_d8_accumulation_and_hand(spark):
    rng = np.random.default_rng(5)
    dem = rng.random((6, 7)) + np.arange(6)[:, None] * 2.0
    flow = hydro.flow_direction(pixels(spark, dem), "v")
    step = {(r["x"], r["y"]): (r["nx"], r["ny"]) if r["code"] else None for r in flow.collect()}
    for (x, y), to in step.items():
        drops = {(x + dx, y + dy): (dem[y, x] - dem[y + dy, x + dx]) / math.hypot(dx, dy) for dx, dy in hydro.D8.values() if 0 <= x + dx < 7 and 0 <= y + dy < 6}
        top = max(drops.values())
        assert (to is None and top <= 0) or drops[to] == pytest.approx(top)
    count = dict.fromkeys(step, 0)
    for at in step:
        while at is not None:
            count[at] += 1
            at = step[at]
    got = {(r["cell"] % (1 << 32), r["cell"] >> 32): r["acc"] for r in hydro.accumulation(flow).collect()}
    assert got == count


def test_fill_depressions_leaves_no_pit(spark):
    dem = np.full((5, 5), 9.0)
    dem[2, 2] = 1.0
    dem[2, 3] = 5.0
    got = {(r["x"], r["y"]): r["filled"] for r in hydro.fill_depressions(pixels(spark, dem).withColumn("basin", F.lit(0).cast("long")), "v").collect()}
    assert got[2, 2] > 9.0 and got[0, 0] == 9.0


def test_road_rules(spark):
    grid = GridSpec(0.0, 100.0, 20, 10, 10.0)
    line = [(0, 0, [(0.0, 55.0), (100.0, 55.0)]), (1, 0, [(5.0, 5.0), (5.0, 5.0)])]
    roads = spark.createDataFrame(line, "id int, part int, coords array<struct<x:double,y:double>>")
    mask = spark.createDataFrame([(2, 4), (3, 4), (8, 4)], "x int, y int")
    s = zonal.sample(zonal.sample(zonal.road_samples(roads), mask, grid, "px", "py", "hit"), mask, grid, "px", "py", "near")
    got = {r["id"]: r.asDict() for r in zonal.road_status(roads, s).collect()}
    hits = sum(int(5 * i / 10) in (2, 3, 8) for i in range(21))
    assert got[0] == {"id": 0, "status": "touched" if 4 * 100 / 21 < 20 else "cut", "length_m": 100, "affected_m": round(hits * 100 / 21)}
    assert got[1]["status"] == "outside"
    assert sorted(r["n"] for r in zonal.stretches(s).collect()) == [2, 4]


def test_polygons_touch_cells(spark):
    triangle = (np.array([0.5, 3.5, 0.5]), np.array([0.5, 0.5, 3.5]))
    got = {(int(c), row) for row, columns in zonal.touched_rows(*triangle, 10, 10) for c in columns}
    for x in range(5):
        for y in range(5):
            inside = any(px >= 0.5 and py >= 0.5 and px + py <= 4.0 for px in np.linspace(x + 1e-6, x + 1 - 1e-6, 40) for py in np.linspace(y + 1e-6, y + 1 - 1e-6, 40))
            assert not inside or (x, y) in got


@pytest.mark.parametrize("block", [None, lambda n: F.pmod(n.cast("int"), F.lit(3)).cast("string"), lambda n: F.lit("all")])
def test_shortest_times(spark, block):
    rng = random.Random(4)
    edges = [(str(rng.randrange(12)), str(rng.randrange(12)), float(rng.randrange(1, 9))) for _ in range(20)]
    times = {"0": 0.0}
    for _ in range(20):
        for u, v, m in edges:
            for a, b in ((u, v), (v, u)):
                if a in times and times[a] + m < times.get(b, math.inf):
                    times[b] = times[a] + m
    df = spark.createDataFrame(edges, "u string, v string, minutes double")
    got = network.shortest_times(df, spark.createDataFrame([("0",)], "node string"), block=block)
    assert {r["node"]: r["time"] for r in got.collect()} == times


def test_later_road_owns_a_shared_edge(spark):
    a, b = (0.0, 0.0), (1000.0, 0.0)
    rows = [(0, "primary", [a, b]), (1, "track", [b, a]), (2, "path", [a, b]), (3, None, [a, b])]
    roads = spark.createDataFrame(rows, "road int, highway string, coords array<struct<x:double,y:double>>")
    assert [(r["road"], round(r["minutes"], 6)) for r in network.road_edges(roads).collect()] == [(1, 5.0)]
    assert [(r["road"], r["minutes"]) for r in network.road_edges(roads, foot=True).collect()] == [(2, 20.0)]


def test_confusion_ignores_and_scores_are_clamped(spark):
    df = spark.createDataFrame([(0, 0), (1, 0), (255, 2), (2, 2)], "y int, p int")
    m = metrics.confusion(df, "y", "p", 3)
    assert m.count() == 9 and m.agg(F.sum("n")).head()[0] == 3
    s = metrics.class_scores(m, "y", "p", ["a", "b", "c"]).head()
    assert (s["b_iou"], s["c_f1"], s["any_iou"]) == (0.0, 1.0, 0.5)


def test_rejected_requests_leave_no_trace(spark):
    rows = [(k, "v", float(t)) for k, t in enumerate((0, 10, 20, 30, 40, 3700, 3605))] + [(9, None, 1.0)]
    got = {r["id"]: (r["admitted"], r["wait_min"]) for r in limits.limit_batch(spark.createDataFrame(rows, "id long, visitor string, at double")).collect()}
    assert [got[k][0] for k in (0, 1, 2, 3, 4, 6, 5, 9)] == [True, True, True, False, False, True, True, True]
    assert got[3][1] == 60


def test_layers_and_geometry(spark):
    rows = [("way", {"highway": "path", "bridge": "yes"}), ("node", {"place": "town", "amenity": "clinic"}), ("way", {"building": "no"}), ("way", {"bridge": "no"})]
    df = spark.createDataFrame(rows, "kind string, tags map<string,string>")
    got = sorted((r["kind"], r["layer"]) for r in features.classified(df).collect())
    assert got == [("node", "health"), ("node", "places"), ("node", "towns"), ("way", "bridges"), ("way", "buildings"), ("way", "roads")]
    ring = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]
    made = spark.createDataFrame([("way", ring, "water"), ("way", ring[:2], "water"), ("way", ring, "roads"), ("node", ring[:1], "places")], "kind string, coords array<struct<x:double,y:double>>, layer string")
    kinds = [r["t"] for r in made.select(features.geometry_of(F.col("kind"), F.col("coords"), F.col("layer"))["type"].alias("t")).collect()]
    assert kinds == ["Polygon", None, "LineString", "Point"]


def test_confidence_and_class_order(spark):
    df = spark.createDataFrame([(True, True, True), (True, True, False), (True, False, False), (False, False, False)], "c boolean, w boolean, ch boolean")
    assert [r[0] for r in df.select(evidence.class_of(F.col("c"), F.col("w"), F.col("ch"))).collect()] == [3, 1, 2, 0]


def test_files_round_trip(spark, tmp_path):
    import io
    import json
    import tarfile

    for k, name in enumerate(("a", "b")):
        (tmp_path / "runs" / name).mkdir(parents=True)
        (tmp_path / "runs" / name / "meta.json").write_text(json.dumps({"id": name, "seconds": 1.5 + k}))
    (tmp_path / "runs" / "c").mkdir()
    (tmp_path / "runs" / "c" / "meta.json").write_text("{broken")
    assert {r["id"] for r in files.saved_runs(spark, str(tmp_path / "runs")).collect()} == {"a", "b"}
    with tarfile.open(tmp_path / "x.tar", "w") as tar:
        for name in ("s1.x", "s1.y", "s2.x"):
            info = tarfile.TarInfo(name)
            info.size = 3
            tar.addfile(info, io.BytesIO(b"abc"))
    got = files.complete_samples(files.archive_members(spark, str(tmp_path / "x.tar")), ["x", "y"]).collect()
    assert [r["sample"] for r in got] == ["s1"]
    df = spark.createDataFrame([(1.1, 2.2, 7), (9.0, 9.0, 8)], "lon double, lat double, k int")
    files.write_cut(df, str(tmp_path / "cut"))
    assert [r["k"] for r in files.read_cut(spark, str(tmp_path / "cut"), (1.0, 2.0, 3.0, 4.0)).collect()] == [7]


def test_tiles_blend_to_the_model(spark):
    a = np.random.default_rng(1).random((10, 23))
    df = pixels(spark, a, "c0")
    out = analysis.predict_tiles(df, ["c0"], 23, 10, lambda: lambda block: np.stack([block[0], 1 - block[0]]), tile=8, overlap=4)
    got = {(r["x"], r["y"]): r["p"] for r in out.where("cls = 0").collect()}
    assert len(got) == 230 and all(abs(got[x, y] - a[y, x]) < 1e-6 for x, y in got)


def test_limiter_stream(spark, tmp_path):
    rows = [(k, "v", float(k)) for k in range(5)]
    df = spark.createDataFrame(rows, "id long, visitor string, at double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = limits.limit_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    # Timeouts keep such a query busy with empty batches for ever, so it is watched and stopped.
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").start()
    got, end = {}, time.monotonic() + 60
    while len(got) < 5 and time.monotonic() < end and q.isActive:
        time.sleep(1)
        if list((tmp_path / "out").glob("_spark_metadata/*")):
            got = {r["id"]: r["admitted"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    q.stop()
    assert got == {0: True, 1: True, 2: True, 3: False, 4: False}

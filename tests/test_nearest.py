"""The nearest target against all pairs, and what a search over dense targets writes."""

from __future__ import annotations

import math
import random

from tidemark.operators import zonal
from tidemark.session import materialise


def searched(spark, monkeypatch, queries, targets, most):
    """The result, as a dictionary, and how many rows of queries were written on the way."""
    rows = []

    def noted(df, name, *args):
        out = materialise(df, name, *args)
        rows.append(out.count() if name == "nearest" else 0)
        return out

    monkeypatch.setattr(zonal, "materialise", noted)
    q = spark.createDataFrame(queries, "qid long, px double, py double")
    t = spark.createDataFrame(targets, "tid long, px double, py double")
    found = {r["qid"]: (r["tid"], r["distance"]) for r in zonal.nearest_point(q, t, most).collect()}
    return found, sum(rows)


def plain(queries, targets, most):
    out = {}
    for qid, qx, qy in queries:
        near = [(d, tid) for tid, px, py in targets if qx is not None and (d := math.hypot(px - qx, py - qy)) <= most]
        if near:
            out[qid] = min(out.get(qid, (math.inf, 0)), min(near))
    return {qid: (tid, d) for qid, (d, tid) in out.items()}


def test_dense_targets_are_met_by_small_cells(spark, monkeypatch):
    rng = random.Random(3)
    targets = [(i, float(rng.randrange(300)), float(rng.randrange(300))) for i in range(2000)]
    queries = [(i, rng.random() * 300, rng.random() * 300) for i in range(400)]
    found, written = searched(spark, monkeypatch, queries, targets, 300.0)
    want = plain(queries, targets, 300.0)
    assert {q: t for q, (t, _) in found.items()} == {q: t for q, (t, _) in want.items()}
    # Nearly all of them are done by the first cells, which hold a few targets and not all 2000.
    assert zonal.first_cell(spark.createDataFrame(targets, "tid long, px double, py double"), 300.0) >= 4
    assert 400 <= written <= 600


def test_far_equal_and_odd_places(spark, monkeypatch):
    targets = [(9, 0.0, 0.0), (3, 0.0, 0.0), (5, 10.0, 0.0), (7, 1000.0, 0.0)]
    queries = [(1, 5.0, 0.0), (2, -300.0, 0.0), (3, -300.5, 0.0), (4, None, 0.0), (5, 700.0, 0.0), (6, 9.0, 0.0), (6, 1.5, 0.0), (7, 500.0, 0.0)]
    found, _ = searched(spark, monkeypatch, queries, targets, 300.0)
    assert found == {1: (3, 5.0), 2: (3, 300.0), 5: (7, 300.0), 6: (5, 1.0)} == plain(queries, targets, 300.0)

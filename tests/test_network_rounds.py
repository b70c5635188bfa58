"""Shortest times over long paths and many blocks."""

from __future__ import annotations

import heapq

from tidemark.operators import network


def dijkstra(edges: list[tuple[str, str, float]], start: str) -> dict[str, float]:
    near: dict[str, list] = {}
    for u, v, m in edges:
        near.setdefault(u, []).append((v, m))
        near.setdefault(v, []).append((u, m))
    best, queue = {}, [(0.0, start)]
    while queue:
        t, at = heapq.heappop(queue)
        if at not in best:
            best[at] = t
            for to, m in near.get(at, ()):
                heapq.heappush(queue, (t + m, to))
    return best


def test_a_long_road_is_searched_to_its_end(spark):
    """A zigzag of 1,500 edges over several blocks, and a short cut back into the first one."""
    at = lambda k: f"{k * 40.0},{(k % 7) * 900.0}"
    edges = [(at(k), at(k + 1), 1.0 + k % 3) for k in range(1500)] + [(at(0), at(900), 50.0), (at(1400), at(3), 5.0)]
    df = spark.createDataFrame(edges, "u string, v string, minutes double")
    got = network.shortest_times(df, spark.createDataFrame([(at(0),)], "node string"), block=network.block_of)
    assert {r["node"]: r["time"] for r in got.collect()} == dijkstra(edges, at(0))


def test_every_hop_is_a_round_without_blocks(spark):
    edges = [(str(k), str(k + 1), 1.0) for k in range(12)]
    df = spark.createDataFrame(edges, "u string, v string, minutes double")
    assert {r["node"]: r["time"] for r in network.shortest_times(df, spark.createDataFrame([("0",)], "node string")).collect()} == {str(k): float(k) for k in range(13)}

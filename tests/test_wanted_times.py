"""Shortest times of wanted nodes only."""

from __future__ import annotations

from tidemark.operators import network


def test_search_ends_behind_the_furthest_wanted_node(spark):
    edges = [("a", f"{k}", f"{k + 1}", 1.0) for k in range(12)] + [("b", "0", "1", 1.0), ("b", "1", "2", 1.0), ("b", "5", "6", 1.0)]
    edges += [("a", "0", "3", 9.0)]
    graphs = spark.createDataFrame(edges, "g string, u string, v string, minutes double")
    sources = spark.createDataFrame([("a", "0"), ("b", "0")], "g string, node string")
    wanted = spark.createDataFrame([("a", "3"), ("a", "1"), ("b", "5"), ("b", "2")], "g string, node string")
    found = {(r["g"], r["node"]): r["time"] for r in network.shortest_times(graphs, sources, ("g",), wanted=wanted).collect()}
    assert found["a", "3"] == 3.0 and found["a", "1"] == 1.0 and found["b", "2"] == 2.0 and ("b", "5") not in found
    assert ("a", "12") not in found and max(found.values()) < 11

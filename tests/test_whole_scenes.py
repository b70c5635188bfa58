"""Scenes take whole tables."""

from __future__ import annotations

import os

from tidemark.plans import q_analysis

SF = os.environ.get("TEST_DATA", "/root/testdata") + "/sf0.001"


def test_assess_scene_takes_every_order_and_supplier(spark):
    count = lambda name: spark.read.parquet(f"{SF}/{name}.parquet").count()
    stats = q_analysis.assess_scene(spark, SF).first()
    assert (stats["bridges_total"], stats["health_total"]) == (count("orders"), count("supplier"))
    assert stats["roads_affected_km"] > 25


def test_access_scene_settles_every_customer(spark):
    folder = SF.replace("sf0.001", "sf0.01")
    want = {r["c_custkey"] for r in spark.read.parquet(f"{folder}/customer.parquet").select("c_custkey").collect()}
    assert {r["sid"] for r in q_analysis.access_scene(spark, folder).collect()} == want

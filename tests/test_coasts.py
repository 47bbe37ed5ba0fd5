"""Polygons with ragged coasts: a cell holds the edges near it alone, whatever lies east of it, and points are found as by brute force."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from kinweave.operators import spatial


def test_cells_hold_only_edges_near_them(spark):
    rng = random.Random(8)
    north = [(-170 + 340 * i / 3000, -20.0 + i * 7919 % 997 / 997 * 30) for i in range(3000)]
    spikes = [(rng.uniform(20, 120), 40 + 20 * i / 1500) for i in range(1500)]  # and one that runs the other way
    rings = [[(-175.0, -80.0), *north, (175.0, -80.0), (-175.0, -80.0)], [(130.0, 35.0), *spikes, (130.0, 65.0), (130.0, 35.0)]]
    shapes = spark.createDataFrame([(o, f"c{o}", f"c{o}", [[ring]]) for o, ring in enumerate(rings)], "ord int, name string, key string, rings array<array<array<struct<lng: double, lat: double>>>>")
    points = [(rng.uniform(-180, 180), rng.uniform(-90, 90)) for _ in range(150)] + [(rng.uniform(0, 140), rng.uniform(36, 64)) for _ in range(60)] + [rng.choice(ring) for ring in rings for _ in range(20)]

    def held(x, y, ring):
        odd = False
        for (x1, y1), (x2, y2) in zip(ring, ring[1:], strict=False):
            if (x2 - x1) * (y - y1) == (y2 - y1) * (x - x1) and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
                return True
            odd ^= (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1
        return odd

    rows = spark.createDataFrame(points, "lng double, lat double").distinct()
    found = {(r["lng"], r["lat"]): r["at"] and r["at"]["name"] for r in spatial.first_at(rows, shapes, F.col("lng"), F.col("lat"), "at").collect()}
    assert found == {(x, y): next((f"c{o}" for o, ring in enumerate(rings) if held(x, y, ring)), None) for x, y in points}
    pieces = spatial.cut(shapes)[0].filter(f"shiftright(cell, 40) < {spatial.LAST}")
    assert pieces.selectExpr("max(size(edges))").first()[0] <= spatial.MOST_EDGES

"""Areas, centroids and containment against plain versions."""

import json
import random

from civicflow.sources import geometry


def collection(*shapes):
    return json.dumps({"type": "FeatureCollection", "features": [{"properties": {"no": i}, "geometry": g} for i, g in enumerate(shapes)]})


def frame(spark, *shapes):
    return geometry.shape_features(spark.createDataFrame([(collection(*shapes),)], "json string"))


SQUARE = [[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]]
HOLE = [[1, 1], [1, 3], [3, 3], [3, 1], [1, 1]]


def test_areas_and_centroids(spark):
    far = [[x + 10, y] for x, y in SQUARE]
    shapes = [
        {"type": "Polygon", "coordinates": [SQUARE, HOLE]},
        {"type": "Polygon", "coordinates": [SQUARE[::-1][:-1]]},  # clockwise, not closed
        {"type": "MultiPolygon", "coordinates": [[SQUARE], [far, [[x + 10, y] for x, y in HOLE]]]},
        {"type": "Point", "coordinates": [5, 6]},
        {"type": "LineString", "coordinates": [[0, 0], [2, 4]]},
        {"type": "MultiLineString", "coordinates": [[[0, 0], [2, 4]], [[4, 8]]]},
        {"type": "Polygon", "coordinates": []},
        None,
        {"type": "Unknown", "coordinates": "x"},
    ]
    got = {int(r["properties"]["no"]): (r["area"], r["cx"], r["cy"]) for r in geometry.measured(frame(spark, *shapes)).collect()}
    centre = (16 * 2 + 12 * 12) / 28
    assert got == {0: (12, 2, 2), 1: (16, 2, 2), 2: (28, centre, 2), 3: (0, 5, 6), 4: (0, 1, 2), 5: (0, 2, 4), 6: (0, None, None), 7: (0, None, None), 8: (0, None, None)}
    assert geometry.shape_features(spark.createDataFrame([(None,), ("no json",)], "json string")).count() == 0


def inside(ring, x, y):
    odd = False
    for (a, b), (c, d) in zip(ring, ring[1:] + ring[:1]):
        if (b > y) != (d > y) and x < (c - a) * (y - b) / (d - b) + a:
            odd = not odd
    return odd


def test_points_in_shapes_of_all_sizes(spark):
    rng = random.Random(3)
    rings, points = [], [(i, rng.uniform(-50, 50), rng.uniform(-50, 50)) for i in range(400)]
    for size in [0.5, 3, 10, 40, 200] * 6:
        x, y = rng.uniform(-50, 50), rng.uniform(-50, 50)
        rings.append([[x + rng.uniform(-size, size), y + rng.uniform(-size, size)] for _ in range(rng.choice([3, 5, 9]))])
    shapes = [{"type": "Polygon", "coordinates": [r]} for r in rings]
    shapes += [{"type": "Point", "coordinates": [0, 0]}, {"type": "Polygon", "coordinates": [SQUARE, HOLE]}]
    rings = [[r] for r in rings] + [[], [SQUARE, HOLE]]
    extra = [(900, 2.0, 2.0), (901, 0.5, 0.5), (902, None, 1.0), (903, 0.5, 0.5), (904, 0.0, 0.0), (905, 4.0, 4.0)]
    df = spark.createDataFrame([*points, *extra], "shape int, x double, y double")  # a column whose name clashes
    got = sorted((int(r["shape"]["properties"]["no"]), r["point"]["shape"]) for r in geometry.points_in_shapes(frame(spark, *shapes), df).collect())
    want = sorted((k, i) for k, own in enumerate(rings) for i, x, y in [*points, *extra] if x is not None and sum(inside(r, x, y) for r in own) % 2)
    assert got == want and len(want) > 500
    assert {(31, 901), (31, 903), (31, 904)} <= set(want) and not {(31, 900), (31, 905)} & set(want)
    assert geometry.points_in_shapes(frame(spark, *shapes), df.limit(0)).count() == 0
    assert geometry.points_in_shapes(frame(spark), df).count() == 0


def test_no_shape_is_broadcast(spark):
    """Estimates made before shapes are parsed are far too small, so that a million of them filled the driver."""
    df = spark.createDataFrame([(1.0, 2.0)], "x double, y double")
    plan = geometry.points_in_shapes(frame(spark, {"type": "Polygon", "coordinates": [SQUARE]}), df)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan

"""GeoJSON shapes: features of every geometry type, areas, centroids, and points within shapes.

All of it is built-in array functions. Coordinates are taken as a plane's, in degrees or whatever
unit they have. Points meet shapes by cells of a grid with one level for each power of two: a shape
lies on the level whose cells are as wide as its box, so it takes four cells at most however large
it is, and a point takes one cell on each level that occurs. Who shares a cell is then tested exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POINT = "array<double>"
LINE = f"array<{POINT}>"
POLYGON = f"array<{LINE}>"
MULTIPOLYGON = f"array<{POLYGON}>"


def _read(text: Column, schema: str) -> Column:
    return F.from_json(F.concat(F.lit('{"c":'), text, F.lit("}")), f"struct<c:{schema}>")["c"]


def shape_features(df: DataFrame) -> DataFrame:
    """(properties, kind, polygons, vertices) of each feature of df's column ``json``, one collection a row.

    polygons holds the rings of each polygon, the outer one first; null for kinds without area.
    vertices holds all points of the shape. A feature without geometry, of an unknown kind or with
    unreadable coordinates keeps its row, with nulls. A null or broken collection gives no rows.
    """
    schema = "struct<features:array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>>"
    flat = df.select(F.explode(F.from_json("json", schema)["features"]).alias("f"))
    kind, text = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    polygons = F.when(kind == "Polygon", F.array(_read(text, POLYGON))).when(kind == "MultiPolygon", _read(text, MULTIPOLYGON))
    lines = F.when(kind == "Point", F.array(_read(text, POINT))).when(kind.isin("MultiPoint", "LineString"), _read(text, LINE)).when(kind == "MultiLineString", F.flatten(_read(text, POLYGON)))
    read = flat.select(F.col("f.properties").alias("properties"), kind.alias("kind"), polygons.alias("polygons"), lines.alias("lines"))
    return read.select("properties", "kind", "polygons", F.coalesce(F.flatten(F.flatten("polygons")), "lines").alias("vertices"))


def _edges(ring: Column) -> Column:
    """The edges of a ring, from its first point back to it; none for an empty ring."""
    after = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.zip_with(ring, after, lambda p, q: F.struct(F.get(p, 0).alias("x"), F.get(p, 1).alias("y"), F.get(q, 0).alias("u"), F.get(q, 1).alias("v")))


def _ring_sums(ring: Column) -> Column:
    """A ring's area and its area times its centroid, by the shoelace formula from its first point."""
    x0, y0 = F.get(F.get(ring, 0), 0), F.get(F.get(ring, 0), 1)

    def add(acc: Column, e: Column) -> Column:
        x, y, u, v = e["x"] - x0, e["y"] - y0, e["u"] - x0, e["v"] - y0
        cross = x * v - u * y
        return F.struct((acc["a"] + cross).alias("a"), (acc["mx"] + cross * (x + u)).alias("mx"), (acc["my"] + cross * (y + v)).alias("my"))

    def done(acc: Column) -> Column:
        side, area = F.signum(acc["a"]), F.abs(acc["a"]) / 2
        return F.struct(area.alias("a"), (area * x0 + side * acc["mx"] / 6).alias("mx"), (area * y0 + side * acc["my"] / 6).alias("my"))

    return F.aggregate(_edges(ring), _zero(), add, done)


def _zero() -> Column:
    return F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my"))


def measured(shapes: DataFrame, area: str = "area", cx: str = "cx", cy: str = "cy") -> DataFrame:
    """shapes (polygons, vertices) with their area and centroid; holes are taken away.

    A shape without area has area 0 and the mean of its vertices; one without vertices has a null centroid.
    """

    def part(rings: Column) -> Column:
        return F.transform(rings, lambda r, k: F.struct(F.when(k == 0, 1.0).otherwise(-1.0).alias("w"), _ring_sums(r).alias("s")))

    def add(acc: Column, r: Column) -> Column:
        return F.struct(*[(acc[c] + r["w"] * r["s"][c]).alias(c) for c in ("a", "mx", "my")])

    sums = F.aggregate(F.flatten(F.transform(F.filter("polygons", lambda p: F.size(p) > 0), part)), _zero(), add)
    mean = lambda i: F.aggregate(F.transform("vertices", lambda p: F.get(p, i)), F.lit(0.0), lambda a, v: a + v) / F.nullif(F.size("vertices"), F.lit(0))
    whole = shapes.select(F.struct("*").alias("shape"), sums.alias("sums"), mean(0).alias("x"), mean(1).alias("y"))
    has = F.coalesce(F.col("sums.a") > 0, F.lit(False))
    centre = lambda m, v: F.when(has, F.col(f"sums.{m}") / F.col("sums.a")).otherwise(F.col(v))
    return whole.select("shape.*", F.coalesce("sums.a", F.lit(0.0)).alias(area), centre("mx", "x").alias(cx), centre("my", "y").alias(cy))


def contains(polygons: Column, x: Column, y: Column) -> Column:
    """Whether a point lies within: a ray from it crosses the rings an odd number of times. A left or lower edge is within, a right or upper one isn't."""

    def crossed(e: Column) -> Column:
        return ((e["y"] > y) != (e["v"] > y)) & (x < (e["u"] - e["x"]) * (y - e["y"]) / (e["v"] - e["y"]) + e["x"])

    rings = F.transform(F.flatten(polygons), lambda r: F.size(F.filter(_edges(r), crossed)))
    return F.aggregate(rings, F.lit(0), lambda a, n: a + n) % 2 == 1


def points_in_shapes(shapes: DataFrame, points: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """(shape, point): a row for each shape (polygons, vertices) and point (x, y) within it, as structs of their columns.

    Shapes without area hold no point; a point with a null coordinate is in none. Points at one place
    are best counted before, so that a place where very many stand is one row. Shapes are read twice:
    hand in a table or the result of ``cut``. They meet points in a merge join, as no size that is
    estimated before shapes are parsed says how large they are, and a broadcast could fill the driver.
    """
    v = lambda i: F.transform("vertices", lambda p: F.get(p, i))
    box = shapes.where("polygons is not null and size(vertices) > 0").select(F.struct("*").alias("shape"), F.array_min(v(0)).alias("x1"), F.array_max(v(0)).alias("x2"), F.array_min(v(1)).alias("y1"), F.array_max(v(1)).alias("y2"))
    width = F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    levelled = box.where(width > 0).withColumn("level", F.ceil(F.log2(width)).cast("int"))
    cell = lambda c, level: F.floor(c / F.pow(F.lit(2.0), level))
    across, up = (F.sequence(cell(F.col(a), F.col("level")), cell(F.col(b), F.col("level"))) for a, b in (("x1", "x2"), ("y1", "y2")))
    sides = ["x1", "x2", "y1", "y2"]
    in_cells = levelled.select("shape", *sides, "level", F.explode(across).alias("i"), up.alias("up")).select("shape", *sides, "level", "i", F.explode("up").alias("j"))
    levels = [r["level"] for r in levelled.select("level").distinct().collect()]  # as many as a double has exponents, at most
    at = points.select(F.struct("*").alias("point"), F.explode(F.array(*map(F.lit, sorted(levels))).cast("array<int>")).alias("level"))
    at = at.select("point", "level", cell(F.col("point")[x], F.col("level")).alias("i"), cell(F.col("point")[y], F.col("level")).alias("j"))
    met = in_cells.hint("merge").join(at, ["level", "i", "j"])
    px, py = F.col("point")[x], F.col("point")[y]
    near = met.where((px >= F.col("x1")) & (px <= F.col("x2")) & (py >= F.col("y1")) & (py <= F.col("y2")))
    return near.where(contains(F.col("shape.polygons"), px, py)).select("shape", "point")

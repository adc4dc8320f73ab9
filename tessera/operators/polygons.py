"""Polygon footprints: selections by intersection, viewports, projected selections, and well-known binary.

A ring is an array of structs (x, y), not closed. Selections are short lists of vertices known to the driver, so every
test is an expression over one row: no join and no user function. Only the decoding of well-known binary runs in Arrow.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import scalars
from tessera.operators.spatial import in_ring

Ring = list[tuple[float, float]]


def ring_box(ring: Column) -> tuple[Column, Column, Column, Column]:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)


def holds(ring: Column, x: float, y: float) -> Column:
    """Whether a ring column holds a point, by the even-odd rule."""
    n = F.size(ring)

    def crossed(p: Column, i: Column) -> Column:
        q = F.get(ring, (i + 1) % n)
        side = (p["y"] > F.lit(y)) != (q["y"] > F.lit(y))
        return F.when(side, (F.lit(x) < (q["x"] - p["x"]) * (F.lit(y) - p["y"]) / (q["y"] - p["y"]) + p["x"]).cast("int")).otherwise(0)

    return F.aggregate(F.transform(ring, crossed), F.lit(0), lambda s, v: s + v) % 2 == 1


def _edge_meets(ring: Column, selection: Ring) -> Column:
    """Whether an edge of the ring crosses or touches an edge of the selection."""
    n = F.size(ring)
    turn = lambda ax, ay, bx, by, cx, cy: F.signum((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))
    between = lambda v, a, b: (v >= F.least(a, b)) & (v <= F.greatest(a, b))

    def meets(p: Column, i: Column) -> Column:
        q = F.get(ring, (i + 1) % n)
        out = F.lit(False)
        for (ax, ay), (bx, by) in zip(selection, [*selection[1:], selection[0]]):
            a, b, c, d = F.lit(ax), F.lit(ay), F.lit(bx), F.lit(by)
            t1, t2 = turn(a, b, c, d, p["x"], p["y"]), turn(a, b, c, d, q["x"], q["y"])
            t3, t4 = turn(p["x"], p["y"], q["x"], q["y"], a, b), turn(p["x"], p["y"], q["x"], q["y"], c, d)
            on = lambda t, x, y: (t == 0) & between(x, a, c) & between(y, b, d)  # noqa: E731, B023
            off = lambda t, x, y: (t == 0) & between(x, p["x"], q["x"]) & between(y, p["y"], q["y"])  # noqa: E731, B023
            out = out | ((t1 != t2) & (t3 != t4)) | on(t1, p["x"], p["y"]) | on(t2, q["x"], q["y"]) | off(t3, a, b) | off(t4, c, d)
        return out

    return F.exists(F.transform(ring, meets), lambda v: v)


def intersects(ring: Column, selection: Ring) -> Column:
    """Whether a footprint and a selection share a point, edges included. Selections and footprints of under three
    vertices hold nothing; a footprint with a null vertex never meets."""
    if len(selection) < 3:
        return F.lit(False)
    xs, ys = [p[0] for p in selection], [p[1] for p in selection]
    near = scalars.boxes_meet(ring_box(ring), tuple(F.lit(float(v)) for v in (min(xs), min(ys), max(xs), max(ys))))
    inside = F.exists(ring, lambda p: in_ring(p["x"], p["y"], selection))
    around = holds(ring, *selection[0])
    return F.coalesce((F.size(ring) >= 3) & near & (inside | around | _edge_meets(ring, selection)), F.lit(False))


def covered(ring: Column, selection: Ring) -> Column:
    """Whether a footprint lies in the selection: all vertices inside, no edge that meets its margin."""
    return F.coalesce((F.size(ring) >= 3) & F.forall(ring, lambda p: in_ring(p["x"], p["y"], selection)) & ~_edge_meets(ring, selection), F.lit(False))


def polygon_query(df: DataFrame, ring: str, selections: list[Ring], inverted: bool = False) -> DataFrame:
    """Rows whose footprint meets a selection; inverted, rows with a part outside all of them: what a padded box less the
    selections meets. Each row comes once. Selections without a polygon are an error."""
    fine = [s for s in selections if len(s) >= 3]
    if not fine:
        raise ValueError("no selection has three vertices")
    test = covered if inverted else intersects
    hit = reduce(lambda a, b: a | b, [test(F.col(ring), s) for s in fine])
    return df.where(~hit & (F.size(ring) >= 3) if inverted else hit)


def concatenated(df: DataFrame, ring: str, selections: list[Ring]) -> DataFrame:
    """The results of each selection one after the other, with its number; overlapping selections repeat a row."""
    parts = [df.where(intersects(F.col(ring), s)).withColumn("selection", F.lit(k)) for k, s in enumerate(selections)]
    return reduce(DataFrame.unionByName, parts)


def surviving(table: DataFrame, footprints: DataFrame, key: str, ring: str, selections: list[Ring]) -> DataFrame:
    """Rows of a table whose footprint meets a selection."""
    return table.join(polygon_query(footprints, ring, selections).select(key), key, "left_semi")


def in_viewport(x: Column, y: Column, box: tuple[float, float, float, float], radius: float) -> Column:
    """Points whose marker of that radius reaches into the closed box."""
    return x.between(box[0] - radius, box[2] + radius) & y.between(box[1] - radius, box[3] + radius)


def projected(x: Column, y: Column, z: Column, camera: list[list[float]], width: float, height: float) -> tuple[Column, Column, Column]:
    """(screen x, screen y, in front) of a point under a 4 x 4 camera matrix."""
    row = lambda r: r[0] * x + r[1] * y + r[2] * z + r[3]
    w = row(camera[3])
    return (row(camera[0]) / w + 1) / 2 * width, (1 - row(camera[1]) / w) / 2 * height, w > 0


def lasso_3d(x: Column, y: Column, z: Column, camera: list[list[float]], width: float, height: float, ring: Ring) -> Column:
    """Whether a point is seen inside a ring drawn on the screen; points behind the camera never are."""
    sx, sy, ahead = projected(x, y, z, camera, width, height)
    return ahead & in_ring(sx, sy, ring)


def mean_spacing(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """spacing: the root of the bounding box's area (1 at least) over the number of points; null without points."""
    area = (F.max(x) - F.min(x)) * (F.max(y) - F.min(y))
    return df.agg(F.when(F.count("*") > 0, F.sqrt(F.greatest(area, F.lit(1.0)) / F.count("*"))).alias("spacing"))


def boundaries_visible(spacing: Column, zoom: Column, pixels: float = 6.0) -> Column:
    return spacing * F.pow(F.lit(2.0), zoom) >= pixels


def extent(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """xmin, ymin, xmax, ymax of the finite points."""
    a, b = scalars.finite(F.col(x)), scalars.finite(F.col(y))
    both = a.isNotNull() & b.isNotNull()
    return df.where(both).agg(F.min(x).alias("xmin"), F.min(y).alias("ymin"), F.max(x).alias("xmax"), F.max(y).alias("ymax"))


def fit(boxes: DataFrame, width: float, height: float) -> DataFrame:
    """Joint box of boxes (xmin, ymin, xmax, ymax), its centre, and the zoom (log2) at which its tighter axis fits."""
    b = boxes.agg(F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"))
    zoom = F.log2(F.least(width / F.greatest(F.col("xmax") - F.col("xmin"), F.lit(1e-9)), height / F.greatest(F.col("ymax") - F.col("ymin"), F.lit(1e-9))))
    return b.select("*", ((F.col("xmin") + F.col("xmax")) / 2).alias("cx"), ((F.col("ymin") + F.col("ymax")) / 2).alias("cy"), zoom.alias("zoom"))


# Well-known binary.


def rings_of(data: bytes) -> list[list[tuple[float, float]]]:
    """All rings of a polygon or multipolygon in either byte order; further ordinates are skipped; rings come open. Other
    kinds are an error."""
    rings: list[list[tuple[float, float]]] = []

    def read(at: int) -> int:
        order = "<" if data[at] == 1 else ">"
        code = struct.unpack_from(f"{order}I", data, at + 1)[0]
        at += 5
        size = 2 + bool(code & 0x80000000) + bool(code & 0x40000000) if code >> 29 else 2 + {0: 0, 1: 1, 2: 1, 3: 2}[code // 1000 % 4]
        if code & 0x20000000:
            at += 4
        kind = code & 0xFF if code >> 29 else code % 1000
        n = struct.unpack_from(f"{order}I", data, at)[0]
        at += 4
        if kind == 6:
            for _ in range(n):
                at = read(at)
            return at
        if kind != 3:
            raise ValueError(f"geometry of kind {kind} has no rings")
        for _ in range(n):
            m = struct.unpack_from(f"{order}I", data, at)[0]
            flat = struct.unpack_from(f"{order}{m * size}d", data, at + 4)
            at += 4 + 8 * m * size
            points = [(flat[k * size], flat[k * size + 1]) for k in range(m)]
            rings.append(points[:-1] if len(points) > 1 and points[0] == points[-1] else points)
        return at

    read(0)
    return rings


RINGS = "array<array<struct<x:double,y:double>>>"


def decode(df: DataFrame, column: str, key: str) -> DataFrame:
    """(key, rings) of a column of well-known binary; null for null."""
    kind = df.schema[key].dataType.simpleString()
    shape = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [None if v is None else [[{"x": x, "y": y} for x, y in r] for r in rings_of(v)] for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, shape)], names=["key", "rings"])

    return df.select(key, column).mapInArrow(run, f"key {kind}, rings {RINGS}").withColumnRenamed("key", key)


def encode(df: DataFrame, rings: str, key: str, digits: int | None = 2) -> DataFrame:
    """(key, wkb) of a column of rings, its coordinates rounded to so many digits, as a polygon of closed rings."""
    kind = df.schema[key].dataType.simpleString()

    def one(rs: list | None) -> bytes | None:
        if rs is None:
            return None
        out = [struct.pack("<BII", 1, 3, len(rs))]
        for r in rs:
            points = [(p["x"], p["y"]) if digits is None else (round(p["x"], digits), round(p["y"], digits)) for p in r]
            points += points[:1]
            out.append(struct.pack(f"<I{2 * len(points)}d", len(points), *(v for p in points for v in p)))
        return b"".join(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([one(v) for v in batch.column(1).to_pylist()], pa.binary())], names=["key", "wkb"])

    return df.select(key, rings).mapInArrow(run, f"key {kind}, wkb binary").withColumnRenamed("key", key)

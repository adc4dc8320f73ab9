"""Regions found from points: the mask of a tissue and distances to its margin, and the cores of a tissue array.

Points are rows (id, x, y and, for masks, label). Only aggregates of a bounded size leave the executors: histograms of an
axis, occupied cells of a grid with a fixed number of cells per core, hulls.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

AXIS_BINS = 2048
#: Most bins along a side of a mask's raster.
MOST_BINS = 4096
BROADCAST_BINS = 1_000_000
UNASSIGNED = "unassigned"


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def mask_boundary(
    points: DataFrame, interior: list, bin_size: float | None = None, bandwidth: float | None = None, threshold: float = 0.25, margin: float | None = None
) -> DataFrame:
    """(id, signed_distance, compartment): the mask is where the smoothed density of the interior labels is at least
    `threshold` of its maximum; the distance of a point is that of its bin to the nearest bin of the other kind,
    negative inside; compartments are core, margin (within `margin`) and stroma.

    The raster has about 60 bins along the shorter side (or bins of `bin_size`) and at most `MOST_BINS` along the longer one,
    which a far outlier would stretch, however many points there are; distances are exact and found by columns, then by
    rows, a row in a task. Points without a place, and all if the mask has no or every bin, have
    nulls. An interior label that no point has is an error."""
    known = {r[0] for r in points.where(F.col("label").isin(interior)).select("label").distinct().collect()}
    if missing := [v for v in interior if v not in known]:
        raise ValueError(f"no point has the labels {missing}")
    placed = points.where(_finite(F.col("x")) & _finite(F.col("y")))
    x0, y0, x1, y1 = placed.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    if x0 is None:
        return points.select("id", F.lit(None).cast("double").alias("signed_distance"), F.lit(None).cast("string").alias("compartment"))
    size = bin_size or min(x1 - x0, y1 - y0) / 60 or max(x1 - x0, y1 - y0) / 60 or 1.0
    size = max(size, max(x1 - x0, y1 - y0) / (MOST_BINS - 1))
    bandwidth = 3 * size if bandwidth is None else bandwidth
    margin = bandwidth if margin is None else margin
    nx, ny = math.floor((x1 - x0) / size) + 1, math.floor((y1 - y0) / size) + 1
    at = lambda c, low: F.floor((F.col(c) - low) / size).cast("int")
    binned = points.withColumn("bx", F.when(_finite(F.col("x")), at("x", x0))).withColumn("by", F.when(_finite(F.col("y")), at("y", y0)))
    density = binned.where(F.col("label").isin(interior)).groupBy("bx", "by").agg(F.count("*").cast("double").alias("n"))
    reach = math.ceil(3 * bandwidth / size)
    kernel = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(math.exp(-((k * size) ** 2) / (2 * bandwidth**2)) if bandwidth else 1.0).alias("w")) for k in range(-reach, reach + 1)]))
    for c, n in (("bx", nx), ("by", ny)):
        other = "by" if c == "bx" else "bx"
        density = density.select(other, c, "n", kernel.alias("s")).select(other, (F.col(c) + F.col("s.k")).alias(c), (F.col("n") * F.col("s.w")).alias("n"))
        density = density.where(F.col(c).between(0, n - 1)).groupBy(other, c).agg(F.sum("n").alias("n"))
    grid = points.sparkSession.range(nx * ny).select((F.col("id") % nx).cast("int").alias("bx"), F.floor(F.col("id") / nx).cast("int").alias("by"))
    grid = grid.join(density, ["bx", "by"], "left").crossJoin(F.broadcast(density.agg(F.max("n").alias("most"))))  # one row
    grid = grid.select("bx", "by", (F.coalesce("n", F.lit(0.0)) >= F.greatest(threshold * F.col("most"), F.lit(1e-12))).alias("m"))
    column = Window.partitionBy("bx").orderBy("by")
    before, after = column.rowsBetween(Window.unboundedPreceding, 0), column.rowsBetween(0, Window.unboundedFollowing)

    def down(kind: Column) -> Column:
        own = F.when(kind, F.col("by"))
        return F.least(F.col("by") - F.last(own, True).over(before), F.first(own, True).over(after) - F.col("by"))

    far = grid.select("bx", "by", "m", down(F.col("m")).alias("to_in"), down(~F.col("m")).alias("to_out"))

    def across(row: pd.DataFrame) -> pd.DataFrame:
        """The least distance over the columns of one row, at most MOST_BINS bins long."""
        bx, m = row["bx"].to_numpy(), row["m"].to_numpy()
        out = np.full(len(row), np.nan)
        for kind, side in ((True, "to_out"), (False, "to_in")):
            g, own = row[side].to_numpy(dtype=float), np.flatnonzero(m == kind)
            has = np.flatnonzero(np.isfinite(g))
            for at in range(0, len(own), 256) if len(has) else ():
                some = own[at : at + 256]
                d = np.sqrt(((bx[some, None] - bx[None, has]) ** 2 + g[None, has] ** 2).min(axis=1))
                out[some] = np.where(kind, -d, d) * size
        return pd.DataFrame({"bx": bx, "by": row["by"], "signed_distance": out})

    edt = far.groupBy("by").applyInPandas(across, "bx int, by int, signed_distance double")
    edt = edt.withColumn("signed_distance", F.nanvl("signed_distance", F.lit(None).cast("double")))
    out = binned.select("id", "bx", "by").join(F.broadcast(edt) if nx * ny <= BROADCAST_BINS else edt, ["bx", "by"], "left")
    d = F.col("signed_distance")
    return out.select("id", "signed_distance", F.when(F.abs(d) <= margin, "margin").when(d < 0, "core").when(d > 0, "stroma").alias("compartment"))


def _mixture(at: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, float]:
    """Means of a mixture of k normal curves over a histogram, and the mean probability of the likeliest curve."""
    share = weight / weight.sum()
    mu = np.interp((np.arange(k) + 0.5) / k, np.cumsum(share), at)
    for _ in range(30):
        near = np.abs(at[:, None] - mu[None]).argmin(axis=1)
        held = np.bincount(near, weights=share, minlength=k)
        mu = np.where(held > 0, np.bincount(near, weights=share * at, minlength=k) / np.maximum(held, 1e-12), mu)
    floor = (at[1] - at[0]) ** 2 if len(at) > 1 else 1.0
    var = np.maximum(np.bincount(near, weights=share * (at - mu[near]) ** 2, minlength=k) / np.maximum(held, 1e-12), floor)
    part = np.maximum(held, 1e-9)
    for _ in range(100):
        log = np.log(part) - 0.5 * np.log(var) - (at[:, None] - mu[None]) ** 2 / (2 * var)
        p = np.exp(log - log.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        r = p * share[:, None]
        part = np.maximum(r.sum(axis=0), 1e-9)
        new = (r * at[:, None]).sum(axis=0) / part
        var = np.maximum((r * (at[:, None] - new[None]) ** 2).sum(axis=0) / part, floor)
        if np.abs(new - mu).max() < 1e-9 * max(1.0, np.ptp(at)):
            break
        mu = new
    return np.sort(mu), float((p.max(axis=1) * share).sum())


def grid_lines(at: np.ndarray, weight: np.ndarray, n: int | None, most: int = 16) -> np.ndarray:
    """The grid lines of an axis from its histogram; n lines, or as many as give the surest assignment. Lines that are
    missing in gaps of over 1.75 times the median spacing are filled in evenly."""
    counts = [n] if n else range(2, min(most, max(2, len(at) - 1)) + 1)
    lines = max((_mixture(at, weight, k) for k in counts), key=lambda x: round(x[1], 6))[0]
    if len(lines) < 2:
        return lines
    step = np.median(np.diff(lines))
    fill = [np.linspace(a, b, max(2, round((b - a) / step)) if b - a > 1.75 * step else 1, endpoint=False) for a, b in zip(lines[:-1], lines[1:])]
    return np.r_[np.concatenate(fill), lines[-1]]


def hull(p: np.ndarray) -> np.ndarray:
    """The convex hull of points, counter-clockwise from the leftmost."""
    p = np.unique(p, axis=0)
    if len(p) < 3:
        return p

    def half(points: np.ndarray) -> list:
        out: list = []
        for q in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]):
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(half(p) + half(p[::-1]))


def _settle(cells: np.ndarray, centres: np.ndarray, rounds: int = 50) -> np.ndarray:
    """The place in centres of the core that each occupied cell belongs to, as the cores move to their cells."""
    alive = np.arange(len(centres))
    own = np.zeros(len(cells), dtype=int)
    for _ in range(rounds):
        near, dist = [], []
        for s in range(0, len(cells), 16_384):
            d = np.hypot(cells[s : s + 16_384, 0, None] - centres[alive, 0], cells[s : s + 16_384, 1, None] - centres[alive, 1])
            near.append(d.argmin(axis=1))
            dist.append(d.min(axis=1))
        new, dist = alive[np.concatenate(near)], np.concatenate(dist)
        close = dist <= 2 * np.median(dist)
        held = np.bincount(new[close], minlength=len(centres))
        keep = np.flatnonzero((held > 0) & (held >= 0.1 * np.median(held[held > 0])))
        moved = np.stack([np.bincount(new[close], weights=cells[close, c], minlength=len(centres)) / np.maximum(held, 1) for c in (0, 1)], axis=1)
        same = np.array_equal(new, own) and np.array_equal(keep, alive)
        own, alive = new, keep
        centres = np.where((held > 0)[:, None], moved, centres)
        if same:
            break
    return own


def tissue_cores(
    points: DataFrame, angle: float = 0.0, rows: int | None = None, columns: int | None = None, least_share: float = 0.001,
    row_letters: bool = True, row_start: str = "Top", column_start: str = "Left",
) -> DataFrame:
    """(id, core): the name of the core of a tissue array whose hull holds the point, else `unassigned`.

    Grid lines come from histograms of the axes turned by `angle` degrees; occupied cells of a fine grid (20 to a
    spacing) settle on cores; a core's hull leaves out points beyond 1.1 times the 99th percentile of their distance
    from its mean. Hulls are built from the hulls of partitions, so no task holds a core's points. Cores with less than
    `least_share` of the points have no name. Points without a place are unassigned."""
    if row_start not in ("Top", "Bottom") or column_start not in ("Left", "Right"):
        raise ValueError("row_start is Top or Bottom, column_start is Left or Right")
    spark, turn = points.sparkSession, math.radians(angle)
    u = F.col("x") * math.cos(turn) - F.col("y") * math.sin(turn)
    v = F.col("x") * math.sin(turn) + F.col("y") * math.cos(turn)
    all_points = points.select("id", u.alias("u"), v.alias("v"))
    p = all_points.where(_finite(F.col("u")) & _finite(F.col("v")))
    none = points.select("id", F.lit(UNASSIGNED).alias("core"))
    low_u, high_u, low_v, high_v = p.agg(F.min("u"), F.max("u"), F.min("v"), F.max("v")).first()
    if low_u is None or low_u == high_u or low_v == high_v:
        return none
    lines = []
    for c, low, high, n in (("u", low_u, high_u, columns), ("v", low_v, high_v, rows)):
        step = (high - low) / AXIS_BINS
        h = p.groupBy(F.least(F.floor((F.col(c) - low) / step), F.lit(AXIS_BINS - 1)).alias("b")).count().collect()  # AXIS_BINS rows
        w = np.zeros(AXIS_BINS)
        w[[r["b"] for r in h]] = [r["count"] for r in h]
        lines.append(grid_lines(low + (np.arange(AXIS_BINS) + 0.5) * step, w, n))
    us, vs = lines
    gaps = [float(np.median(np.diff(x))) if len(x) > 1 else high - low for x, low, high in ((us, low_u, high_u), (vs, low_v, high_v))]
    fine = min(gaps) / 20
    gu, gv = F.floor(F.col("u") / fine).alias("gu"), F.floor(F.col("v") / fine).alias("gv")
    close = F.col("u").between(us[0] - 2 * gaps[0], us[-1] + 2 * gaps[0]) & F.col("v").between(vs[0] - 2 * gaps[1], vs[-1] + 2 * gaps[1])
    p = p.where(close).select("id", "u", "v", gu, gv)
    cells = p.select("gu", "gv").distinct().toPandas()  # 400 cells a core and spacing ratio, at most
    centres = np.array([(a / fine - 0.5, b / fine - 0.5) for b in vs for a in us])
    cells["k"] = _settle(cells[["gu", "gv"]].to_numpy(dtype=float), centres)
    of = p.join(F.broadcast(spark.createDataFrame(cells, "gu bigint, gv bigint, k int")), ["gu", "gv"]).select("k", "u", "v")
    sums = of.groupBy("k").agg(F.count("*").alias("n"), F.avg("u").alias("mu"), F.avg("v").alias("mv"))
    of = of.join(F.broadcast(sums), "k").select("k", "n", "u", "v", F.hypot(F.col("u") - F.col("mu"), F.col("v") - F.col("mv")).alias("d"))
    trim = of.groupBy("k", "n").agg((1.1 * F.percentile_approx("d", 0.99, 10_000)).alias("most"))
    total = F.lit(least_share) * sums.agg(F.sum("n")).first()[0]
    of = of.join(F.broadcast(trim.where(F.col("n") >= F.floor(total)).select("k", "most")), "k").where("d <= most").select("k", "u", "v")

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for f in frames:
            for k, g in f.groupby("k"):
                own = g[["u", "v"]].to_numpy()
                held[k] = hull(np.concatenate([held[k], own]) if k in held else own)
        for k, h in held.items():
            yield pd.DataFrame({"k": np.int32(k), "u": h[:, 0], "v": h[:, 1]})

    corners = of.mapInPandas(partial, "k int, u double, v double").toPandas()  # partitions x cores x corners of a hull
    hulls = {k: h for k, g in corners.groupby("k") if len(h := hull(g[["u", "v"]].to_numpy())) > 2}
    if not hulls:
        return none
    r_of, c_of = sorted({k // len(us) for k in hulls}, reverse=row_start == "Top"), sorted({k % len(us) for k in hulls}, reverse=column_start == "Right")
    letter = lambda i: chr(65 + i) if i < 26 else letter(i // 26 - 1) + chr(65 + i % 26)
    names = {}
    for k in sorted(hulls):
        r, c = r_of.index(k // len(us)), c_of.index(k % len(us))
        names[k] = f"{letter(r)}{c + 1}" if row_letters else f"{letter(c)}{r + 1}"
    shared = spark.sparkContext.broadcast([(names[k], hulls[k]) for k in sorted(hulls)])

    @pandas_udf("string")
    def inside(us: pd.Series, vs: pd.Series) -> pd.Series:
        x, y = us.to_numpy(dtype=float), vs.to_numpy(dtype=float)
        out = np.full(len(x), UNASSIGNED, dtype=object)
        for name, h in shared.value:
            at = np.flatnonzero((x >= h[:, 0].min()) & (x <= h[:, 0].max()) & (y >= h[:, 1].min()) & (y <= h[:, 1].max()) & (out == UNASSIGNED))
            for a, b in zip(h, np.roll(h, -1, axis=0)):
                at = at[(b[0] - a[0]) * (y[at] - a[1]) >= (b[1] - a[1]) * (x[at] - a[0])]
            out[at] = name
        return pd.Series(out)

    return all_points.select("id", inside("u", "v").alias("core"))

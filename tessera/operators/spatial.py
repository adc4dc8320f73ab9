"""Spatial graphs and statistics over points (id, x, y, label, lib).

Neighbour searches are equi-joins on grid cells: a point meets only the points of nearby cells, so the work follows the
number of neighbours and not the square of the table. Ties of distance are broken by id. Small tables (`SMALL` targets)
are joined by lib alone.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.shared import materialize


def _around(df: DataFrame, size: float, ring: int) -> DataFrame:
    """df once for each cell within `ring` cells of its own."""
    steps = F.array(*[F.lit(i) for i in range(-ring, ring + 1)])
    df = df.withColumn("dx", F.explode(steps)).withColumn("dy", F.explode(steps))
    return df.select("*", (F.floor(F.col("x") / size) + F.col("dx")).alias("cx"), (F.floor(F.col("y") / size) + F.col("dy")).alias("cy")).drop("dx", "dy")


def _cells(df: DataFrame, size: float) -> DataFrame:
    return df.select("*", F.floor(F.col("x") / size).alias("cx"), F.floor(F.col("y") / size).alias("cy"))


def pairs_within(a: DataFrame, b: DataFrame, radius: float) -> DataFrame:
    """(i, j, d and the labels li, lj) of pairs of points of the same lib at most radius apart, self-pairs excluded."""
    left = _around(a, radius, 1).select(F.col("id").alias("i"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("label").alias("li"), "lib", "cx", "cy")
    right = _cells(b, radius).select(F.col("id").alias("j"), F.col("x").alias("bx"), F.col("y").alias("by"), F.col("label").alias("lj"), "lib", "cx", "cy")
    d = F.sqrt((F.col("ax") - F.col("bx")) ** 2 + (F.col("ay") - F.col("by")) ** 2)
    out = left.join(right, ["lib", "cx", "cy"]).where("i <> j").withColumn("d", d)
    return out.where(F.col("d") <= radius).select("i", "j", "d", "li", "lj", "lib")


#: Pairs of points and targets up to which the points that are left meet all targets.
FEW_PAIRS = 50_000_000
#: Targets up to which points meet all targets of their lib at once, without a grid.
SMALL = 5000


def _ranked(left: DataFrame, right: DataFrame, on: list[str], k: int, include_self: bool) -> DataFrame:
    """(i, j, d, rk, li, lj, lib) of the k nearest of the targets that meet each point."""
    d = F.sqrt((F.col("p.x") - F.col("q.x")) ** 2 + (F.col("p.y") - F.col("q.y")) ** 2)
    near = left.join(right, on)
    if not include_self:
        near = near.where("p.id <> q.id")
    near = near.select(F.col("p.id").alias("i"), F.col("q.id").alias("j"), d.alias("d"), F.col("p.label").alias("li"), F.col("q.label").alias("lj"), "lib")
    near = near.withColumn("rk", F.row_number().over(Window.partitionBy("i").orderBy("d", "j"))).where(F.col("rk") <= k)
    return near.select("i", "j", "d", F.col("rk").cast("bigint").alias("rk"), "li", "lj", "lib")


def _cell_size(targets: DataFrame, n: int, libs: int, box: list, wanted: float) -> float:
    """A cell size at which a target shares its cell with about `wanted` others, whatever lies far outside: from the box of
    all but the outer 4 %, then halved while cells are too full."""
    size = max(((box[1] - box[0]) * (box[3] - box[2]) * wanted * libs / n) ** 0.5, 1e-300)
    for _ in range(12):
        held = _cells(targets, size).groupBy("lib", "cx", "cy").agg(F.count("*").alias("c"))
        full = held.agg(F.sum(F.col("c").cast("double") ** 2) / F.sum("c")).first()[0]
        if full <= 8 * wanted:
            break
        size *= max(0.125, min(0.5, (2 * wanted / full) ** 0.5))
    return size


def knn(points: DataFrame, k: int, include_self: bool = False, targets: DataFrame | None = None) -> DataFrame:
    """(i, j, d, rk, li, lj, lib): the k nearest targets (default: the points) of each point in its lib, exactly.

    Each round, points meet the targets of the nine cells around their own; a point is settled once its k-th distance is
    within a cell's size, which nothing beyond the nine cells can be. The others go on to cells four times as large, and
    meet all targets at last when they are few: a far outlier never makes others meet a whole cluster, and no point is
    copied more than nine times."""
    targets = points if targets is None else targets
    s = targets.agg(
        F.count("*").alias("n"), F.count_distinct("lib").alias("libs"), F.percentile_approx("x", F.array(F.lit(0.02), F.lit(0.98))).alias("x"), F.percentile_approx("y", F.array(F.lit(0.02), F.lit(0.98))).alias("y"),
        *(e.alias(f"{c}{m}") for c in "xy" for m, e in (("lo", F.min(c)), ("hi", F.max(c)))),
    ).first()
    kind = F.struct("id", "x", "y", "label")
    if s["n"] <= SMALL:
        return _ranked(points.select("lib", kind.alias("p")), targets.select("lib", kind.alias("q")), ["lib"], k, include_self)
    own = points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if own[0] is None:
        return _ranked(points.select("lib", kind.alias("p")), targets.select("lib", kind.alias("q")), ["lib"], k, include_self)
    span = max(max(own[1], s["xhi"]) - min(own[0], s["xlo"]), max(own[3], s["yhi"]) - min(own[2], s["ylo"]), 1e-300)
    size = min(_cell_size(targets, s["n"], max(s["libs"], 1), [*s["x"], *s["y"]], 0.6 * k + 2), span)
    found, rest = [], points
    while True:
        left = _around(rest, size, 1).select("lib", "cx", "cy", kind.alias("p"))
        right = _cells(targets, size).select("lib", "cx", "cy", kind.alias("q"))
        near = _ranked(left, right, ["lib", "cx", "cy"], k, include_self)
        if size >= span:
            return reduce(DataFrame.unionByName, [*found, near])
        whole = Window.partitionBy("i")
        near = near.withColumn("n", F.count("*").over(whole)).withColumn("m", F.max("d").over(whole))
        done = materialize(near.where((F.col("n") == k) & (F.col("m") <= size)).drop("n", "m"), "knn")
        found.append(done)
        rest = materialize(rest.join(done.where("rk = 1").select(F.col("i").alias("id")), "id", "left_anti"), "unsettled")
        left_over = rest.count()
        if not left_over:
            return reduce(DataFrame.unionByName, found)
        size = size * 4 if left_over * s["n"] > FEW_PAIRS else span


def knn_vectors(df: DataFrame, k: int, block: int = 8192) -> DataFrame:
    """(i, j, d, rk): exact nearest neighbours of vectors (id, v: array<double>), by pairs of tiles of `block` rows.

    A pair of tiles is compared once, by a matrix product, for the rows of both; each row keeps a few more than k
    candidates by it, whose distances are then worked out from the differences. What a task returns is one row with arrays
    of k candidates for each vector; a vector is sent to as many tasks as there are tiles."""
    n = df.count()
    tiles = max(1, -(-n // block))
    t = df.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(tiles)).cast("int").alias("t"))
    rows = t.select("*", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("o"))
    rows = rows.select("id", "v", "t", F.least("t", "o").alias("a"), F.greatest("t", "o").alias("b"))
    kind = df.schema["id"].dataType.simpleString()
    extra = k + 8

    def nearest(ids: np.ndarray, x: np.ndarray, to: np.ndarray, y: np.ndarray) -> tuple[list, list]:
        js, ds = [], []
        yy = (y * y).sum(axis=1)
        step = max(1, 4_000_000 // max(1, len(y)))
        for s in range(0, len(x), step):
            part = x[s : s + step]
            d2 = (part * part).sum(axis=1)[:, None] + yy[None] - 2 * part @ y.T
            d2[ids[s : s + step, None] == to[None]] = np.inf
            best = np.argpartition(d2, extra - 1, axis=1)[:, :extra] if len(y) > extra else np.tile(np.arange(len(y)), (len(part), 1))
            d = np.sqrt(((part[:, None] - y[best]) ** 2).sum(axis=2))
            d[np.isinf(np.take_along_axis(d2, best, axis=1))] = np.inf
            order = np.lexsort((to[best], d))[:, :k]
            j, d = np.take_along_axis(to[best], order, axis=1), np.take_along_axis(d, order, axis=1)
            js += [a[np.isfinite(b)] for a, b in zip(j, d)]
            ds += [b[np.isfinite(b)] for b in d]
        return js, ds

    def near(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        own = [g[g["t"] == c] for c in dict.fromkeys(key)]
        ids, xs = [p["id"].to_numpy() for p in own], [np.stack(p["v"].to_numpy()) if len(p) else np.zeros((0, 1)) for p in own]
        if any(len(p) == 0 for p in own):
            return pd.DataFrame({"i": [], "j": [], "d": []})
        sides = [(0, 0)] if len(own) == 1 else [(0, 1), (1, 0)]
        out = [nearest(ids[p], xs[p], ids[q], xs[q]) for p, q in sides]
        return pd.DataFrame({"i": np.concatenate([ids[p] for p, _ in sides]), "j": [v for js, _ in out for v in js], "d": [v for _, ds in out for v in ds]})

    got = rows.groupBy("a", "b").applyInPandas(near, f"i {kind}, j array<{kind}>, d array<double>")
    got = got.select("i", F.explode(F.arrays_zip("j", "d")).alias("e")).select("i", "e.j", "e.d")
    got = got.withColumn("rk", F.row_number().over(Window.partitionBy("i").orderBy("d", "j")).cast("bigint"))
    return got.where(F.col("rk") <= k)


def composition(edges: DataFrame) -> DataFrame:
    """(i, label, proportion) of the labels among the neighbours of each point."""
    n = edges.groupBy("i", F.col("lj").alias("label")).agg(F.count("*").alias("n"))
    return n.select("i", "label", (F.col("n") / F.sum("n").over(Window.partitionBy("i"))).alias("proportion"))


def grid_graph(places: DataFrame, kind: str = "square", rings: int = 1) -> DataFrame:
    """(i, j, ring) of places (id, row, col, lib) on a grid that are at most `rings` steps apart: four neighbours each on a
    square grid, six on a hexagonal one whose rows are shifted by one of two columns. One equi-join for each offset."""
    steps = {"square": [(0, 1), (0, -1), (1, 0), (-1, 0)], "hex": [(0, 2), (0, -2), (1, 1), (1, -1), (-1, 1), (-1, -1)]}
    if kind not in steps:
        raise ValueError(f"kind is square or hex, not {kind!r}")
    reach, front = {(0, 0): 0}, [(0, 0)]
    for ring in range(1, rings + 1):
        front = [(a + c, b + d) for a, b in front for c, d in steps[kind]]
        front = [p for p in dict.fromkeys(front) if p not in reach]
        reach |= dict.fromkeys(front, ring)
    offsets = F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc"), F.lit(k).alias("ring")) for (a, b), k in reach.items() if k])
    left = places.select(F.col("id").alias("i"), "lib", "row", "col", F.explode(offsets).alias("o"))
    left = left.select("i", "lib", (F.col("row") + F.col("o.dr")).alias("row"), (F.col("col") + F.col("o.dc")).alias("col"), F.col("o.ring").alias("ring"))
    return left.join(places.select(F.col("id").alias("j"), "lib", "row", "col"), ["lib", "row", "col"]).select("i", "j", "ring")


def interaction(edges: DataFrame, normalized: bool = False, weight: str | None = None) -> DataFrame:
    """(li, lj, n) label-pair edge counts, or sums of a weight, or each row's shares of them (share)."""
    n = edges.groupBy("li", "lj").agg((F.sum(weight) if weight else F.count("*")).alias("n"))
    return n.select("li", "lj", (F.col("n") / F.sum("n").over(Window.partitionBy("li"))).alias("share")) if normalized else n


def shuffled_labels(points: DataFrame, n_perms: int, seed: int = 0) -> DataFrame:
    """(perm, id, label): labels dealt anew within each lib, by the order of an MD5 of seed, permutation and id."""
    perms = points.select("id", "label", "lib", F.explode(F.sequence(F.lit(0), F.lit(n_perms - 1))).alias("perm"))
    key = F.md5(F.concat_ws("|", F.lit(seed), "perm", "id"))
    own = Window.partitionBy("perm", "lib").orderBy("id")
    new = Window.partitionBy("perm", "lib").orderBy("key", "id")
    ranked = perms.withColumn("key", key).select("perm", "lib", "id", "label", F.row_number().over(own).alias("r"), F.row_number().over(new).alias("s"))
    return ranked.select("perm", "lib", "id", "r").join(ranked.select("perm", "lib", "label", F.col("s").alias("r")), ["perm", "lib", "r"]).select("perm", "id", "label")


def permutation_z(observed: DataFrame, permuted: DataFrame, keys: list[str], value: str, n_perms: int) -> DataFrame:
    """keys, observed value, mean and sd (population) over permutations with absent pairs as 0, and z."""
    s = permuted.groupBy(*keys).agg(F.sum(value).alias("s1"), F.sum(F.col(value) * F.col(value)).alias("s2"))
    out = observed.join(s, keys, "left").fillna(0, ["s1", "s2"])
    mean = F.col("s1") / n_perms
    sd = F.sqrt(F.greatest(F.col("s2") / n_perms - mean * mean, F.lit(0.0)))
    return out.select(*keys, F.col(value).alias("observed"), mean.alias("mean"), sd.alias("sd"), F.when(sd > 0, (F.col(value) - mean) / sd).alias("z"))


def nhood_enrichment(edges: DataFrame, points: DataFrame, n_perms: int = 10, seed: int = 0) -> DataFrame:
    perm = shuffled_labels(points, n_perms, seed)
    e = edges.select("i", "j")
    a = perm.select("perm", F.col("id").alias("i"), F.col("label").alias("li"))
    b = perm.select("perm", F.col("id").alias("j"), F.col("label").alias("lj"))
    counts = e.join(a, "i").join(b, ["perm", "j"]).groupBy("perm", "li", "lj").agg(F.count("*").alias("n"))
    return permutation_z(interaction(edges), counts, ["li", "lj"], "n", n_perms)


def autocorrelation(edges: DataFrame, values: DataFrame) -> DataFrame:
    """(moran_i, geary_c) of values (id, value) over unit-weight edges (i, j)."""
    m = values.agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.var_pop("value").alias("var"))
    e = edges.select("i", "j").join(values.select(F.col("id").alias("i"), F.col("value").alias("vi")), "i").join(values.select(F.col("id").alias("j"), F.col("value").alias("vj")), "j")
    e = e.crossJoin(F.broadcast(m))  # one row
    s = e.groupBy("n", "mean", "var").agg(F.count("*").alias("w"), F.sum((F.col("vi") - F.col("mean")) * (F.col("vj") - F.col("mean"))).alias("c"), F.sum((F.col("vi") - F.col("vj")) ** 2).alias("g"))
    total = F.col("n") * F.col("var")
    return s.select((F.col("n") / F.col("w") * F.col("c") / total).alias("moran_i"), ((F.col("n") - 1) / (2 * F.col("w")) * F.col("g") / total).alias("geary_c"))


def co_occurrence(points: DataFrame, edges: list[float]) -> DataFrame:
    """(li, lj, bin, n, ratio): pairs by distance bin (edges[b], edges[b+1]]; ratio is P(lj | li, bin) / P(lj | bin)."""
    p = pairs_within(points, points, edges[-1])
    b = reduce(lambda c, i: c.when(F.col("d") <= edges[i + 1], i), range(len(edges) - 1), F.when(F.col("d") <= edges[0], -1))
    n = p.select("li", "lj", b.cast("bigint").alias("bin")).where("bin >= 0").groupBy("li", "lj", "bin").agg(F.count("*").alias("n"))
    over = lambda *c: F.sum("n").over(Window.partitionBy("bin", *c))
    return n.select("li", "lj", "bin", "n", ((F.col("n") / over("li")) / (over("lj") / over())).alias("ratio"))


def ripley(points: DataFrame, radii: list[float]) -> DataFrame:
    """(label, r, pairs, l): ordered pairs of a label within r, and L(r) over the bounding box's area."""
    p = pairs_within(points, points, max(radii)).where("li = lj")
    box = points.agg(((F.max("x") - F.min("x")) * (F.max("y") - F.min("y"))).alias("area"))
    size = points.groupBy("label").agg(F.count("*").alias("n"))
    grid = size.crossJoin(F.broadcast(box)).select("*", F.explode(F.array(*map(F.lit, radii))).alias("r"))
    hits = p.select(F.col("li").alias("label"), "d", F.explode(F.array(*map(F.lit, radii))).alias("r")).where("d <= r").groupBy("label", "r").agg(F.count("*").alias("pairs"))
    out = grid.join(hits, ["label", "r"], "left").fillna(0, ["pairs"])
    k = F.col("area") * F.col("pairs") / (F.col("n") * (F.col("n") - 1))
    return out.select("label", "r", "pairs", F.when(F.col("n") > 1, F.sqrt(k / F.lit(np.pi))).alias("l"))


def nearest_type(points: DataFrame) -> DataFrame:
    """(i, li, lj, d): the distance from each point to the nearest point of each other label in its lib.

    Each point asks once for each other label (a few categories); asks and targets meet under lib and label."""
    labels = points.select(F.col("label").alias("want")).distinct()
    asks = points.crossJoin(F.broadcast(labels)).where("label <> want")  # categories, not rows
    ask_lib = F.concat_ws("|", "lib", "want")
    asks = asks.select(F.struct("id", F.col("want").alias("want")).alias("id"), "x", "y", "label", ask_lib.alias("lib"))
    targets = points.select(F.struct("id", F.col("label").alias("want")).alias("id"), "x", "y", "label", F.concat_ws("|", "lib", "label").alias("lib"))
    near = knn(asks, 1, include_self=True, targets=targets)
    return near.select(F.col("i.id").alias("i"), "li", "lj", "d")


def proximity(points: DataFrame) -> DataFrame:
    """(li, lj, median_d, mean_d) of nearest-neighbour distances of each ordered pair of labels."""
    return nearest_type(points).groupBy("li", "lj").agg(F.percentile("d", F.lit(0.5)).alias("median_d"), F.avg("d").alias("mean_d"))


def soft_boundary(points: DataFrame, interior: list, radius: float, margin: float = 0.15) -> DataFrame:
    """(id, insideness, compartment): the share of interior points among those within radius, the point itself too."""
    is_in = lambda c: F.col(c).isin(interior).cast("double")
    p = pairs_within(points, points, radius).groupBy("i").agg(F.sum(is_in("lj")).alias("s"), F.count("*").alias("n"))
    out = points.join(p.withColumnRenamed("i", "id"), "id", "left").fillna(0, ["s", "n"])
    f = (F.col("s") + is_in("label")) / (F.col("n") + 1)
    return out.select("id", f.alias("insideness"), F.when(f > 0.5 + margin, "core").when(f < 0.5 - margin, "stroma").otherwise("margin").alias("compartment"))


def in_ring(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """Even-odd ray cast against one ring, behind a bounding-box test; rings of under three vertices hold nothing."""
    if len(ring) < 3:
        return F.lit(False)
    inside = F.lit(False)
    for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]]):
        if y1 != y2:
            inside = inside != (((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1))
    xs, ys = [p[0] for p in ring], [p[1] for p in ring]
    return x.between(min(xs), max(xs)) & y.between(min(ys), max(ys)) & inside


def in_polygons(x: Column, y: Column, rings: list[list[tuple[float, float]]]) -> Column:
    return reduce(lambda a, b: a | b, [in_ring(x, y, r) for r in rings], F.lit(False))


def bbox_query(df: DataFrame, box: tuple[float, float, float, float], limit: int | None = None) -> DataFrame:
    """Rows whose x, y lie in the closed box; with a limit, none at all if there are more than limit."""
    out = df.where(F.col("x").between(box[0], box[2]) & F.col("y").between(box[1], box[3]))
    if limit is not None:
        n = out.agg(F.count("*").alias("n_hits"))
        out = out.crossJoin(F.broadcast(n)).where(F.col("n_hits") <= limit).drop("n_hits")  # one row
    return out


def infiltration(points: DataFrame, distance: str, target: Column, bins: int) -> DataFrame:
    """(bin, n, fraction, hits: number of target) over equal-width bins of the distance column."""
    r = points.agg(F.min(distance).alias("lo"), F.max(distance).alias("hi"))
    b = F.least(F.floor((F.col(distance) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
    out = points.crossJoin(F.broadcast(r)).select(F.when(F.col("hi") > F.col("lo"), b).otherwise(0).cast("bigint").alias("bin"), target.cast("double").alias("t"))
    return out.groupBy("bin").agg(F.count("*").alias("n"), F.avg("t").alias("fraction"), F.sum("t").cast("bigint").alias("hits"))


def sliding_window(points: DataFrame, size: float, overlap: float) -> DataFrame:
    """(id, wx, wy) of every window of the given size, spaced by size - overlap, that holds the point."""
    step = size - overlap
    axis = lambda c: F.explode(F.sequence(F.floor((F.col(c) - size) / step) + 1, F.floor(F.col(c) / step)))
    return points.withColumn("wx", axis("x")).withColumn("wy", axis("y")).select("id", "wx", "wy")


def paga(edges: DataFrame) -> DataFrame:
    """(li, lj, n, connectivity): inter-cluster edges against their expectation under random attachment."""
    n = edges.where("li <> lj").groupBy("li", "lj").agg(F.count("*").alias("n"))
    deg = edges.groupBy("li").agg(F.count("*").alias("deg"))
    total = edges.agg(F.count("*").alias("total"))
    out = n.join(deg, "li").join(deg.select(F.col("li").alias("lj"), F.col("deg").alias("deg2")), "lj").crossJoin(F.broadcast(total))
    return out.select("li", "lj", "n", F.least(F.col("n") * F.col("total") / (F.col("deg") * F.col("deg2")), F.lit(1.0)).alias("connectivity"))


def centrality(edges: DataFrame) -> DataFrame:
    """(label, degree): distinct neighbours outside the label over the number of points outside it."""
    out = edges.where("li <> lj").groupBy("li").agg(F.count_distinct("j").alias("out"))
    size = edges.groupBy("li").agg(F.count_distinct("i").alias("n"))
    total = edges.agg(F.count_distinct("i").alias("total"))
    both = size.join(out, "li", "left").fillna(0, ["out"]).crossJoin(F.broadcast(total))
    return both.select(F.col("li").alias("label"), (F.col("out") / (F.col("total") - F.col("n"))).alias("degree"))


def proximity_z(points: DataFrame, n_perms: int = 10, seed: int = 0) -> DataFrame:
    """(li, lj, observed, mean, sd, z) of the median nearest distance of each pair of labels against label shuffles.

    All shuffles are searched together: each permutation of a lib is a lib of its own. A pair that a shuffle lacks does
    not count in its mean; z is null where the shuffles do not vary."""
    observed = proximity(points).select("li", "lj", F.col("median_d").alias("observed"))
    new = shuffled_labels(points, n_perms, seed).join(points.select("id", "x", "y", "lib"), "id")
    new = new.select(F.struct("perm", "id").alias("id"), "x", "y", "label", F.concat_ws("|", "perm", "lib").alias("lib"))
    each = nearest_type(new).groupBy(F.col("i.perm").alias("perm"), "li", "lj").agg(F.percentile("d", F.lit(0.5)).alias("m"))
    stats = each.groupBy("li", "lj").agg(F.avg("m").alias("mean"), F.stddev_pop("m").alias("sd"))
    out = observed.join(stats, ["li", "lj"], "left")
    return out.select("li", "lj", "observed", "mean", "sd", F.when(F.col("sd") > 1e-12, (F.col("observed") - F.col("mean")) / F.col("sd")).alias("z"))


def niche_enrichment(proportions: DataFrame, niches: DataFrame) -> DataFrame:
    """(niche, label, enrichment): log2 of the mean proportion (i, label, proportion) in a niche (i, niche) over the
    mean of all points. Labels that a point lacks count as 0; a label that a niche lacks has no row."""
    size = niches.groupBy("niche").agg(F.count("*").alias("n"))
    total = niches.agg(F.count("*").alias("nt"))
    own = proportions.join(niches, "i").groupBy("niche", "label").agg(F.sum("proportion").alias("s"))
    whole = own.groupBy("label").agg(F.sum("s").alias("st"))
    out = own.join(whole, "label").join(size, "niche").crossJoin(F.broadcast(total))  # one row
    return out.select("niche", "label", F.log2((F.col("s") / F.col("n")) / (F.col("st") / F.col("nt"))).alias("enrichment"))


def hilbert(x: Column, y: Column, box: tuple[float, float, float, float], bits: int = 16) -> Column:
    """The place (long) of a point on a Hilbert curve of 2^bits x 2^bits cells over the box; null for null or NaN."""
    most = (1 << bits) - 1
    cell = lambda v, lo, hi: F.least(F.greatest(F.floor((v - lo) / max(hi - lo, 1e-300) * (most + 1)), F.lit(0)), F.lit(most)).cast("bigint")
    start = F.struct(cell(x, box[0], box[2]).alias("x"), cell(y, box[1], box[3]).alias("y"), F.lit(0).cast("bigint").alias("d"))

    def step(a: Column, s: Column) -> Column:
        side = F.lit(1).cast("bigint") * s
        rx, ry = (a["x"].bitwiseAND(side) > 0).cast("bigint"), (a["y"].bitwiseAND(side) > 0).cast("bigint")
        flip = lambda v: F.when((ry == 0) & (rx == 1), F.lit(most) - v).otherwise(v)
        nx = F.when(ry == 0, flip(a["y"])).otherwise(a["x"])
        ny = F.when(ry == 0, flip(a["x"])).otherwise(a["y"])
        return F.struct(nx.alias("x"), ny.alias("y"), (a["d"] + side * side * (3 * rx).bitwiseXOR(ry)).alias("d"))

    sides = F.array(*[F.lit(1 << b).cast("bigint") for b in reversed(range(bits))])
    ok = x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y)
    return F.when(ok, F.aggregate(sides, start, step)["d"])

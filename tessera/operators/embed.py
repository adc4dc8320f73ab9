"""Layouts and diffusion on neighbour graphs, densities in embeddings, doublet scores.

Iterations are DataFrames: each round is a join of edges with their ends' places and a sum per node, written to the shared
folder, so neither nodes nor edges have to fit a machine. Randomness is a hash of names and rounds.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import spatial
from tessera.operators.leiden import weighted
from tessera.shared import discard, materialize, sweep


def connectivities(neighbours: DataFrame, iterations: int = 30) -> DataFrame:
    """(i, j, w) with i < j: fuzzy memberships of a kNN graph (i, j, d). Each node's distances beyond its nearest one are
    scaled so that its memberships add up to log2 of its neighbours; both directions join as a + b - ab."""
    rows = neighbours.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("d", "j"))).alias("n"))
    kind = neighbours.schema["i"].dataType.simpleString()

    def run(batches):
        for g in batches:
            out = []
            for n in g["n"]:
                d = np.array([x["d"] for x in n])
                rho = d[d > 0].min(initial=np.inf)
                over = np.maximum(d - (rho if np.isfinite(rho) else 0.0), 0.0)
                target, low, high, s = math.log2(len(d) + 1), 0.0, np.inf, 1.0
                for _ in range(iterations):
                    total = np.exp(-over / s).sum()
                    if abs(total - target) < 1e-5:
                        break
                    low, high = (low, s) if total > target else (s, high)
                    s = s * 2 if np.isinf(high) else (low + high) / 2
                s = max(s, 1e-3 * max(d.mean(), 1e-12))
                out.append(np.exp(-over / s))
            yield pd.DataFrame({"i": g["i"], "j": [[x["j"] for x in n] for n in g["n"]], "w": out})

    own = rows.mapInPandas(run, f"i {kind}, j array<{kind}>, w array<double>").select("i", F.explode(F.arrays_zip("j", "w")).alias("e")).select("i", "e.j", "e.w")
    both = own.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "w")
    return both.groupBy("i", "j").agg(F.sum("w").alias("s"), F.product("w").alias("p"), F.count("*").alias("n")).select("i", "j", F.when(F.col("n") > 1, F.col("s") - F.col("p")).otherwise(F.col("s")).alias("w"))


def _noise(*names: Column | str, seed: int) -> Column:
    """A number in -1..1 by a hash."""
    return F.pmod(F.xxhash64(*names, F.lit(seed)), F.lit(2_000_001)).cast("double") / 1_000_000 - 1


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("j").alias("i"), F.col("i").alias("j"), "w"))


def diffusion_map(edges: DataFrame, k: int = 10, rounds: int = 40, seed: int = 0) -> tuple[DataFrame, list[float]]:
    """((id, v: array of k), eigenvalues): the leading eigenvectors, the constant one first, of the symmetric transition
    matrix of a graph (i, j, w), weights first divided by both ends' strengths (Coifman and Lafon, 2006), by block power
    iteration. Each round multiplies, then makes the k columns orthogonal by their k x k products, all that reaches the
    driver. The sign of a column makes its sum of cubes positive."""
    e = _both(weighted(edges))
    q = e.groupBy("i").agg(F.sum("w").alias("q"))
    e = e.join(q, "i").join(q.select(F.col("i").alias("j"), F.col("q").alias("r")), "j").select("i", "j", (F.col("w") / (F.col("q") * F.col("r"))).alias("w"))
    z = e.groupBy("i").agg(F.sum("w").alias("z"))
    e = e.join(z, "i").join(z.select(F.col("i").alias("j"), F.col("z").alias("y")), "j").select("i", "j", (F.col("w") / F.sqrt(F.col("z") * F.col("y"))).alias("w"))
    e = materialize(e, "transitions")
    names = [f"x{c}" for c in range(k)]
    start = [F.sqrt("z"), *(_noise("i", seed=seed * 1000 + c) for c in range(1, k))]
    x = materialize(z.select(F.col("i").alias("id"), *(v.alias(n) for v, n in zip(start, names))), "vectors")

    def products(x: DataFrame) -> np.ndarray:
        row = x.agg(*(F.sum(F.col(names[a]) * F.col(names[b])).alias(f"p{a}_{b}") for a in range(k) for b in range(a, k))).first()
        return np.array([[float(row[f"p{min(a, b)}_{max(a, b)}"] or 0.0) for b in range(k)] for a in range(k)])

    def turned(x: DataFrame, m: np.ndarray, more: tuple[str, ...] = ()) -> DataFrame:
        return x.select("id", *more, *(sum((float(m[a, b]) * F.col(names[a]) for a in range(k)), F.lit(0.0)).alias(names[b]) for b in range(k)))

    values = np.ones(k)
    for _ in range(rounds):
        g = products(x)
        w, v = np.linalg.eigh(g)
        own = turned(x, v / np.sqrt(np.maximum(w, 1e-300)))  # orthonormal columns
        # Half a step of the identity keeps negative eigenvalues from leading.
        step = e.join(own.withColumnRenamed("id", "j"), "j").groupBy(F.col("i").alias("id")).agg(*(F.sum(F.col("w") * F.col(n)).alias(f"t_{n}") for n in names))
        both = materialize(own.join(step, "id"), "step")
        row = both.agg(*(F.sum(F.col(names[a]) * F.col(f"t_{names[b]}")).alias(f"p{a}_{b}") for a in range(k) for b in range(k))).first()
        t = np.array([[float(row[f"p{a}_{b}"] or 0.0) for b in range(k)] for a in range(k)])
        w, v = np.linalg.eigh((t + t.T) / 2)
        order = np.argsort(-w)
        old, last = values, x
        values = w[order]
        m = v[:, order]
        mixed = [sum((float(m[a, b]) * (F.col(names[a]) + F.col(f"t_{names[a]}")) / 2 for a in range(k)), F.lit(0.0)).alias(names[b]) for b in range(k)]
        x = materialize(both.select("id", *mixed), "vectors")
        discard(both)
        discard(last)
        if np.abs(values - old).max() < 1e-6:
            break
    g = products(x)
    w, v = np.linalg.eigh(g)
    # Columns are almost orthogonal: the symmetric square root keeps their order.
    x = turned(x, v @ np.diag(1 / np.sqrt(np.maximum(w, 1e-300))) @ v.T)
    cubes = x.agg(*(F.sum(F.col(n) ** 3).alias(n) for n in names)).first()
    signs = [1.0 if (cubes[n] or 0.0) >= 0 else -1.0 for n in names]
    return x.select("id", F.array(*(F.col(n) * s for n, s in zip(names, signs))).alias("v")), values.tolist()


def pseudotime(vectors: DataFrame, values: list[float], root) -> DataFrame:
    """(id, time): diffusion pseudotime from a root (Haghverdi et al., 2016): the distance over all components but the
    constant one, each weighted by lambda / (1 - lambda), scaled to 1 at most."""
    start = vectors.where(F.col("id") == root).select("v").first()
    if start is None:
        raise ValueError(f"no node {root!r}")
    weight = [min(v / max(1 - v, 1e-6), 1e6) for v in values[1:]]
    d = sum((((F.col("v")[c + 1] - float(start["v"][c + 1])) * float(w)) ** 2 for c, w in enumerate(weight)), F.lit(0.0))
    out = vectors.select("id", F.sqrt(d).alias("d"))
    most = out.agg(F.max("d").alias("m"))
    return out.crossJoin(F.broadcast(most)).select("id", F.when(F.col("m") > 0, F.col("d") / F.col("m")).otherwise(0.0).alias("time"))  # one row


def layout(edges: DataFrame, start: DataFrame, kind: str = "umap", rounds: int = 30, repel: int = 5, dims: int = 2, seed: int = 0) -> DataFrame:
    """(id, v): places of the nodes of a graph (i, j, w) from a start (id, v): edges draw, and each node is driven from
    `repel` others that a hash picks anew each round. kind says by which forces: umap (its low-dimensional curve at a
    least distance of 0.1), tsne (Student's kernel, attraction times four in the first third), force (springs against inverse
    distances). Others stand for all nodes, so a round costs edges + repel x nodes."""
    if kind not in ("umap", "tsne", "force"):
        raise ValueError(f"kind is umap, tsne or force, not {kind!r}")
    e = materialize(_both(weighted(edges)).withColumn("w", F.col("w").cast("double")), "edges")
    axes = [f"x{c}" for c in range(dims)]
    box = start.agg(*(F.stddev_pop(F.get("v", F.lit(c))).alias(a) for c, a in enumerate(axes)), F.count("*").alias("n")).first()
    n = int(box["n"])
    unit = [10.0 / max(box[a] or 1.0, 1e-12) / 5 for a in axes]
    numbered = materialize(start.select("id", *(F.coalesce(F.get("v", F.lit(c)), F.lit(0.0)).cast("double").alias(a) for c, a in enumerate(axes))), "start")
    place = numbered.select("id", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(max(n, 1))).alias("slot"), *((F.col(a) * u + _noise("id", F.lit(a), seed=seed) * 1e-3).alias(a) for a, u in zip(axes, unit)))
    place = materialize(place, "places")
    a, b = 1.577, 0.895  # the curve 1 / (1 + a d^(2b)) for a least distance of 0.1
    for r in range(rounds):
        rate = 1.0 - r / rounds
        ends = e.join(place.select(F.col("id").alias("i"), *(F.col(c).alias(f"p{c}") for c in axes)), "i").join(place.select(F.col("id").alias("j"), *(F.col(c).alias(f"q{c}") for c in axes)), "j")
        gap = [F.col(f"p{c}") - F.col(f"q{c}") for c in axes]
        d2 = sum((g * g for g in gap), F.lit(0.0))
        if kind == "umap":
            pull = -2 * a * b * F.pow(d2, F.lit(b - 1)) / (1 + a * F.pow(d2, F.lit(b))) * F.col("w")
        elif kind == "tsne":
            pull = -F.col("w") / (1 + d2) * (4.0 if 3 * r < rounds else 1.0)
        else:
            pull = -F.col("w") * F.sqrt(d2) / 10
        pull = F.when(d2 > 0, pull).otherwise(0.0)
        drawn = ends.select(F.col("i").alias("id"), *(F.greatest(F.least(pull * g, F.lit(4.0)), F.lit(-4.0)).alias(f"f{c}") for c, g in zip(axes, gap)))
        # Slots are hashes, so some hold none and some several nodes: about `repel` others meet each node.
        asks = place.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(repel))))
        asks = asks.select("id", *(F.col(c).alias(f"p{c}") for c in axes), F.pmod(F.xxhash64("id", "k", F.lit(seed + 7919 * (r + 1))), F.lit(max(n, 1))).alias("slot"))
        met = asks.join(place.select("slot", F.col("id").alias("other"), *(F.col(c).alias(f"q{c}") for c in axes)), "slot").where("id <> other")
        if kind == "umap":
            push = 2 * b / ((0.001 + d2) * (1 + a * F.pow(d2, F.lit(b))))
        elif kind == "tsne":
            push = 1 / ((1 + d2) * (1 + d2)) * 4
        else:
            push = 1 / (0.01 + d2)
        driven = met.select("id", *(F.greatest(F.least(push * g, F.lit(4.0)), F.lit(-4.0)).alias(f"f{c}") for c, g in zip(axes, gap)))
        force = drawn.unionByName(driven).groupBy("id").agg(*(F.sum(f"f{c}").alias(f"f{c}") for c in axes))
        step = place.join(force, "id", "left")
        moved = [(F.col(c) + F.coalesce(F.greatest(F.least(F.col(f"f{c}"), F.lit(8.0)), F.lit(-8.0)), F.lit(0.0)) * (0.5 * rate)).alias(c) for c in axes]
        last, place = place, materialize(step.select("id", "slot", *moved), "places")
        discard(last)
    return place.select("id", F.array(*axes).alias("v"))


def density(points: DataFrame, bandwidth: float) -> DataFrame:
    """(id, density): Gaussian kernel density of each point (id, x, y, label) among those of its label, cut off at three
    bandwidths, scaled to 0..1 within the label; 1 where all are equal."""
    own = points.select("id", "x", "y", "label", F.col("label").cast("string").alias("lib"))
    near = spatial.pairs_within(own, own, 3 * bandwidth)
    sums = near.groupBy(F.col("i").alias("id")).agg(F.sum(F.exp(-F.col("d") ** 2 / (2 * bandwidth**2))).alias("s"))
    out = own.join(sums, "id", "left").select("id", "label", (F.coalesce("s", F.lit(0.0)) + 1.0).alias("s"))
    box = out.groupBy("label").agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    scaled = F.when(F.col("hi") > F.col("lo"), (F.col("s") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(1.0)
    return out.join(box, "label").select("id", scaled.alias("density"))


def _doublet_pairs(rows: DataFrame, ratio: float, seed: int) -> DataFrame:
    """(row, other): int(ratio n) pairs of different rows that a hash picks, those with the least hashes of their names. A
    hash's leading bits are counted first, so only the last of 4096 slices is sorted."""
    n = rows.count()
    slots = rows.select(F.col("row").alias("other"), F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(max(n, 1))).alias("m"))
    asks = rows.withColumn("c", F.explode(F.sequence(F.lit(1), F.lit(max(1, math.ceil(2 * ratio))))))
    met = asks.withColumn("m", F.pmod(F.xxhash64("row", "c", F.lit(seed + 1)), F.lit(max(n, 1)))).join(slots, "m").where("row <> other")
    met = materialize(met.select("row", "c", "other"), "met")
    h = F.xxhash64("row", "c", "other")
    met = met.withColumn("slice", F.shiftright(h, 52))
    wanted, below, last, rest = int(ratio * n), 0, None, 0
    for r in met.groupBy("slice").count().orderBy("slice").collect():  # at most 4096
        if below + r["count"] > wanted:
            last, rest = r["slice"], wanted - below
            break
        below += r["count"]
    if last is None:
        return met.select("row", "other")
    cut = met.where(F.col("slice") == last).orderBy(h, "row", "c", "other").limit(rest)
    return met.where(F.col("slice") < last).unionByName(cut).select("row", "other")


def _cells(sample: np.ndarray, leaves: int) -> tuple[list, np.ndarray, np.ndarray]:
    """(nodes, lo, hi): boxes that fill space, each with about as many rows of the sample, by halving the widest axis. A node
    is (axis, cut, left, right), left being at most the cut; a leaf is a negative number, -1 - its place in lo and hi."""
    nodes, lows, highs = [], [], []
    m = sample.shape[1]

    def grow(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, parts: int) -> int:
        if parts > 1 and len(x) > 1:
            for axis in np.argsort(-x.std(axis=0)):
                cut = float(np.partition(x[:, axis], (len(x) - 1) // 2)[(len(x) - 1) // 2])
                left = x[:, axis] <= cut
                if left.all():  # the upper half is one value
                    low = x[:, axis][x[:, axis] < cut]
                    if not len(low):
                        continue
                    cut = float(low.max())
                    left = x[:, axis] <= cut
                at = len(nodes)
                nodes.append(None)
                share = min(max(int(round(parts * left.mean())), 1), parts - 1)
                up, down = hi.copy(), lo.copy()
                up[axis], down[axis] = cut, cut
                nodes[at] = (int(axis), cut, grow(x[left], lo, up, share), grow(x[~left], down, hi, parts - share))
                return at
        lows.append(lo)
        highs.append(hi)
        return -len(lows)

    root = grow(sample, np.full(m, -np.inf), np.full(m, np.inf), leaves)
    return [root, nodes], np.array(lows), np.array(highs)


def _leaf(tree: list, x: np.ndarray) -> np.ndarray:
    """The leaf of each row."""
    root, nodes = tree
    out = np.zeros(len(x), dtype=np.int32)
    open_ = [(root, np.arange(len(x)))]
    while open_:
        at, rows = open_.pop()
        if at < 0:
            out[rows] = -1 - at
        elif len(rows):
            axis, cut, left, right = nodes[at]
            low = x[rows, axis] <= cut
            open_ += [(left, rows[low]), (right, rows[~low])]
    return out


def _unpack(packed: pd.Series, m: int) -> np.ndarray:
    return np.frombuffer(b"".join(packed), dtype=np.float64).reshape(-1, m)


def _near(q: np.ndarray, y: np.ndarray, weight: np.ndarray, k: int, radius: np.ndarray | None = None):
    """(first row of q, rows, targets, distances) by blocks of q: of each row the targets that are nearer than the one with
    which their weights reach k, or as near, in order; with a radius, only targets that near. A matrix product says which
    pairs may count, their distances are of the differences."""
    mid = y.mean(axis=0) if len(y) else 0.0
    a, b = q - mid, y - mid
    aa, bb = (a * a).sum(axis=1), (b * b).sum(axis=1)
    right = np.c_[-2 * b, np.ones(len(b)), bb].T
    slack = 1e-12 * (aa + bb.max(initial=0.0))
    step, few = (max(1, n // max(1, len(y))) for n in (4_000_000, 260_000))  # the products of a few rows stay in a core's cache
    most = min(k, len(y))
    for s in range(0, len(q), step):
        count, hits = len(a[s : s + step]), []
        for f in range(s, s + count, few):
            part = slice(f, min(f + few, s + count))
            d2 = np.c_[a[part], aa[part], np.ones(len(a[part]))] @ right
            if radius is None:  # k targets weigh k or more
                bound = np.partition(d2, most - 1, axis=1)[:, most - 1] if most < len(y) else np.full(len(d2), np.inf)
            else:
                bound = radius[part] ** 2
            hits.append((f - s) * len(y) + np.flatnonzero(d2 <= (bound * (1 + 1e-9) + slack[part])[:, None]))
        rows, to = np.divmod(np.concatenate(hits), max(1, len(y)))
        d = np.sqrt(((q[s + rows] - y[to]) ** 2).sum(axis=1))
        if radius is not None:
            inside = d <= radius[s + rows]
            rows, to, d = rows[inside], to[inside], d[inside]
        order = np.lexsort((d, rows))
        rows, to, d = rows[order], to[order], d[order]
        total = np.cumsum(weight[to])
        start = np.searchsorted(rows, np.arange(count + 1))
        before = np.r_[0, total][start]
        reached = np.searchsorted(total, before[:-1] + k)  # the place at which a row's weights reach k
        end = np.minimum(reached, start[1:] - 1)
        full = reached < start[1:]
        far = np.where(full, d[np.maximum(end, 0)] if len(d) else np.inf, np.inf)
        keep = d <= far[rows]
        yield s, rows[keep], to[keep], d[keep], far


def _doublet_shares(places: DataFrame, m: int, k: int, leaf_rows: int = 16_384, visits_most: int = 200_000) -> DataFrame:
    """(p, d, t): of places (p: m packed doubles, distinct; real, made: numbers of rows there) with a real row, how many of the k
    nearest others of such a row are made, and how many others there are up to k. At equal distance made rows come first.

    Exact: boxes are fitted to a sample of at most 200,000 places, and all places are dealt to them. A place first meets its own
    box, which bounds the distance of the k-th; then all boxes that are within that bound."""
    spark = places.sparkSession
    count = places.count()
    leaves = max(1, -(-count // leaf_rows))
    every = max(1, count // min(max(20_000, 32 * leaves), 200_000))
    sample = places.where(F.pmod(F.xxhash64("p", F.lit(7)), F.lit(every)) == 0).select("p").limit(220_000).toPandas() if leaves > 1 else None
    tree, lo, hi = _cells(_unpack(sample["p"], m), leaves) if sample is not None and len(sample) else ([-1, []], np.full((1, m), -np.inf), np.full((1, m), np.inf))
    tree, lo, hi = (spark.sparkContext.broadcast(v) for v in (tree, lo, hi))  # a few hundred bytes a leaf

    def deal(batches):
        for g in batches:
            g["leaf"] = _leaf(tree.value, _unpack(g["p"], m))
            yield g

    dealt = places.select("p", "real", "made").mapInPandas(deal, "p binary, real bigint, made bigint, leaf int")

    def first(g: pd.DataFrame) -> pd.DataFrame:
        y, weight = _unpack(g["p"], m), np.minimum(g["real"] + g["made"], k + 1).to_numpy()
        own = np.flatnonzero(g["real"].to_numpy() > 0)
        names, low, high = g["p"].to_numpy(), lo.value, hi.value
        out = []
        for s, _, _, _, far in _near(y[own], y, weight, k + 1):  # the row itself is one of them
            q = y[own[s : s + len(far)]]
            gap = np.zeros((len(q), len(low)))
            for c in range(m):
                gap += np.maximum(np.maximum(low[None, :, c] - q[:, c, None], q[:, c, None] - high[None, :, c]), 0.0) ** 2
            rows, to = np.nonzero(gap <= (far * far * (1 + 1e-9))[:, None])
            out.append(pd.DataFrame({"p": names[own[s + rows]], "radius": far[rows], "leaf": to.astype(np.int32)}))
        return pd.concat(out) if out else pd.DataFrame({"p": [], "radius": [], "leaf": []})

    visits = materialize(dealt.groupBy("leaf").applyInPandas(first, "p binary, radius double, leaf int"), "visits")
    # A box that many places ask is given to several tasks.
    parts = visits.groupBy("leaf").agg(F.ceil(F.count("*") / visits_most).cast("int").alias("parts"))
    parts = F.broadcast(materialize(parts, "parts"))  # a row a leaf
    asks = visits.join(parts, "leaf").withColumn("part", F.pmod(F.xxhash64("p", F.lit(11)), "parts").cast("int")).drop("parts")
    held = dealt.join(parts, "leaf").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    def meet(asks: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        names, found = [], []
        if len(asks) and len(g):
            y, real, made = _unpack(g["p"], m), np.minimum(g["real"], k + 1).to_numpy(), np.minimum(g["made"], k + 1).to_numpy()
            name = asks["p"].to_numpy()
            for s, rows, to, d, _ in _near(_unpack(asks["p"], m), y, np.minimum(real + made, k + 1), k + 1, asks["radius"].to_numpy()):
                packed = np.c_[d, real[to], made[to]]
                at = np.searchsorted(rows, np.arange(min(len(name) - s, rows.max(initial=-1) + 1) + 1))
                for r in np.flatnonzero(at[1:] > at[:-1]):
                    names.append(name[s + r])
                    found.append(packed[at[r] : at[r + 1]].tobytes())
        return pd.DataFrame({"p": names, "c": found})

    got = asks.groupBy("leaf", "part").cogroup(held.groupBy("leaf", "part")).applyInPandas(meet, "p binary, c binary")

    def settle(batches):
        for g in batches:
            out = np.zeros((len(g), 2), dtype=np.int64)
            for i, parts in enumerate(g["c"]):
                c = _unpack(parts, 3)
                c = c[np.argsort(c[:, 0], kind="stable")]
                real = c[:, 1].copy()
                real[np.flatnonzero((c[:, 0] == 0) & (real > 0))[0]] -= 1  # the row itself
                d, w, kind = np.r_[c[:, 0], c[:, 0]], np.r_[c[:, 2], real], np.r_[np.zeros(len(c)), np.ones(len(c))]
                order = np.lexsort((kind, d))
                w = w[order]
                taken = np.clip(k - (np.cumsum(w) - w), 0, w)
                out[i] = taken[kind[order] == 0].sum(), taken.sum()
            yield pd.DataFrame({"p": g["p"], "d": out[:, 0], "t": out[:, 1]})

    return got.groupBy("p").agg(F.collect_list("c").alias("c")).mapInPandas(settle, "p binary, d bigint, t bigint")


def doublet_scores(x: DataFrame, obs: DataFrame, variable: DataFrame, k: int = 15, ratio: float = 2.0, rate: float = 0.06, components: int = 10, seed: int = 0) -> DataFrame:
    """(row, score): how much of a row's neighbourhood are simulated doublets (Wolock et al., 2019): `ratio` times as many
    sums of two rows as there are rows, picked by hash; all normalised to a total of 10,000, log1p, the genes of variable
    (var, rank); neighbours in principal components; the share of doublets q among k (1 + ratio) becomes
    q rate / ratio / (1 - rate - q (1 - rate - rate / ratio)).

    A row's entries are gathered once; a doublet is its two rows' entries side by side. Rows and doublets at one place are
    compared as one place with two counts."""
    from tessera.operators import graph

    kind = obs.schema["row"].dataType.simpleString()
    if kind not in ("bigint", "int"):
        raise ValueError("rows are numbered")
    rows = obs.select(F.col("row").cast("bigint").alias("row")).distinct()
    genes = materialize(variable.select("var", (F.col("rank") - 1).cast("int").alias("k")), "genes")
    width = (genes.agg(F.max("k")).first()[0] or 0) + 1
    entries = x.select(F.col("row").cast("bigint").alias("row"), "var", F.col("value").cast("double").alias("value")).join(F.broadcast(genes), "var", "left")
    held = F.col("k").isNotNull()
    own = entries.groupBy("row").agg(F.sum("value").alias("total"), F.collect_list(F.when(held, F.col("k"))).alias("k"), F.collect_list(F.when(held, F.col("value"))).alias("v"))
    none = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>")).alias(c)
    own = materialize(rows.join(own, "row", "left").select("row", F.coalesce("total", F.lit(0.0)).alias("total"), none("k", "int"), none("v", "double")), "profiles")
    sweep(obs.sparkSession)
    a, b = own.select("row", *(F.col(c).alias(f"{c}1") for c in ("total", "k", "v"))), own.select(F.col("row").alias("other"), *(F.col(c).alias(f"{c}2") for c in ("total", "k", "v")))
    made = _doublet_pairs(own.select("row"), ratio, seed).join(a, "row").join(b, "other")
    made = materialize(made.select((F.col("total1") + F.col("total2")).alias("total"), F.concat("k1", "k2").alias("k"), F.concat("v1", "v2").alias("v")), "made")
    sweep(obs.sparkSession)

    def dense(g: pd.DataFrame) -> np.ndarray:
        size = np.array([len(v) for v in g["k"]])
        at = np.repeat(np.arange(len(g)), size) * width + (np.concatenate(g["k"].to_numpy()) if size.sum() else np.zeros(0, dtype=np.int64))
        out = np.bincount(at.astype(np.int64), weights=np.concatenate(g["v"].to_numpy()) if size.sum() else None, minlength=len(g) * width).reshape(-1, width).astype(float)
        total = g["total"].to_numpy()[:, None]
        return np.log1p(np.where(total > 0, out * 1e4 / np.where(total > 0, total, 1.0), 0.0))

    s = graph.moment_matrix(own.select("total", "k", "v").unionByName(made), vectors=dense)
    if not len(s):
        return obs.select("row", F.lit(0.0).alias("score")).limit(0)
    mean, axes = graph.loadings(s, components)
    m = axes.shape[1]

    def project(batches):
        for g in batches:
            v = dense(g)
            p = np.zeros((len(v), m))
            for c in range(width):  # in one order, so that equal rows have equal places in any batch
                p += (v[:, c] - mean[c])[:, None] * axes[c]
            p += 0.0  # no negative zeros
            g = g[["row"]] if "row" in g else pd.DataFrame(index=g.index)
            yield g.assign(p=[r.tobytes() for r in p])

    real = materialize(own.mapInPandas(project, "row bigint, p binary"), "places")
    both = real.select("p", F.lit(1).alias("real"), F.lit(0).alias("made")).unionByName(made.mapInPandas(project, "p binary").select("p", F.lit(0).alias("real"), F.lit(1).alias("made")))
    places = materialize(both.groupBy("p").agg(F.sum("real").alias("real"), F.sum("made").alias("made")), "distinct")
    discard(made)
    discard(own)
    sweep(obs.sparkSession)
    near = real.join(_doublet_shares(places, m, int(round(k * (1 + ratio)))), "p")
    q = (F.col("d") + 1) / (F.col("t") + 2)
    score = q * rate / ratio / (1 - rate - q * (1 - rate - rate / ratio))
    return near.select(F.col("row").cast(kind).alias("row"), score.alias("score"))


def sepal(x: DataFrame, edges: DataFrame, obs: DataFrame, max_neighs: int = 6, dt: float = 0.1, threshold: float = 1e-8, most: int = 30_000, rounds: int = 200) -> DataFrame:
    """(var, time): how long a gene diffuses on a grid graph (i, j) until its entropy no longer changes (Andersson and
    Lundeberg, 2021): with max_neighs neighbours per full node; nodes with fewer keep their value towards the missing ones. A
    gene is one row of all grid places in an Arrow batch; grids of over `most` places are an error."""
    if max_neighs not in (4, 6):
        raise ValueError("max_neighs is 4 or 6")
    n = obs.count()
    if n > most:
        raise ValueError(f"a grid has at most {most} places, this one {n}")
    ids = np.array([r["row"] for r in obs.select("row").orderBy("row").collect()])  # at most `most`
    e = edges.select("i", "j").where("i <> j").distinct().limit(most * max_neighs + 1).toPandas()  # at most max_neighs a place
    if len(e) > most * max_neighs:
        raise ValueError(f"a place has at most {max_neighs} neighbours")
    a, b = np.searchsorted(ids, e["i"].to_numpy()), np.searchsorted(ids, e["j"].to_numpy())
    degree = np.bincount(a, minlength=n).astype(float)
    scale = 1.0 if max_neighs == 4 else 2.0 / 3.0
    genes = x.groupBy("var").agg(F.collect_list("row").alias("r"), F.collect_list(F.col("value").cast("double")).alias("v"))
    kind = x.schema["var"].dataType.simpleString()

    def run(batches):
        for g in batches:
            out = []
            for rows, values in zip(g["r"], g["v"]):
                c = np.zeros(n)
                c[np.searchsorted(ids, rows)] = values
                total = c.sum()
                time, before = 0.0, -np.inf
                for _ in range(rounds):
                    if total <= 0:
                        break
                    flow = np.bincount(a, weights=c[b], minlength=n) - degree * c
                    c = np.maximum(c + dt * scale * flow, 0.0)
                    p = c / max(c.sum(), 1e-300)
                    h = -(p[p > 0] * np.log(p[p > 0])).sum() / n
                    time += dt
                    if abs(h - before) <= threshold:
                        break
                    before = h
                out.append(time)
            yield pd.DataFrame({"var": g["var"], "time": out})

    return genes.mapInPandas(run, f"var {kind}, time double")


def closeness(edges: DataFrame, labels: DataFrame, most: int = 50) -> DataFrame:
    """(label, closeness): nodes outside a label (id, label) over the sum of their distances to it, by rounds of frontier
    joins; nodes that can't be reached within `most` steps count as if one step farther."""
    both = materialize(edges.select("i", "j").unionByName(edges.select(F.col("j").alias("i"), F.col("i").alias("j"))).distinct(), "edges")
    reached = materialize(labels.select(F.col("id").alias("i"), "label", F.lit(0).alias("steps")), "reached")
    for step in range(1, most + 1):
        front = reached.where(F.col("steps") == step - 1)
        new = front.join(both, "i").select(F.col("j").alias("i"), "label").distinct().join(reached.select("i", "label"), ["i", "label"], "left_anti").withColumn("steps", F.lit(step))
        new = materialize(new, "front")
        if new.isEmpty():
            break
        reached = materialize(reached.unionByName(new), "reached")
    n = labels.count()
    size = labels.groupBy("label").agg(F.count("*").alias("own"))
    far = reached.where("steps > 0").groupBy("label").agg(F.sum("steps").alias("s"), F.count("*").alias("k"))
    g = size.join(far, "label", "left").fillna(0, ["s", "k"])
    missing = n - F.col("own") - F.col("k")
    total = F.col("s") + missing * (most + 1)
    return g.select("label", F.when(total > 0, (n - F.col("own")) / total).alias("closeness"))


def clustering(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, clustering): the mean local clustering coefficient of the nodes of each label; 0 for under two neighbours.

    Triangles are counted from each edge to the lower-ranked of its ends (by degree), so a hub is never paired with itself."""
    e = edges.where("i <> j").select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).distinct()
    both = e.unionByName(e.select(F.col("j").alias("i"), F.col("i").alias("j")))
    deg = both.groupBy("i").agg(F.count("*").alias("k"))
    ranked = e.join(deg, "i").join(deg.select(F.col("i").alias("j"), F.col("k").alias("l")), "j")
    up = (F.col("k") < F.col("l")) | ((F.col("k") == F.col("l")) & (F.col("i") < F.col("j")))
    d = materialize(ranked.select(F.when(up, F.col("i")).otherwise(F.col("j")).alias("u"), F.when(up, F.col("j")).otherwise(F.col("i")).alias("v")), "ranked")
    wedge = d.select("u", F.col("v").alias("a")).join(d.select("u", F.col("v").alias("b")), "u").where("a < b")
    tri = wedge.join(e.select(F.col("i").alias("a"), F.col("j").alias("b")), ["a", "b"])
    per = tri.select(F.explode(F.array("u", "a", "b")).alias("i")).groupBy("i").agg(F.count("*").alias("t"))
    c = deg.join(per, "i", "left").select(F.col("i").alias("id"), F.when(F.col("k") > 1, 2 * F.coalesce("t", F.lit(0)) / (F.col("k") * (F.col("k") - 1))).otherwise(0.0).alias("c"))
    return labels.join(c, "id", "left").groupBy("label").agg(F.avg(F.coalesce("c", F.lit(0.0))).alias("clustering"))


def nearest_share(points: DataFrame, radii: list[float], mode: str = "G", seed: int = 0, samples: int = 1000) -> DataFrame:
    """(label, r, share): the share of points of a label (mode G), or of `samples` places drawn by hash over the bounding box
    (mode F), whose nearest point of the label (another one, in G) is within r."""
    own = points.select("id", "x", "y", "label", F.col("label").cast("string").alias("lib"))
    if mode == "G":
        near = spatial.knn(own, 1).select("li", "d").withColumnRenamed("li", "label")
        size = own.groupBy("label").agg(F.count("*").alias("n"))
    elif mode == "F":
        box = own.agg(F.min("x").alias("a"), F.max("x").alias("c"), F.min("y").alias("b"), F.max("y").alias("d"))
        spots = own.sparkSession.range(samples).crossJoin(F.broadcast(box))  # one row
        u = lambda name: (_noise("id", F.lit(name), seed=seed) + 1) / 2
        spots = spots.select("id", (F.col("a") + u("x") * (F.col("c") - F.col("a"))).alias("x"), (F.col("b") + u("y") * (F.col("d") - F.col("b"))).alias("y"))
        asks = spots.crossJoin(F.broadcast(own.select("label", "lib").distinct()))  # categories
        asks = asks.select(F.struct("id", "lib").alias("id"), "x", "y", "label", "lib")
        targets = own.select(F.struct("id", "lib").alias("id"), "x", "y", "label", "lib")
        near = spatial.knn(asks, 1, include_self=True, targets=targets).select(F.col("li").alias("label"), "d")
        size = own.select("label").distinct().withColumn("n", F.lit(samples))
    else:
        raise ValueError(f"mode is F or G, not {mode!r}")
    grid = size.select("label", "n", F.explode(F.array(*map(F.lit, radii))).alias("r"))
    hits = near.select("label", "d", F.explode(F.array(*map(F.lit, radii))).alias("r")).where("d <= r").groupBy("label", "r").agg(F.count("*").alias("c"))
    return grid.join(hits, ["label", "r"], "left").select("label", "r", (F.coalesce("c", F.lit(0)) / F.col("n")).alias("share"))

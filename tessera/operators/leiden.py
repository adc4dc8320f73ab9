"""Communities by the Leiden method (Traag, Waltman and van Eck, 2019): local moving, refinement, aggregation, by levels.

Graphs of at most `MOST_LOCAL` edges are one task in numpy and plain lists. Larger ones are first made smaller as
DataFrames: rounds of synchronous local moving, then one node for each community, until the graph is small enough; the
method proper then works on what is left. Labels do not depend on the partitioning of the input.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.shared import materialize

MOST_LOCAL = 1_000_000
#: Rounds of synchronous moving for each level of a large graph.
ROUNDS = 5


def weighted(edges: DataFrame) -> DataFrame:
    """(i, j, w) with i < j: the larger of the weights of both directions (1 where edges have none); loops go."""
    w = F.col("w").cast("double") if "w" in edges.columns else F.lit(1.0)
    e = edges.where("i <> j").select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), w.alias("w"))
    return e.groupBy("i", "j").agg(F.max("w").alias("w")).where("w > 0")


class Graph:
    """Neighbour lists without loops, loops' weights and strengths (loops count twice)."""

    def __init__(self, n: int, i: np.ndarray, j: np.ndarray, w: np.ndarray, loops: np.ndarray):
        a, b, x = np.r_[i, j], np.r_[j, i], np.r_[w, w]
        order = np.lexsort((b, a))
        self.n, self.loops = n, loops
        self.first = np.searchsorted(a[order], np.arange(n + 1)).tolist()
        self.to, self.w = b[order].tolist(), x[order].tolist()
        self.strength = (np.bincount(a, weights=x, minlength=n) + 2 * loops).tolist()
        self.i, self.j, self.weights = i, j, w
        self.total = float(sum(self.strength))

    def around(self, v: int) -> zip:
        s, e = self.first[v], self.first[v + 1]
        return zip(self.to[s:e], self.w[s:e])

    def merged(self, label: np.ndarray) -> Graph:
        """One node for each label (0..)."""
        n = int(label.max()) + 1 if len(label) else 0
        a, b = label[self.i], label[self.j]
        loops = np.bincount(label, weights=self.loops, minlength=n) + np.bincount(a[a == b], weights=self.weights[a == b], minlength=n)
        lo, hi, w = np.minimum(a, b)[a != b], np.maximum(a, b)[a != b], self.weights[a != b]
        keys, back = np.unique(lo.astype(np.int64) * max(n, 1) + hi, return_inverse=True)
        return Graph(n, keys // max(n, 1), keys % max(n, 1), np.bincount(back, weights=w, minlength=len(keys)), loops)


def _move(g: Graph, label: list[int], resolution: float, rng: np.random.Generator) -> bool:
    """Move nodes while a move gains; nodes whose neighbours moved are looked at again."""
    tot = [0.0] * g.n
    for v, c in enumerate(label):
        tot[c] += g.strength[v]
    size = np.bincount(label, minlength=g.n).tolist()
    empty = [c for c in range(g.n) if not size[c]]
    queue, waits, moved = deque(rng.permutation(g.n).tolist()), [True] * g.n, False
    while queue:
        v = queue.popleft()
        waits[v] = False
        c, k = label[v], g.strength[v]
        links: dict[int, float] = {}
        for u, w in g.around(v):
            d = label[u]
            links[d] = links.get(d, 0.0) + w
        tot[c] -= k
        size[c] -= 1
        rate = resolution * k / g.total
        best, most = c, links.get(c, 0.0) - rate * tot[c]
        for d, w in links.items():
            if (gain := w - rate * tot[d]) > most + 1e-12 or gain > most - 1e-12 and d < best and d != c and best != c:
                best, most = d, gain
        if most < -1e-12 and (size[c] or best != c):
            if not size[c]:
                best = c
            elif empty:
                best = empty.pop()
        if size[c] == 0 and best != c:
            empty.append(c)
        tot[best] += k
        size[best] += 1
        if best != c:
            label[v], moved = best, True
            for u, _ in g.around(v):
                if not waits[u] and label[u] != best:
                    waits[u] = True
                    queue.append(u)
    return moved


def _refine(g: Graph, label: list[int], resolution: float, rng: np.random.Generator) -> np.ndarray:
    """Split each community into well-connected parts: single nodes join the part of greatest gain inside it."""
    whole = np.bincount(label, weights=g.strength, minlength=g.n).tolist()
    part, alone = list(range(g.n)), [True] * g.n
    tot = list(g.strength)
    inside = [sum(w for u, w in g.around(v) if label[u] == label[v]) for v in range(g.n)]  # from a part to the rest of its community
    cut = list(inside)
    for v in rng.permutation(g.n).tolist():
        c, k = label[v], g.strength[v]
        if not alone[v] or inside[v] < resolution * k * (whole[c] - k) / g.total - 1e-12:
            continue
        links: dict[int, float] = {}
        for u, w in g.around(v):
            if label[u] == c:
                links[part[u]] = links.get(part[u], 0.0) + w
        best, most = -1, 1e-12
        for p, w in sorted(links.items()):
            if p != part[v] and cut[p] >= resolution * tot[p] * (whole[c] - tot[p]) / g.total - 1e-12:
                if (gain := w - resolution * k * tot[p] / g.total) > most:
                    best, most = p, gain
        if best >= 0:
            cut[best] += inside[v] - 2 * links[best]
            tot[best] += k
            alone[v] = alone[best] = False
            part[v] = best
    return np.unique(part, return_inverse=True)[1]


def partition(n: int, i: np.ndarray, j: np.ndarray, w: np.ndarray, resolution: float = 1.0, seed: int = 0, iterations: int = 2, loops: np.ndarray | None = None) -> np.ndarray:
    """The community of each of n nodes (numbered by first node) of a graph of edges i < j."""
    rng = np.random.default_rng(seed)
    base = Graph(n, i, j, w, np.zeros(n) if loops is None else loops)
    found = np.arange(n)
    if not base.total:
        return found
    for _ in range(max(1, iterations)):
        g, of, label = base, np.arange(n), found.tolist()
        while True:
            moved = _move(g, label, resolution, rng)
            parts = _refine(g, label, resolution, rng)
            found = np.asarray(label)[of]
            if parts.max() + 1 == g.n and not moved or parts.max() + 1 == g.n:
                break
            # A node of the next level starts in the community its part was in.
            start = np.zeros(parts.max() + 1, dtype=np.int64)
            start[parts] = label
            label = np.unique(start, return_inverse=True)[1].tolist()
            g, of = g.merged(parts), parts[of]
        found = np.unique(found, return_inverse=True)[1]
    first = np.full(found.max() + 1, n)
    np.minimum.at(first, found, np.arange(n))
    return first[found]


def _shrunk(e: DataFrame, resolution: float) -> DataFrame:
    """(id, c): communities of a large graph by rounds of synchronous local moving; only moves towards smaller labels in
    even rounds and larger ones in odd rounds, which keeps pairs from swapping."""
    both = materialize(e.unionByName(e.select(F.col("j").alias("i"), F.col("i").alias("j"), "w")), "graph")
    total = both.agg(F.sum("w")).first()[0]
    deg = both.groupBy("i").agg(F.sum("w").alias("k"))
    lab = deg.select(F.col("i").alias("id"), F.col("i").alias("c"))
    for r in range(ROUNDS):
        size = lab.join(deg.withColumnRenamed("i", "id"), "id").groupBy("c").agg(F.sum("k").alias("s"))
        links = both.where("i <> j").join(lab.select(F.col("id").alias("j"), "c"), "j").groupBy("i", "c").agg(F.sum("w").alias("w"))
        own = lab.select(F.col("id").alias("i"), F.col("c").alias("old"))
        every = links.unionByName(own.select("i", F.col("old").alias("c"), F.lit(0.0).alias("w"))).groupBy("i", "c").agg(F.sum("w").alias("w"))
        cand = every.join(own, "i").join(size, "c").join(deg, "i")
        stay = F.col("c") == F.col("old")
        gain = F.col("w") - resolution * F.col("k") * (F.col("s") - F.when(stay, F.col("k")).otherwise(0.0)) / total
        ok = stay | ((F.col("c") < F.col("old")) if r % 2 == 0 else (F.col("c") > F.col("old")))
        best = cand.where(ok).groupBy("i").agg(F.max_by("c", F.struct(gain, stay.cast("int"), (-F.col("c")).alias("t"))).alias("c"))
        lab = materialize(best.select(F.col("i").alias("id"), "c"), "labels")
    return lab


def communities(edges: DataFrame, resolution: float = 1.0, seed: int = 0, iterations: int = 2, most_local: int = MOST_LOCAL) -> DataFrame:
    """(id, community) of the nodes of edges (i, j and maybe w); a community's label is its least member."""
    e = materialize(weighted(edges), "edges")
    of = None
    loops = None
    while (n := e.count()) > most_local:
        lab = _shrunk(e if loops is None else e.unionByName(loops.select(F.col("id").alias("i"), F.col("id").alias("j"), (F.col("x")).alias("w"))), resolution)
        of = lab if of is None else materialize(of.withColumnRenamed("c", "m").join(lab.select(F.col("id").alias("m"), "c"), "m").select("id", "c"), "of")
        a, b = lab.select(F.col("id").alias("i"), F.col("c").alias("a")), lab.select(F.col("id").alias("j"), F.col("c").alias("b"))
        joined = e.join(a, "i").join(b, "j")
        own = joined.where("a = b").groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("x"))
        if loops is not None:
            own = own.unionByName(loops.join(lab, "id").select(F.col("c").alias("id"), "x")).groupBy("id").agg(F.sum("x").alias("x"))
        loops = materialize(own, "loops")
        smaller = joined.where("a <> b").groupBy(F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j")).agg(F.sum("w").alias("w"))
        e = materialize(smaller, "edges")
        if e.count() > 0.9 * n:
            break  # moving no longer shrinks it: the rest is one task
    kind = e.schema["i"].dataType.simpleString()
    rows = e if loops is None else e.unionByName(loops.select(F.col("id").alias("i"), F.col("id").alias("j"), F.col("x").alias("w")))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        loop = g["i"] == g["j"]
        plain = g[~loop].sort_values(["i", "j"])
        nodes = np.unique(np.r_[g["i"].to_numpy(), g["j"].to_numpy()])
        own = np.zeros(len(nodes))
        np.add.at(own, np.searchsorted(nodes, g[loop]["i"].to_numpy()), g[loop]["w"].to_numpy())
        c = partition(len(nodes), np.searchsorted(nodes, plain["i"].to_numpy()), np.searchsorted(nodes, plain["j"].to_numpy()), plain["w"].to_numpy(), resolution, seed, iterations, own)
        return pd.DataFrame({"id": nodes, "c": nodes[c]})

    last = rows.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(run, f"id {kind}, c {kind}")
    if of is not None:
        last = of.withColumnRenamed("c", "m").join(last.select(F.col("id").alias("m"), "c"), "m").select("id", "c")
    last = materialize(last, "communities")
    least = last.groupBy("c").agg(F.min("id").alias("community"))
    return last.join(least, "c").select("id", "community")


def ordinals(found: DataFrame) -> DataFrame:
    """found with number: 0 for the largest community, ties by label, as text, and order, the same as a number."""
    size = found.groupBy("community").agg(F.count("*").alias("n"))
    ranked = size.withColumn("order", F.row_number().over(Window.orderBy(F.desc("n"), "community")) - 1).select("community", "order", F.col("order").cast("string").alias("number"))
    return found.join(ranked, "community")


def modularity(edges: DataFrame, found: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row: the modularity of a partition (id, community) of edges (i, j and maybe w)."""
    e = weighted(edges)
    a, b = found.select(F.col("id").alias("i"), F.col("community").alias("a")), found.select(F.col("id").alias("j"), F.col("community").alias("b"))
    j = e.join(a, "i").join(b, "j")
    inside = j.where("a = b").groupBy(F.col("a").alias("c")).agg(F.sum("w").alias("e"))
    deg = j.select(F.explode(F.array("a", "b")).alias("c"), "w").groupBy("c").agg(F.sum("w").alias("d"))
    m = j.agg(F.sum("w").alias("m"))
    return deg.join(inside, "c", "left").fillna(0.0, ["e"]).crossJoin(F.broadcast(m)).agg(F.sum(F.col("e") / F.col("m") - resolution * (F.col("d") / (2 * F.col("m"))) ** 2).alias("modularity"))  # one row

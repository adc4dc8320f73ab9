"""Operators without an SQL twin, and the errors of the others, against brute force on small made tables."""

import itertools
import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import scalars
from tessera.operators import catalog, embed, fields, graph, leiden, markers, polygons, sequences, spatial, tables


def points(spark, xy, labels=None, libs=None):
    rows = [(i, float(x), float(y), int(labels[i]) if labels is not None else 0, int(libs[i]) if libs is not None else 0) for i, (x, y) in enumerate(xy)]
    return spark.createDataFrame(rows, "id bigint, x double, y double, label int, lib int")


def brute_knn(xy, lib, k):
    out = {}
    for i in range(len(xy)):
        d = np.sqrt(((xy - xy[i]) ** 2).sum(axis=1))
        d[(lib != lib[i]) | (np.arange(len(xy)) == i)] = np.inf
        out[i] = [(j, d[j]) for j in np.lexsort((np.arange(len(xy)), d))[:k] if np.isfinite(d[j])]
    return out


@pytest.mark.parametrize("k", [6, 20])
def test_nearest_by_grid(spark, monkeypatch, k):
    monkeypatch.setattr(spatial, "SMALL", 10)
    rng = np.random.default_rng(3)
    xy = np.concatenate([rng.normal(0, 1, (400, 2)), rng.normal(50, 0.01, (200, 2)), [[1e7, 1e7], [0, 0], [0, 0]]])
    lib = rng.integers(0, 2, len(xy))
    got = {}
    for r in spatial.knn(points(spark, xy, libs=lib), k).collect():
        got.setdefault(r["i"], []).append((r["rk"], r["j"], r["d"]))
    want = brute_knn(xy, lib, k)
    assert {i: [j for _, j, _ in sorted(v)] for i, v in got.items()} == {i: [j for j, _ in v] for i, v in want.items()}


def test_nearest_with_a_far_outlier(spark):
    rng = np.random.default_rng(4)
    xy = rng.uniform(0, 1, (8000, 2))
    def seconds(a):
        p = points(spark, a).cache()
        p.count()
        t = time.time()
        assert spatial.knn(p, 6).count() == 6 * len(a)
        return time.time() - t
    seconds(xy)
    plain = seconds(xy)
    assert seconds(np.concatenate([xy, [[1e6, 1e6]]])) < 2 * plain + 3


def test_nearest_vectors(spark):
    v = np.random.default_rng(5).normal(size=(300, 8))
    v[7] = v[8]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id bigint, v array<double>")
    want = brute_knn(v, np.zeros(300), 5)
    for block in (64, 8192):
        got = {}
        for r in spatial.knn_vectors(df, 5, block).collect():
            got.setdefault(r["i"], []).append((r["rk"], r["j"], r["d"]))
        assert {i: [j for _, j, _ in sorted(x)] for i, x in got.items()} == {i: [j for j, _ in x] for i, x in want.items()}
        assert all(abs(d - want[i][rk - 1][1]) < 1e-12 for i, x in got.items() for rk, _, d in x)


def planted(seed, n, groups, inside, outside):
    rng = np.random.default_rng(seed)
    label = np.arange(n) % groups
    return label, [(i, j) for i in range(n) for j in range(i) if rng.random() < (inside if label[i] == label[j] else outside)]


def modularity(pairs, c):
    deg = np.bincount(np.ravel(pairs))
    m = len(pairs)
    return sum(c[i] == c[j] for i, j in pairs) / m - sum((sum(deg[i] for i in c if c[i] == k) / (2 * m)) ** 2 for k in set(c.values()))


@pytest.mark.parametrize("most", [leiden.MOST_LOCAL, 200])
def test_communities(spark, most):
    label, pairs = planted(4, 160, 4, 0.4, 0.01)
    edges = spark.createDataFrame(pairs, "i bigint, j bigint")
    found = leiden.communities(edges, most_local=most)
    got = {r["id"]: r["community"] for r in found.collect()}
    assert set(got) == {x for p in pairs for x in p} and all(c <= i for i, c in got.items())
    best = modularity(pairs, {i: label[i] for i in got})
    assert modularity(pairs, got) >= (0.999 if most > 200 else 0.9) * best
    assert abs(leiden.modularity(edges, found).first()[0] - modularity(pairs, got)) < 1e-9
    again = {r["id"]: r["community"] for r in leiden.communities(edges.repartition(5), most_local=most).collect()}
    assert again == got
    if most > 200:
        sizes = leiden.ordinals(found).groupBy("order").agg(F.count("*").alias("n"), F.first("number").alias("s")).orderBy("order").collect()
        assert [r["n"] for r in sizes] == sorted((r["n"] for r in sizes), reverse=True) and [r["s"] for r in sizes] == [str(k) for k in range(len(sizes))]


def test_communities_by_weight_and_resolution(spark):
    pairs = [(i, j, 10.0 if i // 4 == j // 4 else 0.1) for i in range(16) for j in range(i)]
    edges = spark.createDataFrame(pairs + [(3, 3, 99.0), (0, 1, 5.0)], "i bigint, j bigint, w double")
    got = {r["id"]: r["community"] for r in leiden.communities(edges).collect()}
    assert got == {i: i // 4 * 4 for i in range(16)}
    assert len({r["community"] for r in leiden.communities(edges, resolution=100.0).collect()}) == 16
    # A bridge between two halves of a community: refinement keeps every community connected.
    label, more = planted(9, 60, 3, 0.5, 0.02)
    c = {r["id"]: r["community"] for r in leiden.communities(spark.createDataFrame(more, "i bigint, j bigint"), resolution=2.0).collect()}
    for k in set(c.values()):
        own = {i for i in c if c[i] == k}
        seen, todo = set(), [min(own)]
        while todo:
            v = todo.pop()
            if v not in seen:
                seen.add(v)
                todo += [b if a == v else a for a, b in more if v in (a, b) and (b if a == v else a) in own]
        assert seen == own


def test_mixing(spark):
    rng = np.random.default_rng(6)
    xy, labels = rng.normal(size=(80, 2)), rng.integers(0, 3, 80)
    near = spatial.knn(points(spark, xy, labels), 15)
    got = {r["id"]: r["lisi"] for r in graph.lisi(near, 5.0).collect()}
    for i, row in brute_knn(xy, np.zeros(80), 15).items():
        d = np.array([x for _, x in row]) ** 2
        lo, hi = 0.0, 1e6
        for _ in range(200):
            b = (lo + hi) / 2
            p = np.exp(-(d - d.min()) * b)
            p /= p.sum()
            lo, hi = (b, hi) if -(p * np.log(np.maximum(p, 1e-300))).sum() > math.log(5) else (lo, b)
        share = [p[[labels[j] == c for j, _ in row]].sum() for c in range(3)]
        assert abs(got[i] - 1 / sum(s * s for s in share)) < 1e-3 and 1 <= got[i] <= 3 + 1e-9


def test_components(spark):
    rng = np.random.default_rng(7)
    v = rng.normal(size=(200, 6)) @ np.diag([5, 3, 1, 0.5, 0.2, 0.1]) + 4
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id bigint, v array<double>").repartition(5)
    got = np.array([r["pc"] for r in graph.pca(df, 3).orderBy("id").collect()])
    c = v - v.mean(axis=0)
    _, _, u = np.linalg.svd(c, full_matrices=False)
    want = c @ u[:3].T
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-8)


def ring_graph(n):
    return [(i, (i + 1) % n) for i in range(n)]


def test_diffusion(spark):
    path = [(i, i + 1, 1.0) for i in range(7)]
    edges = spark.createDataFrame(path, "i bigint, j bigint, w double")
    vectors, values = embed.diffusion_map(edges, 3, rounds=60)
    w = np.zeros((8, 8))
    for i, j, x in path:
        w[i, j] = w[j, i] = x
    q = w.sum(axis=1)
    w = w / np.outer(q, q)
    z = w.sum(axis=1)
    want, u = np.linalg.eigh(w / np.sqrt(np.outer(z, z)))
    assert np.allclose(values, want[::-1][:3], atol=2e-3)
    got = np.array([r["v"] for r in vectors.orderBy("id").collect()])
    assert abs(abs(got[:, 1] @ u[:, -2]) - 1) < 0.01
    order = [r["id"] for r in embed.pseudotime(vectors, values, 0).orderBy("time").collect()]
    assert order[0] == 0 and sum(a < b for a, b in zip(order, order[1:])) >= 6
    with pytest.raises(ValueError):
        embed.pseudotime(vectors, values, 99)


@pytest.mark.parametrize("kind", ["umap", "tsne", "force"])
def test_layouts_part_clusters(spark, kind):
    rng = np.random.default_rng(8)
    v = np.concatenate([rng.normal(0, 1, (30, 5)), rng.normal(12, 1, (30, 5))])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id bigint, v array<double>")
    edges = embed.connectivities(spatial.knn_vectors(df, 8))
    assert edges.where("w <= 0 or w > 1.0000001").count() == 0
    start = graph.pca(df, 2).withColumnRenamed("pc", "v")
    got = np.array([r["v"] for r in embed.layout(edges, start, kind, rounds=5).orderBy("id").collect()])
    a, b = got[:30], got[30:]
    within = np.mean([np.linalg.norm(p - p.mean(axis=0), axis=1).mean() for p in (a, b)])
    assert np.isfinite(got).all() and np.linalg.norm(a.mean(axis=0) - b.mean(axis=0)) > 2 * within
    with pytest.raises(ValueError):
        embed.layout(edges, start, "other")


def test_doublets(spark):
    rng = np.random.default_rng(9)
    base = [np.r_[np.full(20, 5.0), np.full(20, 0.2)], np.r_[np.full(20, 0.2), np.full(20, 5.0)]]
    cells = [rng.poisson(base[i % 2]) for i in range(120)] + [rng.poisson(base[0]) + rng.poisson(base[1]) for _ in range(8)]
    x = spark.createDataFrame([(i, v, float(n)) for i, c in enumerate(cells) for v, n in enumerate(c.tolist()) if n], "row bigint, var int, value double")
    obs = spark.createDataFrame([(i,) for i in range(128)], "row bigint")
    variable = spark.createDataFrame([(v, v + 1) for v in range(40)], "var int, rank bigint")
    got = {r["row"]: r["score"] for r in embed.doublet_scores(x, obs, variable, k=8, components=4).collect()}
    assert set(got) == set(range(128))
    assert np.mean([got[i] for i in range(120, 128)]) > 2 * np.mean([got[i] for i in range(120)])


def test_doublets_in_boxes(spark):
    """shares among the k nearest by boxes, some asked in parts, are those of all distances, copies included."""
    rng = np.random.default_rng(22)
    v = rng.integers(0, 6, (400, 3)).astype(float) * [4, 2, 1]
    v[300:] = rng.normal(5, 4, (100, 3))
    made = rng.random(400) < 0.6
    names, at = np.unique(v, axis=0, return_inverse=True)
    counts = [np.bincount(at.ravel()[w], minlength=len(names)).tolist() for w in (~made, made)]
    places = spark.createDataFrame([(bytearray(p.tobytes()), r, m) for p, r, m in zip(names, *counts)], "p binary, real bigint, made bigint")
    got = {bytes(r["p"]): (r["d"], r["t"]) for r in embed._doublet_shares(places, 3, 20, leaf_rows=30, visits_most=15).collect()}
    want = {}
    for i in np.flatnonzero(~made):
        d = np.sqrt(((v - v[i]) ** 2).sum(axis=1))
        near = sorted((d[j], not made[j]) for j in range(400) if j != i)[:20]
        want[v[i].tobytes()] = (sum(not real for _, real in near), 20)
    assert got == want


def test_doublets_shuffle_little(spark):
    """doublets are rows, not entries, while they are dealt out."""
    rng = np.random.default_rng(23)
    y = rng.poisson(3.0, (400, 60))
    x = spark.createDataFrame([(i, v, float(y[i, v])) for i in range(400) for v in range(60) if y[i, v]], "row bigint, var int, value double").repartition(4, "row").persist()
    obs = spark.createDataFrame([(i,) for i in range(401)], "row bigint")  # the last one has no entries
    variable = spark.createDataFrame([(v, v + 1) for v in range(60)], "var int, rank bigint")
    assert x.count()
    bus, store = spark.sparkContext._jsc.sc().listenerBus(), spark.sparkContext._jsc.sc().statusStore()

    def written():
        bus.waitUntilEmpty(30_000)
        found = store.executorList(False)
        return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))

    before = written()
    got = {r["row"]: r["score"] for r in embed.doublet_scores(x, obs, variable, k=5, components=4).collect()}
    assert set(got) == set(range(401)) and all(0 < s < 1 for s in got.values())
    assert written() - before < 1_500_000


def test_grid_diffusion(spark):
    cells = [(8 * i + j) for i in range(8) for j in range(8)]
    edges = [(8 * i + j, 8 * a + b) for i in range(8) for j in range(8) for a, b in ((i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)) if 0 <= a < 8 and 0 <= b < 8]
    obs = spark.createDataFrame([(c,) for c in cells], "row bigint")
    rows = [(c, 0, 1.0) for c in cells] + [(27, 1, 64.0)]
    x = spark.createDataFrame(rows, "row bigint, var int, value double")
    got = {r["var"]: r["time"] for r in embed.sepal(x, spark.createDataFrame(edges, "i bigint, j bigint"), obs, 4).collect()}
    assert got[0] < got[1]
    with pytest.raises(ValueError):
        embed.sepal(x, spark.createDataFrame(edges, "i bigint, j bigint"), obs, 5)


def test_hvg_counts(spark):
    rng = np.random.default_rng(10)
    mu = rng.lognormal(1, 1, 60)
    y = rng.negative_binomial(1 / np.where(np.arange(60) < 6, 2.0, 0.1), 1 / (1 + mu * np.where(np.arange(60) < 6, 2.0, 0.1)), (100, 60))
    x = spark.createDataFrame([(i, v, float(y[i, v])) for i in range(100) for v in range(60) if y[i, v]], "row bigint, var int, value double")
    got = [(r["var"], r["score"]) for r in markers.variable_counts(x, 100, 10).orderBy("rank").collect()]
    m, v = y.mean(axis=0), y.var(axis=0, ddof=1)
    ok = v > 0
    c = np.polyfit(np.log10(m[ok]), np.log10(v[ok]), 2)
    sd = np.sqrt(10 ** np.polyval(c, np.log10(m[ok])))
    z = np.minimum((y[:, ok] - m[ok]) / sd, 10.0)
    score = (z**2).sum(axis=0) / 99
    want = [int(np.flatnonzero(ok)[k]) for k in np.argsort(-score)[:10]]
    assert [g for g, _ in got] == want and len(set(want) & set(range(6))) >= 4


def test_rank_sums_with_negative_values(spark):
    rng = np.random.default_rng(11)
    y = rng.integers(-2, 3, (40, 5)).astype(float)
    g = rng.integers(0, 3, 40)
    x = spark.createDataFrame([(i, v, float(y[i, v])) for i in range(40) for v in range(5) if y[i, v]], "row bigint, var int, value double")
    obs = spark.createDataFrame([(i, int(g[i])) for i in range(40)], "row bigint, grp int")
    got = {(r["var"], r["grp"]): r for r in markers.rank_sums(x, obs).collect()}
    for v, c in itertools.product(range(5), range(3)):
        col = y[:, v]
        rank = np.array([(col < t).sum() + ((col == t).sum() + 1) / 2 for t in col])
        assert abs(got[v, c]["r"] - rank[g == c].sum()) < 1e-9
        _, n = np.unique(col, return_counts=True)
        assert got[v, c]["tie"] == (n.astype(float) ** 3 - n).sum()
    with pytest.raises(ValueError):
        markers.markers(x, obs, "other")
    with pytest.raises(ValueError, match="no cell type"):
        markers.region_features(x, obs.withColumn("type", F.lit("T")), min_cells=30)
    assert len(markers.markers(x, obs, "wilcoxon").where("grp = 0").collect()) == 5


def test_chi_square_tail(spark):
    # Values of the distribution's tables.
    known = [(3.841459, 1, 0.05), (5.991465, 2, 0.05), (7.814728, 3, 0.05), (18.30704, 10, 0.05), (24.99579, 15, 0.05), (0.0, 4, 1.0), (30.57791, 15, 0.01)]
    df = spark.createDataFrame([(x, d) for x, d, _ in known], "x double, d int")
    got = [r["p"] for r in df.select(scalars.chi_square_tail(F.col("x"), F.col("d")).alias("p")).collect()]
    assert np.allclose(got, [p for *_, p in known], atol=2e-5)
    two = spark.createDataFrame([("a", "x")] * 12 + [("a", "y")] * 5 + [("b", "x")] * 4 + [("b", "y")] * 9, "a string, b string")
    r = tables.chi_square(two, "a", "b").first()
    e = np.outer([17, 13], [16, 14]) / 30
    want = ((np.abs(np.array([[12, 5], [4, 9]]) - e) - 0.5) ** 2 / e).sum()
    assert r["dof"] == 1 and abs(r["chi2"] - want) < 1e-9


def test_cell_cycle_scores_divide_once(spark):
    """F2: equal scores are equal in doubles too, so the phase doesn't hang on the order of a row's entries."""
    rng = np.random.default_rng(21)
    column = rng.integers(1, 50, 300)
    y = np.stack([rng.permutation(column) for _ in range(12)], axis=1).astype(float)  # equal means: one bin
    x = spark.createDataFrame([(i, v, float(y[i, v])) for i in range(300) for v in range(12)], "row bigint, var int, value double")
    obs = spark.createDataFrame([(i,) for i in range(301)], "row bigint")  # the last one has no entries
    sets = ([0, 1, 2], [3, 4, 5])
    control = [[r["var"] for r in markers.control_genes(x, s, 301, ctrl_size=3).collect()] for s in sets]
    a, b = (np.r_[y[:, s].sum(axis=1) / 3 - y[:, c].sum(axis=1) / 3, 0.0] for s, c in zip(sets, control))
    got = markers.cell_cycle(x, obs, *sets).orderBy("row").collect()
    assert [r["s_score"] for r in got] == a.tolist() and [r["g2m_score"] for r in got] == b.tolist()
    phase = np.where(np.maximum(a, b) <= 1e-9, "G1", np.where(b > a, "G2M", "S"))
    assert [r["phase"] for r in got] == phase.tolist() and got[300]["phase"] == "G1"


def test_random_places_and_density(spark):
    rng = np.random.default_rng(12)
    xy, labels = rng.uniform(0, 1, (120, 2)), rng.integers(0, 2, 120)
    p = points(spark, xy, labels)
    for mode in ("F", "G"):
        got = {(r["label"], r["r"]): r["share"] for r in embed.nearest_share(p, [0.05, 0.2, 2.0], mode, samples=200).collect()}
        assert all(got[c, 0.05] <= got[c, 0.2] <= got[c, 2.0] == 1.0 for c in (0, 1))
    for c in (0, 1):
        own = xy[labels == c]
        d = [np.sort(np.linalg.norm(own - q, axis=1))[1] for q in own]
        assert abs(got[c, 0.05] - np.mean(np.array(d) <= 0.05)) < 1e-12
    with pytest.raises(ValueError):
        embed.nearest_share(p, [0.1], "H")
    dens = {r["id"]: r["density"] for r in embed.density(p, 0.1).collect()}
    raw = {i: sum(math.exp(-(d**2) / 0.02) for j in range(120) if labels[j] == labels[i] and (d := np.linalg.norm(xy[i] - xy[j])) <= 0.3) for i in range(120)}
    for i in range(120):
        own = [raw[j] for j in range(120) if labels[j] == labels[i]]
        assert abs(dens[i] - (raw[i] - min(own)) / (max(own) - min(own))) < 1e-9


def test_group_centrality(spark):
    pairs = ring_graph(12) + [(0, 6), (1, 7), (0, 2)]
    edges = spark.createDataFrame(pairs, "i bigint, j bigint")
    labels = spark.createDataFrame([(i, i % 3) for i in range(12)], "id bigint, label bigint")
    near = {i: set() for i in range(12)}
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    for r in embed.closeness(edges, labels).collect():
        dist, todo = {i: 0 for i in range(12) if i % 3 == r["label"]}, [i for i in range(12) if i % 3 == r["label"]]
        while todo:
            v = todo.pop(0)
            for u in near[v]:
                if u not in dist:
                    dist[u] = dist[v] + 1
                    todo.append(u)
        assert r["closeness"] == 8 / sum(dist.values())
    for r in embed.clustering(edges, labels).collect():
        own = [i for i in range(12) if i % 3 == r["label"]]
        c = [sum(b in near[a] for a, b in itertools.combinations(near[i], 2)) / math.comb(len(near[i]), 2) for i in own]
        assert abs(r["clustering"] - np.mean(c)) < 1e-12


def test_polygons(spark):
    rng = np.random.default_rng(13)
    lasso = [(0.2, 0.2), (0.8, 0.25), (0.5, 0.5), (0.85, 0.8), (0.15, 0.75)]
    rows = []
    for i in range(150):
        c, r, n = rng.uniform(0, 1, 2), rng.uniform(0.01, 0.4), rng.integers(3, 7)
        turn = np.sort(rng.uniform(0, 2 * np.pi, n))
        rows.append((i, [(float(c[0] + r * np.cos(t)), float(c[1] + r * np.sin(t))) for t in turn]))
    df = spark.createDataFrame(rows + [(900, []), (901, None), (902, [(0.5, 0.4)])], "id bigint, ring array<struct<x:double,y:double>>")

    def inside(p, ring):
        out = False
        for (a, b), (c, d) in zip(ring, ring[1:] + ring[:1]):
            if (b > p[1]) != (d > p[1]) and p[0] < (c - a) * (p[1] - b) / (d - b) + a:
                out = not out
        return out

    def cross(a, b, c, d):
        t = lambda p, q, r: np.sign((q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0]))
        return t(a, b, c) != t(a, b, d) and t(c, d, a) != t(c, d, b)

    edges = lambda r: list(zip(r, r[1:] + r[:1]))
    meets = {i: any(cross(*e, *f) for e in edges(r) for f in edges(lasso)) for i, r in rows}
    hit = {i for i, r in rows if meets[i] or any(inside(p, lasso) for p in r) or any(inside(p, r) for p in lasso)}
    whole = {i for i, r in rows if not meets[i] and all(inside(p, lasso) for p in r)}
    assert {r["id"] for r in polygons.polygon_query(df, "ring", [lasso]).collect()} == hit and 0 < len(hit) < 150
    assert {r["id"] for r in polygons.polygon_query(df, "ring", [lasso], inverted=True).collect()} == {i for i, _ in rows} - whole
    with pytest.raises(ValueError):
        polygons.polygon_query(df, "ring", [[(0.0, 0.0)]])


def test_catalog_changes(spark):
    shapes = spark.createDataFrame([], catalog.SHAPE)
    for k, (i, kind, pts) in enumerate([("a", "rectangle", [(0.0, 0.0), (2.0, 1.0)]), ("b", "point", [(1.0, 1.0)]), ("a", "polygon", [(0.0, 0.0), (1.0, 0.0), (0.0, 1.0)])]):
        shapes = catalog.with_annotation(shapes, i, kind, f"l{k}", pts)
    assert [(r["id"], r["kind"], r["label"]) for r in shapes.orderBy("pos").collect()] == [("b", "point", "l1"), ("a", "polygon", "l2")]
    assert [r["id"] for r in catalog.without_annotations(shapes, ["b"]).collect()] == ["a"]
    for bad in (("c", "blob", []), ("c", "polygon", [(0.0, 0.0)])):
        with pytest.raises(ValueError):
            catalog.with_annotation(shapes, bad[0], bad[1], "x", bad[2])
    with pytest.raises(ValueError):
        catalog.without_annotations(shapes, ["z"])
    jobs = spark.createDataFrame([(1, "s", "staged"), (2, "s", "running")], "seq bigint, session string, status string")
    assert {r["seq"]: r["status"] for r in catalog.moved(catalog.moved(jobs, 1, "queued"), 2, "completed").collect()} == {1: "queued", 2: "completed"}
    assert catalog.moved(jobs, 1, "deleted").count() == 1
    for seq, to in ((1, "running"), (2, "queued"), (3, "queued")):
        with pytest.raises(ValueError):
            catalog.moved(jobs, seq, to)
    maps = spark.createDataFrame([("e", 1.0, 0.0, 0.0, 0.0, 1.0, 0.0)], "element string, a double, b double, c double, d double, e double, f double")
    assert {r["element"]: r["a"] for r in catalog.with_transform(catalog.with_transform(maps, "e", (2, 0, 0, 0, 2, 0)), "g", (3, 0, 0, 0, 3, 0)).collect()} == {"e": 2.0, "g": 3.0}
    with pytest.raises(ValueError):
        catalog.with_transform(maps, "e", (1, 1, 0, 1, 1, 0))
    old = catalog.migrated({"version": 1, "selection": {"a": 1}, "plots": [{"name": "p"}, {"name": "q", "status": "running"}], "more": 3})
    assert old == {"version": 3, "selections": [{"a": 1}], "plots": [{"status": "drawn", "name": "p"}, {"status": "lost", "name": "q"}], "more": 3}
    for bad in ({}, {"version": 4}, {"version": 3, "plots": [], "selections": {}}):
        with pytest.raises(ValueError):
            catalog.migrated(bad)
    listing = spark.createDataFrame([("f", "a.csv"), ("f", "b.txt")], "folder string, name string")
    with pytest.raises(Exception, match="several types"):
        catalog.classified_folders(listing, [{"type": "x", "all_of": ["*.csv"]}, {"type": "y", "all_of": ["*.txt"]}]).collect()


def test_field_errors(spark):
    obs = spark.createDataFrame([(0, "r", 1.0), (1, "q", 2.0)], "row bigint, region string, v double")
    maps = spark.createDataFrame([("r", 1.0, 0.0, 0.0, 0.0, 1.0, 0.0)], "region string, a double, b double, c double, d double, e double, f double")
    with pytest.raises(ValueError, match="'q'"):
        fields.placed(obs.withColumnRenamed("v", "x").withColumn("y", F.lit(0.0)), maps)
    ds = fields.adopt(obs.drop("row"))
    assert "row" in ds.obs.columns and fields.adopt(ds) is ds
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0)], "i bigint, j bigint, w double")
    ds = fields.Dataset(obs, obsp={"g": edges}, obsm={"p": spark.createDataFrame([(0, 1.005), (1, 2.0)], "row bigint, v double")})
    assert fields.resolve(ds, "obsp:g", 2).count() == 2
    with pytest.raises(ValueError, match="over 1 edges"):
        fields.resolve(ds, "obsp:g", 1)
    assert fields.resolve(ds, "obsm:p").columns == ["row", "d0"]
    for bad in ("X:gene", "layers:a/b", "odd:x", "obsm:z"):
        with pytest.raises(ValueError):
            fields.resolve(ds, bad)
    with pytest.raises(ValueError, match="no row"):
        fields.by_positions(obs, [77])
    assert [r["row"] for r in fields.by_positions(obs, [0, 99], inverted=True).collect()] == [1]
    same = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)
    assert fields.place_of({"name": "e", "region": "r"}, {"r": same}, {}) == same and scalars.is_identity(scalars.compose(scalars.inverse((2, 1, 3, 0, 2, 5)), (2, 1, 3, 0, 2, 5)))
    with pytest.raises(ValueError):
        fields.place_of({"name": "e"}, {}, {})
    with pytest.raises(ValueError):
        scalars.inverse((1, 2, 0, 2, 4, 0))


def test_budget():
    levels = [("a", [100.0, 25.0, 6.0]), ("b", [80.0, 20.0]), ("c", [10.0])]
    assert sequences.within_budget(levels, 1000) == {"a": 0, "b": 0, "c": 0}
    assert sequences.within_budget(levels, 150) == {"a": 1, "b": 0, "c": 0} or sequences.within_budget(levels, 150)["a"] >= 1
    assert sequences.within_budget(levels, 1) == {"a": 2, "b": 1, "c": 0}


def test_refusals(spark):
    df = spark.createDataFrame([(1, 2.0, "a"), (2, 3.0, "b")], "id int, v double, s string")
    with pytest.raises(ValueError, match="not labels"):
        tables.annotate(df, F.col("id") == 1, "v", "x")
    assert {r["s"] for r in tables.annotate(df, F.col("id") == 1, "s", "x").collect()} == {"x", "b"}
    with pytest.raises(ValueError, match="no row"):
        tables.composition_of(df, F.lit(False), "s")
    with pytest.raises(ValueError, match="square or hex"):
        spatial.grid_graph(df, "odd")

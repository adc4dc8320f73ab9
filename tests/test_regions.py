"""Masks, tissue cores, abundance and hierarchies on planted shapes."""

import numpy as np
import pytest

from tessera.operators import graph, regions, spatial


def test_tissue_cores(spark):
    rng = np.random.default_rng(3)
    rows, want, i = [], {}, 0
    for r in range(3):
        for c in range(4):
            if (r, c) == (1, 2):
                continue  # a missing core
            a, d = rng.uniform(0, 2 * np.pi, 250), np.sqrt(rng.uniform(0, 1, 250)) * 3
            for x, y in zip(c * 10 + d * np.cos(a), r * 10 + d * np.sin(a)):
                rows.append((i, float(x), float(y)))
                want[i] = "CBA"[r] + str(c + 1)
                i += 1
    rows += [(90_000, None, 1.0), (90_001, float("nan"), 1.0), (90_002, 500.0, 500.0), (90_003, 5.0, 5.0)]
    df = spark.createDataFrame(rows, "id int, x double, y double").repartition(4)
    got = {r["id"]: r["core"] for r in regions.tissue_cores(df.where("id < 90002 or id = 90003")).collect()}
    assert len(got) == len(rows) - 1 and all(got[k] in (w, regions.UNASSIGNED) for k, w in want.items())
    assert sum(got[k] == w for k, w in want.items()) >= 0.98 * len(want)
    assert all(got[k] == regions.UNASSIGNED for k in (90_000, 90_001, 90_003))
    low = {r["id"]: r["core"] for r in regions.tissue_cores(df.where("id < 90000"), rows=3, columns=4, row_letters=False, row_start="Bottom", column_start="Right").collect()}
    assert low[0] in ("D1", regions.UNASSIGNED) and {v for v in low.values()} >= {"D1", "A3"}
    assert all(r["core"] == regions.UNASSIGNED for r in regions.tissue_cores(df.where("id = 5")).collect())
    with pytest.raises(ValueError):
        regions.tissue_cores(df, row_start="Left")


def test_hull():
    p = np.random.default_rng(0).normal(size=(500, 2))
    h = regions.hull(p)
    for a, b in zip(h, np.roll(h, -1, axis=0)):
        assert ((b[0] - a[0]) * (p[:, 1] - a[1]) - (b[1] - a[1]) * (p[:, 0] - a[0]) >= -1e-12).all()
    assert np.array_equal(regions.hull(np.concatenate([regions.hull(p[:200]), regions.hull(p[200:])])), h)


def test_grid_lines():
    at = np.linspace(0, 50, 501)
    w = sum(np.exp(-((at - c) ** 2) / 2) for c in (5, 15, 25, 45))
    assert np.allclose(regions.grid_lines(at, w, 4), [5, 15, 25, 35, 45], atol=0.1)


def test_mask(spark):
    rng = np.random.default_rng(4)
    xy = rng.uniform(0, 60, (6000, 2))
    r = np.hypot(xy[:, 0] - 30, xy[:, 1] - 30)
    rows = [(i, float(x), float(y), "in" if q < 15 else "out") for i, ((x, y), q) in enumerate(zip(xy, r))] + [(9999, None, 1.0, "in")]
    df = spark.createDataFrame(rows, "id int, x double, y double, label string")
    got = {g["id"]: g for g in regions.mask_boundary(df, ["in"]).collect()}
    d = np.array([got[i]["signed_distance"] for i in range(6000)])
    assert np.corrcoef(d, r)[0, 1] > 0.99 and np.abs(d - (r - 15)).max() < 6
    assert all(got[i]["compartment"] == "core" for i in range(6000) if r[i] < 8) and all(got[i]["compartment"] == "stroma" for i in range(6000) if r[i] > 26)
    assert len(got) == 6001 and got[9999]["signed_distance"] is None and got[9999]["compartment"] is None
    with pytest.raises(ValueError):
        regions.mask_boundary(df, ["in", "other"])


def test_differential_abundance(spark):
    rng = np.random.default_rng(8)
    rows = []
    for s in range(8):  # the second cloud grows eightfold under condition b: from a sixth of the cells to three fifths
        for centre, n in ((0.0, 100), (8.0, 20 if s < 4 else 160)):
            rows += [(0, [float(x) for x in rng.normal(centre, 1, 3)], f"s{s}", "a" if s < 4 else "b") for _ in range(n)]
    rows = [(i, *x[1:]) for i, x in enumerate(rows)]
    cells = spark.createDataFrame(rows, "id bigint, v array<double>, sample string, condition string")
    near = spatial.knn_vectors(cells.select("id", "v"), 60).persist()
    hoods = graph.neighbourhoods(cells, near, 0.2).collect()
    size = {h: sum(x["hood"] == h for x in hoods) for h in {x["hood"] for x in hoods}}
    assert 20 < len(size) < 350 and set(size.values()) == {61}
    got = graph.differential_abundance(cells, near, 0.2).collect()
    place = {x[0]: x[1][0] > 4 for x in rows}
    up = [x["log2_fold"] for x in got if place[x["hood"]]]
    down = [x["log2_fold"] for x in got if not place[x["hood"]]]
    assert min(up) > 0 and np.mean(up) > 1 and -2 < np.mean(down) < 0  # shares fall where the other cloud grows
    assert np.mean([x["spatial_fdr"] < 0.1 for x in got if place[x["hood"]]]) > 0.8
    far = {h: max(x["d"] for x in hoods if x["hood"] == h) for h in size}
    ps = sorted((x["p"], x["hood"], x["spatial_fdr"]) for x in got)
    w = np.array([1 / far[h] for _, h, _ in ps])
    q = np.array([p for p, _, _ in ps]) * w.sum() / np.cumsum(w)
    assert np.allclose([f for _, _, f in ps], np.minimum(np.minimum.accumulate(q[::-1])[::-1], 1))
    with pytest.raises(ValueError):
        graph.differential_abundance(cells.where("condition = 'a'"), near)


def test_dendrogram(spark):
    base = {1: [1.0, 2.0, 3.0, 4.0], 2: [1.0, 2.0, 3.0, 4.5], 3: [4.0, 3.0, 2.0, 1.0], 4: [4.2, 3.0, 2.0, 0.0]}
    v = spark.createDataFrame([(i, base[i % 4 + 1]) for i in range(40)], "id bigint, v array<double>")
    g = spark.createDataFrame([(i, i % 4 + 1) for i in range(40)], "id bigint, community bigint")
    got = graph.dendrogram(v, g).orderBy("step").collect()
    assert {(x["left"], x["right"]) for x in got[:2]} == {(1, 2), (3, 4)} and (got[2]["left"], got[2]["right"], got[2]["size"]) == (1, 3, 4)
    c = np.corrcoef(np.array([base[k] for k in sorted(base)]))
    assert abs(got[2]["height"] - (1 - c[:2, 2:].min())) < 1e-9
    assert graph.dendrogram(v.where("false"), g).count() == 0

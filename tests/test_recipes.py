"""Recipes: substitution, checks before a run, and runs over the star-schema tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.plans import recipes as r

SF = "/root/testdata/sf0.001"


def test_checks():
    op = r.Operator("f", ("a",), ("b",), {"x": 1, "y": r.REQUIRED}, dict)
    assert op.bind({"x": None, "y": 0}) == {"x": 1, "y": 0} and op.bind({"x": 0, "y": 2}) == {"x": 0, "y": 2}
    for bad in ({"y": ""}, {"y": 1, "z": 2}):
        with pytest.raises(ValueError):
            op.bind(bad)
    assert r.substitute({"a": ["$n", 1], "b": "x"}, {"n": 5}) == {"a": [5, 1], "b": "x"}
    with pytest.raises(ValueError):
        r.substitute("$m", {"n": 5})
    assert r.preflight(r.RECIPES["cluster_markers"], {"graph"}) == [(2, "counts"), (4, "counts")]
    assert r.preflight(r.RECIPES["cluster_raw_counts"], {"counts", "obs"}) == []
    with pytest.raises(ValueError):
        r.run("neighborhood_enrichment", {})
    with pytest.raises(ValueError):
        r.steps_of(r.Recipe("x", {}, (("nothing", {}),)))


def test_every_recipe_binds():
    given = {"edges": [0.0, 0.1], "radii": [0.1], "region_key": "a", "cell_type_key": "b", "tested": "t", "reference": "u", "intercepts": {"a": 0.1}}
    for x in r.RECIPES.values():
        assert r.steps_of(x, {k: v for k, v in given.items() if k in x.params})


def test_runs(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    v = F.col("embedding")
    points = e.select(F.col("vec_id").alias("id"), v[0].cast("double").alias("x"), v[1].cast("double").alias("y"), F.col("label").alias("kind"), (F.col("vec_id") % 4).alias("lib"))
    out = r.run("neighborhood_enrichment", {"points": points}, {"cluster_key": "kind", "n_perms": 3})
    assert out["enrichment"].count() > 10
    out = r.run("graph_topology", {"points": points}, {"cluster_key": "kind", "n_neighs": 0 + 4})
    assert out["edges"].count() == 4 * points.count() and out["centrality"].count() == 10
    out = r.run("neighborhoods", {"points": points}, {"cell_type_key": "kind"})
    assert out["niches"].count() == points.count() and out["niche_enrichment"].count() > 0
    li = spark.read.parquet(f"{SF}/lineitem.parquet")
    counts = li.groupBy(F.col("l_orderkey").alias("row"), F.col("l_partkey").alias("var")).agg(F.sum("l_quantity").alias("value"))
    obs = counts.select("row").distinct()
    out = r.run("preprocess", {"counts": counts, "obs": obs}, {"min_counts": 50, "target": 100, "rounds": 1, "n_top": 30})
    assert out["umap"].count() == out["umap_3d"].count() == out["obs"].count() and len(out["umap_3d"].first()["v"]) == 3
    total = out["counts"].groupBy("row").agg(F.sum(F.expm1("value")).alias("t"))
    assert total.where(F.abs(F.col("t") - 100) > 1e-6).count() == 0 and 0 < total.count() < counts.select("row").distinct().count()


def test_counts_to_markers(spark):
    rows = [(i, g, 5.0 if g // 10 == i % 2 else 1.0) for i in range(40) for g in range(20) if (i * g) % 7 or g % 10 == 0] + [(99, 1, 1.0)]
    counts = spark.createDataFrame(rows, "row bigint, var int, value double")
    obs = spark.createDataFrame([(i,) for i in [*range(40), 99]], "row bigint")
    have = {"counts": counts, "obs": obs}
    steps = [("filter_cells", {"min_genes": 2}), ("normalize", {}), ("log1p", {}), ("variable_genes", {"n_top": 15}), ("dense_vectors", {})]
    out = r.run(r.Recipe("x", {}, tuple(steps)), have)
    got = {x["id"]: x["v"] for x in out["vectors"].collect()}
    assert set(got) == set(range(40)) and all(len(v) == 15 for v in got.values())
    rank = {x["var"]: x["rank"] for x in out["variable"].collect()}
    want = {(x["row"], x["var"]): x["value"] for x in out["counts"].collect()}
    assert all(abs(got[i][k - 1] - want.get((i, v), 0.0)) < 1e-12 for i in got for v, k in rank.items())
    assert r.preflight(r.RECIPES["spots_analysis"], {"counts", "obs"}) == []


def test_markers_trajectories_and_regions(spark):
    rng = np.random.default_rng(2)
    rows = [(i, g, float(v)) for i in range(60) for g in range(24) if (v := rng.poisson(6.0 if g // 8 == i % 3 else 0.5))]
    obs = spark.createDataFrame([(i, f"t{i % 3}", f"r{i // 30}") for i in range(60)], "row bigint, kind string, region string")
    state = {"counts": spark.createDataFrame(rows, "row bigint, var int, value double"), "obs": obs}
    out = r.run("tsne_and_diffusion", state, {"n_top": 24, "rounds": 2})
    groups = out["clusters"].join(obs, F.col("id") == F.col("row")).groupBy("community").agg(F.count_distinct("kind").alias("k"))
    assert out["tsne"].count() == out["diffusion"].count() == 60 and groups.count() == 3 and groups.where("k <> 1").isEmpty()
    for method in ("wilcoxon", "t-test", "t-test_overestim_var", "logreg"):
        got = r.run("marker_genes", state, {"method": method, "groupby": "kind", "n_genes": 8})["markers"].collect()
        assert {(x["grp"], x["var"] // 8) for x in got} == {("t0", 0), ("t1", 1), ("t2", 2)} and len(got) == 24
    with pytest.raises(ValueError):
        r.run("marker_genes", state, {"method": "guess", "groupby": "kind"})
    got = r.run("region_feature_differences", state, {"cell_type_key": "kind", "region_key": "region", "min_cells": 5})
    assert got["features"].count() > 0 and got["feature_means"].where("z is null").isEmpty()
    for flavor in ("seurat", "cell_ranger", "seurat_v3"):
        assert r.run(r.Recipe("v", {}, (("variable_genes", {"n_top": 5, "flavor": flavor}),)), state)["variable"].count() == 5
    extra = r.Recipe("e", {}, (("regress_out", {"keys": ["depth"]}), ("score_genes", {"gene_list": [0, 1, 2], "ctrl_size": 3}), ("score_cell_cycle", {"s_genes": [0, 1], "g2m_genes": [8, 9]})))
    got = r.run(extra, state | {"obs": obs.withColumn("depth", F.col("row") % 7)})
    assert got["residuals"].count() == 60 * 24 and got["scores"].count() == 60 and {x[0] for x in got["phases"].select("phase").distinct().collect()} <= {"G1", "S", "G2M"}
    assert abs(got["residuals"].agg(F.sum("value")).first()[0]) < 1e-6

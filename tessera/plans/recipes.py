"""Named operators with checked parameters, and recipes: parameterised lists of their steps over a set of tables.

A state is a dict of DataFrames under keys such as `points`, `obs`, `counts` or `graph`. Each operator says which keys
it needs and makes, so a recipe is checked before anything runs; iterative operators (graphs, layouts) run at once, the
others only extend lazy plans.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import expression as ex
from tessera.operators import embed, graph, leiden, markers, regions, spatial, tables

State = dict[str, DataFrame]
REQUIRED = object()


@dataclass(frozen=True)
class Operator:
    """run(state, **params) returns the tables it makes; params maps names to defaults (REQUIRED: none)."""

    key: str
    needs: tuple[str, ...]
    makes: tuple[str, ...]
    params: dict[str, Any]
    run: Callable[..., State]

    def bind(self, given: dict[str, Any]) -> dict[str, Any]:
        """Defaults with the given values; null and blank count as not given, 0 does not. Unknown names are refused."""
        unknown = sorted(set(given) - set(self.params))
        if unknown:
            raise ValueError(f"{self.key} has no {', '.join(unknown)}; it has {', '.join(self.params) or 'none'}")
        out = self.params | {k: v for k, v in given.items() if v is not None and v != ""}
        missing = [k for k, v in out.items() if v is REQUIRED]
        if missing:
            raise ValueError(f"{self.key} needs {', '.join(missing)}")
        return out


@dataclass(frozen=True)
class Recipe:
    """steps are (operator key, params); a text `$name` stands for a parameter of the recipe."""

    key: str
    params: dict[str, Any]
    steps: tuple[tuple[str, dict[str, Any]], ...] = field(default=())


OPERATORS: dict[str, Operator] = {}
RECIPES: dict[str, Recipe] = {}


def operator(key: str, needs: str, makes: str, **params: Any) -> Callable:
    def add(f: Callable) -> Callable:
        OPERATORS[key] = Operator(key, tuple(needs.split()), tuple(makes.split()), params, f)
        return f

    return add


def substitute(value: Any, params: dict[str, Any]) -> Any:
    if isinstance(value, str) and value.startswith("$"):
        if value[1:] not in params:
            raise ValueError(f"no parameter {value[1:]}; there are {', '.join(params) or 'none'}")
        return params[value[1:]]
    if isinstance(value, dict):
        return {k: substitute(v, params) for k, v in value.items()}
    return [substitute(v, params) for v in value] if isinstance(value, list) else value


def steps_of(recipe: Recipe, given: dict[str, Any] | None = None) -> list[tuple[Operator, dict[str, Any]]]:
    """The bound steps of a recipe."""
    own = Operator(recipe.key, (), (), recipe.params, dict).bind(given or {})
    out = []
    for key, params in recipe.steps:
        if key not in OPERATORS:
            raise ValueError(f"no operator {key}")
        out.append((OPERATORS[key], OPERATORS[key].bind(substitute(params, own))))
    return out


def preflight(recipe: Recipe, have: set[str], given: dict[str, Any] | None = None) -> list[tuple[int, str]]:
    """(step, key) of all that a step needs and neither the tables nor an earlier step provide."""
    have, out = set(have), []
    for n, (op, _) in enumerate(steps_of(recipe, given), 1):
        out += [(n, k) for k in op.needs if k not in have]
        have |= set(op.makes)
    return out


def run(recipe: Recipe | str, state: State, given: dict[str, Any] | None = None) -> State:
    """The state after all steps."""
    recipe = RECIPES[recipe] if isinstance(recipe, str) else recipe
    if missing := preflight(recipe, set(state), given):
        raise ValueError("; ".join(f"step {n} needs {k}" for n, k in missing))
    state = dict(state)
    for op, params in steps_of(recipe, given):
        state |= op.run(state, **params)
    return state


def _typed(state: State, column: str) -> DataFrame:
    p = state["points"]
    return p if column == "label" else p.drop("label").withColumnRenamed(column, "label")


@operator("qc", "counts", "qc", top=50)
def _(s, top):
    return {"qc": ex.qc_metrics(s["counts"], top)}


@operator("filter_cells", "counts", "counts", min_counts=0, max_counts=0, min_genes=0, max_genes=0)
def _(s, min_counts, max_counts, min_genes, max_genes):
    obs = s["obs"] if "obs" in s else s["counts"].select("row").distinct()
    kept = markers.kept_rows(s["counts"], obs, min_counts or None, max_counts or None, min_genes or None, max_genes or None)
    return {"counts": s["counts"].join(kept.select("row"), "row", "left_semi")} | ({"obs": kept} if "obs" in s else {})


@operator("filter_genes", "counts", "counts", min_cells=1)
def _(s, min_cells):
    return {"counts": ex.filter_vars(s["counts"], min_cells)}


@operator("normalize", "counts", "counts", target=0)
def _(s, target):
    return {"counts": ex.normalize_total(s["counts"], target or None)}


@operator("log1p", "counts", "counts")
def _(s):
    return {"counts": ex.log1p(s["counts"])}


@operator("scale", "counts obs", "scaled", max_value=10.0)
def _(s, max_value):
    return {"scaled": ex.scale(s["counts"], F.lit(s["obs"].count()), max_value)}


@operator("variable_genes", "counts obs", "variable", n_top=2000, flavor="seurat")
def _(s, n_top, flavor):
    n = s["obs"].count()
    ways = {"seurat": lambda: ex.dispersion_binned(s["counts"], F.lit(n), n_top), "cell_ranger": lambda: markers.variable_cell_ranger(s["counts"], F.lit(n), n_top)}
    ways |= dict.fromkeys(("seurat_v3", "seurat_v3_paper"), lambda: markers.variable_counts(s["counts"], n, n_top))
    if flavor not in ways:
        raise ValueError(f"flavor is one of {', '.join(ways)}")
    return {"variable": ways[flavor]()}


@operator("pca", "vectors", "pca", n_comps=50)
def _(s, n_comps):
    return {"pca": graph.pca(s["vectors"], n_comps)}


@operator("neighbors", "pca", "graph", n_neighbors=15)
def _(s, n_neighbors):
    return {"graph": spatial.knn_vectors(s["pca"].select("id", F.col("pc").alias("v")), n_neighbors)}


@operator("cluster", "graph", "clusters", resolution=1.0, seed=0, n_iterations=2)
def _(s, resolution, seed, n_iterations):
    return {"clusters": leiden.communities(s["graph"].select("i", "j"), resolution, seed, n_iterations)}


@operator("connectivities", "graph", "weights_graph")
def _(s):
    return {"weights_graph": embed.connectivities(s["graph"])}


def _layout(s, kind, n_components, rounds, seed):
    start = s["pca"].select("id", F.slice("pc", 1, n_components).alias("v"))
    return embed.layout(s["weights_graph"], start, kind, rounds, dims=n_components, seed=seed)


@operator("umap", "weights_graph pca", "umap", rounds=30, seed=0)
def _(s, rounds, seed):
    return {"umap": _layout(s, "umap", 2, rounds, seed)}


@operator("umap_3d", "weights_graph pca", "umap_3d", rounds=30, seed=0)
def _(s, rounds, seed):
    return {"umap_3d": _layout(s, "umap", 3, rounds, seed)}


@operator("tsne", "weights_graph pca", "tsne", rounds=30, seed=0)
def _(s, rounds, seed):
    return {"tsne": _layout(s, "tsne", 2, rounds, seed)}


@operator("draw_graph", "weights_graph pca", "drawn", rounds=30, seed=0)
def _(s, rounds, seed):
    return {"drawn": _layout(s, "force", 2, rounds, seed)}


@operator("diffmap", "weights_graph", "diffusion", n_comps=10, rounds=40)
def _(s, n_comps, rounds):
    return {"diffusion": embed.diffusion_map(s["weights_graph"], n_comps, rounds)[0]}


@operator("dpt", "weights_graph", "pseudotime", root=REQUIRED, n_comps=10, rounds=40)
def _(s, root, n_comps, rounds):
    return {"pseudotime": embed.pseudotime(*embed.diffusion_map(s["weights_graph"], n_comps, rounds), root)}


@operator("scrublet", "counts obs variable", "doublets", k=15, rate=0.06, seed=0)
def _(s, k, rate, seed):
    return {"doublets": embed.doublet_scores(s["counts"], s["obs"], s["variable"], k, rate=rate, seed=seed)}


@operator("regress_out", "counts obs", "residuals", keys=REQUIRED)
def _(s, keys):
    return {"residuals": markers.regress_out(s["counts"], s["obs"], keys)}


@operator("score_genes", "counts obs", "scores", gene_list=REQUIRED, ctrl_size=50, n_bins=25, seed=0)
def _(s, gene_list, ctrl_size, n_bins, seed):
    return {"scores": markers.gene_score(s["counts"], s["obs"], gene_list, n_bins, ctrl_size, seed)}


@operator("score_cell_cycle", "counts obs", "phases", s_genes=REQUIRED, g2m_genes=REQUIRED, seed=0)
def _(s, s_genes, g2m_genes, seed):
    return {"phases": markers.cell_cycle(s["counts"], s["obs"], s_genes, g2m_genes, seed)}


@operator("embedding_density", "points", "density", bandwidth=REQUIRED, cluster_key="label")
def _(s, bandwidth, cluster_key):
    return {"density": embed.density(_typed(s, cluster_key), bandwidth)}


@operator("identify_regions", "points", "clusters edges", n_neighbors=15, resolution=1.0, seed=0)
def _(s, n_neighbors, resolution, seed):
    near = spatial.knn(s["points"].withColumn("lib", F.lit(0)), n_neighbors)
    return {"clusters": leiden.communities(near.select("i", "j"), resolution, seed), "edges": near}


def _groups(s, groupby):
    if groupby:
        return s["obs"].select("row", F.col(groupby).alias("grp"))
    return s["clusters"].select(F.col("id").alias("row"), F.col("community").alias("grp"))


@operator("marker_genes", "counts", "markers", method="wilcoxon", n_genes=25, groupby="")
def _(s, method, n_genes, groupby):
    return {"markers": markers.top_markers(markers.markers(s["counts"], _groups(s, groupby), method), n_genes)}


@operator("filter_markers", "markers", "markers", min_in=0.25, max_out=0.5, min_fold=1.0)
def _(s, min_in, max_out, min_fold):
    return {"markers": markers.filter_markers(s["markers"], min_in, max_out, min_fold)}


@operator("dotplot", "counts", "dotplot", groupby="")
def _(s, groupby):
    return {"dotplot": ex.dotplot(s["counts"], _groups(s, groupby))}


@operator("region_features", "counts obs", "features feature_means", celltype_key=REQUIRED, region_key=REQUIRED, min_cells=10, n_top=50)
def _(s, celltype_key, region_key, min_cells, n_top):
    obs = s["obs"].select("row", F.col(celltype_key).alias("type"), F.col(region_key).alias("grp"))
    return {"features": markers.region_features(s["counts"], obs, min_cells, n_top), "feature_means": markers.region_means(s["counts"], obs, min_cells)}


@operator("gene_autocorrelation", "counts edges obs", "gene_autocorrelation")
def _(s):
    return {"gene_autocorrelation": markers.spatial_autocorrelation(s["counts"], s["obs"].select("row"), s["edges"].select("i", "j"))}


@operator("sepal", "counts edges obs", "sepal", max_neighs=6)
def _(s, max_neighs):
    return {"sepal": embed.sepal(s["counts"], s["edges"], s["obs"], max_neighs)}


@operator("spatial_neighbors", "points", "edges", n_neighs=6, cluster_key="label")
def _(s, n_neighs, cluster_key):
    return {"edges": spatial.knn(_typed(s, cluster_key), n_neighs)}


@operator("neighborhood_enrichment", "edges points", "enrichment", n_perms=100, seed=0, cluster_key="label")
def _(s, n_perms, seed, cluster_key):
    return {"enrichment": spatial.nhood_enrichment(s["edges"], _typed(s, cluster_key), n_perms, seed)}


@operator("autocorrelation", "edges values", "autocorrelation")
def _(s):
    return {"autocorrelation": spatial.autocorrelation(s["edges"], s["values"])}


@operator("co_occurrence", "points", "co_occurrence", edges=REQUIRED, cluster_key="label")
def _(s, edges, cluster_key):
    return {"co_occurrence": spatial.co_occurrence(_typed(s, cluster_key), edges)}


@operator("graph_topology", "edges points", "centrality interaction", cluster_key="label", normalized=False)
def _(s, cluster_key, normalized):
    labels = _typed(s, cluster_key).select("id", "label")
    each = spatial.centrality(s["edges"]).join(embed.closeness(s["edges"], labels), "label").join(embed.clustering(s["edges"], labels), "label")
    return {"centrality": each, "interaction": spatial.interaction(s["edges"], normalized)}


@operator("ripley", "points", "ripley", radii=REQUIRED, cluster_key="label", mode="L")
def _(s, radii, cluster_key, mode):
    p = _typed(s, cluster_key)
    return {"ripley": spatial.ripley(p, radii) if mode == "L" else embed.nearest_share(p, radii, mode)}


@operator("region_composition", "obs", "composition chi_square", region_key=REQUIRED, cell_type_key=REQUIRED)
def _(s, region_key, cell_type_key):
    return {"composition": tables.crosstab(s["obs"], region_key, cell_type_key), "chi_square": tables.chi_square(s["obs"], region_key, cell_type_key)}


@operator("cell_neighborhoods", "points", "composition niches", n_neighs=20, n_neighbors=15, resolution=0.1, cell_type_key="label")
def _(s, n_neighs, n_neighbors, resolution, cell_type_key):
    p = _typed(s, cell_type_key)
    mix = spatial.composition(spatial.knn(p, n_neighs, include_self=True))
    labels = [r[0] for r in p.select("label").distinct().orderBy("label").collect()]  # categories
    share = F.array(*[F.coalesce(F.sum(F.when(F.col("label") == x, F.col("proportion"))), F.lit(0.0)) for x in labels])
    vectors = mix.groupBy(F.col("i").alias("id")).agg(share.alias("v"))
    niches = leiden.communities(spatial.knn_vectors(vectors, n_neighbors), resolution).select(F.col("id").alias("i"), F.col("community").alias("niche"))
    return {"composition": mix, "niches": niches}


@operator("niche_enrichment", "composition niches", "niche_enrichment")
def _(s):
    return {"niche_enrichment": spatial.niche_enrichment(s["composition"], s["niches"])}


@operator("pseudobulk_test", "bulk samples", "differential", tested=REQUIRED, reference=REQUIRED)
def _(s, tested, reference):
    return {"differential": ex.pseudobulk_test(s["bulk"], s["samples"], tested, reference)}


@operator("ligand_receptor", "counts pairs", "ligand_receptor", n_perms=100, seed=0, groupby="")
def _(s, n_perms, seed, groupby):
    return {"ligand_receptor": markers.ligand_receptor_test(s["counts"], _groups(s, groupby).withColumn("lib", F.lit(0)), s["pairs"], n_perms, seed)}


@operator("dense_vectors", "counts obs variable", "vectors")
def _(s):
    return {"vectors": graph.dense_vectors(s["counts"], s["obs"], s["variable"])}


@operator("dendrogram", "pca clusters", "dendrogram")
def _(s):
    return {"dendrogram": graph.dendrogram(s["pca"].select("id", F.col("pc").alias("v")), s["clusters"])}


@operator("differential_abundance", "pca obs", "abundance", sample_key=REQUIRED, condition_key=REQUIRED, k=30, prop=0.1, refine=True, seed=0)
def _(s, sample_key, condition_key, k, prop, refine, seed):
    v = s["pca"].select("id", F.col("pc").alias("v"))
    cells = v.join(s["obs"].select(F.col("row").alias("id"), F.col(sample_key).alias("sample"), F.col(condition_key).alias("condition")), "id")
    return {"abundance": graph.differential_abundance(cells, spatial.knn_vectors(v, k), prop, refine, seed)}


@operator("region_boundary", "points", "boundary", interior_labels=REQUIRED, threshold=0.25, cell_type_key="label")
def _(s, interior_labels, threshold, cell_type_key):
    return {"boundary": regions.mask_boundary(_typed(s, cell_type_key), interior_labels, threshold=threshold)}


@operator("tissue_cores", "points", "cores", angle=0.0, rows=0, columns=0)
def _(s, angle, rows, columns):
    return {"cores": regions.tissue_cores(s["points"], angle, rows or None, columns or None)}


@operator("cell_types", "counts obs weights clusters", "types votes", intercepts=REQUIRED)
def _(s, intercepts):
    types = ex.logistic_types(s["counts"], s["obs"], s["weights"], intercepts)
    own = types.join(s["clusters"].select(F.col("id").alias("row"), F.col("community").alias("cluster")), "row")
    return {"types": types, "votes": ex.majority_vote(own, "cluster", "label")}


@operator("paga", "graph clusters", "paga")
def _(s):
    c = s["clusters"]
    e = s["graph"].select("i", "j").join(c.select(F.col("id").alias("i"), F.col("community").alias("li")), "i").join(c.select(F.col("id").alias("j"), F.col("community").alias("lj")), "j")
    return {"paga": spatial.paga(e)}


def recipe(key: str, steps: list[tuple[str, dict[str, Any]]], **params: Any) -> None:
    RECIPES[key] = Recipe(key, params, tuple(steps))


_TYPE = {"cluster_key": "$cluster_key"}
_EDGES = ("spatial_neighbors", {"n_neighs": "$n_neighs", **_TYPE})
_NORMAL = [("normalize", {"target": "$target"}), ("log1p", {})]
_VECTORS = [("variable_genes", {"n_top": "$n_top"}), ("dense_vectors", {}), ("pca", {}), ("neighbors", {})]
_PLACES = [("connectivities", {}), ("umap", {"rounds": "$rounds"}), ("umap_3d", {"rounds": "$rounds"})]
_LEIDEN = ("cluster", {"resolution": "$resolution"})
_MARKERS = [("marker_genes", {"method": "$method", "n_genes": "$n_genes", "groupby": "$groupby"}), ("filter_markers", {})]
_DOTS = ("dotplot", {"groupby": "$groupby"})
_TOP = {"method": "wilcoxon", "n_genes": 25, "groupby": ""}
recipe("preprocess", [("qc", {}), ("filter_cells", {"min_counts": "$min_counts"}), ("filter_genes", {"min_cells": "$min_cells"}), *_NORMAL, *_VECTORS, *_PLACES], min_counts=10, min_cells=5, target=0, n_top=2000, rounds=30)
recipe("cluster_markers", [_LEIDEN, *_MARKERS, _DOTS], resolution=1.0, **_TOP)
recipe("assign_cell_types", [("cell_types", {"intercepts": "$intercepts"})], intercepts=REQUIRED)
recipe("neighborhoods", [("cell_neighborhoods", {"cell_type_key": "$cell_type_key", "resolution": "$resolution"}), ("niche_enrichment", {})], cell_type_key="label", resolution=0.1)
recipe("composition_by_region", [("region_composition", {"region_key": "$region_key", "cell_type_key": "$cell_type_key"})], region_key=REQUIRED, cell_type_key=REQUIRED)
recipe("region_feature_differences", [("region_features", {"celltype_key": "$cell_type_key", "region_key": "$region_key", "min_cells": "$min_cells"})], cell_type_key=REQUIRED, region_key=REQUIRED, min_cells=10)
recipe("neighborhood_enrichment", [_EDGES, ("neighborhood_enrichment", {"n_perms": "$n_perms", **_TYPE})], cluster_key="label", n_neighs=6, n_perms=100)
recipe("spatially_variable_genes", [_EDGES, ("gene_autocorrelation", {})], cluster_key="label", n_neighs=6)
recipe("spatial_autocorrelation", [_EDGES, ("autocorrelation", {})], cluster_key="label", n_neighs=6)
recipe("co_occurrence", [("co_occurrence", {"edges": "$edges", **_TYPE})], cluster_key="label", edges=REQUIRED)
recipe("graph_topology", [_EDGES, ("graph_topology", _TYPE)], cluster_key="label", n_neighs=6)
recipe("point_patterns", [("ripley", {"radii": "$radii", "mode": "$mode", **_TYPE})], cluster_key="label", radii=REQUIRED, mode="L")
recipe("cluster_raw_counts", [*_NORMAL, *_VECTORS, _LEIDEN, *_PLACES], target=0, n_top=2000, resolution=1.0, rounds=30)
recipe("qc_filter_cluster", [("qc", {}), ("filter_cells", {"min_genes": "$min_genes"}), ("filter_genes", {"min_cells": "$min_cells"}), *_NORMAL, *_VECTORS, _LEIDEN], min_genes=10, min_cells=3, target=0, n_top=2000, resolution=1.0)
recipe("marker_genes", [*_MARKERS, _DOTS], **_TOP)
recipe("cluster_and_neighborhoods", [*_NORMAL, *_VECTORS, _LEIDEN, _EDGES, ("neighborhood_enrichment", _TYPE)], target=0, n_top=2000, resolution=1.0, cluster_key="label", n_neighs=6)
recipe("diffusion_time_genes", [_EDGES, ("sepal", {"max_neighs": "$max_neighs"})], cluster_key="label", n_neighs=6, max_neighs=6)
recipe("ligand_receptor", [("ligand_receptor", {"n_perms": "$n_perms", "groupby": "$groupby"})], n_perms=100, groupby="")
recipe("trajectory_graph", [*_NORMAL, *_VECTORS, _LEIDEN, ("paga", {}), *_PLACES], target=0, n_top=2000, resolution=1.0, rounds=30)
recipe("tsne_and_diffusion", [*_NORMAL, *_VECTORS, _LEIDEN, ("connectivities", {}), ("tsne", {"rounds": "$rounds"}), ("diffmap", {"rounds": "$rounds"})], target=0, n_top=2000, resolution=1.0, rounds=30)
recipe("cluster_hierarchy_and_markers", [("dendrogram", {}), *_MARKERS], **_TOP)
_SPOT_FILTERS = [("filter_cells", {"min_counts": "$min_counts"}), ("filter_cells", {"max_counts": "$max_counts"}), ("filter_genes", {"min_cells": 10})]
recipe("spots_analysis", [("qc", {}), *_SPOT_FILTERS, *_NORMAL, *_VECTORS, *_PLACES, _LEIDEN, *_MARKERS], min_counts=5000, max_counts=35_000, target=0, n_top=2000, resolution=1.0, **_TOP, rounds=30)
recipe("imaged_cells_clustering", [*_NORMAL, *_VECTORS, *_PLACES, _LEIDEN], target=1_000_000, n_top=2000, resolution=1.0, rounds=30)
recipe("pseudobulk", [("pseudobulk_test", {"tested": "$tested", "reference": "$reference"})], tested=REQUIRED, reference=REQUIRED)
recipe("protein_clusters", [("scale", {"max_value": "$max_value"}), *_VECTORS, _LEIDEN, *_PLACES], max_value=10.0, n_top=2000, resolution=1.0, rounds=30)

"""Marker genes, rank tests and gene scores over matrices in long form (row, var, value): zeros are not stored and count.

Rank tests never expand the zeros: values are counted by group first, so a gene is as many rows as it has different values
in a group, and the block of zeros has its mid-rank in closed form.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import chi_square_tail, normal_tail
from tessera.operators.expression import bh_adjust, moments

METHODS = ("t-test", "t-test_overestim_var", "wilcoxon", "logreg")


def rank_sums(x: DataFrame, obs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, var, grp, r, m, n, tie): rank sum and size of each group of obs (row, grp, by) among the n rows of its part, for
    every gene with an entry in the part, ties at their mean rank; tie is the sum of t^3 - t over the ties."""
    by = by or []
    size = obs.groupBy(*by, "grp").agg(F.count("*").alias("m"))
    total = size.groupBy(*by).agg(F.sum("m").alias("n"))
    c = x.where("value <> 0").join(obs, "row").groupBy(*by, "var", "value", "grp").agg(F.count("*").alias("c"))
    part = [*by, "var"]
    values = c.groupBy(*part, "value").agg(F.sum("c").alias("t"))
    below = F.coalesce(F.sum("t").over(Window.partitionBy(*part).orderBy("value").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    gene = values.groupBy(*part).agg(F.sum("t").alias("nnz"), F.coalesce(F.sum(F.when(F.col("value") < 0, F.col("t"))), F.lit(0)).alias("neg"), F.sum(F.col("t").cast("double") ** 3 - F.col("t")).alias("ties"))
    gene = gene.join(total, by) if by else gene.crossJoin(F.broadcast(total))  # one row
    gene = gene.withColumn("z", F.col("n") - F.col("nnz"))
    mid = values.withColumn("below", below).join(gene.select(*part, "z"), part)
    mid = mid.select(*part, "value", (F.col("below") + (F.col("t") + 1) / 2 + F.when(F.col("value") > 0, F.col("z")).otherwise(0)).alias("mid"))
    own = c.join(mid, [*part, "value"]).groupBy(*part, "grp").agg(F.sum(F.col("c") * F.col("mid")).alias("s"), F.sum("c").alias("k"))
    grid = gene.join(size, by) if by else gene.crossJoin(F.broadcast(size))  # genes x groups, the size of the result
    out = grid.join(own, [*part, "grp"], "left").fillna(0, ["s", "k"])
    zeros = (F.col("m") - F.col("k")) * (F.col("neg") + (F.col("z") + 1) / 2)
    return out.select(*part, "grp", (F.col("s") + zeros).alias("r"), "m", "n", (F.col("ties") + F.col("z").cast("double") ** 3 - F.col("z")).alias("tie"))


def wilcoxon(x: DataFrame, obs: DataFrame, tie_correct: bool = False) -> DataFrame:
    """(grp, var, score): z of each group's rank sum against the rest, zeros ranked."""
    s = rank_sums(x, obs)
    n, m = F.col("n").cast("double"), F.col("m").cast("double")
    spread = (n + 1) - (F.col("tie") / (n * (n - 1)) if tie_correct else 0.0)
    sd = F.sqrt(m * (n - m) * spread / 12)
    return s.select("grp", "var", F.when(sd > 0, (F.col("r") - m * (n + 1) / 2) / sd).alias("score"))


def kruskal_zeros(x: DataFrame, obs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, var, h, groups, p): Kruskal-Wallis of the groups (grp), zeros ranked; 0 and 1 if all values are equal."""
    by = by or []
    g = rank_sums(x, obs, by).groupBy(*by, "var").agg(F.sum(F.col("r") * F.col("r") / F.col("m")).alias("q"), F.count("*").alias("groups"), F.first("n").cast("double").alias("n"), F.first("tie").alias("tie"))
    c = 1 - F.col("tie") / (F.col("n") ** 3 - F.col("n"))
    h = F.lit(12.0) / (F.col("n") * (F.col("n") + 1)) * F.col("q") - 3 * (F.col("n") + 1)
    g = g.withColumn("h", F.when(c > 1e-12, F.greatest(h / c, F.lit(0.0))).otherwise(0.0))
    return g.select(*by, "var", "h", "groups", chi_square_tail(F.col("h"), F.col("groups") - 1).alias("p"))


def region_features(x: DataFrame, obs: DataFrame, min_cells: int = 10, n_top: int = 50) -> DataFrame:
    """(type, var, h, p, padj, rank): genes that differ between the regions (grp) of a cell type (type, row, grp), tested in
    regions of at least min_cells cells where there are two, adjusted within the type; the n_top least, ties by gene.
    No type to test is an error."""
    size = obs.groupBy("type", "grp").agg(F.count("*").alias("n")).where(F.col("n") >= min_cells)
    able = size.groupBy("type").agg(F.count("*").alias("k")).where("k >= 2").select("type")
    if able.isEmpty():
        raise ValueError(f"no cell type has {min_cells} cells in each of two regions")
    kept = obs.join(size.join(able, "type", "left_semi").select("type", "grp"), ["type", "grp"], "left_semi").select("row", "type", "grp")
    tested = bh_adjust(kruskal_zeros(x, kept, ["type"]), "p", "var", ["type"])
    w = Window.partitionBy("type").orderBy("padj", "p", "var")
    return tested.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= n_top).select("type", "var", "h", "p", "padj", "rank")


def region_means(x: DataFrame, obs: DataFrame, min_cells: int = 10) -> DataFrame:
    """(type, var, grp, mean, z): mean of each gene in each region of a type, zeros counted, and its z-score across the
    regions (population deviation; 0 where they do not differ)."""
    size = obs.groupBy("type", "grp").agg(F.count("*").alias("n")).where(F.col("n") >= min_cells)
    sums = x.join(obs, "row").groupBy("type", "grp", "var").agg(F.sum("value").alias("s"))
    genes = sums.join(size, ["type", "grp"]).select("type", "var").distinct()
    grid = genes.join(size, "type").join(sums, ["type", "grp", "var"], "left").select("type", "var", "grp", (F.coalesce("s", F.lit(0.0)) / F.col("n")).alias("mean"))
    w = Window.partitionBy("type", "var")
    sd = F.stddev_pop("mean").over(w)
    return grid.withColumn("sd", sd).withColumn("c", F.avg("mean").over(w)).select("type", "var", "grp", "mean", F.when(F.col("sd") > 1e-12, (F.col("mean") - F.col("c")) / F.col("sd")).otherwise(0.0).alias("z"))


def _against_rest(x: DataFrame, obs: DataFrame) -> DataFrame:
    """grp, var, n, m (rest), s1, s2, k of the group and o1, o2, ok of the rest, for every group and gene."""
    size = obs.groupBy("grp").agg(F.count("*").alias("n"))
    total = obs.agg(F.count("*").alias("nt"))
    held = x.join(obs, "row")
    own = moments(held, by=("grp", "var")).withColumnRenamed("nnz", "k")
    whole = moments(held).select("var", F.col("s1").alias("t1"), F.col("s2").alias("t2"), F.col("nnz").alias("tk"))
    grid = whole.crossJoin(F.broadcast(size)).crossJoin(F.broadcast(total)).join(own, ["grp", "var"], "left").fillna(0, ["s1", "s2", "k"])  # genes x groups, the size of the result
    rest = {"m": F.col("nt") - F.col("n"), "o1": F.col("t1") - F.col("s1"), "o2": F.col("t2") - F.col("s2"), "ok": F.col("tk") - F.col("k")}
    return grid.withColumns(rest)


def markers(x: DataFrame, obs: DataFrame, method: str = "wilcoxon", logged: bool = True) -> DataFrame:
    """(grp, var, score, p, padj, log2_fold, in_share, out_share) of every group and gene: the group against the rest.

    method is one of METHODS; the overestimated variance takes the group's size for the rest's too; logreg scores by the
    weights of a logistic regression of the standardised genes, one step of Newton's method from zero, and has no p. p of t
    is by Wallace's normal approximation. The fold is of means, undone from log1p if logged, with 1e-9 added to both."""
    if method not in METHODS:
        raise ValueError(f"method is one of {METHODS}, not {method!r}")
    g = _against_rest(x, obs)
    n, m = F.col("n").cast("double"), F.col("m").cast("double")
    mi, mo = F.col("s1") / n, F.col("o1") / m
    undo = (lambda v: F.expm1(v)) if logged else (lambda v: v)
    fold = F.log2((undo(mi) + 1e-9) / (undo(mo) + 1e-9))
    base = g.select("grp", "var", "n", "m", "s1", "s2", "o1", "o2", fold.alias("log2_fold"), (F.col("k") / n).alias("in_share"), (F.col("ok") / m).alias("out_share"))
    if method == "wilcoxon":
        out = base.join(wilcoxon(x, obs), ["grp", "var"]).withColumn("p", normal_tail(F.col("score")))
    else:
        vi, vo = (F.col("s2") - F.col("s1") * mi) / (n - 1), (F.col("o2") - F.col("o1") * mo) / (m - 1)
        if method == "logreg":
            t1, t2, nt = F.col("s1") + F.col("o1"), F.col("s2") + F.col("o2"), n + m
            var = (t2 - t1 * t1 / nt) / nt
            out = base.withColumn("score", F.when(var > 0, 4 * (F.col("s1") - n * t1 / nt) / (nt * F.sqrt(var)))).withColumn("p", F.lit(None).cast("double"))
        else:
            m2 = n if method == "t-test_overestim_var" else m
            a, b = vi / n, vo / m2
            t, dof = (mi - mo) / F.sqrt(a + b), (a + b) ** 2 / (a * a / (n - 1) + b * b / (m2 - 1))
            z = (8 * dof + 1) / (8 * dof + 3) * F.sqrt(dof * F.log1p(t * t / dof))
            out = base.withColumn("score", F.when((a + b) > 0, t)).withColumn("p", F.when((a + b) > 0, normal_tail(z)))
    return bh_adjust(out, "p", "var", ["grp"]).select("grp", "var", "score", "p", F.when(F.col("p").isNotNull(), F.col("padj")).alias("padj"), "log2_fold", "in_share", "out_share")


def top_markers(found: DataFrame, n: int) -> DataFrame:
    """found with rank: the n genes of largest score of each group, ties by gene."""
    w = Window.partitionBy("grp").orderBy(F.desc_nulls_last("score"), "var")
    return found.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= n)


def filter_markers(found: DataFrame, min_in: float = 0.25, max_out: float = 0.5, min_fold: float = 1.0) -> DataFrame:
    """found with name: the gene where it is in enough rows of the group, in few enough others, and its fold (a ratio) is
    large enough, else null; the rows stay."""
    ok = (F.col("in_share") >= min_in) & (F.col("out_share") <= max_out) & (F.col("log2_fold") >= math.log2(min_fold) if min_fold > 0 else F.lit(True))
    return found.withColumn("name", F.when(ok, F.col("var")))


def aggregate(x: DataFrame, obs: DataFrame, func: str) -> DataFrame:
    """(grp, var, value): sum, mean, variance (sample) or count_nonzero of each gene in each group, zeros counted; pairs
    without an entry have no row."""
    m = moments(x.join(obs, "row"), by=("grp", "var")).join(obs.groupBy("grp").agg(F.count("*").alias("n")), "grp")
    mean = F.col("s1") / F.col("n")
    ways = {"sum": F.col("s1"), "mean": mean, "var": (F.col("s2") - F.col("s1") * mean) / (F.col("n") - 1), "count_nonzero": F.col("nnz").cast("double")}
    if func not in ways:
        raise ValueError(f"func is one of {sorted(ways)}, not {func!r}")
    return m.select("grp", "var", ways[func].alias("value"))


def control_genes(x: DataFrame, genes: list, n: int | Column, n_bins: int = 25, ctrl_size: int = 50, seed: int = 0) -> DataFrame:
    """(var): control genes of a set: for each bin of mean expression (by rank, n_bins of them) that holds a gene of the set,
    the ctrl_size others that come first by an MD5 of seed and gene."""
    mean = x.groupBy("var").agg((F.sum("value") / n).alias("mean"))
    count = mean.agg(F.count("*").alias("n_vars"))
    place = F.rank().over(Window.orderBy("mean")) - 1  # one row per gene
    bins = mean.withColumn("r", place).crossJoin(F.broadcast(count)).select("var", F.floor(F.col("r") * n_bins / F.col("n_vars")).alias("bin"))
    own = bins.where(F.col("var").isin(genes)).select("bin").distinct()
    rest = bins.join(F.broadcast(own), "bin", "left_semi").where(~F.col("var").isin(genes))  # at most n_bins rows
    w = Window.partitionBy("bin").orderBy(F.md5(F.concat_ws("|", F.lit(seed), F.col("var").cast("string"))), "var")
    return rest.withColumn("k", F.row_number().over(w)).where(F.col("k") <= ctrl_size).select("var")


def gene_score(x: DataFrame, obs: DataFrame, genes: list, n_bins: int = 25, ctrl_size: int = 50, seed: int = 0) -> DataFrame:
    """(row, score): the mean of the genes less that of their control genes, zeros counted. Both sums are divided once, so
    counts give the same score in any order of their rows."""
    n = obs.count()
    control = control_genes(x, genes, n, n_bins, ctrl_size, seed)
    held = x.where(F.col("var").isin(genes)).select("var").distinct()
    size = F.count("*").over(Window.partitionBy())
    marks = control.select("var", F.lit(False).alias("own"), size.alias("n"))  # n_bins x ctrl_size rows
    marks = marks.unionByName(held.select("var", F.lit(True).alias("own"), size.alias("n")))  # genes of the set
    mean = lambda own: F.coalesce(F.sum(F.when(own, F.col("value"))) / F.max(F.when(own, F.col("n"))), F.lit(0.0))
    s = x.join(F.broadcast(marks), "var").groupBy("row").agg((mean(F.col("own")) - mean(~F.col("own"))).alias("score"))
    return obs.select("row").join(s, "row", "left").fillna(0.0, ["score"])


def cell_cycle(x: DataFrame, obs: DataFrame, s_genes: list, g2m_genes: list, seed: int = 0) -> DataFrame:
    """(row, s_score, g2m_score, phase): the phase of the larger positive score, G1 if none is positive."""
    size = min(len(s_genes), len(g2m_genes))
    a = gene_score(x, obs, s_genes, ctrl_size=size, seed=seed).withColumnRenamed("score", "s_score")
    b = gene_score(x, obs, g2m_genes, ctrl_size=size, seed=seed).withColumnRenamed("score", "g2m_score")
    both = a.join(b, "row")
    return both.withColumn("phase", F.when(F.greatest("s_score", "g2m_score") <= 1e-9, "G1").when(F.col("g2m_score") > F.col("s_score"), "G2M").otherwise("S"))


def variable_cell_ranger(x: DataFrame, n: int | Column, n_top: int, bins: int = 20) -> DataFrame:
    """(var, score, rank): dispersion less its bin's median over the bin's median absolute deviation, bins of equal numbers
    of genes by mean; the n_top largest, ties by gene."""
    m = moments(x)
    mean = F.col("s1") / n
    g = m.select("var", mean.alias("mean"), ((F.col("s2") - F.col("s1") * mean) / (n - F.lit(1)) / mean).alias("d")).where("mean > 0")
    count = g.agg(F.count("*").alias("n_vars"))
    g = g.withColumn("r", F.row_number().over(Window.orderBy("mean", "var")) - 1).crossJoin(F.broadcast(count)).withColumn("b", F.floor(F.col("r") * bins / F.col("n_vars")))  # one row per gene
    med = g.groupBy("b").agg(F.percentile("d", F.lit(0.5)).alias("md"))
    g = g.join(F.broadcast(med), "b").withColumn("e", F.col("d") - F.col("md"))  # at most `bins` rows
    mad = g.groupBy("b").agg(F.percentile(F.abs(F.col("e")), F.lit(0.5)).alias("mad"))
    g = g.join(F.broadcast(mad), "b").select("var", F.when(F.col("mad") > 0, F.col("e") / F.col("mad")).otherwise(0.0).alias("score"))
    w = Window.orderBy(F.desc("score"), "var")
    return g.orderBy(F.desc("score"), "var").limit(n_top).withColumn("rank", F.row_number().over(w).cast("bigint"))


def variable_counts(x: DataFrame, n: int, n_top: int) -> DataFrame:
    """(var, score, rank): variance of counts standardised by a trend of log variance over log mean (a parabola by least
    squares) and clipped at the root of n; the n_top largest, ties by gene."""
    m = moments(x)
    mean = F.col("s1") / n
    g = m.select("var", "nnz", mean.alias("mean"), ((F.col("s2") - F.col("s1") * mean) / (n - 1)).alias("v")).where("v > 0")
    u, y = F.log10("mean"), F.log10("v")
    s = g.agg(F.count("*").alias("n"), *(F.sum(u**k).alias(f"u{k}") for k in range(1, 5)), *(F.sum(u**k * y).alias(f"y{k}") for k in range(3))).first()
    if not s["n"]:
        return g.select("var", F.lit(0.0).alias("score"), F.lit(0).cast("bigint").alias("rank"))
    p = [float(s["n"]), *(float(s[f"u{k}"]) for k in range(1, 5))]
    a = np.array([[p[i + j] for j in range(3)] for i in range(3)]) + 1e-9 * np.eye(3)
    c = np.linalg.solve(a, np.array([float(s[f"y{k}"]) for k in range(3)]))
    sd = F.sqrt(F.pow(F.lit(10.0), F.lit(float(c[0])) + float(c[1]) * u + float(c[2]) * u * u))
    g = g.withColumn("sd", sd)
    top = math.sqrt(n)
    z = F.least((F.col("value") - F.col("mean")) / F.col("sd"), F.lit(top))
    zero = -F.col("mean") / F.col("sd")
    own = x.join(g, "var").groupBy("var").agg(F.sum(z * z).alias("q"), F.first("mean").alias("mean"), F.first("sd").alias("sd"), F.first("nnz").alias("nnz"))
    out = own.select("var", ((F.col("q") + (n - F.col("nnz")) * zero * zero) / (n - 1)).alias("score"))
    w = Window.orderBy(F.desc("score"), "var")
    return out.orderBy(F.desc("score"), "var").limit(n_top).withColumn("rank", F.row_number().over(w).cast("bigint"))


def top_shares(x: DataFrame, tops: list[int]) -> DataFrame:
    """(row, pct_<k>): the percentage of a row's total in its k largest entries, for each k."""
    w = Window.partitionBy("row").orderBy(F.desc("value"), "var")
    r = x.withColumn("rn", F.row_number().over(w))
    return r.groupBy("row").agg(*((F.lit(100.0) * F.sum(F.when(F.col("rn") <= k, F.col("value"))) / F.sum("value")).alias(f"pct_{k}") for k in tops))


def kept_rows(x: DataFrame, obs: DataFrame, least_total: float | None = None, most_total: float | None = None, least_vars: int | None = None, most_vars: int | None = None) -> DataFrame:
    """Rows of obs whose total and number of stored genes lie within the bounds given; rows without entries count as 0."""
    g = x.groupBy("row").agg(F.sum("value").alias("_t"), F.count("*").alias("_n"))
    t, n = F.coalesce("_t", F.lit(0.0)), F.coalesce("_n", F.lit(0))
    checks = [(t, least_total, "ge"), (t, most_total, "le"), (n, least_vars, "ge"), (n, most_vars, "le")]
    ok = reduce(lambda a, b: a & b, [c >= v if way == "ge" else c <= v for c, v, way in checks if v is not None], F.lit(True))
    return obs.join(g, "row", "left").where(ok).drop("_t", "_n")


def kept_vars(x: DataFrame, least_rows: int | None = None, most_rows: int | None = None, least_total: float | None = None, most_total: float | None = None) -> DataFrame:
    """(var) of genes with an entry whose number of rows and total lie within the bounds given."""
    g = x.groupBy("var").agg(F.sum("value").alias("t"), F.count("*").alias("n"))
    checks = [(F.col("n"), least_rows, "ge"), (F.col("n"), most_rows, "le"), (F.col("t"), least_total, "ge"), (F.col("t"), most_total, "le")]
    return g.where(reduce(lambda a, b: a & b, [c >= v if way == "ge" else c <= v for c, v, way in checks if v is not None], F.lit(True))).select("var")


def regress_out(x: DataFrame, obs: DataFrame, keys: list[str]) -> DataFrame:
    """(row, var, value): residuals of each gene after least squares on columns of obs with an intercept, for every row and
    gene, as residuals have no zeros to leave out. Cross products of the few columns come to the driver, genes do not."""
    cols = [F.lit(1.0), *(F.col(k).cast("double") for k in keys)]
    k = len(cols)
    s = obs.agg(*(F.sum(cols[i] * cols[j]).alias(f"s{i}_{j}") for i in range(k) for j in range(i, k))).first()
    a = np.array([[float(s[f"s{min(i, j)}_{max(i, j)}"] or 0) for j in range(k)] for i in range(k)])
    inv = np.linalg.pinv(a)
    xty = x.join(obs, "row").groupBy("var").agg(*(F.sum(F.col("value") * c).alias(f"y{i}") for i, c in enumerate(cols)))
    beta = xty.select("var", *(sum((float(inv[i, j]) * F.col(f"y{j}") for j in range(k)), F.lit(0.0)).alias(f"b{i}") for i in range(k)))
    fitted = sum((F.col(f"b{i}") * c for i, c in enumerate(cols)), F.lit(0.0))
    every = obs.crossJoin(F.broadcast(beta) if beta.limit(100_001).count() <= 100_000 else beta).select("row", "var", fitted.alias("f"))  # the dense result itself
    return every.join(x, ["row", "var"], "left").select("row", "var", (F.coalesce("value", F.lit(0.0)) - F.col("f")).alias("value"))


def spatial_autocorrelation(x: DataFrame, obs: DataFrame, edges: DataFrame) -> DataFrame:
    """(var, moran_i, moran_p, geary_c, geary_p) of every gene over edges (i, j) of weight one, zeros counted; p two-sided
    under normality. Sums run over stored entries and the edges between them. A constant gene has nulls."""
    n = obs.count()
    out_deg, in_deg = edges.groupBy("i").agg(F.count("*").alias("o")), edges.groupBy("j").agg(F.count("*").alias("p"))
    deg = obs.select("row").join(out_deg, F.col("row") == F.col("i"), "left").join(in_deg, F.col("row") == F.col("j"), "left").select("row", F.coalesce("o", F.lit(0)).alias("o"), F.coalesce("p", F.lit(0)).alias("p"))
    back = edges.select(F.col("i").alias("j"), F.col("j").alias("i")).withColumn("b", F.lit(1))
    both = edges.select("i", "j").join(back, ["i", "j"], "left").agg(F.count("*").alias("w"), F.count("b").alias("b")).first()
    w, s1 = float(both["w"] or 0), float((both["w"] or 0) + (both["b"] or 0))  # s1 = half the sum of (w_ij + w_ji)^2
    s2 = float(deg.agg(F.sum((F.col("o") + F.col("p")) ** 2)).first()[0] or 0)
    own = x.join(deg, "row")
    gene = own.groupBy("var").agg(F.sum("value").alias("t1"), F.sum(F.col("value") ** 2).alias("t2"), F.sum(F.col("value") * (F.col("o") + F.col("p"))).alias("d1"), F.sum(F.col("value") ** 2 * (F.col("o") + F.col("p"))).alias("d2"))
    a = x.select(F.col("row").alias("i"), "var", F.col("value").alias("vi"))
    b = x.select(F.col("row").alias("j"), "var", F.col("value").alias("vj"))
    cross = edges.select("i", "j").join(a, "i").join(b, ["j", "var"]).groupBy("var").agg(F.sum(F.col("vi") * F.col("vj")).alias("c"))
    g = gene.join(cross, "var", "left").fillna(0.0, ["c"])
    mean = F.col("t1") / n
    ss = F.col("t2") - F.col("t1") * mean
    moran = (n / w) * (F.col("c") - mean * F.col("d1") + mean * mean * w) / ss if w else F.lit(None).cast("double")
    geary = ((n - 1) / (2 * w)) * (F.col("d2") - 2 * F.col("c")) / ss if w else F.lit(None).cast("double")
    if w and n > 2:
        e = -1 / (n - 1)
        vm = (n * n * s1 - n * s2 + 3 * w * w) / ((n * n - 1) * w * w) - e * e
        vg = ((2 * s1 + s2) * (n - 1) - 4 * w * w) / (2 * (n + 1) * w * w)
    else:
        e, vm, vg = 0.0, 0.0, 0.0
    fine = ss > 1e-12
    p = lambda v, centre, var: normal_tail((v - centre) / math.sqrt(var)) if var > 0 else F.lit(None).cast("double")
    return g.select("var", *(F.when(fine, v).alias(k) for k, v in (("moran_i", moran), ("moran_p", p(moran, e, vm)), ("geary_c", geary), ("geary_p", p(geary, 1.0, vg)))))


def ligand_receptor_test(x: DataFrame, obs: DataFrame, pairs: DataFrame, n_perms: int = 100, seed: int = 0) -> DataFrame:
    """(ligand, receptor, source, target, score, p): the mean of the two group means where both are above 0, and the share of
    label shuffles (within lib) whose score is as large. obs is (row, grp, lib); pairs are few. Only entries of the pairs'
    genes are carried through the shuffles."""
    from tessera.operators.spatial import shuffled_labels

    wanted = pairs.select(F.col("ligand").alias("var")).unionByName(pairs.select(F.col("receptor").alias("var"))).distinct()
    held = x.join(wanted, "var", "left_semi")
    size = obs.groupBy("grp").agg(F.count("*").alias("n"))  # shuffles keep it

    def scored(labels: DataFrame, by: list[str]) -> DataFrame:
        m = held.join(labels, "row").groupBy(*by, "grp", "var").agg(F.sum("value").alias("s")).join(F.broadcast(size), "grp")
        m = m.select(*by, "grp", "var", (F.col("s") / F.col("n")).alias("mean"))
        a = m.select(*by, F.col("var").alias("ligand"), F.col("grp").alias("source"), F.col("mean").alias("ml"))
        b = m.select(*by, F.col("var").alias("receptor"), F.col("grp").alias("target"), F.col("mean").alias("mr"))
        both = pairs.join(a, "ligand").join(b, ["receptor", *by]).where("ml > 0 and mr > 0")
        return both.select(*by, "ligand", "receptor", "source", "target", ((F.col("ml") + F.col("mr")) / 2).alias("score"))

    observed = scored(obs.select("row", "grp"), [])
    points = obs.select(F.col("row").alias("id"), F.col("grp").alias("label"), "lib")
    perm = shuffled_labels(points, n_perms, seed).select(F.col("id").alias("row"), F.col("label").alias("grp"), "perm")
    keys = ["ligand", "receptor", "source", "target"]
    chance = scored(perm, ["perm"]).withColumnRenamed("score", "chance")
    out = observed.join(chance, keys, "left").groupBy(*keys, "score").agg((F.count_if(F.col("chance") >= F.col("score") - 1e-12) / n_perms).alias("p"))
    return out

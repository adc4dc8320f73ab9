"""Expression matrices in long form (row, var, value): zeros are not stored and always count.

Sums come from the stored entries, and each mean or variance divides by the number of all rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import normal_tail


def qc_metrics(x: DataFrame, top: int = 2) -> DataFrame:
    """(row, total, n_vars, pct_top): totals, stored entries and the share of the `top` largest, per row."""
    w = Window.partitionBy("row").orderBy(F.desc("value"), "var")
    r = x.withColumn("rn", F.row_number().over(w))
    g = r.groupBy("row").agg(F.sum("value").alias("total"), F.count("*").alias("n_vars"), F.sum(F.when(F.col("rn") <= top, F.col("value"))).alias("t"))
    return g.select("row", "total", "n_vars", (F.lit(100.0) * F.col("t") / F.col("total")).alias("pct_top"))


def filter_rows(x: DataFrame, min_counts: float | None = None, min_vars: int | None = None) -> DataFrame:
    g = x.groupBy("row").agg(F.sum("value").alias("total"), F.count("*").alias("n"))
    keep = g.where((F.col("total") >= (min_counts or 0)) & (F.col("n") >= (min_vars or 0)))
    return x.join(keep.select("row"), "row", "left_semi")


def filter_vars(x: DataFrame, min_rows: int) -> DataFrame:
    keep = x.groupBy("var").agg(F.count("*").alias("n")).where(F.col("n") >= min_rows)
    return x.join(keep.select("var"), "var", "left_semi")


def normalize_total(x: DataFrame, target: float | None = None) -> DataFrame:
    """Scale each row to the target, by default the median of the totals above 0."""
    total = x.groupBy("row").agg(F.sum("value").alias("total")).where("total > 0")
    out = x.join(total, "row")
    if target is not None:
        return out.select("row", "var", (F.col("value") * target / F.col("total")).alias("value"))
    median = total.agg(F.percentile("total", F.lit(0.5)).alias("target"))
    return out.crossJoin(F.broadcast(median)).select("row", "var", (F.col("value") * F.col("target") / F.col("total")).alias("value"))


def log1p(x: DataFrame) -> DataFrame:
    return x.select("row", "var", F.log1p("value").alias("value"))


def moments(x: DataFrame, by: tuple[str, ...] = ("var",)) -> DataFrame:
    """by, nnz, s1, s2: what means and variances with implicit zeros need."""
    return x.groupBy(*by).agg(F.count("*").alias("nnz"), F.sum("value").alias("s1"), F.sum(F.col("value") * F.col("value")).alias("s2"))


def scale(x: DataFrame, n: int | Column, max_value: float) -> DataFrame:
    """z-scores (sample deviation, zeros counted) of the stored entries, clipped, and each gene's value at zero."""
    m = moments(x)
    mean = F.col("s1") / n
    sd = F.sqrt((F.col("s2") - F.col("s1") * mean) / (n - F.lit(1)))
    z = lambda v: F.greatest(F.least((v - F.col("mean")) / F.col("sd"), F.lit(max_value)), F.lit(-max_value))
    m = m.select("var", mean.alias("mean"), F.when(sd > 0, sd).otherwise(1.0).alias("sd"))
    return x.join(m, "var").select("row", "var", z(F.col("value")).alias("z"), z(F.lit(0.0)).alias("z_zero"))


def dispersion(x: DataFrame, n: int | Column, n_top: int) -> DataFrame:
    """(var, mean, dispersion, rank): variance over mean, the n_top largest, ties by var."""
    m = moments(x)
    mean = F.col("s1") / n
    var = (F.col("s2") - F.col("s1") * mean) / (n - F.lit(1))
    d = m.select("var", mean.alias("mean"), (var / mean).alias("dispersion"))
    top = d.orderBy(F.desc("dispersion"), "var").limit(n_top)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("dispersion"), "var")).cast("bigint"))


def pseudobulk(x: DataFrame, obs: DataFrame, by: tuple[str, ...], min_rows: int = 10, min_count: float = 10) -> DataFrame:
    """by, var, value: sums over groups of at least min_rows rows; genes of at least min_count over kept groups."""
    size = obs.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") >= min_rows).drop("n")
    sums = x.join(obs, "row").join(size, list(by), "left_semi").groupBy(*by, "var").agg(F.sum("value").alias("value"))
    keep = sums.groupBy("var").agg(F.sum("value").alias("t")).where(F.col("t") >= min_count)
    return sums.join(keep.select("var"), "var", "left_semi")


def rank_ttest(x: DataFrame, obs: DataFrame) -> DataFrame:
    """(grp, var, mean_in, mean_out, t): Welch's t of each group against the rest, zeros counted."""
    size = obs.groupBy("grp").agg(F.count("*").alias("n"))
    total = obs.agg(F.count("*").alias("nt"))
    g = moments(x.join(obs, "row"), by=("grp", "var"))
    all_ = moments(x).select("var", F.col("s1").alias("t1"), F.col("s2").alias("t2"))
    j = size.crossJoin(F.broadcast(total)).join(g, "grp").join(all_, "var").withColumn("m", F.col("nt") - F.col("n"))
    j = j.withColumn("o1", F.col("t1") - F.col("s1")).withColumn("o2", F.col("t2") - F.col("s2"))
    mi, mo = F.col("s1") / F.col("n"), F.col("o1") / F.col("m")
    vi = (F.col("s2") - F.col("s1") * mi) / (F.col("n") - 1)
    vo = (F.col("o2") - F.col("o1") * mo) / (F.col("m") - 1)
    se = F.sqrt(vi / F.col("n") + vo / F.col("m"))
    return j.select("grp", "var", mi.alias("mean_in"), mo.alias("mean_out"), F.when(se > 0, (mi - mo) / se).alias("t"))


def mid_ranks(df: DataFrame, part: list[str], value: str = "value") -> DataFrame:
    """df with `mid`, the rank of value among the rows that df has (`markers` ranks matrices with their zeros) within part, ties at their mean, and `ties`, how many share it."""
    w, t = Window.partitionBy(*part).orderBy(value), Window.partitionBy(*part, value)
    return df.withColumn("ties", F.count("*").over(t)).withColumn("mid", F.rank().over(w) + (F.col("ties") - 1) / 2)


def kruskal(df: DataFrame, by: list[str], group: str, value: str = "value") -> DataFrame:
    """by, h (corrected for ties; 0 if all values are equal), groups: the Kruskal-Wallis statistic."""
    r = mid_ranks(df, by, value)
    n = r.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.col("ties") * F.col("ties") - 1).alias("tie"))
    s = r.groupBy(*by, group).agg(F.sum("mid").alias("s"), F.count("*").alias("m"))
    s = s.groupBy(*by).agg(F.sum(F.col("s") * F.col("s") / F.col("m")).alias("q"), F.count("*").alias("groups"))
    h = F.lit(12.0) / (F.col("n") * (F.col("n") + 1)) * F.col("q") - 3 * (F.col("n") + 1)
    c = 1 - F.col("tie") / (F.col("n") * F.col("n") * F.col("n") - F.col("n"))
    return n.join(s, by).select(*by, F.when(c > 0, h / c).otherwise(0.0).alias("h"), "groups")


def rank_wilcoxon(df: DataFrame, by: list[str], group: str, value: str = "value") -> DataFrame:
    """by, group, z of each group's rank sum against the rest (normal approximation, no tie correction)."""
    r = mid_ranks(df, by, value)
    n = r.groupBy(*by).agg(F.count("*").alias("n"))
    s = r.groupBy(*by, group).agg(F.sum("mid").alias("s"), F.count("*").alias("m")).join(n, by)
    mean = F.col("m") * (F.col("n") + 1) / 2
    sd = F.sqrt(F.col("m") * (F.col("n") - F.col("m")) * (F.col("n") + 1) / 12)
    return s.select(*by, group, F.when(sd > 0, (F.col("s") - mean) / sd).alias("z"))


def bh_adjust(df: DataFrame, p: str, key: str, part: list[str] | None = None) -> DataFrame:
    """df with padj: Benjamini-Hochberg within part."""
    own = Window.partitionBy(*(part or []))
    n = F.count("*").over(own)
    r = F.row_number().over(own.orderBy(p, key))
    out = df.withColumn("_q", F.col(p) * n / r).withColumn("_r", r)
    back = own.orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("padj", F.least(F.min("_q").over(back), F.lit(1.0))).drop("_q", "_r")


def dense_column(obs: DataFrame, x: DataFrame, var: DataFrame, gene: str) -> DataFrame:
    """(row, value) of the first gene of that name, zeros filled in."""
    first = var.where(F.col("name") == gene).agg(F.min("var").alias("var"))
    hit = x.join(F.broadcast(first), "var").select("row", "value")
    return obs.select("row").join(hit, "row", "left").select("row", F.coalesce("value", F.lit(0.0)).alias("value"))


def dotplot(x: DataFrame, obs: DataFrame) -> DataFrame:
    """(grp, var, mean, fraction): mean value and share of rows with one, by group."""
    size = obs.groupBy("grp").agg(F.count("*").alias("n"))
    m = moments(x.join(obs, "row"), by=("grp", "var")).join(size, "grp")
    return m.select("grp", "var", (F.col("s1") / F.col("n")).alias("mean"), (F.col("nnz") / F.col("n")).alias("fraction"))


def ligrec(x: DataFrame, obs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(ligand, receptor, source, target, score): mean of the two group means for each pair of groups."""
    d = dotplot(x, obs).select("grp", "var", "mean")
    a = d.select(F.col("var").alias("ligand"), F.col("grp").alias("source"), F.col("mean").alias("ml"))
    b = d.select(F.col("var").alias("receptor"), F.col("grp").alias("target"), F.col("mean").alias("mr"))
    return pairs.join(a, "ligand").join(b, "receptor").select("ligand", "receptor", "source", "target", ((F.col("ml") + F.col("mr")) / 2).alias("score"))


def score_genes(x: DataFrame, obs: DataFrame, genes: Column, control: Column, n_genes: int, n_control: int) -> DataFrame:
    """(row, score): the mean of the genes less that of the control genes, zeros counted."""
    g = x.groupBy("row").agg(F.sum(F.when(genes, F.col("value"))).alias("a"), F.sum(F.when(control, F.col("value"))).alias("b"))
    out = obs.join(g, "row", "left").fillna(0, ["a", "b"])
    return out.select("row", (F.col("a") / n_genes - F.col("b") / n_control).alias("score"))


def is_counts(x: DataFrame) -> DataFrame:
    """One row: whether no value is negative or fractional."""
    return x.agg((F.count_if((F.col("value") < 0) | (F.col("value") != F.floor("value"))) == 0).alias("is_counts"))


def dispersion_binned(x: DataFrame, n: int | Column, n_top: int, bins: int = 20) -> DataFrame:
    """(var, score, rank): log dispersion standardised within equal-width bins of log mean, the n_top largest.

    x is on the natural scale, zeros counted by n. A bin of one gene takes its mean as deviation and 0 as mean."""
    m = moments(x)
    mean = F.col("s1") / n
    var = (F.col("s2") - F.col("s1") * mean) / (n - F.lit(1))
    g = m.select("var", F.log(var / mean).alias("d"), F.log1p(mean).alias("m")).where("d is not null")
    box = g.agg(F.min("m").alias("lo"), F.max("m").alias("hi"))
    b = F.least(F.floor((F.col("m") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
    g = g.crossJoin(F.broadcast(box)).select("var", "d", F.when(F.col("hi") > F.col("lo"), b).otherwise(0).alias("b"))  # one row
    s = g.groupBy("b").agg(F.avg("d").alias("mu"), F.stddev_samp("d").alias("sd"))
    s = s.select("b", F.when(F.col("sd").isNull(), 0.0).otherwise(F.col("mu")).alias("mu"), F.coalesce("sd", "mu").alias("sd"))
    z = g.join(F.broadcast(s), "b").select("var", ((F.col("d") - F.col("mu")) / F.col("sd")).alias("score"))  # at most `bins` rows
    top = z.orderBy(F.desc_nulls_last("score"), "var").limit(n_top)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last("score"), "var")).cast("bigint"))


def size_factors(x: DataFrame) -> DataFrame:
    """(sample, factor) by the median of ratios to the geometric means of genes that every sample has; x is (sample, var, value)."""
    x = x.where("value > 0")
    n = x.agg(F.count_distinct("sample").alias("ns"))
    g = x.groupBy("var").agg(F.avg(F.log("value")).alias("mean"), F.count("*").alias("k")).crossJoin(F.broadcast(n)).where("k = ns")  # one row
    return x.join(g, "var").groupBy("sample").agg(F.exp(F.percentile(F.log("value") - F.col("mean"), F.lit(0.5))).alias("factor"))


def logistic_types(x: DataFrame, obs: DataFrame, weights: DataFrame, intercepts: dict[str, float]) -> DataFrame:
    """(row, label, confidence): the label of largest logit (ties: least label) and its probability.

    weights is (var, label, weight); the intercepts, one for each label, also serve rows without any stored entry."""
    labels = F.array(*[F.struct(F.lit(k).alias("label"), F.lit(float(v)).alias("b")) for k, v in sorted(intercepts.items())])
    sums = x.join(weights, "var").groupBy("row", "label").agg(F.sum(F.col("value") * F.col("weight")).alias("s"))
    every = obs.select("row", F.explode(labels).alias("l")).select("row", "l.*").join(sums, ["row", "label"], "left")
    every = every.select("row", "label", (F.coalesce("s", F.lit(0.0)) + F.col("b")).alias("logit"))
    best = every.groupBy("row").agg(F.max("logit").alias("top"), F.sort_array(F.collect_list(F.struct((-F.col("logit")).alias("k"), "label")))[0]["label"].alias("label"))
    return best.select("row", "label", (1 / (1 + F.exp(-F.col("top")))).alias("confidence"))


def majority_vote(df: DataFrame, cluster: str, label: str) -> DataFrame:
    """(cluster, label, share): each cluster's most frequent label, ties to the least."""
    n = df.groupBy(cluster, label).agg(F.count("*").alias("n"))
    g = n.groupBy(cluster).agg(F.sum("n").alias("t"), F.min(F.struct((-F.col("n")).alias("k"), F.col(label).alias("label"))).alias("b"))
    return g.select(cluster, F.col("b.label").alias("label"), (-F.col("b.k") / F.col("t")).alias("share"))


def pseudobulk_test(x: DataFrame, samples: DataFrame, tested: str, reference: str, factors: DataFrame | None = None) -> DataFrame:
    """(var, base_mean, log2_fold, se, stat, p, padj) of pseudobulk counts (sample, var, value) between two conditions
    of samples (sample, condition): negative binomial regression with a log link and size factors (default: median of
    ratios), Wald test.

    Dispersions are of moments, drawn halfway (on the log scale) to a trend a + b / mean. A gene is one row with the
    counts of all samples, whose number is small; genes are spread over tasks and fitted by numpy in Arrow batches."""
    if not x.where((F.col("value") < 0) | (F.col("value") != F.floor("value"))).isEmpty():
        raise ValueError("raw counts are needed: a value is negative or no whole number")
    s = samples.where(F.col("condition").isin(tested, reference)).join(size_factors(x) if factors is None else factors, "sample")
    rows = {r["sample"]: (r["factor"], r["condition"] == tested) for r in s.collect()}  # samples, not cells
    names = sorted(rows)
    factor, is_tested = np.array([rows[k][0] for k in names]), np.array([rows[k][1] for k in names], dtype=float)
    if not 1 <= is_tested.sum() < len(names) or len(names) < 3:
        raise ValueError("each condition needs samples, three in all")
    at = {k: i for i, k in enumerate(names)}
    place = F.element_at(F.create_map(*[F.lit(v) for kv in at.items() for v in kv]), F.col("sample"))
    genes = x.where(F.col("sample").isin(names)).groupBy("var").agg(F.collect_list(F.struct(place.alias("k"), F.col("value").cast("double").alias("v"))).alias("c"))

    def matrix(g: pd.DataFrame) -> np.ndarray:
        y = np.zeros((len(g), len(names)))
        for i, c in enumerate(g["c"]):
            for e in c:
                y[i, e["k"]] += e["v"]
        return y

    def moments_of(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        q = y / factor
        within = sum(((q[:, m] - q[:, m].mean(axis=1, keepdims=True)) ** 2).sum(axis=1) for m in (is_tested > 0, is_tested == 0))
        mean = np.maximum(q.mean(axis=1), 1e-9)
        return mean, np.clip((within / (len(names) - 2) - mean * (1 / factor).mean()) / mean**2, 1e-4, 50)

    def disperse(batches):
        for g in batches:
            mean, a = moments_of(matrix(g))
            yield pd.DataFrame({"inv": 1 / mean, "a": a})

    t = genes.mapInPandas(disperse, "inv double, a double").where("a > 0.0001")
    t = t.agg(F.regr_slope("a", "inv"), F.regr_intercept("a", "inv"), F.percentile("a", F.lit(0.5))).first()
    slope, base = max(t[0] or 0.0, 0.0), max(t[1] or 0.0, 1e-2 * (t[2] or 1.0), 1e-4)

    def test(batches):
        for g in batches:
            y = matrix(g)
            mean, a = moments_of(y)
            a = np.sqrt(a * (base + slope / mean))[:, None]
            b0, b1 = np.log(mean), np.zeros(len(y))
            for _ in range(60):
                mu = np.clip(factor * np.exp(np.clip(b0[:, None] + b1[:, None] * is_tested, -30, 30)), 1e-8, None)
                w = mu / (1 + a * mu)
                r = (y - mu) / (1 + a * mu)
                w0, w1 = w.sum(axis=1) + 1e-9, (w * is_tested).sum(axis=1)
                g0, g1 = r.sum(axis=1), (r * is_tested).sum(axis=1) - 1e-6 * b1
                det = np.maximum(w0 * (w1 + 1e-6) - w1 * w1, 1e-12)
                d0, d1 = ((w1 + 1e-6) * g0 - w1 * g1) / det, (w0 * g1 - w1 * g0) / det
                b0, b1 = b0 + np.clip(d0, -2, 2), np.clip(b1 + np.clip(d1, -2, 2), -20, 20)
                if max(np.abs(d0).max(initial=0), np.abs(d1).max(initial=0)) < 1e-8:
                    break
            yield pd.DataFrame({"var": g["var"], "base_mean": mean, "log2_fold": b1 / np.log(2), "se": np.sqrt(w0 / det) / np.log(2)})

    kind = x.schema["var"].dataType.simpleString()
    out = genes.mapInPandas(test, f"var {kind}, base_mean double, log2_fold double, se double").withColumn("stat", F.col("log2_fold") / F.col("se"))
    return bh_adjust(out.withColumn("p", normal_tail(F.col("stat"))), "p", "var")

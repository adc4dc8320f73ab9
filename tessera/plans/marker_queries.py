"""Queries of marker genes, rank tests, gene scores and spatial tests, each with an independent SQL statement.

Rows are customers, genes are the names of parts, values the quantities a customer ordered; SQL lays the matrix out with
its zeros.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import markers, tables
from tessera.plans.queries import KNN, REG, _graph, _points, _r, _regions, _t, query

XN = """xn AS (SELECT o_custkey AS r, p_name AS v, sum(l_quantity) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
dense AS (SELECT c_custkey AS r, c_mktsegment AS g, n.v, coalesce(value, 0) AS value, c_acctbal FROM customer CROSS JOIN (SELECT DISTINCT v FROM xn) n LEFT JOIN xn ON xn.r = c_custkey AND xn.v = n.v)"""


def _tail(z: str) -> str:
    t = f"(1 / (1 + 0.3275911 * abs({z}) / sqrt(2)))"
    return f"(((((1.061405429 * {t} - 1.453152027) * {t} + 1.421413741) * {t} - 0.284496736) * {t} + 0.254829592) * {t} * exp(-({z}) * ({z}) / 2))"


def _x(spark, sf) -> DataFrame:
    o = _t(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("row"))
    p = _t(spark, sf, "part").select("p_partkey", F.col("p_name").alias("var"))
    li = _t(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    return li.join(o, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey).groupBy("row", "var").agg(F.sum("l_quantity").alias("value"))


def _obs(spark, sf) -> DataFrame:
    return _t(spark, sf, "customer").select(F.col("c_custkey").alias("row"), F.col("c_mktsegment").alias("grp"))


GROUPS = XN + """, s AS (SELECT g, v, count(*) AS n, sum(value) AS s1, sum(value * value) AS s2, count(*) FILTER (value <> 0) AS k FROM dense GROUP BY 1, 2),
w AS (SELECT a.g, a.v, a.n, a.s1, a.s2, a.k, sum(b.n) AS m, sum(b.s1) AS o1, sum(b.s2) AS o2, sum(b.k) AS ok FROM s a JOIN s b ON a.v = b.v AND a.g <> b.g GROUP BY ALL),
f AS (SELECT *, s1 / n AS mi, o1 / m AS mo, (s2 - s1 * s1 / n) / (n - 1) AS vi, (o2 - o1 * o1 / m) / (m - 1) AS vo, log2((exp(s1 / n) - 1 + 1e-9) / (exp(o1 / m) - 1 + 1e-9)) AS fold FROM w)"""
ADJUST = """, b AS (SELECT *, p * count(*) OVER (PARTITION BY g) / row_number() OVER (PARTITION BY g ORDER BY p, v) AS q, row_number() OVER (PARTITION BY g ORDER BY p, v) AS rn FROM t),
a AS (SELECT *, least(min(q) OVER (PARTITION BY g ORDER BY rn DESC ROWS UNBOUNDED PRECEDING), 1) AS padj FROM b) """
SHOWN = "SELECT g AS grp, v AS var, round(score, 5) AS score, round(p, 5) AS p, round(padj, 5) AS padj, round(fold, 5) AS log2_fold, round(k / n, 6) AS in_share, round(ok / m, 6) AS out_share FROM a"


def _shown(df: DataFrame) -> DataFrame:
    return df.select("grp", "var", *(_r(c, 5).alias(c) for c in ("score", "p", "padj", "log2_fold")), *(_r(c).alias(c) for c in ("in_share", "out_share")))


RANKS = f"""WITH {GROUPS}, k1 AS (SELECT v, g, value, rank() OVER (PARTITION BY v ORDER BY value) + (count(*) OVER (PARTITION BY v, value) - 1) / 2 AS mid FROM dense),
r AS (SELECT v, g, sum(mid) AS r FROM k1 GROUP BY 1, 2), z AS (SELECT f.*, (r - n * (n + m + 1) / 2) / sqrt(n::DOUBLE * m * (n + m + 1) / 12) AS score FROM f JOIN r USING (g, v)),
t AS (SELECT *, {_tail('score')} AS p FROM z){ADJUST}"""


@query(RANKS + SHOWN)
def markers_wilcoxon(spark, sf):
    return _shown(markers.markers(_x(spark, sf), _obs(spark, sf), "wilcoxon"))


def _t_sql(rest: str) -> str:
    z = "((8 * dof + 1) / (8 * dof + 3) * sqrt(dof * ln(1 + score * score / dof)))"
    return f"""WITH {GROUPS}, e AS (SELECT *, vi / n AS a, vo / {rest} AS b, {rest} AS m2 FROM f), d AS (SELECT * EXCLUDE (a, b), (mi - mo) / sqrt(a + b) AS score, (a + b) * (a + b) / (a * a / (n - 1) + b * b / (m2 - 1)) AS dof FROM e),
t AS (SELECT *, {_tail(z)} AS p FROM d){ADJUST}"""


@query(_t_sql("m") + SHOWN)
def markers_ttest(spark, sf):
    return _shown(markers.markers(_x(spark, sf), _obs(spark, sf), "t-test"))


@query(_t_sql("n") + SHOWN)
def markers_ttest_overestimated(spark, sf):
    return _shown(markers.markers(_x(spark, sf), _obs(spark, sf), "t-test_overestim_var"))


@query(f"WITH {GROUPS}, v AS (SELECT v, avg(value) AS mean, stddev_pop(value) AS sd FROM dense GROUP BY 1) SELECT g AS grp, f.v AS var, round(4 * (n / (n + m)) * (mi - mean) / sd, 5) AS score FROM f JOIN v USING (v)")
def markers_logreg(spark, sf):
    return markers.markers(_x(spark, sf), _obs(spark, sf), "logreg").select("grp", "var", _r("score", 5).alias("score"))


@query(RANKS + ", x AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY score DESC, v) AS rank FROM a) SELECT g AS grp, v AS var, rank, CASE WHEN k / n >= 0.4 AND ok / m <= 0.6 AND fold >= log2(1.1) THEN v END AS name FROM x WHERE rank <= 10")
def markers_filtered(spark, sf):
    found = markers.top_markers(markers.markers(_x(spark, sf), _obs(spark, sf), "wilcoxon"), 10)
    return markers.filter_markers(found, 0.4, 0.6, 1.1).select("grp", "var", "rank", "name")


# Regions.

TYPED = XN.replace("c_mktsegment AS g", "c_mktsegment AS type, r_name AS g").replace("FROM customer CROSS JOIN", f"FROM {REG} CROSS JOIN") + """,
size AS (SELECT type, g, count(DISTINCT r) AS m FROM dense GROUP BY 1, 2 HAVING count(DISTINCT r) >= 4), able AS (SELECT type FROM size GROUP BY 1 HAVING count(*) >= 2), held AS (SELECT d.* FROM dense d JOIN size USING (type, g) JOIN able USING (type))"""


def _typed(spark, sf) -> DataFrame:
    return _regions(spark, sf).select(F.col("c_custkey").alias("row"), F.col("c_mktsegment").alias("type"), F.col("r_name").alias("grp"))


CHI = f"CASE dof WHEN 1 THEN {_tail('sqrt(h)')} WHEN 2 THEN exp(-h / 2) WHEN 3 THEN {_tail('sqrt(h)')} + sqrt(2 * h / pi()) * exp(-h / 2) WHEN 4 THEN exp(-h / 2) * (1 + h / 2) END"


@query(f"""WITH {TYPED}, k AS (SELECT *, rank() OVER (PARTITION BY type, v ORDER BY value) + (count(*) OVER (PARTITION BY type, v, value) - 1) / 2 AS mid, count(*) OVER (PARTITION BY type, v, value) AS ties FROM held),
t AS (SELECT type, v, count(*)::DOUBLE AS n, sum(ties * ties - 1) AS tie, count(DISTINCT g) - 1 AS dof FROM k GROUP BY 1, 2), s AS (SELECT type, v, sum(q) AS q FROM (SELECT type, v, sum(mid) * sum(mid) / count(*) AS q FROM k GROUP BY type, v, g) GROUP BY 1, 2),
h AS (SELECT type, v, dof, greatest((12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - tie / (n * n * n - n)), 0) AS h FROM t JOIN s USING (type, v) WHERE tie < n * n * n - n), p AS (SELECT type, v, h, least({CHI}, 1) AS p FROM h),
b AS (SELECT *, p * count(*) OVER (PARTITION BY type) / row_number() OVER (PARTITION BY type ORDER BY p, v) AS q, row_number() OVER (PARTITION BY type ORDER BY p, v) AS rn FROM p),
a AS (SELECT *, least(min(q) OVER (PARTITION BY type ORDER BY rn DESC ROWS UNBOUNDED PRECEDING), 1) AS padj FROM b), o AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY padj, p, v) AS rank FROM a)
SELECT type, v AS var, round(h, 4) AS h, round(p, 5) AS p, round(padj, 5) AS padj, rank FROM o WHERE rank <= 15""")
def region_features(spark, sf):
    out = markers.region_features(_x(spark, sf), _typed(spark, sf), 4, 15)
    return out.select("type", "var", _r("h", 4).alias("h"), _r("p", 5).alias("p"), _r("padj", 5).alias("padj"), "rank")


@query(f"WITH {TYPED}, m AS (SELECT type, v, g, avg(value) AS mean, bool_or(value <> 0) AS has FROM (SELECT d.type, d.v, d.g, d.value FROM dense d JOIN size USING (type, g)) GROUP BY 1, 2, 3), e AS (SELECT *, avg(mean) OVER w AS c, stddev_pop(mean) OVER w AS sd, bool_or(has) OVER w AS present FROM m WINDOW w AS (PARTITION BY type, v)) SELECT type, v AS var, g AS grp, round(mean, 5) AS mean, round(CASE WHEN sd > 1e-12 THEN (mean - c) / sd ELSE 0 END, 4) AS z FROM e WHERE present")
def region_means(spark, sf):
    return markers.region_means(_x(spark, sf), _typed(spark, sf), 4).select("type", "var", "grp", _r("mean", 5).alias("mean"), _r("z", 4).alias("z"))


@query(f"""WITH n AS (SELECT r_name AS a, c_mktsegment AS b, count(*) AS n FROM {REG} GROUP BY 1, 2), t AS (SELECT sum(n) AS t FROM n), ra AS (SELECT a, sum(n) AS na FROM n GROUP BY 1), rb AS (SELECT b, sum(n) AS nb FROM n GROUP BY 1),
g AS (SELECT coalesce(n, 0) AS o, na * nb / t AS e FROM ra CROSS JOIN rb CROSS JOIN t LEFT JOIN n ON n.a = ra.a AND n.b = rb.b), h AS (SELECT sum((o - e) * (o - e) / e) / 2 AS h FROM g)
SELECT round(exp(-h) * (1 + h + h ** 2 / 2 + h ** 3 / 6 + h ** 4 / 24 + h ** 5 / 120 + h ** 6 / 720 + h ** 7 / 5040), 6) AS p FROM h""")
def region_chi_square_p(spark, sf):
    return tables.chi_square(_regions(spark, sf), "r_name", "c_mktsegment").select(_r("p").alias("p"))


# Aggregates, filters, scores.


@query(f"""WITH {XN}, s AS (SELECT g, v, sum(value) AS a, avg(value) AS b, var_samp(value) AS c, count(*) FILTER (value <> 0) AS d FROM dense GROUP BY 1, 2 HAVING count(*) FILTER (value <> 0) > 0)
SELECT g AS grp, v AS var, func, round(value, 5) AS value FROM (SELECT g, v, 'sum' AS func, a AS value FROM s UNION ALL SELECT g, v, 'mean', b FROM s UNION ALL SELECT g, v, 'var', c FROM s UNION ALL SELECT g, v, 'count_nonzero', d FROM s)""")
def aggregate_groups(spark, sf):
    x, obs = _x(spark, sf), _obs(spark, sf)
    parts = [markers.aggregate(x, obs, f).select("grp", "var", F.lit(f).alias("func"), _r("value", 5).alias("value")) for f in ("sum", "mean", "var", "count_nonzero")]
    return reduce(DataFrame.unionByName, parts)


@query(f"WITH {XN}, k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY value DESC, v) AS rn FROM xn) SELECT r AS row, round(100 * sum(value) FILTER (rn <= 1) / sum(value), 6) AS pct_1, round(100 * sum(value) FILTER (rn <= 5) / sum(value), 6) AS pct_5, round(100 * sum(value) FILTER (rn <= 20) / sum(value), 6) AS pct_20 FROM k GROUP BY 1")
def top_shares(spark, sf):
    return markers.top_shares(_x(spark, sf), [1, 5, 20]).select("row", *(_r(f"pct_{k}").alias(f"pct_{k}") for k in (1, 5, 20)))


@query(f"WITH {XN}, t AS (SELECT r, sum(value) AS t, count(*) FILTER (value > 0) AS n FROM dense GROUP BY 1) SELECT r AS row FROM t WHERE t BETWEEN 500 AND 1500 AND n BETWEEN 10 AND 40")
def filter_cells_bounds(spark, sf):
    return markers.kept_rows(_x(spark, sf), _obs(spark, sf), 500, 1500, 10, 40).select("row")


@query(f"WITH {XN}, t AS (SELECT v, sum(value) AS t, count(*) AS n, median(count(*)) OVER () AS mn, median(sum(value)) OVER () AS mt FROM xn GROUP BY 1) SELECT v AS var FROM t WHERE n >= 20 AND t <= 100000")
def filter_genes_bounds(spark, sf):
    return markers.kept_vars(_x(spark, sf), least_rows=20, most_total=100_000)


GENES = ["cold widget", "small widget", "large bolt"]
LISTED = "(" + ", ".join(f"'{g}'" for g in GENES) + ")"


def _score_sql(listed: str, size: int) -> str:
    return f"""m AS (SELECT v, sum(value) / (SELECT count(*) FROM customer) AS mean FROM xn GROUP BY 1), bn AS (SELECT v, CAST(floor((rank() OVER (ORDER BY mean) - 1) * 25 / (SELECT count(*) FROM m)) AS INT) AS bin FROM m),
c AS (SELECT v FROM (SELECT v, row_number() OVER (PARTITION BY bin ORDER BY md5(concat_ws('|', 0, v)), v) AS k FROM bn WHERE v NOT IN {listed} AND bin IN (SELECT bin FROM bn WHERE v IN {listed})) WHERE k <= {size}),
sc AS (SELECT r, coalesce(avg(value) FILTER (v IN {listed}), 0) - coalesce(avg(value) FILTER (v IN (SELECT v FROM c)), 0) AS score FROM dense GROUP BY 1)"""


@query(f"WITH {XN}, {_score_sql(LISTED, 3)} SELECT r AS row, round(score, 5) AS score FROM sc")
def gene_scores(spark, sf):
    return markers.gene_score(_x(spark, sf), _obs(spark, sf), GENES, ctrl_size=3).withColumn("score", _r("score", 5))


G2M = ["hot widget", "cold bolt", "small bolt"]


def _renamed(sql: str, mark: str) -> str:
    out = sql
    for name in ("m", "bn", "c", "sc"):
        out = out.replace(f"{name} AS (", f"{name}{mark} AS (").replace(f"FROM {name} ", f"FROM {name}{mark} ").replace(f"FROM {name})", f"FROM {name}{mark})")
    return out


@query(f"WITH {XN}, {_renamed(_score_sql(LISTED, 3), '1')}, {_renamed(_score_sql('(' + ', '.join(repr(g) for g in G2M) + ')', 3), '2')} SELECT r AS row, round(sc1.score, 5) AS s_score, round(sc2.score, 5) AS g2m_score, CASE WHEN greatest(sc1.score, sc2.score) <= 1e-9 THEN 'G1' WHEN sc2.score > sc1.score THEN 'G2M' ELSE 'S' END AS phase FROM sc1 JOIN sc2 USING (r)")
def cell_cycle_phases(spark, sf):
    out = markers.cell_cycle(_x(spark, sf), _obs(spark, sf), GENES, G2M)
    return out.select("row", _r("s_score", 5).alias("s_score"), _r("g2m_score", 5).alias("g2m_score"), "phase")


@query(f"""WITH {XN}, d AS (SELECT v, avg(value) AS mean, var_samp(value) / avg(value) AS d FROM dense GROUP BY 1), b AS (SELECT *, CAST(floor((row_number() OVER (ORDER BY mean, v) - 1) * 8 / (SELECT count(*) FROM d)) AS INT) AS b FROM d),
e AS (SELECT *, d - median(d) OVER (PARTITION BY b) AS e FROM b), s AS (SELECT v, CASE WHEN median(abs(e)) OVER (PARTITION BY b) > 0 THEN e / median(abs(e)) OVER (PARTITION BY b) ELSE 0 END AS score FROM e)
SELECT v AS var, round(score, 5) AS score, row_number() OVER (ORDER BY score DESC, v) AS rank FROM s ORDER BY s.score DESC, v LIMIT 20""")
def hvg_cell_ranger(spark, sf):
    x = _x(spark, sf)
    return markers.variable_cell_ranger(x, _t(spark, sf, "customer").count(), 20, 8).select("var", _r("score", 5).alias("score"), "rank")


@query(f"WITH {XN}, f AS (SELECT v, regr_slope(value, c_acctbal) AS a, regr_intercept(value, c_acctbal) AS b FROM dense GROUP BY 1) SELECT r AS row, v AS var, round(value - b - a * c_acctbal, 4) AS value FROM dense JOIN f USING (v)")
def regressed_out(spark, sf):
    obs = _t(spark, sf, "customer").select(F.col("c_custkey").alias("row"), "c_acctbal")
    return markers.regress_out(_x(spark, sf), obs, ["c_acctbal"]).withColumn("value", _r("value", 4))


# Graph tests.

COMPONENTS = "xv AS (SELECT vec_id AS r, CAST(k - 1 AS INT) AS v, CAST(embedding[k] AS DOUBLE) AS value FROM embeddings, range(1, 65) t(k))"


@query(f"""WITH {KNN}, {COMPONENTS}, q AS (SELECT v, count(*)::DOUBLE AS n, avg(value) AS mean, sum(value * value) - count(*) * avg(value) * avg(value) AS ss FROM xv GROUP BY 1),
w AS (SELECT count(*)::DOUBLE AS w, count(*) + (SELECT count(*) FROM e a JOIN e b ON a.i = b.j AND a.j = b.i) AS s1 FROM e), dg AS (SELECT id, count(*) AS d FROM (SELECT i AS id FROM e UNION ALL SELECT j FROM e) GROUP BY 1), s2 AS (SELECT sum(d * d) AS s2 FROM dg),
c AS (SELECT a.v, sum((a.value - mean) * (b.value - mean)) AS c, sum((a.value - b.value) * (a.value - b.value)) AS g FROM e JOIN xv a ON a.r = e.i JOIN xv b ON b.r = e.j AND a.v = b.v JOIN q ON q.v = a.v GROUP BY 1),
m AS (SELECT v, n / w * c / ss AS mi, (n - 1) / (2 * w) * g / ss AS gc, (n * n * s1 - n * s2 + 3 * w * w) / ((n * n - 1) * w * w) - 1 / ((n - 1) * (n - 1)) AS vm, ((2 * s1 + s2) * (n - 1) - 4 * w * w) / (2 * (n + 1) * w * w) AS vg, n FROM q JOIN c USING (v), w, s2)
SELECT v AS var, round(mi, 5) AS moran_i, round({_tail('((mi + 1 / (n - 1)) / sqrt(vm))')}, 4) AS moran_p, round(gc, 5) AS geary_c, round({_tail('((gc - 1) / sqrt(vg))')}, 4) AS geary_p FROM m""")
def autocorrelation_genes(spark, sf):
    e = _t(spark, sf, "embeddings")
    x = e.select(F.col("vec_id").alias("row"), F.posexplode("embedding").alias("var", "value")).withColumn("value", F.col("value").cast("double")).where("value <> 0")
    out = markers.spatial_autocorrelation(x, e.select(F.col("vec_id").alias("row")), _graph(spark, sf).select("i", "j"))
    return out.select("var", _r("moran_i", 5).alias("moran_i"), _r("moran_p", 4).alias("moran_p"), _r("geary_c", 5).alias("geary_c"), _r("geary_p", 4).alias("geary_p"))


PAIRS = [("cold widget", "small widget"), ("large bolt", "cold bolt"), ("cold bolt", "cold widget")]
PAIRS_SQL = "pr(ligand, receptor) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in PAIRS) + ")"


@query(f"""WITH {XN}, {PAIRS_SQL}, ob AS (SELECT c_custkey AS id, c_mktsegment AS label, 0 AS lib FROM customer), k AS (SELECT id, label, lib, q AS perm, md5(concat_ws('|', 0, q, id)) AS k FROM ob, range(5) t(q)),
rk AS (SELECT perm, lib, id, label, row_number() OVER (PARTITION BY perm, lib ORDER BY id) AS r, row_number() OVER (PARTITION BY perm, lib ORDER BY k, id) AS s FROM k),
lb AS (SELECT a.perm, a.id, b.label FROM rk a JOIN rk b ON a.perm = b.perm AND a.lib = b.lib AND a.r = b.s UNION ALL SELECT -1, id, label FROM ob), sz AS (SELECT label, count(*) AS n FROM ob GROUP BY 1),
mn AS (SELECT perm, lb.label, v, sum(value) / any_value(n) AS mean FROM xn JOIN lb ON lb.id = xn.r JOIN sz ON sz.label = lb.label GROUP BY 1, 2, 3),
sc AS (SELECT a.perm, ligand, receptor, a.label AS source, b.label AS target, (a.mean + b.mean) / 2 AS score FROM pr JOIN mn a ON a.v = ligand JOIN mn b ON b.v = receptor AND a.perm = b.perm WHERE a.mean > 0 AND b.mean > 0)
SELECT o.ligand, o.receptor, o.source, o.target, round(o.score, 5) AS score, count(*) FILTER (c.score >= o.score - 1e-12) / 5 AS p FROM sc o LEFT JOIN sc c ON c.perm >= 0 AND c.ligand = o.ligand AND c.receptor = o.receptor AND c.source = o.source AND c.target = o.target WHERE o.perm = -1 GROUP BY ALL""")
def ligand_receptor_test(spark, sf):
    pairs = spark.createDataFrame(PAIRS, "ligand string, receptor string")
    out = markers.ligand_receptor_test(_x(spark, sf), _obs(spark, sf).withColumn("lib", F.lit(0)), pairs, 5)
    return out.withColumn("score", _r("score", 5))

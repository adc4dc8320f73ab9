"""Queries of the engine over the star-schema tables, each with an independent SQL statement where SQL has one.

Cells are `embeddings` (place: the first two components, type: label, library: vec_id mod 4) or `orders` and `customer`
rows; genes are `part`; counts are sums of l_quantity.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import expression as ex
from tessera.operators import graph, leiden, regions, spatial, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _points(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("embedding")
    return _t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), e[0].cast("double").alias("x"), e[1].cast("double").alias("y"), "label", (F.col("vec_id") % 4).alias("lib"))


def _counts(spark: SparkSession, sf: str) -> DataFrame:
    li = _t(spark, sf, "lineitem")
    return li.groupBy(F.col("l_orderkey").alias("row"), F.col("l_partkey").alias("var")).agg(F.sum("l_quantity").alias("value"))


def _r(c: str | Column, n: int = 6) -> Column:
    return F.round(c, n)


P = "p AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, label, vec_id % 4 AS lib FROM embeddings)"
D = "sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))"
KNN = P + f""", e AS (SELECT i, j, d, rk, li, lj FROM (SELECT a.id AS i, b.id AS j, {D} AS d, a.label AS li, b.label AS lj,
 row_number() OVER (PARTITION BY a.id ORDER BY {D}, b.id) AS rk FROM p a JOIN p b ON a.lib = b.lib AND a.id <> b.id) WHERE rk <= 6)"""
X = "x AS (SELECT l_orderkey AS r, l_partkey AS v, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2)"
RING = [(-0.2, -0.2), (0.2, -0.15), (0.05, 0.0), (0.2, 0.2), (-0.15, 0.15)]
RADIUS = 0.05


def _graph(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.knn(_points(spark, sf), 6)


@query("WITH " + P + f""", e AS (SELECT a.id AS i, b.label AS label, row_number() OVER (PARTITION BY a.id ORDER BY {D}, b.id) AS rk FROM p a JOIN p b ON a.lib = b.lib),
n AS (SELECT i, label, count(*) AS n FROM e WHERE rk <= 20 GROUP BY 1, 2)
SELECT i, label, round(n / sum(n) OVER (PARTITION BY i), 6) AS proportion FROM n""")
def neighborhood_composition(spark, sf):
    out = spatial.composition(spatial.knn(_points(spark, sf), 20, include_self=True))
    return out.select("i", "label", _r("proportion").alias("proportion"))


@query("WITH " + KNN + " SELECT i, j, rk, round(d, 6) AS d FROM e")
def spatial_knn_graph(spark, sf):
    return _graph(spark, sf).select("i", "j", "rk", _r("d").alias("d"))


@query("WITH " + P + f" SELECT a.id AS i, b.id AS j, round({D}, 6) AS d FROM p a JOIN p b ON a.lib = b.lib AND a.id <> b.id WHERE {D} <= {RADIUS}")
def spatial_radius_graph(spark, sf):
    p = _points(spark, sf)
    return spatial.pairs_within(p, p, RADIUS).select("i", "j", _r("d").alias("d"))


@query("""WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
e AS (SELECT a.id AS i, b.id AS j, list_distance(a.v, b.v) AS d FROM v a JOIN v b ON a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rk FROM e) SELECT i, j, rk, round(d, 6) AS d FROM r WHERE rk <= 5""")
def embedding_knn64(spark, sf):
    df = _t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return spatial.knn_vectors(df, 5).select("i", "j", "rk", _r("d").alias("d"))


@query("WITH " + KNN + " SELECT li, lj, count(*) AS n FROM e GROUP BY 1, 2")
def interaction_matrix(spark, sf):
    return spatial.interaction(_graph(spark, sf))


@query("WITH " + KNN + ", n AS (SELECT li, lj, count(*) AS n FROM e GROUP BY 1, 2) SELECT li, lj, round(n / sum(n) OVER (PARTITION BY li), 6) AS share FROM n")
def interaction_matrix_normalized(spark, sf):
    return spatial.interaction(_graph(spark, sf), normalized=True).select("li", "lj", _r("share").alias("share"))


@query("WITH " + KNN + """, k AS (SELECT id, label, lib, q AS perm, md5(concat_ws('|', 0, q, id)) AS k FROM p, range(10) t(q)),
r AS (SELECT perm, lib, id, label, row_number() OVER (PARTITION BY perm, lib ORDER BY id) AS r, row_number() OVER (PARTITION BY perm, lib ORDER BY k, id) AS s FROM k),
m AS (SELECT a.perm, a.id, b.label FROM r a JOIN r b ON a.perm = b.perm AND a.lib = b.lib AND a.r = b.s),
c AS (SELECT a.perm, a.label AS li, b.label AS lj, count(*) AS n FROM e JOIN m a ON e.i = a.id JOIN m b ON e.j = b.id AND a.perm = b.perm GROUP BY 1, 2, 3),
s AS (SELECT li, lj, sum(n) AS s1, sum(n * n) AS s2 FROM c GROUP BY 1, 2), o AS (SELECT li, lj, count(*) AS n FROM e GROUP BY 1, 2),
z AS (SELECT o.li, o.lj, o.n AS observed, coalesce(s1, 0) / 10.0::DOUBLE AS mean, sqrt(greatest(coalesce(s2, 0) / 10.0::DOUBLE - (coalesce(s1, 0) / 10.0::DOUBLE) * (coalesce(s1, 0) / 10.0::DOUBLE), 0)) AS sd
 FROM o LEFT JOIN s ON o.li = s.li AND o.lj = s.lj)
SELECT li, lj, observed, round(mean, 6) AS mean, round(sd, 6) AS sd, CASE WHEN sd > 0 THEN round((observed - mean) / sd, 5) END AS z FROM z""")
def nhood_enrichment_md5(spark, sf):
    out = spatial.nhood_enrichment(_graph(spark, sf), _points(spark, sf), 10)
    return out.select("li", "lj", "observed", _r("mean").alias("mean"), _r("sd").alias("sd"), _r("z", 5).alias("z"))


AUTO = "WITH " + KNN + """, v AS (SELECT vec_id AS id, CAST(embedding[3] AS DOUBLE) AS val FROM embeddings), m AS (SELECT count(*) AS n, avg(val) AS mean, var_pop(val) AS var FROM v),
s AS (SELECT count(*) AS w, sum((a.val - mean) * (b.val - mean)) AS c, sum((a.val - b.val) * (a.val - b.val)) AS g FROM e JOIN v a ON e.i = a.id JOIN v b ON e.j = b.id, m) """


def _auto(spark, sf):
    v = _t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding")[2].cast("double").alias("value"))
    return spatial.autocorrelation(_graph(spark, sf), v)


@query(AUTO + "SELECT round(n / w * c / (n * var), 6) AS moran_i FROM s, m")
def moran_i(spark, sf):
    return _auto(spark, sf).select(_r("moran_i").alias("moran_i"))


@query(AUTO + "SELECT round((n - 1) / (2 * w) * g / (n * var), 6) AS geary_c FROM s, m")
def geary_c(spark, sf):
    return _auto(spark, sf).select(_r("geary_c").alias("geary_c"))


@query("WITH " + P + f""", q AS (SELECT a.label AS li, b.label AS lj, {D} AS d FROM p a JOIN p b ON a.lib = b.lib AND a.id <> b.id),
n AS (SELECT li, lj, CAST(CASE WHEN d <= 0.05 THEN 0 ELSE 1 END AS BIGINT) AS bin, count(*) AS n FROM q WHERE d > 0.0 AND d <= 0.1 GROUP BY 1, 2, 3)
SELECT li, lj, bin, n, round((n / sum(n) OVER (PARTITION BY bin, li)) / (sum(n) OVER (PARTITION BY bin, lj) / sum(n) OVER (PARTITION BY bin)), 6) AS ratio FROM n""")
def co_occurrence(spark, sf):
    return spatial.co_occurrence(_points(spark, sf), [0.0, 0.05, 0.1]).select("li", "lj", "bin", "n", _r("ratio").alias("ratio"))


@query("WITH " + P + f""", q AS (SELECT a.label, {D} AS d FROM p a JOIN p b ON a.lib = b.lib AND a.id <> b.id AND a.label = b.label),
g AS (SELECT label, count(*) AS n FROM p GROUP BY 1), r AS (SELECT unnest([0.05::DOUBLE, 0.1::DOUBLE]) AS r), a AS (SELECT (max(x) - min(x)) * (max(y) - min(y)) AS area FROM p),
c AS (SELECT g.label, r.r, n, area, (SELECT count(*) FROM q WHERE q.label = g.label AND q.d <= r.r) AS pairs FROM g, r, a)
SELECT label, r, pairs, CASE WHEN n > 1 THEN round(sqrt(area * pairs / (n * (n - 1)) / pi()), 6) END AS l FROM c""")
def ripley_l_counts(spark, sf):
    return spatial.ripley(_points(spark, sf), [0.05, 0.1]).select("label", "r", "pairs", _r("l").alias("l"))


NEAR = "WITH " + P + f", t AS (SELECT a.id AS i, a.label AS li, b.label AS lj, min({D}) AS d FROM p a JOIN p b ON a.lib = b.lib AND a.label <> b.label GROUP BY 1, 2, 3) "


@query(NEAR + "SELECT i, li, lj, round(d, 6) AS d FROM t")
def nearest_type_distance(spark, sf):
    return spatial.nearest_type(_points(spark, sf)).select("i", "li", "lj", _r("d").alias("d"))


@query(NEAR + "SELECT li, lj, round(quantile_cont(d, 0.5), 6) AS median_d, round(avg(d), 6) AS mean_d FROM t GROUP BY 1, 2")
def proximity_distances(spark, sf):
    return spatial.proximity(_points(spark, sf)).select("li", "lj", _r("median_d").alias("median_d"), _r("mean_d").alias("mean_d"))


BOUNDARY = "WITH " + P + f""", f AS (SELECT a.id, count(*) AS n, sum(CASE WHEN b.label IN (0, 1, 2, 3) THEN 1 ELSE 0 END) / count(*) AS s, any_value(a.label) AS label FROM p a JOIN p b ON a.lib = b.lib AND {D} <= 0.08 GROUP BY 1) """


@query(BOUNDARY + "SELECT id, round(s, 6) AS insideness, CASE WHEN s > 0.65 THEN 'core' WHEN s < 0.35 THEN 'stroma' ELSE 'margin' END AS compartment FROM f")
def soft_boundary(spark, sf):
    return spatial.soft_boundary(_points(spark, sf), [0, 1, 2, 3], 0.08).select("id", _r("insideness").alias("insideness"), "compartment")


@query(BOUNDARY + """, r AS (SELECT min(s) AS lo, max(s) AS hi FROM f)
SELECT CAST(CASE WHEN hi > lo THEN least(floor((s - lo) / (hi - lo) * 5), 4) ELSE 0 END AS BIGINT) AS bin, count(*) AS n, round(avg(CASE WHEN label = 5 THEN 1.0::DOUBLE ELSE 0 END), 6) AS fraction FROM f, r GROUP BY 1""")
def infiltration_profile(spark, sf):
    p = _points(spark, sf)
    b = spatial.soft_boundary(p, [0, 1, 2, 3], 0.08).join(p.select("id", "label"), "id")
    return spatial.infiltration(b, "insideness", F.col("label") == 5, 5).select("bin", "n", _r("fraction").alias("fraction"))


def _ring_sql() -> str:
    parts = []
    for (x1, y1), (x2, y2) in zip(RING, [*RING[1:], RING[0]]):
        if y1 != y2:
            parts.append(f"CASE WHEN (({y1} > y) <> ({y2} > y)) AND x < ({x2} - {x1}) * (y - {y1}) / ({y2} - {y1}) + {x1} THEN 1 ELSE 0 END")
    return "(" + " + ".join(parts) + ") % 2 = 1"


@query("WITH " + P + " SELECT id, label FROM p WHERE " + _ring_sql())
def points_in_polygon(spark, sf):
    return _points(spark, sf).where(spatial.in_polygons(F.col("x"), F.col("y"), [RING])).select("id", "label")


@query("WITH " + P + " SELECT id, label FROM p WHERE NOT " + _ring_sql())
def points_outside_polygon(spark, sf):
    return _points(spark, sf).where(~spatial.in_polygons(F.col("x"), F.col("y"), [RING])).select("id", "label")


@query("WITH " + P + " SELECT id, label FROM p WHERE x BETWEEN -0.1 AND 0.1 AND y BETWEEN -0.05 AND 0.2")
def bbox_range(spark, sf):
    return spatial.bbox_query(_points(spark, sf), (-0.1, -0.05, 0.1, 0.2)).select("id", "label")


@query("WITH " + P + ", h AS (SELECT id, label FROM p WHERE x BETWEEN -0.1 AND 0.1 AND y BETWEEN -0.05 AND 0.2) SELECT id, label FROM h WHERE (SELECT count(*) FROM h) <= 10")
def bbox_all_or_nothing(spark, sf):
    return spatial.bbox_query(_points(spark, sf), (-0.1, -0.05, 0.1, 0.2), limit=10).select("id", "label")


@query("WITH " + P + """ SELECT id, wx, wy FROM (SELECT id, unnest(range(CAST(floor((x - 0.1) / 0.05) + 1 AS BIGINT), CAST(floor(x / 0.05) + 1 AS BIGINT))) AS wx, y FROM p) a,
 LATERAL (SELECT unnest(range(CAST(floor((y - 0.1) / 0.05) + 1 AS BIGINT), CAST(floor(y / 0.05) + 1 AS BIGINT))) AS wy) b""")
def sliding_window_tiles(spark, sf):
    return spatial.sliding_window(_points(spark, sf), 0.1, 0.05)


@query("WITH " + KNN + """, n AS (SELECT li, lj, count(*) AS n FROM e WHERE li <> lj GROUP BY 1, 2), g AS (SELECT li, count(*) AS deg FROM e GROUP BY 1)
SELECT n.li, n.lj, n, round(least(n * (SELECT count(*) FROM e) / (a.deg * b.deg), 1.0::DOUBLE), 6) AS connectivity FROM n JOIN g a ON a.li = n.li JOIN g b ON b.li = n.lj""")
def paga_connectivity(spark, sf):
    return spatial.paga(_graph(spark, sf)).select("li", "lj", "n", _r("connectivity").alias("connectivity"))


@query("WITH " + KNN + """, o AS (SELECT li, count(DISTINCT j) AS o FROM e WHERE li <> lj GROUP BY 1), s AS (SELECT li, count(DISTINCT i) AS n FROM e GROUP BY 1)
SELECT s.li AS label, round(coalesce(o, 0) / ((SELECT count(DISTINCT i) FROM e) - n), 6) AS degree FROM s LEFT JOIN o ON o.li = s.li""")
def group_centrality(spark, sf):
    return spatial.centrality(_graph(spark, sf)).select("label", _r("degree").alias("degree"))


# Regions, fields, pages.


def _regions(spark, sf):
    c, n, r = _t(spark, sf, "customer"), _t(spark, sf, "nation"), _t(spark, sf, "region")
    return c.join(F.broadcast(n.join(r, n.n_regionkey == r.r_regionkey)), c.c_nationkey == n.n_nationkey)  # 25 rows


REG = "customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


@query(f"WITH n AS (SELECT r_name, c_mktsegment, count(*) AS n FROM {REG} GROUP BY 1, 2) SELECT *, round(n / sum(n) OVER (PARTITION BY r_name), 6) AS proportion FROM n")
def region_crosstab(spark, sf):
    return tables.crosstab(_regions(spark, sf), "r_name", "c_mktsegment").withColumn("proportion", _r("proportion"))


@query(f"""WITH n AS (SELECT r_name AS a, c_mktsegment AS b, count(*) AS n FROM {REG} GROUP BY 1, 2), t AS (SELECT sum(n) AS t FROM n), ra AS (SELECT a, sum(n) AS na FROM n GROUP BY 1), rb AS (SELECT b, sum(n) AS nb FROM n GROUP BY 1),
g AS (SELECT coalesce(n, 0) AS o, na * nb / t AS e FROM ra CROSS JOIN rb CROSS JOIN t LEFT JOIN n ON n.a = ra.a AND n.b = rb.b)
SELECT round(sum((o - e) * (o - e) / e), 6) AS chi2, ((SELECT count(*) FROM ra) - 1) * ((SELECT count(*) FROM rb) - 1) AS dof FROM g""")
def region_chi_square(spark, sf):
    return tables.chi_square(_regions(spark, sf), "r_name", "c_mktsegment").select(_r("chi2").alias("chi2"), "dof")


@query("SELECT c_mktsegment AS value, count(*) AS n FROM customer GROUP BY 1")
def obs_value_counts(spark, sf):
    return tables.value_counts(_t(spark, sf, "customer"), "c_mktsegment")


@query("SELECT min(c_acctbal) AS min, max(c_acctbal) AS max, round(avg(c_acctbal), 6) AS mean, round(quantile_cont(c_acctbal, 0.5), 6) AS median, count(*) FILTER (c_acctbal IS NULL) AS n_missing FROM customer")
def obs_numeric_summary(spark, sf):
    return tables.numeric_summary(_t(spark, sf, "customer"), "c_acctbal").withColumns({"mean": _r("mean"), "median": _r("median")})


@query(f"SELECT c_mktsegment, count(*) FILTER (r_name IN ('ASIA', 'EUROPE')) AS n_inside, count(*) AS n_all, round(avg(c_acctbal) FILTER (r_name IN ('ASIA', 'EUROPE')), 6) AS mean_inside, round(avg(c_acctbal) FILTER (r_name NOT IN ('ASIA', 'EUROPE')), 6) AS mean_outside FROM {REG} GROUP BY 1")
def selection_stats(spark, sf):
    out = tables.selection_stats(_regions(spark, sf), F.col("r_name").isin("ASIA", "EUROPE"), "c_mktsegment", "c_acctbal")
    return out.withColumns({"mean_inside": _r("mean_inside"), "mean_outside": _r("mean_outside")})


@query("SELECT c_custkey, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS code FROM customer")
def categorical_codes(spark, sf):
    return tables.categorical_codes(_t(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment").select("c_custkey", "code")


@query("SELECT p_partkey, CAST(floor((p_retailprice - lo) / (hi - lo) * 255) AS BIGINT) AS bucket FROM part, (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part)")
def color_buckets(spark, sf):
    return tables.color_buckets(_t(spark, sf, "part").select("p_partkey", "p_retailprice"), "p_retailprice").select("p_partkey", "bucket")


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100")
def table_page(spark, sf):
    return tables.page(_t(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), "o_orderkey", 100, 50)


@query("SELECT p_partkey, p_name, CAST(CASE WHEN lower(p_name) LIKE 're%' THEN 0 ELSE 1 END AS BIGINT) AS tier FROM part WHERE lower(p_name) LIKE '%re%' ORDER BY tier, p_partkey LIMIT 50")
def gene_search_ranked(spark, sf):
    return tables.search(_t(spark, sf, "part"), "p_name", "p_partkey", "RE")


@query("SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'high' WHEN '2-HIGH' THEN 'high' WHEN '5-LOW' THEN 'low' ELSE o_orderpriority END AS o_orderpriority FROM orders")
def recode_categories(spark, sf):
    return tables.recode(_t(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", {"1-URGENT": "high", "2-HIGH": "high", "5-LOW": "low", "": "x"})


@query("WITH " + P + " SELECT id, CASE WHEN " + _ring_sql() + " THEN 'core_a' ELSE 'unassigned' END AS region FROM p")
def annotate_region(spark, sf):
    p = _points(spark, sf)
    return tables.annotate(p, spatial.in_polygons(F.col("x"), F.col("y"), [RING]), "region", "core_a").select("id", "region")


@query("WITH " + P + " SELECT id, round(2.0 * x - 0.5 * y + 3, 6) AS x, round(0.5 * x + 2.0 * y - 1, 6) AS y FROM p")
def affine_projection(spark, sf):
    x, y = tables.affine(F.col("x"), F.col("y"), (2.0, -0.5, 3.0, 0.5, 2.0, -1.0))
    return _points(spark, sf).select("id", _r(x).alias("x"), _r(y).alias("y"))


@query("""WITH l AS (SELECT o_orderkey, 'Customer#' || o_custkey AS label FROM orders), a AS (SELECT c_name AS label, min(c_custkey) AS a FROM customer GROUP BY 1), b AS (SELECT 'Customer#' || c_custkey AS label, min(c_custkey) AS b FROM customer GROUP BY 1)
SELECT o_orderkey, coalesce(a, b, -1) AS pos FROM l LEFT JOIN a USING (label) LEFT JOIN b USING (label)""")
def label_to_row_lookup(spark, sf):
    labels = _t(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("Customer#"), "o_custkey").alias("label"))
    rows = _t(spark, sf, "customer").select("c_name", F.concat(F.lit("Customer#"), "c_custkey").alias("alias"), "c_custkey")
    return tables.lookup(labels, rows, "label", "c_name", "alias", "c_custkey").select("o_orderkey", "pos")


@query("SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)")
def stray_region_antijoin(spark, sf):
    known = _t(spark, sf, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("c_nationkey"))
    return _t(spark, sf, "customer").join(known, "c_nationkey", "left_anti").select("c_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def semi_subset(spark, sf):
    keep = _t(spark, sf, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return _t(spark, sf, "orders").join(keep, "o_custkey", "left_semi").select("o_orderkey")


@query("SELECT page_id, CASE WHEN url LIKE 'https://m.%' THEN 'mobile' WHEN url LIKE '%.html' THEN 'page' END AS type FROM pages")
def discover_types(spark, sf):
    return tables.classify(_t(spark, sf, "pages"), "url", {"mobile": "https://m.*", "page": "*.html"}).select("page_id", "type")


HIST = "h AS (SELECT event_id AS seq, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END AS status, unnest([event_type, 'user:' || user_id]) AS field FROM events)"


def _history(spark, sf):
    fields = F.array("event_type", F.concat(F.lit("user:"), "user_id"))
    return _t(spark, sf, "events").select(F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "failed").otherwise("completed").alias("status"), fields.alias("fields"))


@query(f"WITH {HIST} SELECT field, count(*) AS version FROM h WHERE status = 'completed' GROUP BY 1")
def field_versions(spark, sf):
    return tables.field_versions(_history(spark, sf))


@query("WITH r AS (SELECT p_partkey AS plot, unnest(string_split(p_name, ' ')) AS field FROM part) SELECT DISTINCT plot FROM r WHERE field IN (SELECT regexp_extract(p_name, '^([^ ]*)', 1) FROM part WHERE p_size > 48)")
def invalidated_plots(spark, sf):
    part = _t(spark, sf, "part")
    plots = part.select(F.col("p_partkey").alias("plot"), F.split("p_name", " ").alias("refs"))
    return tables.invalidated(plots, part.where("p_size > 48").select(F.regexp_extract("p_name", "^([^ ]*)", 1).alias("field")))


@query("SELECT l_linenumber AS step, l_suppkey AS key FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_acctbal > 9000 AND s_nationkey % 7 >= l_linenumber UNION ALL SELECT l_linenumber, l_suppkey FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 9000)")
def preflight_unresolved(spark, sf):
    needed = _t(spark, sf, "lineitem").select(F.col("l_linenumber").alias("step"), F.col("l_suppkey").alias("key"))
    made = _t(spark, sf, "supplier").where("s_acctbal > 9000").select((F.col("s_nationkey") % 7).alias("step"), F.col("s_suppkey").alias("key"))
    return tables.unresolved(needed, made)


# Expression.


@query(f"WITH {X}, f AS (SELECT min(p_partkey) AS v FROM part WHERE p_name = (SELECT min(p_name) FROM part)) SELECT o_orderkey AS row, coalesce(value, 0) AS value FROM orders LEFT JOIN (SELECT r, value FROM x JOIN f USING (v)) h ON h.r = o_orderkey")
def gene_column_dense(spark, sf):
    part = _t(spark, sf, "part")
    gene = part.agg(F.min("p_name")).first()[0]
    obs = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("row"))
    return ex.dense_column(obs, _counts(spark, sf), part.select(F.col("p_partkey").alias("var"), F.col("p_name").alias("name")), gene)


@query(f"WITH {X}, k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY value DESC, v) AS rn FROM x) SELECT r AS row, sum(value) AS total, count(*) AS n_vars, round(100 * sum(value) FILTER (rn <= 2) / sum(value), 6) AS pct_top FROM k GROUP BY 1")
def qc_metrics(spark, sf):
    return ex.qc_metrics(_counts(spark, sf), 2).withColumn("pct_top", _r("pct_top"))


@query(f"WITH {X} SELECT r AS row, v AS var, value FROM x WHERE r IN (SELECT r FROM x GROUP BY 1 HAVING sum(value) >= 100 AND count(*) >= 3)")
def filter_cells(spark, sf):
    return ex.filter_rows(_counts(spark, sf), 100, 3)


@query(f"WITH {X} SELECT r AS row, v AS var, value FROM x WHERE v IN (SELECT v FROM x GROUP BY 1 HAVING count(*) >= 30)")
def filter_genes(spark, sf):
    return ex.filter_vars(_counts(spark, sf), 30)


@query(f"WITH {X}, t AS (SELECT r, sum(value) AS t FROM x GROUP BY 1) SELECT r AS row, v AS var, round(ln(1 + value * (SELECT quantile_cont(t, 0.5) FROM t) / t), 6) AS value FROM x JOIN t USING (r)")
def normalize_total_log1p(spark, sf):
    return ex.log1p(ex.normalize_total(_counts(spark, sf))).withColumn("value", _r("value"))


@query(f"WITH {X}, n AS (SELECT count(*) AS n FROM orders), m AS (SELECT v, sum(value) / any_value(n) AS mean, sqrt((sum(value * value) - sum(value) * sum(value) / any_value(n)) / (any_value(n) - 1)) AS sd FROM x, n GROUP BY 1) SELECT r AS row, v AS var, round(least((value - mean) / sd, 10), 5) AS z, round(-mean / sd, 5) AS z_zero FROM x JOIN m USING (v)")
def scale_clip(spark, sf):
    n = _t(spark, sf, "orders").count()
    return ex.scale(_counts(spark, sf), F.lit(n), 10.0).withColumns({"z": _r("z", 5), "z_zero": _r("z_zero", 5)})


@query(f"WITH {X}, n AS (SELECT count(*) AS n FROM orders), m AS (SELECT v AS var, sum(value) / any_value(n) AS mean, (sum(value * value) - sum(value) * sum(value) / any_value(n)) / (any_value(n) - 1) / (sum(value) / any_value(n)) AS dispersion FROM x, n GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY dispersion DESC, var) AS rank FROM m) SELECT var, round(mean, 6) AS mean, round(dispersion, 5) AS dispersion, rank FROM k WHERE rank <= 50")
def hvg_dispersion(spark, sf):
    n = _t(spark, sf, "orders").count()
    return ex.dispersion(_counts(spark, sf), F.lit(n), 50).withColumns({"mean": _r("mean"), "dispersion": _r("dispersion", 5)})


def _obs(spark, sf):
    o, c = _t(spark, sf, "orders"), _t(spark, sf, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select(F.col("o_orderkey").alias("row"), F.col("c_nationkey").alias("sample"), F.col("o_orderstatus").alias("grp"))


OBS = "o AS (SELECT o_orderkey AS r, c_nationkey AS sample, o_orderstatus AS grp FROM orders JOIN customer ON o_custkey = c_custkey)"


@query(f"WITH {X}, {OBS}, s AS (SELECT sample, grp FROM o GROUP BY 1, 2 HAVING count(*) >= 10), u AS (SELECT sample, grp, v AS var, sum(value) AS value FROM x JOIN o USING (r) JOIN s USING (sample, grp) GROUP BY 1, 2, 3) SELECT * FROM u WHERE var IN (SELECT var FROM u GROUP BY 1 HAVING sum(value) >= 10)")
def pseudobulk_counts(spark, sf):
    return ex.pseudobulk(_counts(spark, sf), _obs(spark, sf), ("sample", "grp")).select("sample", "grp", "var", "value")


@query("""WITH r AS (SELECT r_name, c_mktsegment AS g, c_acctbal AS v, count(*) OVER (PARTITION BY r_name, c_acctbal) AS ties, rank() OVER (PARTITION BY r_name ORDER BY c_acctbal) AS k FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
m AS (SELECT *, k + (ties - 1) / 2.0::DOUBLE AS mid FROM r), n AS (SELECT r_name, count(*)::DOUBLE AS n, sum(ties * ties - 1)::DOUBLE AS t FROM m GROUP BY 1), s AS (SELECT r_name, g, sum(mid) AS s, count(*) AS c FROM m GROUP BY 1, 2), q AS (SELECT r_name, sum(s * s / c) AS q, count(*) AS groups FROM s GROUP BY 1)
SELECT r_name, round((12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - t / (n * n * n - n)), 6) AS h, groups FROM n JOIN q USING (r_name)""")
def kruskal_by_region(spark, sf):
    return ex.kruskal(_regions(spark, sf), ["r_name"], "c_mktsegment", "c_acctbal").withColumn("h", _r("h"))


@query("""WITH r AS (SELECT r_name, c_mktsegment AS g, count(*) OVER (PARTITION BY r_name, c_acctbal) AS ties, rank() OVER (PARTITION BY r_name ORDER BY c_acctbal) AS k FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
n AS (SELECT r_name, count(*)::DOUBLE AS n FROM r GROUP BY 1), s AS (SELECT r_name, g, sum(k + (ties - 1) / 2.0::DOUBLE) AS s, count(*)::DOUBLE AS m FROM r GROUP BY 1, 2)
SELECT r_name, g AS c_mktsegment, round((s - m * (n + 1) / 2) / sqrt(m * (n - m) * (n + 1) / 12), 6) AS z FROM s JOIN n USING (r_name)""")
def rank_genes_wilcoxon(spark, sf):
    return ex.rank_wilcoxon(_regions(spark, sf), ["r_name"], "c_mktsegment", "c_acctbal").withColumn("z", _r("z"))


@query("""WITH p AS (SELECT p_partkey, p_size / 51.0::DOUBLE AS p FROM part), r AS (SELECT *, row_number() OVER (ORDER BY p, p_partkey) AS r, count(*) OVER () AS n FROM p)
SELECT p_partkey, round(least(min(p * n / r) OVER (ORDER BY r DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1), 6) AS padj FROM r""")
def bh_adjust(spark, sf):
    df = _t(spark, sf, "part").select("p_partkey", (F.col("p_size") / 51.0).alias("p"))
    return ex.bh_adjust(df, "p", "p_partkey").select("p_partkey", _r("padj").alias("padj"))


TT = f"""WITH {X}, {OBS}, z AS (SELECT grp, count(*)::DOUBLE AS n FROM o GROUP BY 1), nt AS (SELECT count(*)::DOUBLE AS nt FROM o), g AS (SELECT grp, v, count(*) AS nnz, sum(value) AS s1, sum(value * value) AS s2 FROM x JOIN o USING (r) GROUP BY 1, 2), a AS (SELECT v, sum(value) AS t1, sum(value * value) AS t2 FROM x GROUP BY 1)"""


@query(TT + """, j AS (SELECT grp, v AS var, n, nt - n AS m, s1 / n AS mi, (t1 - s1) / (nt - n) AS mo, s1, s2, t1 - s1 AS o1, t2 - s2 AS o2 FROM g JOIN z USING (grp) JOIN a USING (v), nt),
k AS (SELECT *, sqrt((s2 - s1 * mi) / (n - 1) / n + (o2 - o1 * mo) / (m - 1) / m) AS se FROM j) SELECT grp, var, round(mi, 6) AS mean_in, round(mo, 6) AS mean_out, CASE WHEN se > 0 THEN round((mi - mo) / se, 5) END AS t FROM k""")
def rank_genes_ttest(spark, sf):
    out = ex.rank_ttest(_counts(spark, sf), _obs(spark, sf).select("row", "grp"))
    return out.select("grp", "var", _r("mean_in").alias("mean_in"), _r("mean_out").alias("mean_out"), _r("t", 5).alias("t"))


@query(TT + " SELECT grp, v AS var, round(s1 / n, 6) AS mean, round(nnz / n, 6) AS fraction FROM g JOIN z USING (grp)")
def dotplot_data(spark, sf):
    return ex.dotplot(_counts(spark, sf), _obs(spark, sf).select("row", "grp")).withColumns({"mean": _r("mean"), "fraction": _r("fraction")})


@query(TT + ", d AS (SELECT grp, v, s1 / n AS mean FROM g JOIN z USING (grp)) SELECT a.v AS ligand, b.v AS receptor, a.grp AS source, b.grp AS target, round((a.mean + b.mean) / 2, 6) AS score FROM d a JOIN d b ON b.v = a.v + 1")
def ligrec_means(spark, sf):
    pairs = _t(spark, sf, "part").select(F.col("p_partkey").alias("ligand"), (F.col("p_partkey") + 1).alias("receptor"))
    return ex.ligrec(_counts(spark, sf), _obs(spark, sf).select("row", "grp"), pairs).withColumn("score", _r("score"))


@query(f"WITH {X}, g AS (SELECT r, sum(value) FILTER (v <= 10) AS a, sum(value) FILTER (v BETWEEN 11 AND 30) AS b FROM x GROUP BY 1) SELECT o_orderkey AS row, round(coalesce(a, 0) / 10 - coalesce(b, 0) / 20, 6) AS score FROM orders LEFT JOIN g ON r = o_orderkey")
def score_genes(spark, sf):
    obs = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("row"))
    v = F.col("var")
    return ex.score_genes(_counts(spark, sf), obs, v <= 10, v.between(11, 30), 10, 20).withColumn("score", _r("score"))


@query(f"WITH {X} SELECT count(*) FILTER (value < 0 OR value <> floor(value)) = 0 AS is_counts FROM x")
def raw_count_guard(spark, sf):
    return ex.is_counts(_counts(spark, sf))


# Graph clustering and scores (no SQL form; unit tests).


@query()
def leiden_clusters(spark, sf):
    return leiden.communities(_graph(spark, sf).select("i", "j"))


@query()
def lisi_scores(spark, sf):
    return graph.lisi(spatial.knn(_points(spark, sf), 15))


@query()
def pca_embedding(spark, sf):
    return graph.pca(_t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v")), 5)


# Beyond the reference: event-time windows over `events`.


@query("SELECT event_type, date_trunc('day', ts) AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_tumbling(spark, sf):
    e = _t(spark, sf, "events").groupBy("event_type", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return e.select("event_type", F.col("w.start").alias("day"), "n", "total")


@query("SELECT event_type, CAST(NULL AS VARCHAR) AS day, count(*) AS n FROM events GROUP BY 1 UNION ALL SELECT event_type, strftime(ts, '%Y-%m-%d'), count(*) FROM events GROUP BY 1, 2 UNION ALL SELECT NULL, NULL, count(*) FROM events")
def events_rollup(spark, sf):
    return _t(spark, sf, "events").select("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).rollup("event_type", "day").agg(F.count("*").alias("n"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new, event_id FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def events_session(spark, sf):
    e = _t(spark, sf, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return e.select("user_id", F.col("w.start").alias("start"), "n")


@query("SELECT event_type, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') - k * INTERVAL 6 HOUR AS start, count(*) AS n FROM events, range(4) t(k) GROUP BY 1, 2")
def events_sliding(spark, sf):
    e = _t(spark, sf, "events").groupBy("event_type", F.window("ts", "1 day", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return e.select("event_type", F.col("w.start").alias("start"), "n")


# Scores against shuffles, niches, cell types, pseudobulk.


@query("WITH " + P + f""", k AS (SELECT id, x, y, label, lib, q AS perm, md5(concat_ws('|', 0, q, id)) AS k FROM p, range(5) t(q)),
r AS (SELECT *, row_number() OVER (PARTITION BY perm, lib ORDER BY id) AS r, row_number() OVER (PARTITION BY perm, lib ORDER BY k, id) AS s FROM k),
m AS (SELECT a.perm, a.lib, a.id, a.x, a.y, b.label FROM r a JOIN r b ON a.perm = b.perm AND a.lib = b.lib AND a.r = b.s UNION ALL SELECT -1, lib, id, x, y, label FROM p),
t AS (SELECT a.perm, a.id, a.label AS li, b.label AS lj, min({D}) AS d FROM m a JOIN m b ON a.perm = b.perm AND a.lib = b.lib AND a.label <> b.label GROUP BY 1, 2, 3, 4),
e AS (SELECT perm, li, lj, quantile_cont(d, 0.5) AS v FROM t GROUP BY 1, 2, 3), s AS (SELECT li, lj, avg(v) AS mean, stddev_pop(v) AS sd FROM e WHERE perm >= 0 GROUP BY 1, 2)
SELECT o.li, o.lj, round(v, 6) AS observed, round(mean, 6) AS mean, CASE WHEN sd > 1e-12 THEN round((v - mean) / sd, 4) END AS z FROM e o LEFT JOIN s ON s.li = o.li AND s.lj = o.lj WHERE perm = -1""")
def proximity_zscore(spark, sf):
    out = spatial.proximity_z(_points(spark, sf), 5)
    return out.select("li", "lj", _r("observed").alias("observed"), _r("mean").alias("mean"), _r("z", 4).alias("z"))


@query("WITH " + P + f""", e AS (SELECT a.id AS i, b.label, row_number() OVER (PARTITION BY a.id ORDER BY {D}, b.id) AS rk FROM p a JOIN p b ON a.lib = b.lib),
s AS (SELECT lib AS niche, e.label, sum(1 / 20.0::DOUBLE) AS s FROM e JOIN p ON p.id = e.i WHERE rk <= 20 GROUP BY 1, 2), n AS (SELECT lib AS niche, count(*) AS n FROM p GROUP BY 1), w AS (SELECT label, sum(s) AS st FROM s GROUP BY 1)
SELECT niche, label, round(log2((s / n) / (st / (SELECT count(*) FROM p))), 5) AS enrichment FROM s JOIN n USING (niche) JOIN w USING (label)""")
def niche_enrichment(spark, sf):
    p = _points(spark, sf)
    out = spatial.niche_enrichment(spatial.composition(spatial.knn(p, 20, include_self=True)), p.select(F.col("id").alias("i"), F.col("lib").alias("niche")))
    return out.select("niche", "label", _r("enrichment", 5).alias("enrichment"))


@query(f"""WITH {X}, t AS (SELECT r, sum(value) AS t FROM x GROUP BY 1), y AS (SELECT v, value * (SELECT quantile_cont(t, 0.5) FROM t) / t AS value FROM x JOIN t USING (r)), n AS (SELECT count(*) AS n FROM orders),
m AS (SELECT v, sum(value) / any_value(n) AS mean, (sum(value * value) - sum(value) * sum(value) / any_value(n)) / (any_value(n) - 1) AS var FROM y, n GROUP BY 1), g AS (SELECT v, ln(var / mean) AS d, ln(1 + mean) AS m FROM m),
h AS (SELECT v, d, CASE WHEN hi > lo THEN least(floor((m - lo) / (hi - lo) * 20), 19) ELSE 0 END AS b FROM g, (SELECT min(m) AS lo, max(m) AS hi FROM g)), s AS (SELECT b, avg(d) AS mu, stddev_samp(d) AS sd FROM h GROUP BY 1),
z AS (SELECT v AS var, (d - CASE WHEN sd IS NULL THEN 0 ELSE mu END) / coalesce(sd, mu) AS score FROM h JOIN s USING (b)), k AS (SELECT *, row_number() OVER (ORDER BY score DESC NULLS LAST, var) AS rank FROM z) SELECT var, round(score, 4) AS score, rank FROM k WHERE rank <= 50""")
def hvg_binned(spark, sf):
    n = _t(spark, sf, "orders").count()
    return ex.dispersion_binned(ex.normalize_total(_counts(spark, sf)), F.lit(n), 50).withColumn("score", _r("score", 4))


def _bulk(spark, sf):
    o = _t(spark, sf, "orders").join(_regions(spark, sf).select("c_custkey", "r_name"), F.col("o_custkey") == F.col("c_custkey"))
    li = _t(spark, sf, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return li.groupBy(F.col("r_name").alias("sample"), F.col("l_partkey").alias("var")).agg(F.sum("l_quantity").alias("value"))


@query(f"""WITH u AS (SELECT r_name AS sample, l_partkey AS var, sum(l_quantity) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN {REG.replace('customer JOIN', 'customer ON o_custkey = c_custkey JOIN')} GROUP BY 1, 2),
g AS (SELECT var, avg(ln(value)) AS mean FROM u GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT sample) FROM u)) SELECT sample, round(exp(quantile_cont(ln(value) - mean, 0.5)), 6) AS factor FROM u JOIN g USING (var) GROUP BY 1""")
def size_factors(spark, sf):
    return ex.size_factors(_bulk(spark, sf)).withColumn("factor", _r("factor"))


@query()
def pseudobulk_de(spark, sf):
    samples = _t(spark, sf, "region").select(F.col("r_name").alias("sample"), F.when(F.col("r_regionkey") < 3, "a").otherwise("b").alias("condition"))
    return ex.pseudobulk_test(_bulk(spark, sf), samples, "b", "a")


TYPES = {"a": 0.5, "b": 0.1, "c": -0.2}
LOGIT = f"""WITH {X}, w AS (SELECT p_partkey AS v, label, ((p_partkey * m) % 7 - 3) / 64.0::DOUBLE AS weight FROM part, (VALUES ('a', 1), ('b', 2), ('c', 3)) t(label, m)), b AS (SELECT * FROM (VALUES ('a', 0.5::DOUBLE), ('b', 0.1::DOUBLE), ('c', -0.2::DOUBLE)) t(label, b)),
s AS (SELECT r, label, sum(value * weight) AS s FROM x JOIN w USING (v) GROUP BY 1, 2), l AS (SELECT o_orderkey AS row, o_custkey % 50 AS cluster, b.label, coalesce(s, 0) + b AS logit FROM orders CROSS JOIN b LEFT JOIN s ON s.r = o_orderkey AND s.label = b.label),
k AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY logit DESC, label) AS rk FROM l) """


def _types(spark, sf):
    m = F.col("p_partkey")
    w = _t(spark, sf, "part").select(m.alias("var"), F.explode(F.array(*[F.struct(F.lit(k).alias("label"), (((m * i) % 7 - 3) / 64.0).alias("weight")) for i, k in enumerate("abc", 1)])).alias("w")).select("var", "w.*")
    return ex.logistic_types(_counts(spark, sf), _t(spark, sf, "orders").select(F.col("o_orderkey").alias("row")), w, TYPES)


@query(LOGIT + "SELECT row, label, round(1 / (1 + exp(-logit)), 6) AS confidence FROM k WHERE rk = 1")
def cell_types_logistic(spark, sf):
    return _types(spark, sf).withColumn("confidence", _r("confidence"))


@query(LOGIT + ", n AS (SELECT cluster, label, count(*) AS n FROM k WHERE rk = 1 GROUP BY 1, 2), v AS (SELECT *, sum(n) OVER (PARTITION BY cluster) AS t, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, label) AS rk FROM n) SELECT cluster, label, round(n / t, 6) AS share FROM v WHERE rk = 1")
def cell_types_majority(spark, sf):
    o = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("row"), (F.col("o_custkey") % 50).alias("cluster"))
    return ex.majority_vote(_types(spark, sf).join(o, "row"), "cluster", "label").withColumn("share", _r("share"))


@query("WITH RECURSIVE " + P + """, b AS (SELECT min(x) AS a, min(y) AS b, max(x) AS c, max(y) AS d FROM p),
c AS (SELECT id, CAST(least(greatest(floor((x - a) / (c - a) * 65536), 0), 65535) AS BIGINT) AS x, CAST(least(greatest(floor((y - b) / (d - b) * 65536), 0), 65535) AS BIGINT) AS y, 0::BIGINT AS h, 32768::BIGINT AS s FROM p, b
 UNION ALL SELECT id, CASE WHEN ry = 0 THEN CASE WHEN rx = 1 THEN 65535 - y ELSE y END ELSE x END, CASE WHEN ry = 0 THEN CASE WHEN rx = 1 THEN 65535 - x ELSE x END ELSE y END, h + s * s * xor(3 * rx, ry), s // 2
 FROM (SELECT *, CASE WHEN x & s > 0 THEN 1 ELSE 0 END::BIGINT AS rx, CASE WHEN y & s > 0 THEN 1 ELSE 0 END::BIGINT AS ry FROM c WHERE s > 0)) SELECT id, h FROM c WHERE s = 0""")
def hilbert_order(spark, sf):
    p = _points(spark, sf)
    box = p.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    return p.select("id", spatial.hilbert(F.col("x"), F.col("y"), tuple(box)).alias("h"))


@query(f"""WITH {P}, s AS (SELECT min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1, least(max(x) - min(x), max(y) - min(y)) / 60 AS s FROM p), c AS (SELECT id, label, CAST(floor((x - x0) / s) AS INT) AS bx, CAST(floor((y - y0) / s) AS INT) AS b_y FROM p, s),
n AS (SELECT bx, b_y, count(*) AS n FROM c WHERE label IN (0, 1, 2) GROUP BY 1, 2), g AS (SELECT u.i AS bx, v.i AS b_y FROM s, range(100000) u(i), range(100000) v(i) WHERE u.i <= floor((x1 - x0) / s) AND v.i <= floor((y1 - y0) / s)),
d AS (SELECT g.bx, g.b_y, sum(n * exp(-((g.bx - n.bx) ** 2 + (g.b_y - n.b_y) ** 2) / 18.0)) AS v FROM g LEFT JOIN n ON abs(g.bx - n.bx) <= 9 AND abs(g.b_y - n.b_y) <= 9 GROUP BY 1, 2),
m AS (SELECT bx, b_y, coalesce(v, 0) >= 0.25 * max(v) OVER () AS m FROM d), e AS (SELECT a.bx, a.b_y, a.m, min((a.bx - b.bx) ** 2 + (a.b_y - b.b_y) ** 2) AS d FROM m a JOIN m b ON a.m <> b.m GROUP BY 1, 2, 3),
f AS (SELECT id, CASE WHEN m THEN -1 ELSE 1 END * sqrt(d) * s AS d, 3 * s AS w FROM c JOIN e USING (bx, b_y), s)
SELECT id, round(d, 6) AS signed_distance, CASE WHEN abs(d) <= w THEN 'margin' WHEN d < 0 THEN 'core' ELSE 'stroma' END AS compartment FROM f""")
def mask_boundary(spark, sf):
    return regions.mask_boundary(_points(spark, sf), [0, 1, 2]).withColumn("signed_distance", _r("signed_distance"))


@query()
def tissue_cores(spark, sf):
    return regions.tissue_cores(_points(spark, sf), rows=3, columns=4)


def _cells(spark, sf):
    v = F.col("embedding").cast("array<double>").alias("v")
    return _t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), v, (F.col("vec_id") % 8).alias("sample"), F.when(F.col("vec_id") % 8 < 4, "a").otherwise("b").alias("condition"), "label")


@query()
def differential_abundance(spark, sf):
    c = _cells(spark, sf)
    return graph.differential_abundance(c, spatial.knn_vectors(c.select("id", "v"), 30))


@query()
def dendrogram(spark, sf):
    c = _cells(spark, sf)
    return graph.dendrogram(c.select("id", "v"), c.select("id", F.col("label").alias("community")))

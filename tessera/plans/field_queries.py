"""Queries of scalar functions, fields, polygons, sequences and catalogs over the star-schema tables, each with an
independent SQL statement. They join the registry of `queries`."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import scalars as sc
from tessera.operators import catalog, fields, polygons, sequences, spatial, tables
from tessera.plans.queries import KNN, REG, RING, P, _graph, _points, _r, _regions, _ring_sql, _t, query

# Scalar functions.


@query(r"""SELECT p_partkey, regexp_replace(trim(regexp_replace(regexp_replace(lower(p_name || ' (' || p_type || ')'), '[^\p{L}\p{N}\s_-]+', '', 'g'), '[\s-]+', ' ', 'g')), ' ', '-', 'g') AS slug,
 substr(regexp_replace(p_name || '   ' || p_type, '\s+', ' ', 'g'), 1, 12) AS clean, CASE WHEN instr(p_name, ' ') > 0 THEN substr(p_name, instr(p_name, ' ') + 1) END AS after_first,
 CASE WHEN contains(p_name, ' ') THEN regexp_extract(p_name, '^(.*) ', 1) ELSE p_name END AS before_last, substr(p_brand, 7) AS brand, nullif(CASE WHEN p_size % 3 = 0 THEN '' ELSE p_type END, '') AS set_type FROM part""")
def text_functions(spark, sf):
    name = F.col("p_name")
    return _t(spark, sf, "part").select(
        "p_partkey", sc.slug(F.concat("p_name", F.lit(" ("), "p_type", F.lit(")"))).alias("slug"), sc.clean_text(F.concat("p_name", F.lit("   "), "p_type"), 12).alias("clean"),
        sc.after_first(name, " ").alias("after_first"), sc.before_last(name, " ").alias("before_last"), sc.without_prefix(F.col("p_brand"), "Brand#").alias("brand"),
        sc.unset(F.when(F.col("p_size") % 3 == 0, " ").otherwise(F.col("p_type"))).alias("set_type"),
    )


@query("""WITH s AS (SELECT o_orderkey, o_totalprice AS v, o_totalprice / 5 AS raw FROM orders), t AS (SELECT *, pow(10.0, floor(log10(raw))) AS ten FROM s)
SELECT o_orderkey, round(ten * CASE WHEN round(raw / ten, 9) <= 1 THEN 1 WHEN round(raw / ten, 9) <= 2 THEN 2 WHEN round(raw / ten, 9) <= 2.5 THEN 2.5 WHEN round(raw / ten, 9) <= 5 THEN 5 ELSE 10 END, 6) AS step,
 least(greatest(v, 50000.0::DOUBLE), 200000.0::DOUBLE) AS clipped, CAST(ceil(o_orderkey / 7.0) AS BIGINT) AS parts,
 CAST(CASE WHEN o_orderkey <= 1 THEN 1 ELSE pow(2, length(bin(o_orderkey - 1))) END AS BIGINT) AS power FROM t""")
def number_functions(spark, sf):
    v, k = F.col("o_totalprice"), F.col("o_orderkey")
    return _t(spark, sf, "orders").select(
        "o_orderkey", _r(sc.nice_step(v)).alias("step"), sc.clip(v, 50000, 200000).alias("clipped"), sc.ceil_div(k, F.lit(7)).alias("parts"), sc.next_power_of_two(k).alias("power")
    )


@query("WITH " + P + " SELECT id, round((x - 0.1) * cos(radians(30)) - (y - 0.2) * sin(radians(30)) + 0.1, 6) AS x, round((x - 0.1) * sin(radians(30)) + (y - 0.2) * cos(radians(30)) + 0.2, 6) AS y FROM p")
def rotated_points(spark, sf):
    x, y = sc.rotate(F.col("x"), F.col("y"), 30, 0.1, 0.2)
    return _points(spark, sf).select("id", _r(x).alias("x"), _r(y).alias("y"))


@query("WITH " + P + " SELECT id, round(x, 5) AS x, round(y, 5) AS y, round(1 / (2.0 * 1.5 + 0.25 * (1 + label)), 6) AS det FROM p")
def affine_inverse(spark, sf):
    d = lambda v: F.lit(v).cast("double")
    m = F.struct(d(2.0).alias("a"), d(-0.5).alias("b"), d(3.0).alias("c"), (0.5 * (1 + F.col("label"))).alias("d"), d(1.5).alias("e"), d(-1.0).alias("f"))
    out = _points(spark, sf).withColumn("m", m)
    fx, fy = sc.apply(F.col("m"), F.col("x"), F.col("y"))
    out = out.withColumn("fx", fx).withColumn("fy", fy).withColumn("n", sc.inverse_columns(F.col("m")))
    x, y = sc.apply(F.col("n"), F.col("fx"), F.col("fy"))
    return out.select("id", _r(x, 5).alias("x"), _r(y, 5).alias("y"), _r(F.col("n")["a"] / 1.5).alias("det"))


@query("WITH " + P + """, b AS (SELECT id, x - 0.1 AS a, y - 0.05 AS b, x + 0.1 AS c, y + 0.05 AS d FROM p),
s AS (SELECT *, greatest(least(c, 0.15) - greatest(a, -0.1), 0) * greatest(least(d, 0.2) - greatest(b, -0.05), 0) AS s FROM b)
SELECT id, round(s / (0.02 + 0.0625 - s), 6) AS iou, s > 0 AS meets, round(a + 2 * b, 6) AS xmin, round(c + 2 * d, 6) AS xmax FROM s""")
def box_overlap(spark, sf):
    x, y = F.col("x"), F.col("y")
    own, fixed = (x - 0.1, y - 0.05, x + 0.1, y + 0.05), tuple(F.lit(v) for v in (-0.1, -0.05, 0.15, 0.2))
    wide = sc.transformed_box((1.0, 2.0, 0.0, 0.0, 1.0, 0.0), own)
    return _points(spark, sf).select("id", _r(sc.box_iou(own, fixed)).alias("iou"), sc.boxes_meet(own, fixed).alias("meets"), _r(wide[0]).alias("xmin"), _r(wide[2]).alias("xmax"))


@query("""SELECT c_custkey, substr(sha256(c_name), 1, 12) AS hash, CAST('0x' || substr(md5(c_name), 1, 2) AS INT) AS red, '#' || substr(md5(c_name), 1, 6) AS colour,
 replace(replace(regexp_replace(base64(CAST(c_name || '?>' AS BLOB)), '=+$', ''), '+', '-'), '/', '_') AS code, c_name || '?>' AS text, c_mktsegment || ' 100%' AS decoded FROM customer""")
def code_functions(spark, sf):
    text = F.concat("c_name", F.lit("?>"))
    rgb = sc.rgb(F.substring(F.md5("c_name"), 1, 6))
    out = _t(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment", sc.base64url(text).alias("code"), rgb.alias("rgb"))
    return out.select(
        "c_custkey", sc.short_hash(F.col("c_name")).alias("hash"), F.get("rgb", F.lit(0)).alias("red"), sc.hex_colour(*(F.get("rgb", F.lit(k)) for k in range(3))).alias("colour"),
        "code", sc.from_base64url(F.col("code")).alias("text"), sc.percent_decoded(F.concat("c_mktsegment", F.lit("%20100%25"))).alias("decoded"),
    )


@query("""WITH a AS (SELECT p_partkey, string_split(p_name, ' ') AS w, string_split(p_type || ' ' || p_brand || ' x', ' ') AS t FROM part)
SELECT p_partkey, CAST(len(list_distinct(list_concat(w, w))) AS INT) AS n_unique, w[1] || '=' || t[1] || ',' || w[2] || '=' || t[2] AS pairs, list_contains(w, 'widget') AS has FROM a""")
def array_functions(spark, sf):
    w, t = F.split("p_name", " "), F.split(F.concat_ws(" ", "p_type", "p_brand", F.lit("x")), " ")
    joined = F.array_join(F.transform(sc.pairs(w, t), lambda p: F.concat_ws("=", p["a"], p["b"])), ",")
    return _t(spark, sf, "part").select("p_partkey", F.size(sc.unique_in_order(F.concat(w, w))).alias("n_unique"), joined.alias("pairs"), F.exists(w, lambda x: x == "widget").alias("has"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at, CAST(json_extract(props, '$.k') AS INT) AS k, CASE WHEN value < 300 THEN value END AS value FROM events")
def record_functions(spark, sf):
    value = sc.finite(F.when(F.col("value") < 300, F.col("value")).otherwise(F.lit(float("nan"))))
    return _t(spark, sf, "events").select("event_id", sc.iso_utc(F.col("ts")).alias("at"), F.from_json("props", "k int")["k"].alias("k"), value.alias("value"))


# Fields.


def _dataset(spark, sf) -> fields.Dataset:
    """Rows: customers; genes: parts; the matrix: quantities a customer ordered of a part."""
    o = _t(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("row"))
    x = _t(spark, sf, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("row", F.col("l_partkey").alias("var")).agg(F.sum("l_quantity").alias("value"))
    e = _t(spark, sf, "embeddings").select(F.col("vec_id").alias("row"), F.col("embedding").alias("v"))
    graph = _graph(spark, sf).select("i", "j", F.col("d").alias("w"))
    places = _points(spark, sf).select(F.col("id").alias("row"), "x", "y")
    return fields.Dataset(
        obs=_t(spark, sf, "customer").withColumnRenamed("c_custkey", "row"), var=_t(spark, sf, "part").withColumnsRenamed({"p_partkey": "var", "p_name": "name"}), x=x,
        layers={"log": x.select("row", "var", F.log1p("value").alias("value"))}, obsm={"X_vec": e}, obsp={"spatial": graph}, shapes={"spots": places},
    )


XC = "xc AS (SELECT o_custkey AS r, l_partkey AS v, sum(l_quantity) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"


@query("SELECT c_custkey AS row, c_acctbal AS value FROM customer")
def field_obs_number(spark, sf):
    return fields.resolve(_dataset(spark, sf), "obs:c_acctbal")


@query("SELECT c_custkey AS row, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS code, c_mktsegment AS label FROM customer")
def field_obs_category(spark, sf):
    return fields.resolve(_dataset(spark, sf), "obs:c_mktsegment")


@query("SELECT p_partkey AS var, CAST(p_size AS DOUBLE) AS value FROM part")
def field_var(spark, sf):
    return fields.resolve(_dataset(spark, sf), "var:p_size")


@query("SELECT vec_id AS row, CAST(round(CAST(embedding[4] AS DOUBLE), 2) AS FLOAT) AS d0, CAST(round(CAST(embedding[1] AS DOUBLE), 2) AS FLOAT) AS d1, CAST(round(CAST(embedding[64] AS DOUBLE), 2) AS FLOAT) AS d2 FROM embeddings")
def field_obsm_components(spark, sf):
    return fields.components(_dataset(spark, sf).obsm["X_vec"], [3, 0, 63])


@query(f"WITH {XC}, f AS (SELECT min(p_partkey) AS v FROM part WHERE p_name = (SELECT min(p_name) FROM part)) SELECT c_custkey AS row, round(coalesce(ln(1 + value), 0), 6) AS value FROM customer LEFT JOIN (SELECT r, value FROM xc JOIN f USING (v)) h ON h.r = c_custkey")
def field_layer_gene(spark, sf):
    name = _t(spark, sf, "part").agg(F.min("p_name")).first()[0]
    return fields.resolve(_dataset(spark, sf), f"layers:log/{name}").select("row", _r("value").alias("value"))


@query("WITH " + KNN + " SELECT i, j, round(d, 6) AS w FROM e")
def field_obsp(spark, sf):
    return fields.resolve(_dataset(spark, sf), "obsp:spatial").select("i", "j", _r("w").alias("w"))


@query(f"""WITH {XC}, f AS (SELECT p_name, min(p_partkey) AS v FROM part WHERE p_name IN ('cold widget', 'small widget') GROUP BY 1), g AS (SELECT r, p_name, value FROM xc JOIN f USING (v))
SELECT c_custkey AS row, c_mktsegment, coalesce(max(value) FILTER (p_name = 'cold widget'), 0) AS "cold widget", coalesce(max(value) FILTER (p_name = 'small widget'), 0) AS "small widget" FROM customer LEFT JOIN g ON r = c_custkey GROUP BY 1, 2""")
def obs_frame(spark, sf):
    return fields.obs_frame(_dataset(spark, sf), ["c_mktsegment", "cold widget", "small widget"])


@query(f"WITH {XC} SELECT p_partkey AS var, p_name AS name, p_size, coalesce(a.value, 0) AS r1, coalesce(b.value, 0) AS r4 FROM part LEFT JOIN xc a ON a.v = p_partkey AND a.r = 1 LEFT JOIN xc b ON b.v = p_partkey AND b.r = 4")
def var_frame(spark, sf):
    return fields.var_frame(_dataset(spark, sf), ["p_size"], [1, 4])


@query("""SELECT facet, key, kind, size FROM (
 SELECT 'obs' AS facet, column_name AS key, CASE WHEN column_type LIKE '%INT%' OR column_type = 'DOUBLE' THEN 'number' ELSE 'category' END AS kind, NULL::BIGINT AS size FROM (DESCRIBE (SELECT c_custkey AS row, * EXCLUDE (c_custkey) FROM customer))
 UNION ALL SELECT 'var', column_name, CASE WHEN column_type LIKE '%INT%' OR column_type = 'DOUBLE' THEN 'number' ELSE 'category' END, NULL FROM (DESCRIBE (SELECT p_partkey AS var, p_name AS name, * EXCLUDE (p_partkey, p_name) FROM part))
 UNION ALL SELECT 'obsm', 'X_vec', 'vector', max(len(embedding)) FROM embeddings UNION ALL SELECT 'obsp', 'spatial', 'graph', NULL UNION ALL SELECT 'layers', 'log', 'matrix', NULL UNION ALL SELECT 'X', 'X', 'matrix', NULL
 UNION ALL SELECT 'n_obs', 'n_obs', 'count', count(*) FROM customer UNION ALL SELECT 'gene', p_name, 'name', row_number() OVER (ORDER BY p_partkey) - 1 FROM (SELECT * FROM part ORDER BY p_partkey LIMIT 50))""")
def describe_fields(spark, sf):
    return fields.describe(_dataset(spark, sf))


@query("SELECT 'spots' AS element, 'point' AS kind, count(*) AS n, 'row,x,y' AS columns FROM embeddings UNION ALL SELECT 'table', 'table', count(*), 'row,c_name,c_nationkey,c_acctbal,c_mktsegment' FROM customer")
def describe_elements(spark, sf):
    return fields.describe_elements(_dataset(spark, sf)).withColumn("columns", F.array_join("columns", ","))


MAPS = [(0, 1.0, 0.0, 2.0, 0.0, 1.0, 1.0), (1, 2.0, 0.0, 0.0, 0.0, 2.0, 0.0), (2, 0.0, 1.0, 0.0, 1.0, 0.0, 3.0), (3, 1.0, 0.5, 0.0, 0.0, 1.0, -1.0)]
MAPS_SQL = "m(region, a, b, c, d, e, f) AS (VALUES " + ", ".join("(" + ", ".join([str(r[0]), *(f"{v}::DOUBLE" for v in r[1:])]) + ")" for r in MAPS) + ")"
WORLD = "WITH " + MAPS_SQL + ", " + P + ", w AS (SELECT id, x, y, a * x + b * y + c AS wx, d * x + e * y + f AS wy FROM p JOIN m ON region = lib)"


def _maps(spark):
    return spark.createDataFrame(MAPS, "region bigint, a double, b double, c double, d double, e double, f double")


def _local(spark, sf):
    return _points(spark, sf).select(F.col("id").alias("row"), F.col("lib").alias("region"), "x", "y")


@query(WORLD + " SELECT id AS row, round(wx, 6) AS wx, round(wy, 6) AS wy FROM w")
def placed_regions(spark, sf):
    return fields.placed(_local(spark, sf), _maps(spark)).select("row", _r("wx").alias("wx"), _r("wy").alias("wy"))


@query(WORLD + ", o AS (SELECT 'local' AS key, max(greatest(abs(x - wx), abs(y - wy))) AS off FROM w UNION ALL SELECT 'world', 0.0::DOUBLE), s AS (SELECT greatest(max(wx) - min(wx), max(wy) - min(wy)) AS span FROM w) SELECT key, round(off, 6) AS off, off <= 0.001 * span AS is_world FROM o, s")
def world_keys(spark, sf):
    local = _local(spark, sf)
    world = fields.placed(local, _maps(spark)).select("row", F.col("wx").alias("x"), F.col("wy").alias("y"))
    return fields.world_keys(local, {"local": local.select("row", "x", "y"), "world": world}, _maps(spark)).withColumn("off", _r("off"))


BOXES = P + ", c AS (SELECT label AS name, min(x) AS a, min(y) AS b, max(x) AS c, max(y) AS d FROM p GROUP BY 1), s AS (SELECT lib AS system, min(x) AS e, min(y) AS f, max(x) AS g, max(y) AS h FROM p WHERE label > 3 GROUP BY 1)"


@query("WITH " + BOXES + """, i AS (SELECT name, system, greatest(least(c, g) - greatest(a, e), 0) * greatest(least(d, h) - greatest(b, f), 0) AS s, (c - a) * (d - b) + (g - e) * (h - f) AS t FROM c, s),
r AS (SELECT name, system, s / (t - s) AS iou, row_number() OVER (PARTITION BY name ORDER BY s / (t - s) DESC, system) AS r FROM i) SELECT name, system, round(iou, 6) AS iou FROM r WHERE r = 1""")
def reconciled_systems(spark, sf):
    p = _points(spark, sf)
    box = (F.min("x").alias("xmin"), F.min("y").alias("ymin"), F.max("x").alias("xmax"), F.max("y").alias("ymax"))
    names = p.groupBy(F.col("label").alias("name")).agg(*box)
    systems = p.where("label > 3").groupBy(F.col("lib").alias("system")).agg(*box).withColumn("pos", F.col("system"))
    return fields.reconcile(names, systems).withColumn("iou", _r("iou"))


@query(f"WITH n AS (SELECT o_orderpriority AS system, count(DISTINCT r_name) AS has, count(*) AS population FROM {REG} JOIN orders ON o_custkey = c_custkey WHERE c_custkey % 7 < 3 OR o_orderpriority < '3' GROUP BY 1) SELECT system, population FROM n WHERE has = (SELECT count(DISTINCT r_name) FROM {REG})")
def shared_systems(spark, sf):
    of = _regions(spark, sf).join(_t(spark, sf, "orders"), F.col("o_custkey") == F.col("c_custkey")).where("c_custkey % 7 < 3 or o_orderpriority < '3'")
    return fields.shared_systems(of.select(F.col("r_name").alias("region"), F.col("o_orderpriority").alias("system")))


@query("SELECT c_custkey AS row, c_name FROM customer WHERE c_custkey IN (3, 5, 8, 13)")
def rows_by_position(spark, sf):
    return fields.by_positions(_dataset(spark, sf).obs, [3, 5, 8, 13, 5, 10**9, -4]).select("row", "c_name")


CHILD = "k AS (SELECT c_custkey AS r FROM customer WHERE c_mktsegment = 'BUILDING')"


@query(f"WITH {XC}, {CHILD}, {KNN} SELECT 'obs' AS part, count(*) AS n FROM k UNION ALL SELECT 'X', count(*) FROM xc JOIN k USING (r) UNION ALL SELECT 'vectors', count(*) FROM embeddings JOIN k ON vec_id = r UNION ALL SELECT 'edges', count(*) FROM e WHERE i IN (SELECT r FROM k) AND j IN (SELECT r FROM k) UNION ALL SELECT 'spots', count(*) FROM embeddings JOIN k ON vec_id = r")
def child_dataset(spark, sf):
    ds = _dataset(spark, sf)
    child = fields.subset(ds, ds.obs.where("c_mktsegment = 'BUILDING'"))
    parts = {"obs": child.obs, "X": child.x, "vectors": child.obsm["X_vec"], "edges": child.obsp["spatial"], "spots": child.shapes["spots"]}
    out = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("part"), "n") for k, df in parts.items()]
    for more in out[1:]:
        out[0] = out[0].unionByName(more)
    return out[0]


PALETTE = ("#111111", "#222222", "#333333")


@query("SELECT c_custkey, CASE c_mktsegment WHEN 'FURNITURE' THEN '#abcdef' ELSE ['#111111', '#222222', '#333333'][(dense_rank() OVER (ORDER BY c_mktsegment) - 1) % 3 + 1] END AS colour, c_mktsegment = 'MACHINERY' AS shown FROM customer")
def category_colours(spark, sf):
    out = fields.colours(_t(spark, sf, "customer"), "c_mktsegment", PALETTE, {"FURNITURE": "#abcdef"})
    return out.select("c_custkey", "colour", fields.isolated(F.col("c_mktsegment"), "MACHINERY").alias("shown"))


@query("SELECT p_partkey, '#999999' AS colour FROM part")
def category_colours_too_many(spark, sf):
    return fields.colours(_t(spark, sf, "part").select("p_partkey", F.concat("p_name", F.col("p_partkey").cast("string")).alias("n")), "n", PALETTE).select("p_partkey", "colour")


# Polygons.

SELECTION = [(-0.2, -0.2), (0.2, -0.15), (0.05, 0.0), (0.2, 0.2), (-0.15, 0.15)]
HALF = 0.03


def _squares(spark, sf):
    at = lambda i, j: F.struct((F.col("x") + i * HALF).alias("x"), (F.col("y") + j * HALF).alias("y"))
    return _points(spark, sf).withColumn("ring", F.array(at(-1, -1), at(1, -1), at(1, 1), at(-1, 1)))


def _squares_sql(body: str) -> str:
    sel = ", ".join(f"({x1}::DOUBLE, {y1}::DOUBLE, {x2}::DOUBLE, {y2}::DOUBLE)" for (x1, y1), (x2, y2) in zip(SELECTION, [*SELECTION[1:], SELECTION[0]]))
    corners = "(-1, -1, 1, -1), (1, -1, 1, 1), (1, 1, -1, 1), (-1, 1, -1, -1)"
    turn = lambda a, b, c, d, e, f: f"sign(({c} - {a}) * ({f} - {b}) - ({d} - {b}) * ({e} - {a}))"
    return (
        "WITH " + P + f", s(ax, ay, cx, cy) AS (VALUES {sel}), k(i, j, m, n) AS (VALUES {corners}), q AS (SELECT id, x + i * {HALF} AS px, y + j * {HALF} AS py, x + m * {HALF} AS qx, y + n * {HALF} AS qy FROM p, k),"
        f" meets AS (SELECT DISTINCT id FROM q, s WHERE {turn('ax', 'ay', 'cx', 'cy', 'px', 'py')} <> {turn('ax', 'ay', 'cx', 'cy', 'qx', 'qy')} AND {turn('px', 'py', 'qx', 'qy', 'ax', 'ay')} <> {turn('px', 'py', 'qx', 'qy', 'cx', 'cy')}),"
        f" v AS (SELECT id, px AS x, py AS y FROM q), inside AS (SELECT id, count(*) AS n FROM v WHERE {_ring_sql()} GROUP BY 1), around AS (SELECT id FROM p WHERE EXISTS (SELECT 1 FROM s WHERE ax BETWEEN x - {HALF} AND x + {HALF} AND ay BETWEEN y - {HALF} AND y + {HALF})) " + body
    )


@query(_squares_sql("SELECT id FROM meets UNION SELECT id FROM inside UNION SELECT id FROM around"))
def polygon_query(spark, sf):
    return polygons.polygon_query(_squares(spark, sf), "ring", [SELECTION, [(0.0, 0.0)]]).select("id")


@query(_squares_sql("SELECT id FROM p WHERE id NOT IN (SELECT id FROM inside WHERE n = 4 AND id NOT IN (SELECT id FROM meets))"))
def polygon_query_inverted(spark, sf):
    return polygons.polygon_query(_squares(spark, sf), "ring", [SELECTION], inverted=True).select("id")


@query(_squares_sql("SELECT vec_id, embeddings.label FROM embeddings WHERE vec_id IN (SELECT id FROM meets UNION SELECT id FROM inside UNION SELECT id FROM around)"))
def surviving_rows(spark, sf):
    table = _t(spark, sf, "embeddings").select("vec_id", "label")
    return polygons.surviving(table, _squares(spark, sf).withColumnRenamed("id", "vec_id"), "vec_id", "ring", [SELECTION])


@query(_squares_sql(f"SELECT id, 0 AS selection FROM (SELECT id FROM meets UNION SELECT id FROM inside UNION SELECT id FROM around) UNION ALL SELECT id, 1 FROM p WHERE x + {HALF} >= -0.1 AND x - {HALF} <= 0.1 AND y + {HALF} >= -0.1 AND y - {HALF} <= 0.1"))
def concatenated_selections(spark, sf):
    box = [(-0.1, -0.1), (0.1, -0.1), (0.1, 0.1), (-0.1, 0.1)]
    return polygons.concatenated(_squares(spark, sf), "ring", [SELECTION, box]).select("id", "selection")


@query("WITH " + P + f" SELECT id, round(4 * {HALF}::DOUBLE * {HALF}::DOUBLE, 9) AS area, round(x, 6) AS cx, round(y, 6) AS cy, x BETWEEN -0.12 AND 0.12 AND y BETWEEN -0.07 AND 0.22 AS visible FROM p")
def footprint_measures(spark, sf):
    centre = sc.ring_centroid(F.col("ring"))
    seen = polygons.in_viewport(F.col("x"), F.col("y"), (-0.1, -0.05, 0.1, 0.2), 0.02)
    return _squares(spark, sf).select("id", _r(sc.ring_area(F.col("ring")), 9).alias("area"), _r(centre["x"]).alias("cx"), _r(centre["y"]).alias("cy"), seen.alias("visible"))


CAMERA = [[1.5, 0.0, 0.2, 0.0], [0.0, 1.5, -0.1, 0.0], [0.0, 0.0, 1.0, -0.1], [0.1, 0.0, 1.0, 0.3]]
SCREEN = [(60.0, 40.0), (160.0, 50.0), (150.0, 130.0), (50.0, 110.0)]


@query("""WITH e AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[3] AS DOUBLE) AS c FROM embeddings), w AS (SELECT *, 0.1 * a + c + 0.3 AS w FROM e),
s AS (SELECT vec_id, w, ((1.5 * a + 0.2 * c) / w + 1) / 2 * 200 AS x, (1 - (1.5 * b - 0.1 * c) / w) / 2 * 150 AS y FROM w),
g(x1, y1, x2, y2) AS (VALUES (60.0::DOUBLE, 40.0::DOUBLE, 160.0::DOUBLE, 50.0::DOUBLE), (160, 50, 150, 130), (150, 130, 50, 110), (50, 110, 60, 40))
SELECT vec_id FROM s, g WHERE w > 0 AND (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 GROUP BY vec_id HAVING count(*) % 2 = 1""")
def lasso_3d(spark, sf):
    part = lambda k: F.col("embedding")[k].cast("double")
    return _t(spark, sf, "embeddings").where(polygons.lasso_3d(part(0), part(1), part(2), CAMERA, 200.0, 150.0, SCREEN)).select("vec_id")


@query("WITH p AS (SELECT vec_id, CAST(embedding[6] AS DOUBLE) AS x, CAST(embedding[10] AS DOUBLE) AS y FROM embeddings) SELECT vec_id FROM p WHERE " + _ring_sql())
def lasso_components(spark, sf):
    part = lambda k: F.col("embedding")[k].cast("double")
    return _t(spark, sf, "embeddings").where(spatial.in_polygons(part(5), part(9), [RING])).select("vec_id")


@query("WITH " + P + ", s AS (SELECT lib, sqrt(greatest((max(x) - min(x)) * 1000 * (max(y) - min(y)) * 1000, 1) / count(*)) AS spacing FROM p GROUP BY 1) SELECT round(avg(spacing), 6) AS spacing, bool_or(spacing * pow(2, -2) >= 6) AS near, bool_or(spacing * pow(2, -5) >= 6) AS far FROM s WHERE lib = 0")
def point_spacing(spark, sf):
    p = _points(spark, sf).where("lib = 0").select((F.col("x") * 1000).alias("x"), (F.col("y") * 1000).alias("y"))
    at = lambda z: polygons.boundaries_visible(F.col("spacing"), F.lit(z))
    return polygons.mean_spacing(p).select(_r("spacing").alias("spacing"), at(-2).alias("near"), at(-5).alias("far"))


@query("WITH " + P + ", b AS (SELECT least(min(x), -0.5) AS a, least(min(y), -0.1) AS b, greatest(max(x), 0.1) AS c, greatest(max(y), 0.6) AS d FROM p) SELECT round(a, 6) AS xmin, round(b, 6) AS ymin, round(c, 6) AS xmax, round(d, 6) AS ymax, round((a + c) / 2, 6) AS cx, round((b + d) / 2, 6) AS cy, round(log2(least(800 / (c - a), 600 / (d - b))), 6) AS zoom FROM b")
def content_fit(spark, sf):
    p = _points(spark, sf)
    nan = p.limit(1).select(F.lit(float("nan")).alias("x"), F.lit(9.0).alias("y"))
    box = polygons.extent(p.select("x", "y").unionByName(nan)).unionByName(spark.createDataFrame([(-0.5, -0.1, 0.1, 0.6)], "xmin double, ymin double, xmax double, ymax double"))
    return polygons.fit(box, 800, 600).select(*(_r(c).alias(c) for c in ("xmin", "ymin", "xmax", "ymax", "cx", "cy", "zoom")))


# Sequences.


@query("WITH n AS (SELECT year(o_orderdate) AS year, count(*) AS n FROM orders GROUP BY 1) SELECT CAST(year AS INT) AS year, n, CAST(coalesce(sum(n) OVER (ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset FROM n")
def running_offsets(spark, sf):
    n = _t(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"))
    return sequences.running_offsets(n, "year", "n")


@query("""WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) - DATE '2024-01-01' AS day FROM events), r AS (SELECT *, day - row_number() OVER (PARTITION BY user_id ORDER BY day) AS g FROM d)
SELECT user_id, CAST(min(day) AS INT) AS first, CAST(max(day) AS INT) AS last, count(*) AS n FROM r GROUP BY user_id, g""")
def active_runs(spark, sf):
    days = _t(spark, sf, "events").select("user_id", F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("day")).distinct()
    return sequences.islands(days, "day", ["user_id"])


SPANS = "s AS (SELECT user_id, epoch_us(ts) // 1000000 AS a, epoch_us(ts) // 1000000 + CAST(floor(value * 30) AS BIGINT) AS b FROM events)"


@query(f"""WITH {SPANS}, m AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR a - reach > 3600 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM m) SELECT user_id, min(a) AS "start", max(b) AS "end", count(*) AS n FROM g GROUP BY user_id, g""")
def coalesced_spans(spark, sf):
    at = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("bigint")
    s = _t(spark, sf, "events").select("user_id", at.alias("start"), (at + F.floor(F.col("value") * 30)).cast("bigint").alias("end"))
    return sequences.coalesced(s, ["user_id"], gap=3600)


@query("SELECT l_linenumber, list_sort(list(l_extendedprice))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS median FROM lineitem GROUP BY 1")
def upper_median(spark, sf):
    return sequences.upper_median(_t(spark, sf, "lineitem"), "l_extendedprice", ["l_linenumber"])


@query("WITH u AS (SELECT DISTINCT c_mktsegment AS s FROM customer WHERE c_mktsegment <> 'BUILDING'), k AS (SELECT s, row_number() OVER (ORDER BY s) - 1 AS slot FROM u) SELECT c_custkey, slot FROM customer LEFT JOIN k ON s = c_mktsegment")
def palette_slots(spark, sf):
    return sequences.slots(_t(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", ("BUILDING",)).select("c_custkey", "slot")


@query("SELECT o_orderkey FROM orders ORDER BY md5(concat_ws('|', 0, o_orderkey)), o_orderkey LIMIT 700")
def seeded_subsample(spark, sf):
    return sequences.subsample(_t(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 700)


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % CAST(ceil((SELECT count(*) FROM orders) / 400) AS BIGINT) = 0")
def strided_sample(spark, sf):
    return sequences.strided(_t(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 400)


@query("SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 25")
def history_tail(spark, sf):
    return sequences.tail(_t(spark, sf, "events").select("event_id", "event_type"), "event_id", 25)


@query("WITH b AS (SELECT DISTINCT p_brand FROM part) SELECT p_brand, row_number() OVER (ORDER BY CAST(substr(p_brand, 7) AS INT)) AS place FROM b")
def level_order(spark, sf):
    from pyspark.sql import Window

    b = _t(spark, sf, "part").select("p_brand").distinct()
    return b.select("p_brand", F.row_number().over(Window.orderBy(sequences.numeric_order(F.col("p_brand")))).cast("bigint").alias("place"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority, o_orderkey) - 1 AS at FROM orders ORDER BY o_orderpriority, o_orderkey LIMIT 150 OFFSET 250")
def page_of_parts(spark, sf):
    return sequences.page_of_parts(_t(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey", 250, 150).select("o_orderkey", "at")


@query("SELECT c_mktsegment AS value, count(*) AS n FROM customer GROUP BY 1 ORDER BY n DESC, value LIMIT 3")
def top_counts(spark, sf):
    return tables.value_counts(_t(spark, sf, "customer"), "c_mktsegment").orderBy(F.desc("n"), "value").limit(3)


# Catalogs.


def _records(spark, sf):
    e = _t(spark, sf, "events")
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "queued").when(F.col("event_type") == "view", "running").otherwise("completed")
    return e.select(F.col("event_id").alias("seq"), F.col("user_id").alias("session"), status.alias("status"), F.col("event_type").alias("function"), F.col("props").alias("params"), F.col("value").alias("_log"))


RECORDS = "r AS (SELECT event_id AS seq, user_id AS session, CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' ELSE 'completed' END AS status, event_type AS function, props AS params FROM events)"


@query(f"WITH {RECORDS} SELECT seq, function, params FROM r WHERE status = 'completed'")
def completed_steps(spark, sf):
    return catalog.steps_of(_records(spark, sf))


@query(f"WITH {RECORDS} SELECT * FROM r")
def public_records(spark, sf):
    return catalog.public(_records(spark, sf))


@query(f"WITH {RECORDS}, q AS (SELECT seq, session // 2 AS s2, status FROM r WHERE seq % 40 < 4) SELECT min(seq) AS seq, s2 AS session FROM q WHERE status = 'queued' AND s2 NOT IN (SELECT s2 FROM q WHERE status = 'running') GROUP BY s2")
def next_in_queue(spark, sf):
    jobs = _records(spark, sf).where("seq % 40 < 4").withColumn("session", F.floor(F.col("session") / 2).cast("bigint"))
    return catalog.next_in_queue(jobs).select("seq", "session")


@query(f"WITH {RECORDS} SELECT seq, status FROM r WHERE status IN ('queued', 'running') UNION ALL (SELECT seq, status FROM r WHERE status NOT IN ('queued', 'running') ORDER BY seq DESC LIMIT 200)")
def retained_jobs(spark, sf):
    return catalog.retained(_records(spark, sf)).select("seq", "status")


@query(f"WITH {RECORDS} SELECT session, count(*) AS n_steps, count(*) FILTER (status = 'failed') AS n_failed, CASE WHEN count(*) FILTER (status = 'failed') = 0 THEN 'ok' WHEN count(*) FILTER (status = 'failed') = count(*) THEN 'failed' ELSE 'partial' END AS state FROM r GROUP BY 1")
def run_status(spark, sf):
    return catalog.run_status(_records(spark, sf), "session")


@query(f"""WITH {RECORDS}, s AS (SELECT session, count(*) AS a, count(*) FILTER (status = 'failed') AS b FROM r GROUP BY 1)
SELECT session, '{{"status":{{"state":"' || CASE WHEN b = 0 THEN 'ok' WHEN a = b THEN 'failed' ELSE 'partial' END || '"}},"steps":{{"n_steps":' || a || ',"n_failed":' || b || '}}}}' AS report FROM s""")
def report_sections(spark, sf):
    return catalog.report_json(catalog.run_status(_records(spark, sf), "session"), "session", {"status": ["state"], "steps": ["n_steps", "n_failed"]})


@query("SELECT n_name AS category, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 8000 GROUP BY 1")
def category_counts(spark, sf):
    nation = _t(spark, sf, "nation")
    rich = _t(spark, sf, "customer").where("c_acctbal > 8000").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return catalog.category_counts(rich, nation.select(F.col("n_name").alias("category")), "n_name")


@query("SELECT 'c_mktsegment' AS name, c_mktsegment AS category, count(*) AS n FROM customer WHERE c_nationkey = 3 GROUP BY 2")
def recounted_sets(spark, sf):
    c = _t(spark, sf, "customer")
    registry = c.select(F.lit("c_mktsegment").alias("name"), F.col("c_mktsegment").alias("category")).distinct().unionByName(spark.createDataFrame([("gone", "a"), ("c_mktsegment", "never")], "name string, category string"))
    return catalog.recounted(registry, c.where("c_nationkey = 3"))


@query("""WITH b AS (SELECT p_type AS facet, p_name AS key, count(*) AS v FROM part WHERE p_size < 40 GROUP BY 1, 2), a AS (SELECT p_type AS facet, p_name AS key, count(*) AS v FROM part WHERE p_size > 4 GROUP BY 1, 2)
SELECT facet, key, CASE WHEN b.v IS NULL THEN 'added' WHEN a.v IS NULL THEN 'removed' ELSE 'changed' END AS change FROM b FULL JOIN a USING (facet, key) WHERE b.v IS DISTINCT FROM a.v""")
def structural_difference(spark, sf):
    of = lambda cond: _t(spark, sf, "part").where(cond).groupBy(F.col("p_type").alias("facet"), F.col("p_name").alias("key")).agg(F.count("*").alias("version"))
    return catalog.difference(of("p_size < 40"), of("p_size > 4"))


@query("WITH v AS (SELECT p_type AS field, count(*) AS version FROM part WHERE p_size < 10 GROUP BY 1), c AS (SELECT DISTINCT p_type AS field FROM part WHERE p_size = 45) SELECT field, CAST(coalesce(version, 0) + (CASE WHEN c.field IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS version FROM v FULL JOIN c USING (field)")
def bumped_versions(spark, sf):
    part = _t(spark, sf, "part").withColumnRenamed("p_type", "field")
    return catalog.bumped(part.where("p_size < 10").groupBy("field").agg(F.count("*").alias("version")), part.where("p_size = 45").select("field"))


@query("SELECT p_partkey AS view, CASE WHEN p_name IN (SELECT p_name FROM part WHERE p_size > 45) THEN p_name END AS reference FROM part")
def pruned_display(spark, sf):
    part = _t(spark, sf, "part")
    return catalog.pruned_display(part.select(F.col("p_partkey").alias("view"), F.col("p_name").alias("reference")), part.where("p_size > 45").select(F.col("p_name").alias("field")))


TERMS = [("scoped", 0, "PROMO", "cold bolt", None, None), ("bolt", 1, None, None, "^.* bolt$", None), ("named", 2, None, "cold widget", None, None), ("cold", 3, None, None, "^cold .*$", None), ("typed", 4, None, None, None, "7")]


def _terms(spark, sf):
    part = _t(spark, sf, "part")
    p = part.select(F.col("p_type").alias("function"), F.col("p_name").alias("parameter"), (F.col("p_size") % 10).cast("string").alias("type")).distinct()
    t = spark.createDataFrame(TERMS, "term string, pos int, scope string, name string, pattern string, type string")
    return catalog.matched_terms(p.groupBy("function", "parameter").agg(F.min("type").alias("type")), t)


MATCHED = "m AS (SELECT p_type AS function, p_name AS parameter, min(CAST(p_size % 10 AS VARCHAR)) AS type FROM part GROUP BY 1, 2), t AS (SELECT function, parameter, CASE WHEN function = 'PROMO' AND parameter = 'cold bolt' THEN 'scoped' WHEN parameter = 'cold widget' THEN 'named' WHEN parameter LIKE '% bolt' THEN 'bolt' WHEN parameter LIKE 'cold %' THEN 'cold' WHEN type = '7' THEN 'typed' END AS term FROM m)"


@query(f"WITH {MATCHED} SELECT * FROM t")
def matched_terms(spark, sf):
    return _terms(spark, sf)


@query(f"WITH {MATCHED} SELECT count(*) AS n, count(term) AS matched, round(count(term) / count(*), 3) AS rate FROM t")
def term_coverage(spark, sf):
    return catalog.term_coverage(_terms(spark, sf))


@query(f"WITH {MATCHED} SELECT parameter, count(*) AS n, array_to_string(list_sort(list(DISTINCT function)), ',') AS functions FROM t WHERE term IS NULL GROUP BY 1")
def unmatched_terms(spark, sf):
    return catalog.unmatched_by_reuse(_terms(spark, sf)).withColumn("functions", F.array_join("functions", ","))


@query("WITH c AS (SELECT p_partkey AS parameter, unnest(string_split(p_name, ' ')) AS type FROM part), t AS (SELECT DISTINCT regexp_extract(p_name, '^(\\w+)', 1) AS type FROM part WHERE p_size > 30) SELECT type, parameter FROM t JOIN c USING (type)")
def common_parameters(spark, sf):
    part = _t(spark, sf, "part")
    types = part.where("p_size > 30").select(F.regexp_extract("p_name", r"^(\w+)", 1).alias("type")).distinct()
    return catalog.common_parameters(types, part.select(F.col("p_partkey").alias("parameter"), F.split("p_name", " ").alias("applies_to")))


@query("WITH f AS (SELECT DISTINCT url FROM pages) SELECT url FROM f WHERE url LIKE '%.html' AND substr(url, 1, length(url) - 5) NOT IN (SELECT url FROM f)")
def without_companion(spark, sf):
    return catalog.without_companion(_t(spark, sf, "pages").select("url").distinct(), "url", ".html", "")


@query("WITH n AS (SELECT p_name AS name FROM part WHERE p_size < 5 UNION SELECT 'c_acctbal' UNION SELECT 'nothing') SELECT name, CASE WHEN name IN ('c_custkey', 'c_acctbal') THEN 'obs' WHEN name IN (SELECT p_name FROM part) THEN 'var' END AS found FROM n")
def resolved_names(spark, sf):
    part = _t(spark, sf, "part")
    names = part.where("p_size < 5").select(F.col("p_name").alias("name")).unionByName(spark.createDataFrame([("c_acctbal",), ("nothing",)], "name string")).distinct()
    return catalog.resolved_names(names, spark.createDataFrame([("c_custkey",), ("c_acctbal",)], "name string"), part.select(F.col("p_name").alias("name")))


@query("SELECT p_partkey AS pos, p_type || '.' || p_name AS key FROM part WHERE (p_name LIKE '%bolt%' OR p_brand LIKE '%bolt%') AND p_type = 'PROMO'")
def function_search(spark, sf):
    f = _t(spark, sf, "part").select(F.concat("p_type", F.lit("."), "p_name").alias("key"), F.col("p_brand").alias("summary"), (F.col("p_size") > 40).alias("custom"), F.col("p_partkey").alias("pos"))
    return catalog.search_functions(f, "BOLT", "PROMO").select("pos", "key")


FOLDERS = [{"type": "feed", "all_of": ["*/en/*"], "any_of": ["*feed*", "*top*"]}, {"type": "plain", "all_of": ["*/en/*"], "none_of": ["*feed*", "*top*"]}, {"type": "any", "any_of": ["*"]}]


@query("""WITH f AS (SELECT regexp_extract(url, '//([^/]*)/', 1) AS folder, regexp_extract(url, '//[^/]*(/.*)', 1) AS name FROM pages), g AS (SELECT folder, bool_or(contains(name, '/en/')) AS en, bool_or(contains(name, 'feed') OR contains(name, 'top')) AS f FROM f GROUP BY 1)
SELECT folder, CASE WHEN en AND f THEN 'feed' WHEN en THEN 'plain' ELSE 'any' END AS type FROM g""")
def classified_folders(spark, sf):
    listing = _t(spark, sf, "pages").select(F.regexp_extract("url", "//([^/]*)/", 1).alias("folder"), F.regexp_extract("url", "//[^/]*(/.*)", 1).alias("name"))
    return catalog.classified_folders(listing, FOLDERS)


@query("WITH t AS (SELECT regexp_extract(url, '//([^/.]*)', 1) AS type FROM pages) SELECT type, count(*) AS n FROM t GROUP BY 1")
def datasets_by_type(spark, sf):
    return _t(spark, sf, "pages").groupBy(F.regexp_extract("url", "//([^/.]*)", 1).alias("type")).agg(F.count("*").alias("n"))


@query("SELECT url AS path, page_id AS modified FROM pages WHERE NOT regexp_matches(url, '(^|/)([._][^/]*|tessera-[^/]*)(/|$)') ORDER BY page_id DESC LIMIT 40")
def newest_datasets(spark, sf):
    return catalog.datasets_newest_first(_t(spark, sf, "pages").select(F.col("url").alias("path"), F.col("page_id").alias("modified")), 40)


@query("SELECT c_nationkey AS element, CAST(sum(octet_length(encode(c_name))) AS BIGINT) AS bytes, sum(octet_length(encode(c_name))) * 4.0::DOUBLE AS unpacked, round(sum(octet_length(encode(c_name))) * 4.0::DOUBLE * 0.3::DOUBLE, 6) AS resident FROM customer GROUP BY 1")
def size_estimates(spark, sf):
    f = _t(spark, sf, "customer").select(F.col("c_nationkey").alias("element"), F.octet_length("c_name").alias("bytes"))
    return catalog.sizes(f, "element").withColumn("resident", _r("resident"))


@query("SELECT c_nationkey, count(DISTINCT c_mktsegment) AS n FROM customer GROUP BY 1")
def distinct_counts(spark, sf):
    return _t(spark, sf, "customer").groupBy("c_nationkey").agg(F.count_distinct("c_mktsegment").alias("n"))


@query("""WITH s AS (SELECT p_partkey AS id, ['point', 'line', 'rectangle', 'ellipse', 'polygon', 'text'][1 + p_partkey % 6] AS kind, CAST(p_size AS DOUBLE) AS a FROM part)
SELECT id, kind, CASE kind WHEN 'rectangle' THEN round(a * 2, 4) WHEN 'polygon' THEN round(a * a / 2, 4) WHEN 'ellipse' THEN round(32 * sin(2 * pi() / 64) * a / 2 * 1.0, 4) END AS area FROM s""")
def annotation_areas(spark, sf):
    part = _t(spark, sf, "part")
    kinds = F.array(*map(F.lit, catalog.KINDS))
    a = F.col("p_size").cast("double")
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    two = F.array(at(F.lit(0.0), F.lit(0.0)), at(a, F.lit(2.0)))
    three = F.array(at(F.lit(0.0), F.lit(0.0)), at(a, F.lit(0.0)), at(F.lit(0.0), a))
    s = part.select(F.col("p_partkey").alias("id"), F.get(kinds, (F.col("p_partkey") % 6).cast("int")).alias("kind"), two.alias("two"), three.alias("three"))
    ring = catalog.annotation_ring(F.col("kind"), F.when(F.col("kind") == "polygon", F.col("three")).otherwise(F.col("two")))
    s = s.select("id", "kind", ring.alias("ring"))
    return s.select("id", "kind", F.when(F.col("ring").isNotNull(), F.round(sc.ring_area(F.col("ring")), 4)).alias("area"))


# Selections and grids.


@query(f"""WITH n AS (SELECT n_name, count(*) FILTER (c_acctbal > 5000) AS n_inside, count(*) AS n_all FROM {REG} GROUP BY 1)
SELECT n_name, n_inside, n_all, round(n_inside / sum(n_inside) OVER (), 6) AS share_inside, round(n_all / sum(n_all) OVER (), 6) AS share_all FROM n ORDER BY n_inside DESC, n_name LIMIT 10""")
def selection_composition(spark, sf):
    out = tables.composition_of(_regions(spark, sf), F.col("c_acctbal") > 5000, "n_name", 10)
    return out.withColumns({"share_inside": _r("share_inside"), "share_all": _r("share_all")})


@query("SELECT c_mktsegment AS value, count(*) AS n FROM customer GROUP BY 1")
def category_counts_sorted(spark, sf):
    return tables.value_counts(_t(spark, sf, "customer"), "c_mktsegment").orderBy("value")


def _grid(spark, sf, wide):
    e = _t(spark, sf, "embeddings")
    row = F.floor(F.col("vec_id") / 30).cast("int")
    col = (F.col("vec_id") % 30).cast("int")
    return e.select(F.col("vec_id").alias("id"), row.alias("row"), (2 * col + row % 2 if wide else col).alias("col"), (F.col("vec_id") % 4 if not wide else F.lit(0)).alias("lib"))


@query("""WITH g AS (SELECT vec_id AS id, vec_id // 30 AS r, vec_id % 30 AS c, vec_id % 4 AS lib FROM embeddings)
SELECT a.id AS i, b.id AS j, CAST(abs(a.r - b.r) + abs(a.c - b.c) AS INT) AS ring FROM g a JOIN g b ON a.lib = b.lib AND abs(a.r - b.r) + abs(a.c - b.c) BETWEEN 1 AND 4""")
def grid_square_neighbors(spark, sf):
    return spatial.grid_graph(_grid(spark, sf, False), "square", 4)


@query("""WITH g AS (SELECT vec_id AS id, vec_id // 30 AS r, 2 * (vec_id % 30) + (vec_id // 30) % 2 AS c FROM embeddings)
SELECT a.id AS i, b.id AS j, CAST(1 AS INT) AS ring FROM g a JOIN g b ON (a.r = b.r AND abs(a.c - b.c) = 2) OR (abs(a.r - b.r) = 1 AND abs(a.c - b.c) = 1)""")
def grid_hex_neighbors(spark, sf):
    return spatial.grid_graph(_grid(spark, sf, True), "hex")


@query("WITH " + KNN + " SELECT li, lj, round(sum(d), 5) AS n FROM e GROUP BY 1, 2")
def interaction_weighted(spark, sf):
    return spatial.interaction(_graph(spark, sf), weight="d").withColumn("n", _r("n", 5))

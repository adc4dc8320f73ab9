"""Datasets and their fields: a table of rows with its matrix, layers, vectors, graphs, shapes and transforms.

A field path names one column of values: `obs:<column>`, `var:<column>`, `X:<gene>`, `layers:<layer>/<gene>`,
`obsm:<key>`, `obsp:<key>`. Rows are numbered (`row`), matrices are in long form (row, var, value) without zeros.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

from tessera.functions import scalars
from tessera.operators import expression, tables

#: Most edges of a graph that a field read hands out.
MOST_EDGES = 5_000_000
#: Share of the extent by which places may differ and still be the same.
TOLERANCE = 1e-3


@dataclass(frozen=True)
class Dataset:
    """obs has `row`, var has `var` and `name`, matrices are (row, var, value), vectors (row, v), graphs (i, j, w)."""

    obs: DataFrame
    var: DataFrame | None = None
    x: DataFrame | None = None
    layers: dict[str, DataFrame] = field(default_factory=dict)
    obsm: dict[str, DataFrame] = field(default_factory=dict)
    obsp: dict[str, DataFrame] = field(default_factory=dict)
    shapes: dict[str, DataFrame] = field(default_factory=dict)
    transforms: dict[str, scalars.Affine] = field(default_factory=dict)

    @property
    def spark(self) -> SparkSession:
        return self.obs.sparkSession


def adopt(found: Dataset | DataFrame) -> Dataset:
    """What a reader returned as a dataset; a bare table becomes a dataset of that table, numbered if need be."""
    if isinstance(found, Dataset):
        return found
    return Dataset(found if "row" in found.columns else found.withColumn("row", F.monotonically_increasing_id()))


def _pick(names: dict | list, key: str, facet: str):
    if key not in names:
        raise ValueError(f"no {key!r} in {facet}; there are {sorted(names)}")
    return names[key] if isinstance(names, dict) else key


def resolve(ds: Dataset, path: str, most_edges: int = MOST_EDGES) -> DataFrame:
    """The values at a field path: (row, value) of numbers, (row, code, label) of categories, (row, d0, d1, ..) of
    vectors rounded to two places as floats, (var, value) of features, (i, j, w) of graphs of at most most_edges."""
    facet, _, key = path.partition(":")
    if facet == "obs":
        return _column(ds.obs, _pick(ds.obs.columns, key, "obs"), "row")
    if facet == "var" and ds.var is not None:
        return _column(ds.var, _pick(ds.var.columns, key, "var"), "var")
    if facet == "X" and ds.x is not None and ds.var is not None:
        return gene(ds, ds.x, key)
    if facet == "layers" and ds.var is not None:
        layer, _, name = key.partition("/")
        return gene(ds, _pick(ds.layers, layer, "layers"), name)
    if facet == "obsm":
        return components(_pick(ds.obsm, key, "obsm"))
    if facet == "obsp":
        g = _pick(ds.obsp, key, "obsp")
        if g.limit(most_edges + 1).count() > most_edges:
            raise ValueError(f"{path} has over {most_edges} edges")
        return g.select("i", "j", "w")
    raise ValueError(f"{path!r} is no field path of this dataset")


def _column(df: DataFrame, column: str, key: str) -> DataFrame:
    kind = df.schema[column].dataType
    if isinstance(kind, NumericType):
        return df.select(key, scalars.finite(F.col(column)).alias("value"))
    text = F.col(column).cast("string")
    if isinstance(kind, BooleanType):
        text = F.initcap(text)
    return tables.categorical_codes(df.select(key, text.alias("label")).withColumn("value", F.col("label")).drop("label"), "value").select(key, "code", F.col("value").alias("label"))


def gene(ds: Dataset, x: DataFrame, name: str) -> DataFrame:
    """(row, value) of the first gene of that name, zeros filled in; an unknown name is an error."""
    if ds.var.where(F.col("name") == name).isEmpty():
        raise ValueError(f"no gene {name!r}")
    return expression.dense_column(ds.obs, x, ds.var, name)


def components(vectors: DataFrame, which: list[int] | None = None, digits: int | None = 2) -> DataFrame:
    """(row, d0, d1, ..) of vectors (row, v), or the chosen components; a plain number is a vector of one."""
    v = F.col("v")
    if not vectors.schema["v"].dataType.simpleString().startswith("array"):
        vectors, v = vectors.withColumn("v", F.array(v)), F.col("v")
    n = vectors.agg(F.max(F.size("v"))).first()[0] or 0
    which = list(range(n)) if which is None else which
    if any(k < 0 or k >= n for k in which):
        raise ValueError(f"components {which} of {n}")
    cell = lambda k: F.get(v, F.lit(k)).cast("double")
    return vectors.select("row", *((F.round(cell(k), digits) if digits is not None else cell(k)).cast("float").alias(f"d{at}") for at, k in enumerate(which)))


def obs_frame(ds: Dataset, keys: list[str], layer: str | None = None) -> DataFrame:
    """row and a column for each key: a column of obs, else a gene, first found wins."""
    out = ds.obs.select("row", *(k for k in keys if k in ds.obs.columns))
    x = ds.x if layer is None else _pick(ds.layers, layer, "layers")
    genes = [k for k in keys if k not in ds.obs.columns]
    if genes:
        first = ds.var.where(F.col("name").isin(genes)).groupBy("name").agg(F.min("var").alias("var"))
        missing = set(genes) - {r["name"] for r in first.select("name").collect()}  # at most as many as asked for
        if missing:
            raise ValueError(f"neither columns nor genes: {sorted(missing)}")
        wide = x.join(F.broadcast(first), "var").groupBy("row").agg(*(F.max(F.when(F.col("name") == g, F.col("value"))).alias(g) for g in genes))
        out = out.join(wide, "row", "left").fillna(0.0, genes)
    return out.select("row", *keys)


def var_frame(ds: Dataset, keys: list[str], rows: list) -> DataFrame:
    """var, name, the columns `keys`, and a column for each of the rows with its values, zeros filled in."""
    names = [f"r{r}" for r in rows]
    wide = ds.x.where(F.col("row").isin(rows)).groupBy("var").agg(*(F.max(F.when(F.col("row") == r, F.col("value"))).alias(n) for r, n in zip(rows, names)))
    return ds.var.join(wide, "var", "left").fillna(0.0, names).select("var", "name", *keys, *names)


def describe(ds: Dataset, most_names: int = 50) -> DataFrame:
    """(facet, key, kind, size): columns of obs and var, vectors with their length, graphs, layers, the matrix, and the
    first names of genes. Without a matrix there is no row for it, which differs from one of zeros."""
    rows = [("obs", f.name, "number" if isinstance(f.dataType, NumericType) else "category", None) for f in ds.obs.schema.fields]
    rows += [("var", f.name, "number" if isinstance(f.dataType, NumericType) else "category", None) for f in (ds.var.schema.fields if ds.var is not None else ())]
    rows += [("obsm", k, "vector", v.agg(F.max(F.size("v"))).first()[0]) for k, v in sorted(ds.obsm.items())]
    rows += [("obsp", k, "graph", None) for k in sorted(ds.obsp)]
    rows += [("layers", k, "matrix", None) for k in sorted(ds.layers)]
    if ds.x is not None:
        rows.append(("X", "X", "matrix", None))
    rows.append(("n_obs", "n_obs", "count", ds.obs.count()))
    if ds.var is not None:
        rows += [("gene", r["name"], "name", k) for k, r in enumerate(ds.var.orderBy("var").select("name").limit(most_names).collect())]
    return ds.spark.createDataFrame(rows, "facet string, key string, kind string, size bigint")


def describe_elements(ds: Dataset) -> DataFrame:
    """(element, kind, n, columns) of the tables and shapes; kind of shapes: polygon with a ring, circle with a radius, else point."""
    kind = lambda c: "polygon" if "ring" in c else "circle" if "radius" in c else "point"
    parts = [("table", "table", ds.obs)] + [(k, kind(v.columns), v) for k, v in sorted(ds.shapes.items())]
    one = lambda name, kind, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("element"), F.lit(kind).alias("kind"), "n", F.array(*map(F.lit, df.columns)).alias("columns"))
    return reduce(DataFrame.unionByName, [one(*p) for p in parts])


# Places of regions.


def placed(df: DataFrame, transforms: DataFrame, region: str = "region", x: str = "x", y: str = "y") -> DataFrame:
    """df with wx, wy: each row's place under its region's map (region, a..f; a small table). Rows of a region without a
    map are an error."""
    stray = df.join(transforms, region, "left_anti").select(region).limit(1).collect()
    if stray:
        raise ValueError(f"no transform for region {stray[0][0]!r}")
    t = transforms.select(region, F.struct(*"abcdef").alias("m"))
    wx, wy = scalars.apply(F.col("m"), F.col(x), F.col(y))
    return df.join(t, region).select(*df.columns, wx.alias("wx"), wy.alias("wy"))


def world_keys(local: DataFrame, keys: dict[str, DataFrame], transforms: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(key, off, is_world): how far the places of each key (row, x, y) are from those that the regions' maps give to the
    local ones (row, region, x, y), and whether that is within the tolerance times the extent: that key holds world places."""
    want = placed(local, transforms).select("row", "wx", "wy")
    box = want.agg(F.greatest(F.max("wx") - F.min("wx"), F.max("wy") - F.min("wy")).alias("span"))

    def off(name: str, df: DataFrame) -> DataFrame:
        d = F.greatest(F.abs(F.col("x") - F.col("wx")), F.abs(F.col("y") - F.col("wy")))
        return df.join(want, "row").agg(F.max(d).alias("off")).select(F.lit(name).alias("key"), "off")

    out = reduce(DataFrame.unionByName, [off(k, v) for k, v in keys.items()])
    return out.crossJoin(F.broadcast(box)).select("key", "off", (F.col("off") <= tolerance * F.greatest("span", F.lit(1e-12))).alias("is_world"))  # one row


def reconcile(candidates: DataFrame, systems: DataFrame) -> DataFrame:
    """(name, system, iou): for each candidate box (name, pos, xmin..ymax) the system (system, pos, xmin..ymax) whose box it
    overlaps best; the earlier system wins ties. Both are lists of elements, not rows."""
    a = candidates.select("name", F.struct("xmin", "ymin", "xmax", "ymax").alias("p"))
    b = systems.select("system", F.col("pos").alias("at"), F.struct("xmin", "ymin", "xmax", "ymax").alias("q"))
    ends = lambda c: tuple(F.col(c)[k] for k in ("xmin", "ymin", "xmax", "ymax"))
    scored = a.crossJoin(F.broadcast(b)).withColumn("iou", scalars.box_iou(ends("p"), ends("q")))
    best = scored.groupBy("name").agg(F.min(F.struct((-F.col("iou")).alias("k"), "at", "system")).alias("b"))
    return best.select("name", F.col("b.system").alias("system"), (-F.col("b.k")).alias("iou"))


def place_of(element: dict, regions: dict[str, scalars.Affine], systems: dict[str, scalars.Affine], fallback: scalars.Affine | None = None) -> scalars.Affine:
    """The map of an element to the world: that of its region, else of its known system, else the reconciled one."""
    if element.get("region") in regions:
        return regions[element["region"]]
    if element.get("system") in systems:
        return systems[element["system"]]
    if fallback is None:
        raise ValueError(f"element {element.get('name')!r} has no place")
    return fallback


def shared_systems(of: DataFrame) -> DataFrame:
    """(system, population) of coordinate systems (region, system) that all regions have, most rows first, then by name."""
    regions = of.agg(F.count_distinct("region").alias("all"))
    n = of.groupBy("system").agg(F.count_distinct("region").alias("has"), F.count("*").alias("population"))
    return n.crossJoin(F.broadcast(regions)).where("has = all").select("system", "population").orderBy(F.desc("population"), "system")  # one row


# Selections and children.


def by_positions(df: DataFrame, positions: list[int], inverted: bool = False) -> DataFrame:
    """Rows of the given numbers, or all others; numbers out of range are ignored, no row at all is an error."""
    wanted = df.sparkSession.createDataFrame([(p,) for p in sorted(set(positions))], "row bigint")
    out = df.join(wanted, "row", "left_anti" if inverted else "left_semi")
    if out.isEmpty():
        raise ValueError("the selection holds no row")
    return out


def subset(ds: Dataset, rows: DataFrame) -> Dataset:
    """The child dataset of the given rows (row): matrices, vectors and graphs keep what belongs to them; shapes with a
    `row` keep theirs, others stay whole."""
    keep = rows.select("row").distinct()
    semi = lambda df: df.join(keep, "row", "left_semi")
    ends = lambda g: g.join(keep.withColumnRenamed("row", "i"), "i", "left_semi").join(keep.withColumnRenamed("row", "j"), "j", "left_semi").select(*g.columns)
    return replace(
        ds, obs=semi(ds.obs), x=None if ds.x is None else semi(ds.x), layers={k: semi(v) for k, v in ds.layers.items()}, obsm={k: semi(v) for k, v in ds.obsm.items()},
        obsp={k: ends(v) for k, v in ds.obsp.items()}, shapes={k: semi(v) if "row" in v.columns else v for k, v in ds.shapes.items()},
    )


def colours(df: DataFrame, column: str, palette: tuple[str, ...], overrides: dict[str, str] | None = None, most: int = 100, grey: str = "#999999") -> DataFrame:
    """df with colour: the palette in the order of the sorted labels, again from the start when it ends; overrides win. More
    than `most` labels, and missing ones, are grey."""
    labels = df.select(F.col(column).alias("_label")).where("_label is not null").distinct()
    if labels.limit(most + 1).count() > most:
        return df.withColumn("colour", F.when(F.lit(False), F.lit(grey)).otherwise(F.lit(grey)))
    names = [r[0] for r in labels.orderBy("_label").collect()]  # at most `most`
    chosen = {n: (overrides or {}).get(n, palette[k % len(palette)]) for k, n in enumerate(names)}
    if not chosen:
        return df.withColumn("colour", F.lit(grey))
    m = F.create_map(*[F.lit(v) for kv in chosen.items() for v in kv])
    return df.withColumn("colour", F.coalesce(F.when(F.col(column).isNotNull(), m[F.col(column)]), F.lit(grey)))


def isolated(label: Column, shown: str) -> Column:
    """Whether a row stays lit when one category is isolated; a missing label never is the isolated one."""
    return F.coalesce(label == shown, F.lit(False))

"""Readers of instrument exports in CSV, discovery of datasets in a listing, path checks and content hashes.

Matrices come out in long form (row, var, value) without zeros: the wide file is unpivoted where it is read, so no
step holds a dense matrix.
"""

from __future__ import annotations

import posixpath
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.tables import glob_pattern


def inside(root: str, path: str) -> str:
    """The normal form of path, which must lie in root; an escape from it is refused."""
    root = posixpath.normpath(root)
    full = posixpath.normpath(path if path.startswith("/") else posixpath.join(root, path))
    if full != root and not full.startswith(root.rstrip("/") + "/"):
        raise ValueError(f"{path!r} lies outside {root!r}")
    return full


def check_paths(root: str, params: object) -> None:
    """Refuse any text in nested parameters that looks like a path and leaves root."""
    if isinstance(params, dict):
        params = list(params.values())
    if isinstance(params, (list, tuple)):
        for p in params:
            check_paths(root, p)
    elif isinstance(params, str) and "/" in params:
        inside(root, params)


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV file with a header, its types read from the file unless a schema names them."""
    r = spark.read.option("header", True)
    return r.schema(schema).csv(path) if schema else r.option("inferSchema", True).csv(path)


def long_counts(wide: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, name, value) of the entries of a wide table that are not zero or missing."""
    genes = [c for c in wide.columns if c not in keys]
    out = wide.select(*keys, *[F.col(f"`{c}`").cast("double").alias(c) for c in genes])
    return out.unpivot(keys, [F.col(f"`{c}`") for c in genes], "name", "value").where("value <> 0 and value is not null")


def read_merscope(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """cells (row, x, y, ...), counts (row, name, value) and transcripts of one region's CSV files."""
    cells = read_csv(spark, f"{path}/cell_metadata.csv")
    first = cells.columns[0]
    cells = cells.select(F.col(f"`{first}`").cast("string").alias("row"), F.col("center_x").cast("double").alias("x"), F.col("center_y").cast("double").alias("y"), *[c for c in cells.columns[1:] if c not in ("center_x", "center_y")])
    wide = read_csv(spark, f"{path}/cell_by_gene.csv")
    wide = wide.withColumnRenamed(wide.columns[0], "row").withColumn("row", F.col("row").cast("string"))
    return {"cells": cells, "counts": long_counts(wide, ["row"]), "transcripts": read_csv(spark, f"{path}/detected_transcripts.csv")}


def read_cosmx(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """cells, counts and fields of view. Local cell numbers repeat in each field: the key is (fov, cell_ID)."""
    key = F.concat_ws("_", "fov", "cell_ID").alias("row")
    meta = read_csv(spark, f"{path}/*metadata_file.csv")
    cells = meta.select(key, F.col("CenterX_global_px").cast("double").alias("x"), F.col("CenterY_global_px").cast("double").alias("y"), *[c for c in meta.columns if c not in ("CenterX_global_px", "CenterY_global_px")])
    wide = read_csv(spark, f"{path}/*exprMat_file.csv").where("cell_ID <> 0")  # 0: outside all cells
    wide = wide.select(key, *[F.col(f"`{c}`") for c in wide.columns if c not in ("fov", "cell_ID")])
    return {"cells": cells, "counts": long_counts(wide, ["row"]), "fields": read_csv(spark, f"{path}/*fov_positions_file.csv")}


def read_mcmicro(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """cells and intensities (row, name, value) from quantification/*.csv; names are those of markers.csv."""
    markers = read_csv(spark, f"{path}/markers.csv")
    names = [r[0] for r in markers.select(F.col("marker_name").cast("string")).collect()]  # the panel
    wide = read_csv(spark, f"{path}/quantification/*.csv").withColumnRenamed("CellID", "row")
    cells = wide.select("row", F.col("X_centroid").alias("x"), F.col("Y_centroid").alias("y"))
    found = [c for c in wide.columns if c in names or c.rsplit("_", 1)[0] in names]
    return {"cells": cells, "counts": long_counts(wide.select("row", *[F.col(f"`{c}`") for c in found]), ["row"]), "markers": markers}


def content_hash(spark: SparkSession, path: str) -> str:
    """SHA-256 over the sorted names and hashes of the files under path; contents are hashed where they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    each = files.select(F.regexp_replace("path", r"^.*" + posixpath.basename(path.rstrip("/")) + "/", "").alias("p"), F.sha2("content", 256).alias("h"))
    return each.agg(F.sha2(F.to_json(F.sort_array(F.collect_list(F.struct("p", "h")))), 256)).first()[0]


@dataclass(frozen=True)
class DataType:
    """A folder is of this type if its entries fit every glob of all_of, one of any_of and none of none_of."""

    name: str
    all_of: tuple[str, ...] = ()
    any_of: tuple[str, ...] = ()
    none_of: tuple[str, ...] = ()

    def score(self) -> int:
        return len(self.all_of) + bool(self.any_of)


def discover(listing: DataFrame, types: list[DataType]) -> DataFrame:
    """(folder, type, tied) of the outermost folders of a listing (path) that are datasets.

    The type of most globs wins; where several of the same number fit, type is null and tied names them."""
    entries = listing.select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder"), F.regexp_extract("path", r"([^/]*)$", 1).alias("entry"))
    globs = sorted({g for t in types for g in (*t.all_of, *t.any_of, *t.none_of)})
    has = {g: F.col(f"g{i}") for i, g in enumerate(globs)}
    found = entries.groupBy("folder").agg(*[F.bool_or(F.col("entry").rlike(glob_pattern(g))).alias(f"g{i}") for i, g in enumerate(globs)])

    def fits(t: DataType) -> Column:
        ok = F.lit(True)
        for g in t.all_of:
            ok = ok & has[g]
        for g in t.none_of:
            ok = ok & ~has[g]
        some = F.lit(not t.any_of)
        for g in t.any_of:
            some = some | has[g]
        return ok & some

    scored = F.filter(F.array(*[F.when(fits(t), F.struct(F.lit(t.score()).alias("score"), F.lit(t.name).alias("name"))) for t in types]), lambda x: x.isNotNull())
    best = found.select("folder", scored.alias("s")).where("size(s) > 0")
    best = best.select("folder", F.transform(F.filter("s", lambda x: x["score"] == F.array_max(F.transform("s", lambda y: y["score"]))), lambda x: x["name"]).alias("tied"))
    parts = F.split("folder", "/")
    above = best.select("folder", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("up")).where("up <> folder")
    inner = above.join(best.select(F.col("folder").alias("up")), "up", "left_semi").select("folder").distinct()
    return best.join(inner, "folder", "left_anti").select("folder", F.when(F.size("tied") == 1, F.col("tied")[0]).alias("type"), "tied")

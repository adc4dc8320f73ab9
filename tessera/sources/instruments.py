"""Whole exports of instruments as datasets: counts in coordinate form, cells or spots, boundaries, transcripts.

All parts are text or Parquet, read by Spark from any store it reads. Counts in HDF5 need a library that is not assumed: the
folder of the same counts in coordinate form, which every export has beside it, is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.fields import Dataset
from tessera.sources.readers import long_counts, read_csv


def _either(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    """name.parquet, name.csv.gz or name.csv under path, the first there is."""
    jvm = spark._jvm.org.apache.hadoop.fs.Path
    for ending in (".parquet", ".csv.gz", ".csv"):
        at = jvm(f"{path}/{name}{ending}")
        if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return spark.read.parquet(f"{path}/{name}{ending}") if ending == ".parquet" else read_csv(spark, f"{path}/{name}{ending}")
    return None


def _needed(df: DataFrame | None, path: str, name: str) -> DataFrame:
    if df is None:
        raise ValueError(f"{path} has no {name}")
    return df


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(at, value): the lines of a small text file in order, from 0. A file of names is one task: its lines have no numbers."""
    return spark.read.option("wholetext", True).text(path).select(F.posexplode(F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n")).alias("at", "value"))


def read_coordinates(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(barcodes: row, name; features: var, name, id, kind; x: row, var, value) of a folder with matrix.mtx, barcodes.tsv and
    features.tsv, compressed or not. Genes are the rows of the file."""
    names = _lines(spark, f"{path}/barcodes.tsv*").select(F.col("at").cast("bigint").alias("row"), F.split("value", "\t")[0].alias("name"))
    parts = F.split("value", "\t")
    features = _lines(spark, f"{path}/features.tsv*").select(F.col("at").cast("bigint").alias("var"), F.coalesce(F.get(parts, F.lit(1)), parts[0]).alias("name"), parts[0].alias("id"), F.get(parts, F.lit(2)).alias("kind"))
    lines = spark.read.text(f"{path}/matrix.mtx*").where(~F.startswith("value", F.lit("%"))).withColumn("at", F.monotonically_increasing_id())
    head = lines.agg(F.min("at").alias("head"))  # the line of sizes; ids rise with the places in the file
    cell = F.split("value", r"\s+")
    entries = lines.crossJoin(F.broadcast(head)).where(F.col("at") > F.col("head"))  # one row
    x = entries.select((cell[1].cast("bigint") - 1).alias("row"), (cell[0].cast("bigint") - 1).alias("var"), cell[2].cast("double").alias("value"))
    return names, features, x.where("value <> 0")


def _renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})


def rings(vertices: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """(name, ring) of boundaries given as one vertex a row, in the order of the file's rows."""
    v = vertices.withColumn("at", F.monotonically_increasing_id())
    return v.groupBy(F.col(key).cast("string").alias("name")).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("ring"))


def read_xenium(spark: SparkSession, path: str) -> Dataset:
    """cells with their places in microns, counts of the kind `Gene Expression` and others, boundaries of cells and nuclei, and
    transcripts where they are."""
    names, features, x = read_coordinates(spark, f"{path}/cell_feature_matrix")
    cells = _needed(_either(spark, path, "cells"), path, "cells")
    cells = _renamed(cells.withColumn("cell_id", F.col("cell_id").cast("string")), {"cell_id": "name", "x_centroid": "x", "y_centroid": "y"})
    obs = names.join(cells, "name", "left")
    shapes = {}
    for part in ("cell_boundaries", "nucleus_boundaries"):
        if (v := _either(spark, path, part)) is not None:
            shapes[part] = rings(v, "cell_id", "vertex_x", "vertex_y").join(names, "name")
    if (t := _either(spark, path, "transcripts")) is not None:
        shapes["transcripts"] = _renamed(t, {"x_location": "x", "y_location": "y", "feature_name": "gene"})
    return Dataset(obs=obs, var=features, x=x, shapes=shapes)


def _spots(spark: SparkSession, path: str) -> DataFrame:
    found = _either(spark, path, "tissue_positions")
    if found is None:  # the older file has no header
        old = read_csv(spark, f"{path}/tissue_positions_list.csv", None)
        raw = spark.read.csv(f"{path}/tissue_positions_list.csv").toDF("barcode", "in_tissue", "array_row", "array_col", "pxl_row_in_fullres", "pxl_col_in_fullres") if "barcode" not in old.columns else old
        found = raw
    number = lambda c: F.col(c).cast("double")
    return found.select(F.col("barcode").alias("name"), F.col("in_tissue").cast("int").alias("in_tissue"), F.col("array_row").cast("int").alias("array_row"), F.col("array_col").cast("int").alias("array_col"), number("pxl_col_in_fullres").alias("x"), number("pxl_row_in_fullres").alias("y"))


def scale_factors(spark: SparkSession, path: str) -> dict[str, float]:
    """The numbers of scalefactors_json.json."""
    row = spark.read.option("multiLine", True).json(f"{path}/scalefactors_json.json").first()
    return {k: float(v) for k, v in row.asDict().items() if isinstance(v, (int, float))}


def read_visium(spark: SparkSession, path: str, counts: str = "filtered_feature_bc_matrix") -> Dataset:
    """Spots with their places in pixels of the full image, as circles, and maps to the smaller images. Spots that the counts do
    not name are left out."""
    names, features, x = read_coordinates(spark, f"{path}/{counts}")
    spots = _spots(spark, f"{path}/spatial")
    scale = scale_factors(spark, f"{path}/spatial")
    obs = names.join(spots, "name", "left")
    circles = obs.select("row", "name", "x", "y", F.lit(scale.get("spot_diameter_fullres", 1.0) / 2).alias("radius"))
    maps = {f"downscaled_{k}": (scale[f"tissue_{k}_scalef"], 0.0, 0.0, 0.0, scale[f"tissue_{k}_scalef"], 0.0) for k in ("hires", "lowres") if f"tissue_{k}_scalef" in scale}
    return Dataset(obs=obs, var=features, x=x, shapes={"spots": circles}, transforms=maps)


def read_visium_hd(spark: SparkSession, path: str, bin_size: str = "square_008um") -> Dataset:
    """The bins of one size under binned_outputs, as squares around their places."""
    own = f"{path}/binned_outputs/{bin_size}"
    ds = read_visium(spark, own)
    half = scale_factors(spark, f"{own}/spatial").get("bin_size_um", 8.0) / scale_factors(spark, f"{own}/spatial").get("microns_per_pixel", 1.0) / 2
    at = lambda i, j: F.struct((F.col("x") + i * half).alias("x"), (F.col("y") + j * half).alias("y"))
    squares = ds.obs.select("row", "name", F.array(at(-1, -1), at(1, -1), at(1, 1), at(-1, 1)).alias("ring"))
    return Dataset(obs=ds.obs, var=ds.var, x=ds.x, shapes={"bins": squares}, transforms=ds.transforms)


def read_steinbock(spark: SparkSession, path: str) -> Dataset:
    """Cells of all images: mean intensities of each marker (intensities/), places and measures (regionprops/), neighbours
    (neighbors/). A cell is an image and an object number."""
    def part(folder: str) -> DataFrame:
        df = spark.read.option("header", True).option("inferSchema", True).csv(f"{path}/{folder}/*.csv")
        image = F.regexp_extract(F.input_file_name(), r"([^/]*)\.csv$", 1)
        return df.withColumn("image", image)

    cell = lambda c: F.concat_ws("_", "image", F.col(c).cast("string")).alias("name")
    wide = part("intensities")
    props = part("regionprops")
    markers = [c for c in wide.columns if c not in ("Object", "image")]
    names = {"centroid-1": "x", "centroid-0": "y"}
    obs = props.select(cell("Object"), "image", *(F.col(f"`{c}`").alias(names.get(c, c.replace("-", "_"))) for c in props.columns if c not in ("Object", "image")))
    obs = obs.withColumn("row", F.xxhash64("name"))
    x = long_counts(wide.select(F.xxhash64(cell("Object")).alias("row"), *(F.col(f"`{c}`") for c in markers)), ["row"])
    var = spark.createDataFrame([(k, m) for k, m in enumerate(markers)], "var bigint, name string")
    graph = part("neighbors")
    ends = [F.xxhash64(F.concat_ws("_", "image", F.col(c).cast("string"))).alias(a) for c, a in (("Object", "i"), ("Neighbor", "j"))]
    return Dataset(obs=obs, var=var, x=x.join(F.broadcast(var), "name").select("row", "var", "value"), obsp={"neighbors": graph.select(*ends, F.col("Distance").cast("double").alias("w"))})  # the panel


def read_curio(spark: SparkSession, path: str) -> Dataset:
    """Beads with counts in coordinate form (a folder with matrix.mtx) and a table of places (*MatchedBeadLocation.csv)."""
    names, features, x = read_coordinates(spark, f"{path}/counts")
    at = spark.read.csv(f"{path}/*MatchedBeadLocation.csv").toDF("name", "x", "y").select("name", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return Dataset(obs=names.join(at.where("x is not null"), "name", "left"), var=features, x=x)


def summary(spark: SparkSession, path: str, columns: tuple[str, ...]) -> dict[str, str]:
    """The first row of an instrument's CSV of measures: the wanted columns that are there and not empty."""
    df = spark.read.option("header", True).csv(path)
    row = df.select(*(f"`{c}`" for c in columns if c in df.columns)).first()
    return {} if row is None else {k: v for k, v in row.asDict().items() if v not in (None, "")}


#: Readers by their full names: two families share short ones.
READERS = {
    "io.xenium": read_xenium, "io.visium": read_visium, "io.visium_hd": read_visium_hd, "io.steinbock": read_steinbock, "io.curio": read_curio,
    "read.visium": read_visium,
}


def reader(name: str):
    """The reader of a full name; a short one, which may mean several, is an error that names them."""
    if name in READERS:
        return READERS[name]
    raise ValueError(f"no reader {name!r}; there are {sorted(READERS)}")

"""Folders, collections, logs and the sidecar of a checkpoint: what lies where, read through Spark's file systems."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.catalog import migrated
from tessera.sources import writers

ENTRY = "path string, name string, is_dir boolean, bytes bigint, modified bigint, depth int"


def _statuses(spark: SparkSession, path: str) -> list:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return list(files.listStatus(at)) if files.exists(at) else []


def _entry(s, depth: int) -> tuple:
    p = s.getPath()
    return p.toString(), p.getName(), s.isDirectory(), s.getLen(), s.getModificationTime(), depth


def browse(spark: SparkSession, path: str, include_files: bool = True) -> DataFrame:
    """The entries of one folder, folders first, then by name; hidden ones are left out."""
    rows = [_entry(s, 0) for s in _statuses(spark, path) if not s.getPath().getName().startswith((".", "_"))]
    df = spark.createDataFrame([r for r in rows if r[2] or include_files], ENTRY)
    return df.orderBy(F.desc("is_dir"), "name")


def listed(spark: SparkSession, roots: list[str], depth: int = 4, most: int = 100_000) -> DataFrame:
    """Every entry under the roots down to a depth, hidden folders left out. The walk is the driver's; a tree of over `most`
    entries is an error, as its listing belongs in a table."""
    out, todo = [], [(r, 1) for r in roots]
    while todo:
        path, d = todo.pop()
        for s in _statuses(spark, path):
            if s.getPath().getName().startswith((".", "_")):
                continue
            out.append(_entry(s, d))
            if len(out) > most:
                raise ValueError(f"over {most} entries under {roots}")
            if s.isDirectory() and d < depth:
                todo.append((s.getPath().toString(), d + 1))
    return spark.createDataFrame(out, ENTRY)


def input_roots(spec: str | dict[str, str]) -> dict[str, str]:
    """Prefixes and their roots: one folder without a prefix, or a mapping (as a dict or JSON text)."""
    if isinstance(spec, str) and spec.lstrip().startswith("{"):
        spec = json.loads(spec)
    if isinstance(spec, str):
        return {"": spec.rstrip("/")}
    if not spec or not all(isinstance(k, str) and isinstance(v, str) and v for k, v in spec.items()):
        raise ValueError("roots are texts by prefix")
    return {k.strip("/"): v.rstrip("/") for k, v in sorted(spec.items())}


def collection(spark: SparkSession, path: str) -> DataFrame:
    """The checkpoints that a collection's index (a JSON list of objects) names, in its order."""
    return spark.read.option("multiLine", True).json(path).withColumn("at", F.monotonically_increasing_id()).orderBy("at").drop("at")


def logs(spark: SparkSession, path: str) -> DataFrame:
    """(record, line): the lines of the logs of records, a text file (compressed or not) for each, named by its record."""
    lines = spark.read.text(f"{path}/*")
    return lines.select(F.regexp_extract(F.input_file_name(), r"([^/]*?)(\.log)?(\.gz)?$", 1).alias("record"), F.col("value").alias("line"))


def figure(spark: SparkSession, path: str, plot: str, form: str) -> bytes:
    """The stored figure of a plot in one of its forms; an unknown one is an error that names those there are."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", f"{plot}.*").load(path).select("path", "content").collect()  # forms of a plot
    found = {r["path"].rpartition(".")[2]: bytes(r["content"]) for r in rows}
    if form not in found:
        raise ValueError(f"no {form} of {plot}; there are {sorted(found)}")
    return found[form]


def write_sidecar(tables: dict[str, DataFrame], path: str, transforms: dict[str, tuple], digest: str = "") -> dict:
    """Write manifest.json beside a checkpoint: its elements with their numbers of rows and columns, transforms and hash; the
    last thing written, so that a reader who finds it finds all it names."""
    manifest = {
        "elements": {k: {"rows": v.count(), "columns": v.columns} for k, v in sorted(tables.items())},
        "transforms": {k: list(map(float, m)) for k, m in sorted(transforms.items())}, "digest": digest,
    }
    spark = next(iter(tables.values())).sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest.json")
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    out.write(json.dumps(manifest, sort_keys=True).encode())
    out.close()
    return manifest


def load_checkpoint(spark: SparkSession, path: str, elements: list[str] | None = None) -> tuple[dict[str, DataFrame], dict]:
    """The tables of the last version of a checkpoint, and its state in the present form (empty states stay empty)."""
    tables, state = writers.load(spark, path, elements)
    return tables, migrated(state) if state else {}

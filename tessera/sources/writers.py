"""Checkpoints of named tables, the spatial order of elements and the gene-major copy of a matrix.

A checkpoint is a folder of element versions and of manifests. A manifest is written after the elements that it names,
so a reader sees either the old or the new state, on file systems and object stores alike; an update writes only the
elements that changed.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.polygons import ring_box
from tessera.operators.spatial import hilbert


def _manifests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("element string, at string, state string, version int").parquet(f"{path}/manifest")


def save(tables: dict[str, DataFrame], path: str, state: dict | None = None, keep: dict[str, str] | None = None, version: int = 1) -> None:
    """Write every table and then the manifest of this version; `keep` names elements that stay where they are."""
    if not tables and not keep:
        raise ValueError("a checkpoint needs a table")
    at = dict(keep or {})
    for name, df in tables.items():
        at[name] = f"elements/{name}/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(f"{path}/{at[name]}")
        spark = df.sparkSession
    if not tables:
        spark = SparkSession.active()
    rows = [(k, v, json.dumps(state or {}, sort_keys=True)) for k, v in sorted(at.items())]
    spark.createDataFrame(rows, "element string, at string, state string").coalesce(1).write.parquet(f"{path}/manifest/version={version}")


def load(spark: SparkSession, path: str, elements: list[str] | None = None, version: int | None = None) -> tuple[dict[str, DataFrame], dict]:
    """The tables (all, or those named: an unknown name is refused) and the state of a version, by default the last."""
    m = _manifests(spark, path)
    version = version or m.agg(F.max("version")).first()[0]
    rows = {r["element"]: r for r in m.where(F.col("version") == version).collect()}  # elements, not cells
    unknown = sorted(set(elements or ()) - set(rows))
    if unknown:
        raise KeyError(f"no {', '.join(unknown)}; there are {', '.join(sorted(rows))}")
    state = json.loads(next(iter(rows.values()))["state"])
    return {k: spark.read.parquet(f"{path}/{r['at']}") for k, r in rows.items() if elements is None or k in elements}, state


def update(tables: dict[str, DataFrame], path: str, state: dict | None = None) -> int:
    """Write only these tables under a new version, which keeps the others as they are; the number of the version."""
    spark = next(iter(tables.values())).sparkSession if tables else SparkSession.active()
    m = _manifests(spark, path)
    last = m.agg(F.max("version")).first()[0]
    rows = m.where(F.col("version") == last).collect()
    old = json.loads(rows[0]["state"])
    save(tables, path, old if state is None else state, {r["element"]: r["at"] for r in rows if r["element"] not in tables}, last + 1)
    return last + 1


def write_spatial(df: DataFrame, path: str, x: str = "x", y: str = "y", rows: int = 65_536, partitions: int | None = None) -> None:
    """Write df in Hilbert order, with row groups of at most `rows`: a range query on x and y reads few of them.

    Rows without a place come last. The box is found by one aggregate; the order is a range partitioning, no total sort."""
    box = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y)).agg(F.min(x), F.min(y), F.max(x), F.max(y)).first()
    box = tuple(box) if box[0] is not None else (0.0, 0.0, 1.0, 1.0)
    out = df.withColumn("hilbert", hilbert(F.col(x).cast("double"), F.col(y).cast("double"), box))
    key = F.col("hilbert").asc_nulls_last()
    out = out.repartitionByRange(partitions, key) if partitions else out.repartitionByRange(key)
    out.sortWithinPartitions(key).write.option("compression", "zstd").option("parquet.block.row.count.limit", rows).parquet(path)


def ring_box_column(ring: str = "ring"):
    """The bounding box of a ring column as a struct, null for null and empty rings: Parquet keeps statistics of its fields."""
    b = ring_box(F.col(ring))
    return F.when(F.size(ring) > 0, F.struct(*(v.alias(k) for v, k in zip(b, ("xmin", "ymin", "xmax", "ymax"))))).alias("bbox")


def group_rows(n: int) -> int:
    """Rows of a row group: a 256th of all, between 4,096 and 65,536."""
    return min(65_536, max(4_096, -(-n // 256)))


def write_shapes(df: DataFrame, path: str, ring: str = "ring", partitions: int | None = None) -> int:
    """Write footprints with a `bbox` struct in Hilbert order of their centres, small row groups, zstd; rows without a ring
    last. Writing what this wrote again gives the same. The rows of a row group are returned."""
    own = df.drop("bbox", "hilbert").withColumn("bbox", ring_box_column(ring))
    x, y = (F.col("bbox.xmin") + F.col("bbox.xmax")) / 2, (F.col("bbox.ymin") + F.col("bbox.ymax")) / 2
    s = own.agg(F.count("*").alias("n"), F.min(x).alias("a"), F.min(y).alias("b"), F.max(x).alias("c"), F.max(y).alias("d")).first()
    box = (s["a"], s["b"], s["c"], s["d"]) if s["a"] is not None else (0.0, 0.0, 1.0, 1.0)
    rows = group_rows(s["n"])
    key = F.col("hilbert").asc_nulls_last()
    out = own.withColumn("hilbert", hilbert(x, y, box))
    out = out.repartitionByRange(partitions, key) if partitions else out.repartitionByRange(key)
    out.sortWithinPartitions(key).drop("hilbert").write.mode("overwrite").option("compression", "zstd").option("parquet.block.row.count.limit", rows).parquet(path)
    return rows


def scan_shapes(spark: SparkSession, path: str, box: tuple[float, float, float, float], limit: int | None = None, columns: list[str] | None = None) -> DataFrame:
    """Footprints whose box meets a closed box: four range predicates on the fields of `bbox`, which the scan compares with the
    row groups' statistics. With a limit, none at all if there are more."""
    df = spark.read.parquet(path)
    hit = df.where((F.col("bbox.xmin") <= box[2]) & (F.col("bbox.xmax") >= box[0]) & (F.col("bbox.ymin") <= box[3]) & (F.col("bbox.ymax") >= box[1]))
    if limit is not None and hit.limit(limit + 1).count() > limit:
        hit = df.where("false")
    return hit.select(*columns) if columns else hit


def index_report(df: DataFrame, rows: int, by: str = "bbox") -> DataFrame:
    """(n, groups, xmin, ymin, xmax, ymax, selectivity) of boxes in their order, in groups of so many rows: bounds, and the
    upper median over groups of how many of all groups a group's box meets."""
    numbered = df.where(F.col(by).isNotNull()).select(f"{by}.*", F.floor(F.monotonically_increasing_id() / F.lit(rows)).alias("g"))
    boxes = numbered.groupBy("g").agg(F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"), F.count("*").alias("n"))
    a, b = boxes.select("g", *(F.col(c).alias(f"a_{c}") for c in ("xmin", "ymin", "xmax", "ymax"))), boxes.drop("n", "g")
    meet = (F.col("a_xmin") <= F.col("xmax")) & (F.col("a_xmax") >= F.col("xmin")) & (F.col("a_ymin") <= F.col("ymax")) & (F.col("a_ymax") >= F.col("ymin"))
    met = a.join(b, meet).groupBy("g").agg(F.count("*").alias("m"))  # row groups, not rows
    total = boxes.agg(F.sum("n").alias("n"), F.count("*").alias("groups"), F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"))
    shares = met.agg(F.array_sort(F.collect_list("m")).alias("ms"))
    return total.crossJoin(shares).select(*total.columns, (F.get("ms", F.floor(F.size("ms") / 2).cast("int")) / F.col("groups")).alias("selectivity"))  # one row each


def chunk_length(x: DataFrame) -> int:
    """Entries of a chunk of the gene-major copy: twice the 95th percentile of a gene's entries, as a power of two between
    16,384 and 1,048,576."""
    p = x.groupBy("var").agg(F.count("*").alias("n")).agg(F.percentile("n", F.lit(0.95))).first()[0] or 0.0
    return int(min(1 << 20, max(1 << 14, 1 << max(0, int(2 * p - 1).bit_length()))))


def select_elements(tables: dict[str, DataFrame], include: dict[str, list[str]] | None = None) -> dict[str, DataFrame]:
    """Tables by `facet/name`: a facet that include does not name keeps all, a named one exactly those listed; an unknown name
    or facet is an error."""
    facets = {k.partition("/")[0] for k in tables}
    out = dict(tables)
    for facet, names in (include or {}).items():
        have = {k.partition("/")[2] for k in tables if k.startswith(f"{facet}/")}
        unknown = sorted(set(names) - have)
        if unknown or facet not in facets:
            raise KeyError(f"no {facet} {', '.join(unknown)}; there are {', '.join(sorted(have)) or ', '.join(sorted(facets))}")
        out = {k: v for k, v in out.items() if not k.startswith(f"{facet}/") or k.partition("/")[2] in names}
    return out


def to_ipc(df: DataFrame) -> bytes:
    """A bounded result (a field, a page) as an Arrow IPC stream."""
    import io

    import pyarrow as pa

    held, sink = df.toArrow(), io.BytesIO()
    with pa.ipc.new_stream(sink, held.schema) as out:
        out.write_table(held)
    return sink.getvalue()


def write_gene_major(x: DataFrame, path: str, partitions: int | None = None) -> None:
    """The matrix (row, var, value) by gene and row, so that one gene is one short range of a file."""
    out = x.repartitionByRange(partitions, "var", "row") if partitions else x.repartitionByRange("var", "row")
    out.sortWithinPartitions("var", "row").write.option("compression", "zstd").parquet(path)


def trim(df: DataFrame, keep: list[str], always: list[str]) -> DataFrame:
    """Only the named columns and those that every table keeps; an unknown name is refused."""
    unknown = sorted(set(keep) - set(df.columns))
    if unknown:
        raise KeyError(f"no {', '.join(unknown)}; there are {', '.join(df.columns)}")
    return df.select(*[c for c in df.columns if c in keep or c in always])

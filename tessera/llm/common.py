"""Input tables, batches and component labelling used by the text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.shared import discard, folder, materialize, shared_dir

__all__ = ["bounded_batches", "connected_components", "discard", "folder", "materialize", "shared_dir", "table"]

#: ASCII white space between words, as a Java/RE2 regular expression.
SPACE = r"[\x20\x09-\x0D]"
#: Rows of an Arrow batch.
ROWS = 1000


def bounded_batches(spark: SparkSession) -> None:
    """Hold Arrow batches to ROWS rows, unless the session asks for other ones: with whole texts, Spark's 10,000 rows
    are hundreds of MB beside the heap and in each worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b: long): root is the least node that can be reached.

    Alternating large-star and small-star rounds (Kiveris et al., 2014) over DataFrames: a logarithmic number of
    rounds, the minimum of a star found with map-side combining, each round written to the shared folder. A star's
    centre joined with many leaves is an ordinary equi-join, which adaptive execution splits when it is skewed.
    No edges: no rows. Self-loops and repeated edges are ignored; a null end drops the edge.
    """
    pairs = (
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    pairs = materialize(pairs, "edges")
    state = _digest(pairs)
    while state[0]:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        parent = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(parent, "a").where("b <> m").select(F.col("b").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(parent.select(F.col("a").alias("u"), F.col("m").alias("v"))).distinct()
        last, pairs = pairs, materialize(small, "stars")
        discard(last)
        now = _digest(pairs)
        if now == state:
            break
        state = now
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    out = pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
    out.tessera_path = pairs.tessera_path
    return out


def _digest(pairs: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    row = pairs.agg(F.count("*"), F.bit_xor(h), F.sum(h.cast("decimal(20,0)"))).first()
    return tuple(row)

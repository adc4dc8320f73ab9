"""Fields, summaries, pages, searches, selections, regions and metadata of observation tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import scalars


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))


def numeric_summary(df: DataFrame, column: str) -> DataFrame:
    v = F.expr(f"try_cast({column} as double)")
    return df.select(v.alias("v")).agg(
        F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"), F.percentile("v", F.lit(0.5)).alias("median"), F.count_if(F.col("v").isNull()).alias("n_missing")
    )


def categorical_codes(df: DataFrame, column: str) -> DataFrame:
    """df with code: the place of the value among the sorted labels, -1 for null. Labels are a broadcast-sized
    dictionary only where they are few; the join is left to the planner."""
    labels = df.select(F.col(column).alias("label")).where("label is not null").distinct()
    codes = labels.withColumn("code", F.row_number().over(Window.orderBy("label")).cast("bigint") - 1)
    out = df.join(codes, df[column] == codes["label"], "left").drop("label")
    return out.withColumn("code", F.coalesce("code", F.lit(-1)))


def color_buckets(df: DataFrame, column: str) -> DataFrame:
    """df with bucket 0..255 between the least and the greatest finite value; 127 where all are equal."""
    v = F.col(column).cast("double")
    r = df.where(v.isNotNull() & ~F.isnan(v)).agg(F.min(v).alias("lo"), F.max(v).alias("hi"))
    t = F.when(F.col("hi") > F.col("lo"), (v - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.5)
    return df.crossJoin(F.broadcast(r)).withColumn("bucket", F.floor(t * 255).cast("bigint")).drop("lo", "hi")


def page(df: DataFrame, key: str, offset: int, limit: int) -> DataFrame:
    return df.orderBy(key).offset(max(0, offset)).limit(min(max(limit, 1), 200))


def search(df: DataFrame, name: str, key: str, text: str, limit: int = 50) -> DataFrame:
    """Names that contain the text, in any case: those that begin with it first, then in table order."""
    n, q = F.lower(F.col(name)), text.lower()
    hits = df.where(n.contains(q)) if q else df
    return hits.select(key, name, F.when(n.startswith(q), 0).otherwise(1).cast("bigint").alias("tier")).orderBy("tier", key).limit(limit)


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    n = df.groupBy(a, b).agg(F.count("*").alias("n"))
    return n.withColumn("proportion", F.col("n") / F.sum("n").over(Window.partitionBy(a)))


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """(chi2, dof, p) of independence of two columns; absent pairs count with their expectation; with one degree of freedom
    half is taken off each difference (Yates)."""
    n = df.groupBy(a, b).agg(F.count("*").alias("n"))
    ra, rb = n.groupBy(a).agg(F.sum("n").alias("na")), n.groupBy(b).agg(F.sum("n").alias("nb"))
    total = n.agg(F.sum("n").alias("nt"))
    grid = ra.crossJoin(rb).crossJoin(F.broadcast(total)).join(n, [a, b], "left").fillna(0, ["n"])  # labels x labels
    e = F.col("na") * F.col("nb") / F.col("nt")
    off = F.abs(F.col("n") - e)
    out = grid.agg(F.sum(off**2 / e).alias("chi2"), F.sum((off - F.least(off, F.lit(0.5))) ** 2 / e).alias("yates"), ((F.count_distinct(a) - 1) * (F.count_distinct(b) - 1)).alias("dof"))
    out = out.select(F.when(F.col("dof") == 1, F.col("yates")).otherwise(F.col("chi2")).alias("chi2"), "dof")
    return out.withColumn("p", F.when(F.col("dof") > 0, scalars.chi_square_tail(F.col("chi2"), F.col("dof"))))


def selection_stats(df: DataFrame, inside: Column, label: str, value: str) -> DataFrame:
    return df.groupBy(label).agg(
        F.count_if(inside).alias("n_inside"), F.count("*").alias("n_all"), F.avg(F.when(inside, F.col(value))).alias("mean_inside"), F.avg(F.when(~inside, F.col(value))).alias("mean_outside")
    )


def composition_of(df: DataFrame, inside: Column, label: str, most: int = 25) -> DataFrame:
    """(label, n_inside, n_all, share_inside, share_all) of the `most` labels that are most frequent inside, ties by label; a
    selection without a row is an error."""
    n = df.groupBy(label).agg(F.count_if(inside).alias("n_inside"), F.count("*").alias("n_all"))
    total = n.agg(F.sum("n_inside").alias("i"), F.sum("n_all").alias("a"))
    if not total.first()["i"]:
        raise ValueError("the selection holds no row")
    out = n.crossJoin(F.broadcast(total)).select(label, "n_inside", "n_all", (F.col("n_inside") / F.col("i")).alias("share_inside"), (F.col("n_all") / F.col("a")).alias("share_all"))  # one row
    return out.orderBy(F.desc("n_inside"), label).limit(most)


def recode(df: DataFrame, column: str, mapping: dict[str, str]) -> DataFrame:
    """All labels at once; blank and unchanged entries of the mapping are dropped, an empty one is refused."""
    pairs = {k: v for k, v in mapping.items() if k and v and k != v}
    if not pairs:
        raise ValueError("the mapping changes nothing")
    m = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    return df.withColumn(column, F.coalesce(m[F.col(column)], F.col(column)))


def annotate(df: DataFrame, inside: Column, column: str, label: str) -> DataFrame:
    """Rows inside get the label, whatever they had; the others keep theirs or are unassigned. A column of other than labels is
    not overwritten: that is an error."""
    if column in df.columns and df.schema[column].dataType.simpleString() != "string":
        raise ValueError(f"{column!r} holds {df.schema[column].dataType.simpleString()}, not labels")
    old = F.col(column) if column in df.columns else F.lit(None).cast("string")
    return df.withColumn(column, F.when(inside, F.lit(label)).otherwise(F.coalesce(old, F.lit("unassigned"))))


def lookup(labels: DataFrame, rows: DataFrame, key: str, first: str, second: str, pos: str) -> DataFrame:
    """labels with pos of the row whose `first` is the key, else whose `second` is it (the first such row), else -1."""
    a = rows.groupBy(F.col(first).alias(key)).agg(F.min(pos).alias("_a"))
    b = rows.groupBy(F.col(second).alias(key)).agg(F.min(pos).alias("_b"))
    return labels.join(a, key, "left").join(b, key, "left").withColumn("pos", F.coalesce("_a", "_b", F.lit(-1))).drop("_a", "_b")


def affine(x: Column, y: Column, m: tuple[float, float, float, float, float, float]) -> tuple[Column, Column]:
    a, b, c, d, e, f = m
    return a * x + b * y + c, d * x + e * y + f


def field_versions(history: DataFrame) -> DataFrame:
    """(field, version): how many completed records of history (seq, status, fields) changed each field."""
    return history.where("status = 'completed'").select(F.explode("fields").alias("field")).groupBy("field").agg(F.count("*").alias("version"))


def invalidated(plots: DataFrame, changed: DataFrame) -> DataFrame:
    """Plots (plot, refs) that refer to a changed field."""
    return plots.select("plot", F.explode("refs").alias("field")).join(changed, "field", "left_semi").select("plot").distinct()


def unresolved(needed: DataFrame, produced: DataFrame) -> DataFrame:
    """Keys (step, key) that no earlier step and no table provides."""
    p = produced.groupBy("key").agg(F.min("step").alias("made"))
    return needed.join(p, "key", "left").where("made is null or made >= step").select("step", "key")


def glob_pattern(glob: str) -> str:
    """A regular expression for * and ?, all else literal."""
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else "\\" + c if not c.isalnum() and c != "_" else c for c in glob) + "$"


def classify(listing: DataFrame, path: str, types: dict[str, str]) -> DataFrame:
    """listing with type: the first whose glob fits the path, null if none does."""
    out = F.lit(None).cast("string")
    for name, glob in reversed(types.items()):
        out = F.when(F.col(path).rlike(glob_pattern(glob)), name).otherwise(out)
    return listing.withColumn("type", out)

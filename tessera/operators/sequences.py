"""Ordered computations over lists of parts: offsets, islands, spans, budgets, samples, tails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_offsets(parts: DataFrame, order: str, size: str, by: list[str] | None = None) -> DataFrame:
    """parts with offset: the sum of the sizes before each one."""
    w = Window.partitionBy(*(by or [])).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("offset", F.coalesce(F.sum(size).over(w), F.lit(0)).cast("bigint"))


def islands(kept: DataFrame, number: str, by: list[str]) -> DataFrame:
    """by, first, last, n of each run of adjacent numbers."""
    w = Window.partitionBy(*by).orderBy(number)
    run = kept.withColumn("_run", F.col(number) - F.row_number().over(w))
    return run.groupBy(*by, "_run").agg(F.min(number).alias("first"), F.max(number).alias("last"), F.count("*").alias("n")).drop("_run")


def coalesced(spans: DataFrame, by: list[str], start: str = "start", end: str = "end", gap: int = 131_072) -> DataFrame:
    """by, start, end, n of spans joined where at most `gap` lies between them, overlaps included."""
    w = Window.partitionBy(*by).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col(start) - reach > gap), 1).otherwise(0)
    run = spans.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy(*by, "_run").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("_run")


def upper_median(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """by, median: the element at place n // 2 of the sorted values (the upper one of an even number)."""
    w = Window.partitionBy(*by)
    r = df.withColumn("_r", F.row_number().over(w.orderBy(value)) - 1).withColumn("_n", F.count("*").over(w))
    return r.where(F.col("_r") == F.floor(F.col("_n") / 2)).select(*by, F.col(value).alias("median"))


def within_budget(levels: list[tuple[str, list[float]]], budget: float) -> dict[str, int]:
    """How many of the finest levels each image drops so that all fit the budget: always the image whose finest kept
    level is largest, ties to the first; each keeps at least its last level."""
    drop = {name: 0 for name, _ in levels}
    sizes = dict(levels)
    while sum(sum(s[drop[n] :]) for n, s in sizes.items()) > budget:
        able = [n for n, s in sizes.items() if drop[n] < len(s) - 1]
        if not able:
            break
        drop[max(able, key=lambda n: sizes[n][drop[n]])] += 1
    return drop


def slots(labels: DataFrame, label: str, skipped: tuple[str, ...] = ("unassigned",)) -> DataFrame:
    """labels with slot: the place among the labels that are not skipped, sorted; null for skipped ones."""
    used = labels.where(~F.col(label).isin(*skipped)).select(label).distinct().withColumn("slot", F.row_number().over(Window.orderBy(label)).cast("bigint") - 1)
    return labels.join(used, label, "left")


def subsample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows by the order of an MD5 of seed and key; all of them if there are no more."""
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string"))), key).limit(n)


def strided(df: DataFrame, row: str, most: int) -> DataFrame:
    """Every k-th row by its number, with the least k that leaves at most `most` rows."""
    total = df.agg(F.count("*").alias("_n"))
    step = F.greatest(F.ceil(F.col("_n") / most), F.lit(1))
    return df.crossJoin(F.broadcast(total)).where(F.col(row) % step == 0).drop("_n")  # one row


def tail(df: DataFrame, order: str, n: int) -> DataFrame:
    """The last n rows, newest first."""
    return df.orderBy(F.desc(order)).limit(n)


def numeric_order(name: Column) -> Column:
    """A sort key of level names by their number, not their letters; names without a number come last."""
    return F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(name, r"(\d+)$", 1), F.lit("")), F.lit("99999999999999999999")).cast("bigint"), F.lit(2**62))


def page_of_parts(df: DataFrame, part: str, order: str, offset: int, limit: int) -> DataFrame:
    """A page of a table in the order of its parts: the parts' counts say which ones a page touches, the others are not
    sorted. limit is held to 1..200, offset to 0 or more; a page past the end is empty."""
    offset, limit = max(0, offset), min(max(limit, 1), 200)
    counts = running_offsets(df.groupBy(part).agg(F.count("*").alias("_n")), part, "_n")
    touched = counts.where((F.col("offset") < offset + limit) & (F.col("offset") + F.col("_n") > offset)).select(part, "offset")
    at = F.row_number().over(Window.partitionBy(part).orderBy(order)) - 1 + F.col("offset")
    return df.join(F.broadcast(touched.limit(limit + 1)), part).withColumn("at", at.cast("bigint")).where(F.col("at").between(offset, offset + limit - 1)).drop("offset")  # a page touches at most limit + 1 parts

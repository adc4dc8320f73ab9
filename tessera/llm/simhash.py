"""SimHash near-duplicates: 64-bit fingerprints of word 3-shingles, compared exactly in tiles.

Distinct fingerprints are dealt into tiles by population count (and by hash where a count holds many). Two tiles
meet in a task only if their population counts differ by at most the radius, since the count of differing bits is at
least the difference of the population counts. Inside a task the same bound skips pairs of sub-tiles, by the counts
of 32-bit halves (or 16-bit quarters in large tiles); what is left is compared by exclusive-or and bit counts in
numpy. A task returns a spanning forest of its links, never all pairs, so a group of n near copies costs n rows.

Sizes: a tile has about `tile_rows` fingerprints (8 bytes each); exact copies share one fingerprint and add nothing.
Nulls: a null text is like an empty one, fingerprint 0, which links like any other. Null or repeated doc_ids keep
their rows; component_id is the least non-null doc_id reachable. An empty table gives an empty result. Other columns
of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, connected_components, materialize

SEED = 42
RADIUS = 3
SHINGLE = 3
#: Bounds of a tile's rows: a tile pair is two arrays of at most 8 bytes x MOST_ROWS.
LEAST_ROWS, MOST_ROWS = 2048, 262_144


def simhash(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The fingerprint as a signed 64-bit integer; 0 without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    else:
        ends = (np.cumsum([len(w) + 1 for w in words]) - 1).tolist()
        starts = [0, *(e + 1 for e in ends)]
        h = xxhash.xxh64_intdigest
        hashes = np.fromiter((h(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :])), dtype=np.uint64)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 8192):
        part = hashes[at : at + 8192].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fp long): one row per row of docs."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = pa.array([simhash(x.as_py()) for x in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), fps], names=["key", "fp"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"key {kind}, fp bigint")


def tile_forest(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest between fingerprints (uint64) of a and b, or within a: (node, root) arrays."""
    nodes = a if b is None else np.concatenate([a, b])
    lab = np.arange(len(nodes))
    quarters = max(len(a), 0 if b is None else len(b)) > 32_768
    oa, ka, sa = _subtiles(a, quarters)
    ob, kb, sb = (oa, ka, sa) if b is None else _subtiles(b, quarters)
    shift = 0 if b is None else len(a)
    other = a if b is None else b
    for i in range(len(ka)):
        near = np.flatnonzero(np.abs(kb - ka[i]).sum(axis=1) <= radius)
        if b is None:
            near = near[near >= i]
        if not len(near):
            continue
        left = oa[sa[i] : sa[i + 1]]
        right = np.concatenate([ob[sb[j] : sb[j + 1]] for j in near])
        x, y = a[left], other[right]
        step = max(1, 1_000_000 // len(y))
        for at in range(0, len(x), step):
            hit = np.bitwise_count(x[at : at + step, None] ^ y[None, :]) <= radius
            if b is None or hit.any():
                r, c = np.nonzero(hit)
                lab = spread(lab, left[at + r], shift + right[c])
    out = np.flatnonzero(lab != np.arange(len(lab)))
    return nodes[out], nodes[lab[out]]


def _subtiles(fps: np.ndarray, quarters: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order, population counts of the segments of each sub-tile, and where each begins."""
    parts = fps.astype("<u8").view("<u2" if quarters else "<u4").reshape(len(fps), -1)
    counts = np.bitwise_count(parts).astype(np.int64)
    code = counts @ (64 ** np.arange(counts.shape[1]))
    order = np.argsort(code, kind="stable")
    first = np.flatnonzero(np.r_[True, np.diff(code[order]) != 0]) if len(fps) else np.array([], dtype=int)
    return order, counts[order[first]], np.r_[first, len(fps)]


def spread(lab: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The labels after links between i and j: the least of each component."""
    while True:
        a, b = lab[i], lab[j]
        differ = a != b
        if not differ.any():
            return lab
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        lab = lab.copy()
        np.minimum.at(lab, np.maximum(a, b), np.minimum(a, b))
        while (up := lab[lab]) is not lab and not np.array_equal(up, lab):
            lab = up


def _tile_pairs(nodes: DataFrame, radius: int) -> DataFrame:
    """Each fingerprint once for each pair of tiles it has to be in: (ta, tb, t, fp)."""
    nodes = nodes.withColumn("p", F.bit_count("fp").cast("int"))
    held = {r["p"]: r["n"] for r in nodes.groupBy("p").agg(F.count("*").alias("n")).collect()}  # at most 65 rows
    rows = min(MOST_ROWS, max(LEAST_ROWS, sum(held.values()) // 32))
    split = [max(1, -(-held.get(p, 0) // rows)) if p in held else 0 for p in range(65)]
    parts = F.array(*map(F.lit, split))
    at = F.pmod(F.xxhash64(F.col("fp"), F.lit("tile")), F.element_at(parts, F.col("p") + 1).cast("bigint"))
    own = (F.col("p") * F.lit(1 << 24).cast("bigint") + at).alias("t")
    rows = nodes.select("fp", "p", own)
    q = F.explode(F.sequence(F.greatest(F.col("p") - radius, F.lit(0)), F.least(F.col("p") + radius, F.lit(64))))
    rows = rows.select("fp", "t", q.alias("q")).withColumn("n", F.element_at(parts, F.col("q") + 1)).where("n > 0")
    rows = rows.select("fp", "t", "q", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("s"))
    rows = rows.withColumn("o", F.col("q") * F.lit(1 << 24).cast("bigint") + F.col("s"))
    return rows.select(F.least("t", "o").alias("ta"), F.greatest("t", "o").alias("tb"), "t", "fp")


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b) links that join the distinct fingerprints (fp) of nodes into the components of "radius or fewer bits"."""

    def compare(group: pa.Table) -> pa.Table:
        ta, tb = group["ta"][0].as_py(), group["tb"][0].as_py()
        t = group["t"].to_numpy()
        fp = group["fp"].to_numpy().astype(np.int64).view(np.uint64)
        a, b = tile_forest(fp[t == ta], None if ta == tb else fp[t == tb], radius)
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    return _tile_pairs(nodes, radius).groupBy("ta", "tb").applyInArrow(compare, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """(key, fp long, component: the least key that is reachable over links of `radius` or fewer differing bits)."""
    bounded_batches(docs.sparkSession)
    prints = materialize(fingerprints(docs, text, key), "fingerprints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("key").alias("least")), "nodes")
    roots = connected_components(links(nodes, radius)).select(F.col("node").alias("fp"), "root")
    joined = nodes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = joined.groupBy("root").agg(F.min("least").alias("component"))
    of = materialize(joined.join(least, "root").select("fp", "component"), "components")
    return prints.join(of, "fp").select(F.col("key").alias(key), "fp", "component")


def simhash_components(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    out = near_duplicates(docs)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


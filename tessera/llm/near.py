"""Near copies of a given similarity by SimHash: word shingles of five, exact Jaccard of at least 0.8.

The digest settings of `simhash` (three words, 64 bits, three bits' difference) find copies that are almost equal. Here
the fingerprints have 512 bits, of the distinct shingles of five words, and are compared at a radius of 120 bits: at a
similarity of 0.8 about 78 bits differ (binomial, standard deviation 8), so a pair is missed with a chance under 1e-5,
mostly by the first 64 bits, which are compared alone at first. Sets of under `FEW` shingles, where one shingle tells more
bits, have a wider radius. Texts of one set of shingles are one node (64-bit hash of the set).

Tiles. Nodes are dealt into classes of set size, a factor of 1.25 each, and by hash into tiles of bounded size. As a
similarity of 0.8 needs sizes within that factor, a tile meets those of its own and of the adjacent classes only. In a
task, blocks of rows and columns whose sizes or population counts are too far apart are skipped; the others are compared
by exclusive-or and bit counts in numpy. A task returns a forest of its hits, close ones first, never all pairs: a
group of n near copies costs about n pairs a tile pair.

Verification. The pairs of the forests are checked by the exact Jaccard of both sets. Where one fails, hits beside the
forest may link its two sides. The nodes of the components that failed pairs connect meet once more in tiles, with their
sets: every hit between different components is worked out there, in the task, until a pair links them; only such pairs
are returned. So no hit is left unsettled, and none of them is a row.

Rows are known by their doc_id and two hashes of their text, so only fingerprints are written, no texts. Null and empty
texts are copies of each other. Of rows with the same doc_id and text one is kept, if any; rows without a doc_id or with
repeated doc_ids are copies like any others. An empty table gives an empty result. Extra columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, connected_components, discard, materialize
from tessera.llm.simhash import spread

SHINGLE = 5
#: Least similarity as a fraction.
OVER, UNDER = 4, 5
LANES = 8
#: Most bits that differ: of all lanes, of those of sets under FEW shingles, of the first lane, and of nearly sure pairs.
RADIUS, WIDE, FIRST, SURE = 120, 150, 24, 72
FEW = 24
#: Bounds of a tile's rows, 88 bytes each, and most shingles of a tile that has its sets.
LEAST_ROWS, MOST_ROWS, MOST_SHINGLES = 16_384, 131_072, 2_000_000
#: Most rows of up to 32 bytes that are broadcast.
MOST_BROADCAST = 1_000_000
_U = np.uint64
_SALT = np.array([(k + 1) * 0x9E3779B97F4A7C15 % 2**64 for k in range(LANES)], dtype=np.uint64)


def shingles(text: bytes | None) -> np.ndarray:
    """The distinct hashes of the shingles, sorted; none without words."""
    words = (text or b"").lower().split()
    if not words:
        return np.array([], dtype=np.uint64)
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    ends = (np.cumsum([len(w) + 1 for w in words]) - 1).tolist()
    starts = [0, *(e + 1 for e in ends)]
    return np.unique(np.array([h(joined[a:b]) for a, b in zip(starts, ends[min(SHINGLE, len(words)) - 1 :])], dtype=np.uint64))


def lanes(hashes: np.ndarray) -> np.ndarray:
    """The fingerprint of a set of shingles: LANES numbers of 64 bits, zero without shingles."""
    counts = np.zeros(64 * LANES, dtype=np.int64)
    for at in range(0, len(hashes), 2048):
        x = hashes[at : at + 2048, None] ^ _SALT
        x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> _U(29))) * _U(0xC4CEB9FE1A85EC53)
        part = (x ^ (x >> _U(32))).astype("<u8").view(np.uint8).reshape(len(x), -1)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")


def _key(text: Column) -> list[Column]:
    """Two hashes of a text; null counts as empty."""
    t = F.coalesce(text, F.lit(""))
    return [F.xxhash64(t).alias("t1"), F.xxhash64(F.lit(7), t).alias("t2")]


def _signed(docs: DataFrame) -> DataFrame:
    """doc_id, the text's hashes, node, size of the set and fingerprint of each row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, size, own = [], [], []
            for x in batch.column(3):
                h = shingles(x.as_py())
                node.append(xxhash.xxh64_intdigest(h.tobytes()))
                size.append(len(h))
                own.append(lanes(h).tobytes())
            got = [pa.array(np.array(node, dtype=np.uint64).view(np.int64)), pa.array(size, pa.int32()), pa.array(own, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *got], names=["id", "t1", "t2", "node", "size", "lanes"])

    rows = docs.select(F.col("doc_id").alias("id"), *_key(F.col("text")), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, t1 bigint, t2 bigint, node bigint, size int, lanes binary")


def forest(lab: np.ndarray, i: np.ndarray, j: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(labels, numbers of the pairs picked): a forest of the pairs (i, j), those of least d first, beside the links
    that labels stand for already."""
    picked, at = [], np.arange(len(i))
    while True:
        a, b = lab[i[at]], lab[j[at]]
        apart = a != b
        at, a, b = at[apart], a[apart], b[apart]
        if not len(at):
            return lab, np.concatenate(picked) if picked else at
        order = np.argsort(d[at], kind="stable")
        ends = np.concatenate([a[order], b[order]])
        rank = np.concatenate([np.arange(len(order))] * 2)
        by = np.lexsort((rank, ends))
        first = np.r_[True, ends[by][1:] != ends[by][:-1]]
        best = at[order[np.unique(rank[by[first]])]]
        picked.append(best)
        lab = spread(lab, i[best], j[best])


class Tile:
    """Nodes in the order of their set sizes."""

    def __init__(self, part: pa.Table, sets: bool):
        size = part["size"].to_numpy()
        order = np.argsort(size, kind="stable")
        self.node, self.size = part["node"].to_numpy()[order], size[order].astype(np.int64)
        self.lanes = np.frombuffer(b"".join(part["lanes"].to_pylist()), dtype="<u8").reshape(-1, LANES)[order]
        self.bits = np.bitwise_count(self.lanes).sum(axis=1, dtype=np.int64)
        if sets:
            self.root = part["root"].to_numpy()[order]
            held = part["set"].combine_chunks()
            flat, first = held.values.to_numpy(), held.offsets.to_numpy()
            self.sets = [flat[first[k] : first[k + 1]] for k in order]


def hits(a: Tile, b: Tile | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, columns) of the pairs within the first lane's radius, block by block."""
    other, high, wide = a if b is None else b, 256, 4096
    for s in range(0, len(a.node), high):
        rows = slice(s, min(s + high, len(a.node)))
        low = np.searchsorted(other.size, -(-a.size[rows][0] * OVER // UNDER))
        top = np.searchsorted(other.size, a.size[rows][-1] * UNDER // OVER, side="right")
        x, near = a.lanes[rows, 0], a.bits[rows]
        for t in range(max(low, s) if b is None else low, top, wide):
            cols = slice(t, min(t + wide, top))
            bits = other.bits[cols]
            if bits.min() > near.max() + WIDE or near.min() > bits.max() + WIDE:
                continue
            r, c = np.nonzero(np.bitwise_count(x[:, None] ^ other.lanes[cols, 0][None]) <= FIRST)
            r, c = r + s, c + t
            if b is None:
                r, c = r[c > r], c[c > r]
            if len(r):
                yield r, c


def _near(a: Tile, other: Tile, r: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Those of the pairs that are within the radius in all bits and near enough in size, and their differing bits."""
    d = np.bitwise_count(a.lanes[r] ^ other.lanes[c]).sum(axis=1, dtype=np.int64)
    x, y = a.size[r], other.size[c]
    low = np.minimum(x, y)
    ok = (d <= np.where(low < FEW, WIDE, RADIUS)) & (UNDER * low >= OVER * np.maximum(x, y))
    return r[ok], c[ok], d[ok]


def _forests(a: Tile, b: Tile | None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of nodes: forests of the nearly sure hits and of all hits."""
    other, shift = (a, 0) if b is None else (b, len(a.node))
    total = len(a.node) + (0 if b is None else len(b.node))
    sure, any_ = np.arange(total), np.arange(total)
    out = []
    for r, c in hits(a, b):
        apart = sure[r] != sure[c + shift]
        r, c, d = _near(a, other, r[apart], c[apart])
        close = np.flatnonzero(d <= SURE)
        sure, p = forest(sure, r[close], c[close] + shift, d[close])
        p = close[p]
        any_ = spread(any_, r[p], c[p] + shift)
        any_, q = forest(any_, r, c + shift, d)
        p = np.union1d(p, q).astype(np.int64)
        if len(p):
            out.append((a.node[r[p]], other.node[c[p]]))
    return out


def _links(a: Tile, b: Tile | None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of nodes of different roots whose sets are similar, enough of them to join the roots that any pair joins."""
    other, every = a if b is None else b, [*a.sets, *([] if b is None else b.sets)]
    _, flat = np.unique(np.concatenate(every), return_inverse=True)
    codes = np.split(flat, np.cumsum([len(x) for x in every])[:-1])
    own, of = codes[: len(a.node)], codes if b is None else codes[len(a.node) :]
    marked = np.zeros(len(flat), dtype=np.int32)
    roots, lab = np.unique(np.r_[a.root, other.root], return_inverse=True)
    x, y = lab[: len(a.root)], lab[len(a.root) :]
    joined = np.arange(len(roots))
    out = []
    for r, c in hits(a, b):
        apart = joined[x[r]] != joined[y[c]]
        r, c, _ = _near(a, other, r[apart], c[apart])
        edge = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if len(r) else np.array([], dtype=np.int64)
        for lo, hi in zip(edge, [*edge[1:], len(r)]):
            i, js = r[lo], c[lo:hi]
            js = js[joined[y[js]] != joined[x[i]]]
            if not len(js):
                continue
            marked[own[i]] = 1
            first = np.cumsum([0, *(len(of[j]) for j in js[:-1])])
            n = np.add.reduceat(marked[np.concatenate([of[j] for j in js])], first)
            marked[own[i]] = 0
            js = js[UNDER * n >= OVER * (a.size[i] + other.size[js] - n)]
            _, one = np.unique(joined[y[js]], return_index=True)
            js = js[one]
            if len(js):
                joined = spread(joined, np.full(len(js), x[i]), y[js])
                out.append((np.full(len(js), a.node[i]), other.node[js]))
    return out


def _in_tiles(nodes: DataFrame, sets: bool) -> DataFrame:
    """(a, b) pairs of nodes: by `_forests`, or by `_links` of nodes that come with their roots and sets."""
    nodes = nodes.where("size > 0").withColumn("c", F.floor(F.log("size") / F.log(F.lit(1.2501))).cast("int"))
    held = {r["c"]: (r["n"], r["s"]) for r in nodes.groupBy("c").agg(F.count("*").alias("n"), F.sum("size").alias("s")).collect()}  # a row for each factor of 1.25
    rows = min(MOST_ROWS, max(LEAST_ROWS, sum(n for n, _ in held.values()) // 64))
    tiles = {c: max(-(-n // rows), -(-s // MOST_SHINGLES) if sets else 1) for c, (n, s) in held.items()}
    split = F.array(*(F.lit(tiles.get(c, 0)) for c in range(max(held, default=0) + 2)))
    names = ["node", "size", "lanes", *(("root", "set") if sets else ())]
    wide = F.lit(1 << 20).cast("bigint")
    at = nodes.withColumn("k", F.pmod(F.xxhash64("node", F.lit("tile")), F.greatest(F.get(split, F.col("c")), F.lit(1)).cast("bigint")).cast("int"))
    others = F.explode(F.sequence(F.greatest(F.col("c") - 1, F.lit(0)), F.col("c") + 1))
    at = at.select(*names, (F.col("c") * wide + F.col("k")).alias("t"), others.alias("q"))
    at = at.withColumn("n", F.get(split, F.col("q"))).where("n > 0").withColumn("s", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    other = F.col("q") * wide + F.col("s")
    at = at.select(*names, "t", F.least("t", other).alias("ta"), F.greatest("t", other).alias("tb"))

    def compare(group: pa.Table) -> pa.Table:
        t = group["t"].to_numpy()
        own = [Tile(group.filter(pa.array(t == k)), sets) for k in np.unique(t)]
        two = group["ta"][0].as_py() != group["tb"][0].as_py()
        if len(own) < 1 + two:
            out = []
        else:
            out = (_links if sets else _forests)(own[0], own[1] if two else None)
        a, b = (np.concatenate(x) for x in zip(*out)) if out else (np.array([], dtype=np.int64),) * 2
        return pa.table({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})

    return at.groupBy("ta", "tb").applyInArrow(compare, "a bigint, b bigint").distinct()


def _sets(docs: DataFrame, first: DataFrame) -> DataFrame:
    """(node, set): the hashes of the shingles of the texts of first (node, id, t1, t2), each text once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                own = pa.array([shingles(x.as_py()).view(np.int64) for x in part.column(1)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), own], names=["node", "set"])

    few = F.broadcast(first) if first.count() <= MOST_BROADCAST else first
    rows = docs.select(F.col("doc_id").alias("own"), *_key(F.col("text")), F.col("text").cast("binary").alias("text"))
    texts = rows.join(few, ["t1", "t2"]).where(F.col("own").eqNullSafe(F.col("id"))).groupBy("node").agg(F.first("text").alias("text"))
    return texts.mapInArrow(run, "node bigint, set array<bigint>")


def _checked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, ok): whether the sets of a and b have the least similarity; row by row, as sets can be long."""
    x, y = (sets.select(F.col("node").alias(n), F.col("set").alias(s)) for n, s in (("a", "x"), ("b", "y")))
    both = pairs.join(x, "a").join(y, "b").select("a", "b", F.size(F.array_intersect("x", "y")).alias("n"), (F.size("x") + F.size("y")).alias("m"))
    return both.select("a", "b", F.expr(f"{UNDER} * n >= {OVER} * (m - n)").alias("ok"))


def _roots(edges: DataFrame) -> DataFrame:
    found = connected_components(edges)
    out = materialize(found, "roots")
    discard(found)
    return out


def _ends(pairs: DataFrame, name: str) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias(name)).distinct()


def components(docs: DataFrame, rows: DataFrame) -> DataFrame | None:
    """(node, root) of the nodes of rows (as `_signed` of docs) that have links; None if none has."""
    firsts = [F.first(c).alias(c) for c in ("size", "lanes")]
    nodes = rows.groupBy("node").agg(*firsts, F.min(F.struct(F.col("id").isNull().alias("none"), "id", "t1", "t2")).alias("x"))
    nodes = materialize(nodes.select("node", "size", "lanes", "x.id", "x.t1", "x.t2"), "nodes")
    pairs = materialize(_in_tiles(nodes, False), "candidates")
    if pairs.isEmpty():
        return None
    sets = materialize(_sets(docs, nodes.join(_ends(pairs, "node"), "node", "left_semi").select("node", "id", "t1", "t2")), "sets")
    checked = materialize(_checked(pairs, sets), "checked")
    edges = checked.where("ok").select("a", "b")
    roots = _roots(edges)
    failed = checked.where("not ok")
    if not failed.isEmpty():
        of = lambda t, c: t.join(roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")), c, "left").withColumn(f"root_{c}", F.coalesce(f"root_{c}", c))
        between = of(of(failed, "a"), "b").where("root_a <> root_b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
        live = materialize(_ends(between, "root"), "live")
        if not live.isEmpty():
            # Every node of a component has its set already, as a pair of it was checked.
            all_roots = nodes.select("node", "size", "lanes").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).join(live, "root", "left_semi")
            more = materialize(_in_tiles(all_roots.join(sets, "node"), True), "more")
            if not more.isEmpty():
                roots = _roots(edges.unionByName(more))
    for done in (nodes, pairs, sets, checked):
        discard(done)
    return roots


def dedup(docs: DataFrame) -> DataFrame:
    """One row of docs of each component of near copies: that of the least doc_id, of a null one if there is no other."""
    bounded_batches(docs.sparkSession)
    rows = materialize(_signed(docs), "signed")
    light = rows.select("id", "t1", "t2", "node")
    roots = components(docs, rows)
    light = light.withColumn("root", F.col("node")) if roots is None else light.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "t1", "t2")).alias("x")
    first = light.groupBy("root").agg(least).select("root", "x.id", "x.t1", "x.t2")
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"f.{c}")) for c in ("id", "t1", "t2")]
    both = light.alias("l").join(first.alias("f"), "root").select("l.id", "l.t1", "l.t2", (same[0] & same[1] & same[2]).alias("kept"))
    # Keys that are not to be kept at all, and kept ones that several rows have, of which one stays.
    keys = both.groupBy("id", "t1", "t2").agg(F.first("kept").alias("kept"), F.count("*").alias("n"))
    keys = materialize(keys.where("not kept or n > 1").select(F.col("id").alias("k_id"), F.col("t1").alias("k1"), F.col("t2").alias("k2"), "kept"), "keys")
    own = docs.select(F.struct("*").alias("row"), *_key(F.col("text")))
    few = F.broadcast(keys) if keys.count() <= MOST_BROADCAST else keys
    at = (F.col("t1") == F.col("k1")) & (F.col("t2") == F.col("k2")) & F.col("row.doc_id").eqNullSafe(F.col("k_id"))
    alone = own.join(few, at, "left_anti").select("row.*")
    repeated = own.join(F.broadcast(keys.where("kept")) if keys.count() <= MOST_BROADCAST else keys.where("kept"), at)
    if keys.where("kept").isEmpty():
        return alone
    return alone.unionByName(repeated.groupBy("k1", "k2", "k_id").agg(F.first("row").alias("row")).select("row.*"))

"""Removal of repeated substrings: every byte covered by a string of `LENGTH` bytes that also starts somewhere else.

Candidates. Each window of LENGTH bytes has an anchor, its 32-byte string of least hash, leftmost among equals; equal
windows have equal anchors at equal places. A run of windows with the same anchor is a context (at most 2 LENGTH
bytes). Anchors are gathered by hash: one that occurs once has no repeated window; contexts that are equal as a whole
are repeated as a whole and count once from there on; what is left are the different contexts of one anchor. Two of them
can share a window only if they agree on half of what a window has beside its anchor, all to the left or all to the
right: contexts whose hashes of both sides are like no other's have no repeated window either.

Comparison. Those contexts are laid out in blocks of a bounded size. On the Burrows-Wheeler transform of a block,
breadth-first backward extension of intervals (Beller et al., 2013) derives the common prefixes of neighbouring suffixes
by increasing value and stops at LENGTH: neighbours without a value by then share LENGTH bytes. An anchor with over
`HOT` different contexts fills several blocks; one window of each class of such a block is then counted by its
128-bit hash across blocks.

Equal texts are one text (by a 128-bit hash) until the last step and each task sends a text once, so a group of copies of
any size neither shuffles nor sorts as such; texts with copies of LENGTH bytes or more go as a whole. Contexts that are
equal as a whole among the texts a task works on at once are settled there, and one of them goes on to the others. The last
join, of documents with the spans of their texts, may be skewed by copies and is split by adaptive execution.
Null texts are empty. Null or repeated doc_ids keep their rows; extra columns are ignored; an empty table gives an empty
result. Very long texts are cut into overlapping pieces, which changes no result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, materialize

LENGTH = 200
GRAM = 32
PIECE = 2 << 20  # bytes worked on at once
BLOCK_BYTES = 2 << 20
HOT = 4096  # contexts of LENGTH..2 LENGTH bytes: at most BLOCK_BYTES or so
ANCHORS = 300_000  # of a bucket
SEEN = 500_000  # text keys that a task remembers
_U = np.uint64
_LOW = _U((1 << 24) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(29))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of the GRAM-byte strings at each place of data (uint8), by doubling."""
    h = _mix(data.astype(np.uint64) + _U(0x9E3779B97F4A7C15))
    n = 1
    while n < GRAM:
        h = _mix(h[:-n] * _U(0xBF58476D1CE4E5B9) + h[n:])
        n *= 2
    return h


def anchors(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window, last window, anchor's place) of each run of windows with one anchor, inside pieces of
    data."""
    h = gram_hashes(data)
    m = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
    span, n = length - GRAM + 1, 1
    while n * 2 <= span:
        m = np.minimum(m[:-n], m[n:])
        n *= 2
    if span > n:
        m = np.minimum(m[: len(m) - (span - n)], m[span - n :])
    count = sizes - length + 1
    base = np.repeat(starts - np.r_[0, np.cumsum(count)[:-1]], count)
    s = base + np.arange(len(base))
    p = (m[s] & _LOW).astype(np.int64)
    first = np.r_[True, (p[1:] != p[:-1]) | (s[1:] != s[:-1] + 1)]
    at = np.flatnonzero(first)
    return h[p[at]], s[at], s[np.r_[at[1:] - 1, len(s) - 1]], p[at]


def sides(data: np.ndarray, lo: np.ndarray, hi: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (32 bits, 0 for none) of the bytes before and after the anchor at `at` of contexts of windows lo to hi: half of
    what a window has beside its anchor, 0 where the context has fewer."""
    n = (length - GRAM) // 2 // 4 * 4
    left, right = np.zeros(len(at), dtype=np.uint32), np.zeros(len(at), dtype=np.uint32)
    if n < 4:
        return left + np.uint32(1), right + np.uint32(1)
    weights = _mix(np.arange(1, n // 4 + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)) | _U(1)
    views = np.lib.stride_tricks.sliding_window_view(data, n) if len(data) >= n else None
    for out, has, first in ((left, at - lo >= n, at - n), (right, hi + length - at - GRAM >= n, at + GRAM)):
        own = np.flatnonzero(has)
        for k in range(0, len(own), 8192):
            some = own[k : k + 8192]
            words = np.ascontiguousarray(views[first[some]]).view("<u4").astype(np.uint64)
            out[some] = (_mix((words * weights).sum(axis=1, dtype=np.uint64)) >> _U(32)).astype(np.uint32) | np.uint32(1)
    return left, right


def suffix_order(codes: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling from seven symbols on; codes are 0..257 and end with the only 0."""
    n = len(codes)
    padded = np.r_[codes.astype(np.int64), np.zeros(6, dtype=np.int64)]
    key = np.zeros(n, dtype=np.int64)
    for i in range(7):
        key = key * 258 + padded[i : i + n]
    h = 7
    while True:
        order = np.argsort(key, kind="stable")
        k = key[order]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(np.r_[0, k[1:] != k[:-1]])
        if rank[order[-1]] == n - 1:
            return order
        after = np.zeros(n, dtype=np.int64)
        after[: n - h] = rank[h:] + 1
        key = rank * (n + 1) + after
        h *= 2


def bounded_prefixes(bwt: np.ndarray, minimum: int) -> np.ndarray:
    """For each i in 1..n-1 whether the suffixes i - 1 and i of the order share at least `minimum` symbols."""
    n = len(bwt)
    order = np.argsort(bwt, kind="stable")
    lf = np.empty(n, dtype=np.int64)
    lf[order] = np.arange(n)
    symbols, first = np.unique(bwt[order], return_index=True)
    places = np.split(order, first[1:])
    known = np.zeros(n + 1, dtype=bool)
    known[[0, n]] = True
    lb, rb = np.array([0]), np.array([n - 1])
    for _ in range(minimum):
        size = rb - lb + 1
        one, few = size == 1, (size > 1) & (size <= 16)
        los, his = [lf[lb[one]]], [lf[lb[one]]]
        if few.any():
            a, m = lb[few], size[few]
            i = np.repeat(a - np.r_[0, np.cumsum(m)[:-1]], m) + np.arange(m.sum())
            tag = np.repeat(np.arange(len(a)), m) * 512 + bwt[i]
            o = np.argsort(tag, kind="stable")
            t = tag[o]
            new = np.r_[True, t[1:] != t[:-1]]
            last = np.r_[new[1:], True]
            los.append(lf[i[o[new]]])
            his.append(lf[i[o[last]]])
        many = size > 16
        if many.any():
            a, b = lb[many], rb[many]
            for c, at in zip(first, places):
                x, y = np.searchsorted(at, a), np.searchsorted(at, b, side="right")
                ok = y > x
                los.append(c + x[ok])
                his.append(c + y[ok] - 1)
        lb, rb = np.concatenate(los), np.concatenate(his)
        new = ~known[rb + 1]
        lb, rb = lb[new], rb[new]
        known[rb + 1] = True
        if not len(lb):
            break
    return ~known[1:n]


def repeated_windows(contexts: list[bytes], minimum: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, offset, class) of all windows of `minimum` bytes of the contexts; classes are of equal windows."""
    parts, starts, at = [], [], 0
    for i, c in enumerate(contexts):
        tail = np.array([1, 2 + (i >> 24 & 255), 2 + (i >> 16 & 255), 2 + (i >> 8 & 255), 2 + (i & 255)], dtype=np.int16)
        parts += [np.frombuffer(c, dtype=np.uint8).astype(np.int16) + 2, tail]
        starts.append(at)
        at += len(c) + 5
    codes = np.concatenate([*parts, np.zeros(1, dtype=np.int16)])
    order = suffix_order(codes)
    shared = bounded_prefixes(codes[order - 1], minimum)
    number = np.cumsum(np.r_[0, ~shared])
    starts, sizes = np.array(starts), np.array([len(c) for c in contexts])
    of = np.searchsorted(starts, order, side="right") - 1
    offset = order - starts[of]
    inside = offset <= sizes[of] - minimum
    return of[inside], offset[inside], number[inside]


def _texts(docs: DataFrame) -> DataFrame:
    t = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    both = F.xxhash64("t").alias("tid"), F.xxhash64(F.lit(7), F.col("t")).alias("tie")  # one hash, and one with another seed
    return docs.select("doc_id", t.alias("t")).select("doc_id", "t", *both, F.octet_length("t").cast("bigint").alias("n"))


def _anchor_rows(texts: DataFrame, buckets: int, length: int) -> DataFrame:
    """Anchors of texts as packed columns, by hash bucket: each row those of some texts."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, int, int, bytes]]]:
        seen: set = set()
        held, size = [], 0
        for batch in batches:
            for tid, tie, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if (tid, tie) in seen:
                    continue
                text = x.as_py()
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add((tid, tie))
                for at in range(0, len(text) - length + 1, PIECE):
                    part = text[at : at + PIECE + length - 1]
                    held.append((tid, tie, at, part))
                    size += len(part)
                    if size >= PIECE:
                        yield held
                        held, size = [], 0
        if held:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_bucket = -1 - (TaskContext.get().partitionId() << 32)
        for number, held in enumerate(pieces(batches)):
            sizes = np.array([len(p) for *_, p in held])
            starts = np.cumsum(sizes) - sizes
            joined = b"".join([p for *_, p in held])
            data = np.frombuffer(joined, dtype=np.uint8)
            ah, lo, hi, place = anchors(data, starts, sizes, length)
            left, right = sides(data, lo, hi, place, length)
            of = np.searchsorted(starts, lo, side="right") - 1
            view, h = memoryview(joined), xxhash.xxh3_64_intdigest
            ch = np.fromiter((h(view[a:b]) for a, b in zip(lo.tolist(), (hi + length).tolist())), dtype=np.uint64, count=len(lo))
            tid, tie, at = (np.array(x, dtype=np.int64)[of] for x in list(zip(*held))[:3])
            x = {"ah": ah, "ch": ch, "tid": tid, "tie": tie, "s": at + lo - starts[of], "m": (hi - lo + length).astype(np.uint16), "left": left, "right": right}
            order = np.lexsort((ch, ah))
            first = np.r_[True, (ah[order][1:] != ah[order][:-1]) | (ch[order][1:] != ch[order][:-1])]
            again = np.zeros(len(ah), dtype=bool)  # equal as a whole to an earlier one of these texts
            again[order] = ~first
            many = np.bincount(np.cumsum(first) - 1)[np.cumsum(first) - 1] > 1
            x["more"] = np.zeros(len(ah), dtype=np.uint8)
            x["more"][order] = many
            b = np.where(again, buckets, (ah % _U(buckets)).astype(np.int64))
            order = np.argsort(b, kind="stable")
            edge = np.searchsorted(b[order], np.arange(buckets + 2))
            own = np.flatnonzero(np.diff(edge))
            cut = [order[edge[k] : edge[k + 1]] for k in own]
            out = {"bucket": pa.array(np.where(own == buckets, own_bucket - number, own), pa.int64())}
            for name, v in x.items():
                out[name] = pa.array([v[i].tobytes() for i in cut], pa.binary())
            yield pa.RecordBatch.from_pydict(out)

    rows = texts.where(F.col("n") >= length).select("tid", "tie", "t")
    return rows.mapInArrow(run, "bucket bigint, " + ", ".join(f"{k} binary" for k in _PACKED))


_PACKED = {"ah": np.uint64, "ch": np.uint64, "tid": np.int64, "tie": np.int64, "s": np.int64, "m": np.uint16, "left": np.uint32, "right": np.uint32, "more": np.uint8}
_FOUND = "tid bigint, tie bigint, s bigint, e bigint, ask boolean, single boolean, ah bigint, salt int"


def _meet(group: pa.Table) -> pa.Table:
    """Spans of contexts that are equal as a whole, and the different contexts of one anchor, one of each (ask)."""
    x = {k: np.frombuffer(b"".join(group[k].to_pylist()), dtype=t) for k, t in _PACKED.items()}
    settled = group["bucket"][0].as_py() < 0
    order = np.lexsort((x["s"], x["tie"], x["tid"], x["ch"], x["ah"]))
    x = {k: v[order] for k, v in x.items()}
    differ = lambda *names: np.r_[True, np.any([x[k][1:] != x[k][:-1] for k in names], axis=0)]
    once = differ("ah", "ch", "tid", "tie", "s")  # a text sent by several tasks counts once
    # A text that two tasks sent has two marks: it is repeated if either says so.
    more = np.logical_or.reduceat(x["more"] > 0, np.flatnonzero(once))
    x = {k: v[once] for k, v in x.items()}
    anchor, context = differ("ah"), differ("ah", "ch")
    a_no, c_no = np.cumsum(anchor) - 1, np.cumsum(context) - 1
    repeated = (np.bincount(c_no) > 1) | (np.bincount(c_no, weights=more) > 0)
    repeated = np.ones(len(c_no), dtype=bool) if settled else repeated[c_no]
    first = np.flatnonzero(context)
    alike = np.zeros(len(first), dtype=bool)
    for side in ("left", "right"):
        key = (a_no[first].astype(np.uint64) << _U(32)) | x[side][first]
        _, back, n = np.unique(key, return_inverse=True, return_counts=True)
        alike |= (x[side][first] > 0) & (n[back] > 1)
    ask = np.zeros(len(context), dtype=bool)
    ask[first] = alike & (not settled)
    c_of_a = np.bincount(a_no[ask], minlength=a_no[-1] + 1)[a_no]
    before = np.cumsum(ask) - ask
    rank = before - before[np.flatnonzero(anchor)][a_no]  # number of the context under its anchor
    whole = {k: x[k].astype(np.int64) for k in ("tid", "tie", "s", "m")}
    out = []
    for sel, asked in ((repeated, False), (ask, True)):
        salt = np.where(c_of_a > HOT, rank // HOT, -1)[sel]
        k = int(sel.sum())
        out.append(pa.table({
            "tid": whole["tid"][sel], "tie": whole["tie"][sel], "s": whole["s"][sel], "e": (whole["s"] + whole["m"])[sel], "ask": np.full(k, asked), "single": ~repeated[sel],
            "ah": x["ah"][sel].view(np.int64), "salt": salt.astype(np.int32),
        }))
    return pa.concat_tables(out)


_BLOCK = "tid bigint, tie bigint, s bigint, e bigint, w1 bigint, w2 bigint"


def _compare(length: int):
    def run(group: pa.Table) -> pa.Table:
        tid, tie, s = (group[k].to_numpy() for k in ("tid", "tie", "s"))
        single, hot, ctx = group["single"].to_numpy(zero_copy_only=False), group["hot"][0].as_py(), group["ctx"].to_pylist()
        _, first = np.unique(np.stack([tid, tie, s]), axis=1, return_index=True)  # a text may come from several documents
        tid, tie, s, single, ctx = tid[first], tie[first], s[first], single[first], [ctx[i] for i in first]
        of, offset, number = repeated_windows(ctx, length)
        size = np.bincount(number) if len(number) else np.array([], dtype=int)
        mark = (size[number] > 1) & single[of] if len(number) else np.array([], dtype=bool)
        o = np.lexsort((offset[mark], of[mark]))
        c, w = of[mark][o], offset[mark][o]
        new = np.r_[True, (c[1:] != c[:-1]) | (w[1:] != w[:-1] + 1)] if len(c) else np.array([], dtype=bool)
        last = np.r_[new[1:], True] if len(c) else new
        c0 = c[new]
        rows = [tid[c0], tie[c0], s[c0] + w[new], s[c0] + w[last] + length]
        h1, h2 = np.full(len(c0), None, dtype=object), np.full(len(c0), None, dtype=object)
        if hot and len(number):
            _, rep = np.unique(number, return_index=True)
            c, w = of[rep], offset[rep]
            both = [xxhash.xxh3_128_intdigest(ctx[i][k : k + length]) for i, k in zip(c.tolist(), w.tolist())]
            signed = lambda v: v - (1 << 64) if v >> 63 else v
            alone = (size[number[rep]] == 1) & single[c]
            rows = [np.r_[a, b] for a, b in zip(rows, (tid[c], tie[c], np.where(alone, s[c] + w, -1), np.where(alone, s[c] + w + length, -1)))]
            h1 = np.r_[h1, np.array([signed(v >> 64) for v in both], dtype=object)]
            h2 = np.r_[h2, np.array([signed(v & (1 << 64) - 1) for v in both], dtype=object)]
        names = ("tid", "tie", "s", "e")
        return pa.table({k: pa.array(v, pa.int64()) for k, v in zip(names, rows)} | {"w1": pa.array(h1.tolist(), pa.int64()), "w2": pa.array(h2.tolist(), pa.int64())})

    return run


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """(keys: tid, tie, copies of each text; spans: tid, tie, s, e of repeated strings in texts, overlapping ones as well)."""
    texts = _texts(docs)
    keys = materialize(texts.groupBy("tid", "tie").agg(F.count("*").alias("copies"), F.min("doc_id").alias("one"), F.first("n").alias("n")), "texts")
    total = keys.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, -(-total * 2 // (length - GRAM + 2) // ANCHORS))
    found = materialize(_anchor_rows(texts, buckets, length).groupBy("bucket").applyInArrow(_meet, _FOUND), "anchors")
    asked = found.where("ask")
    volume = asked.agg(F.sum(F.col("e") - F.col("s"))).first()[0] or 0
    blocks = max(1, -(-volume // BLOCK_BYTES))
    block = F.when(F.col("salt") < 0, F.pmod(F.xxhash64("ah"), F.lit(blocks))).otherwise(F.shiftrightunsigned(F.xxhash64("ah", "salt"), 2) + blocks)
    wanted = asked.select("tid", "tie", F.struct("s", "e", "single", block.alias("block"), (F.col("salt") >= 0).alias("hot")).alias("x"))
    wanted = wanted.groupBy("tid", "tie").agg(F.collect_list("x").alias("xs")).join(keys.select("tid", "tie", "one"), ["tid", "tie"])
    at = texts.join(wanted, ["tid", "tie"]).where(F.col("doc_id").eqNullSafe(F.col("one"))).select("tid", "tie", "t", F.explode("xs").alias("x"))
    ctx = at.select("tid", "tie", "x.*", F.substring("t", F.col("x.s").cast("int") + 1, (F.col("x.e") - F.col("x.s")).cast("int")).alias("ctx")).drop("e")
    compared = materialize(ctx.groupBy("block").applyInArrow(_compare(length), _BLOCK), "compared")
    across = compared.where("w1 is not null").groupBy("w1", "w2").agg(F.count("*").alias("c"), F.collect_list(F.when(F.col("s") >= 0, F.struct("tid", "tie", "s", "e"))).alias("xs"))
    across = across.where("c > 1").select(F.explode("xs").alias("x")).select("x.*")
    spans = found.where("not ask").select("tid", "tie", "s", "e").unionByName(compared.where("w1 is null").select("tid", "tie", "s", "e")).unionByName(across)
    return keys, spans


def remove_repeats(docs: DataFrame, length: int = LENGTH, digests: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256, or the kept bytes (kept) without `digests`."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    bounded_batches(docs.sparkSession)
    keys, spans = repeated_spans(docs, length)
    by_text = spans.distinct().groupBy("tid", "tie").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("xs"))
    of = keys.join(by_text, ["tid", "tie"], "left").select("tid", "tie", (F.col("copies") > 1).alias("copied"), "xs").where("copied or xs is not null")
    rows = _texts(docs).join(of, ["tid", "tie"], "left").select("doc_id", "t", "copied", "xs.s", "xs.e")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text, copied, ss, es in zip(batch.column(1), *(batch.column(i).to_pylist() for i in (2, 3, 4))):
                text = text.as_py()
                if copied and len(text) >= length:
                    ss, es = [0], [len(text)]
                kept, at, runs = [], 0, 0
                gone_from, gone_to = -1, -1
                for s, e in zip(ss or [], es or []):
                    if s > gone_to:
                        if gone_to >= 0:
                            kept.append(text[at:gone_from])
                            at = gone_to
                        runs += 1
                        gone_from, gone_to = s, e
                    else:
                        gone_to = max(gone_to, e)
                if gone_to >= 0:
                    kept.append(text[at:gone_from])
                    at = gone_to
                kept.append(text[at:])
                rest = b"".join(kept)
                out.append((len(text), len(text) - len(rest), runs, hashlib.sha256(rest).hexdigest() if digests else rest))
            cols = list(zip(*out)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string() if digests else pa.binary())], names=["k", "a", "b", "c", "d"])

    got = rows.mapInArrow(run, f"k {kind}, a bigint, b bigint, c bigint, d {'string' if digests else 'binary'}")
    return got.select(F.col("k").alias("doc_id"), F.col("a").alias("n_bytes"), F.col("b").alias("n_removed"), F.col("c").alias("n_spans"), F.col("d").alias("kept_sha256" if digests else "kept"))

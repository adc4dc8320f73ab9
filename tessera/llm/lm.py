"""Language-model scores from a log-frequency Bloom filter (Talbot and Osborne, 2007).

The filter holds quantised counts of all word pairs of the training texts: a pair of level q is
entered with each level 1 to q, and its count is found by probing levels until one is missing. The probability of a
word is a mixture of the pair estimate and the add-one estimate of the word alone; a text's probability is the mean
over the mixture weights `SHARES`, so it is at most a factor 1/len(SHARES) below the word model's. Lower-bound counts
keep the pair estimates of a context at a sum of at most one, but for false positives (about 1 % of absent pairs).

The corpus is cut once into chunks of about `CHUNK` bytes, written to the shared folder as token numbers and word
hashes (56 bits). Word counts are exact up to hash collisions: each chunk sends its distinct words' hashes to hash
buckets and gets their corpus counts back, so no vocabulary is broadcast. Pair counts are added up in hash buckets of
bounded size. Filter segments are broadcast in groups of at most `MOST_FILTER` bytes; a larger filter takes several
passes over the chunks, each probing the pairs of its segments, with the same results. A chunk's tokens are probed in
slices of `SLICE`, which bounds a worker's memory beside the filter.

Training texts are those whose crc32(doc_id) mod 7 is not 2 (a null doc_id trains). Nulls are empty texts: one token,
the end. Extra columns are ignored, repeated rows train and are scored each; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.llm.common import bounded_batches, discard, materialize

CHUNK = 8 << 20
MOST_FILTER = 64 << 20
SLICE = 1 << 18  # tokens worked on at once
BITS, PROBES = 12, 4  # of the filter for each entry, and set by each
BASE = 1.5  # ratio of two levels' counts from level 2 (count 2) on; level 1 is count 1
SHARES = (0.0, 0.1, 0.3, 0.6, 0.9)
_U = np.uint64
END, START = _U(1), _U(2)  # in place of word hashes


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def _salt(level: int) -> np.uint64:
    return _U(level * 0xD6E8FEB86659FD93 % 2**64)


def pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _mix(_mix(a) * _U(0x9E3779B97F4A7C15) + b)


def level_of(counts: np.ndarray) -> np.ndarray:
    return np.where(counts < 2, 1, np.floor(np.log(np.maximum(counts, 2) / 2) / np.log(BASE) + 1e-9).astype(np.int64) + 2)


def count_of(levels: np.ndarray) -> np.ndarray:
    """The least count of a level; 0 at level 0."""
    return np.where(levels > 1, 2 * BASE ** (levels.astype(float) - 2), levels.astype(float))


def _pack(x: np.ndarray, n: int) -> bytes:
    """Ascending numbers of n bytes as differences, first the high bytes of all (which codecs make short), then the next."""
    d = np.diff(x, prepend=_U(0)).astype("<u8").view(np.uint8).reshape(-1, 8)
    return d[:, :n][:, ::-1].T.tobytes()


def _unpack(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((len(data) // n, 8), dtype=np.uint8)
    out[:, :n] = np.frombuffer(data, dtype=np.uint8).reshape(n, -1)[::-1].T
    return np.cumsum(out.view("<u8").ravel(), dtype=np.uint64)


class Filter:
    """Bloom segments, one for each hash bucket of pairs, or some of them. The `PROBES` bits of an entry lie in one word
    of 64 bits, so a probe is one look at the filter."""

    def __init__(self, sizes: np.ndarray, offsets: np.ndarray, words: np.ndarray):
        self.sizes, self.offsets, self.words = sizes, offsets, words  # words of each bucket (0: not here), first word, words

    @staticmethod
    def segment(keys: np.ndarray, levels: np.ndarray, size: int) -> np.ndarray:
        """The words of a segment of `size` words."""
        own = np.zeros(size, dtype=np.uint64)
        for q in range(1, int(levels.max(initial=0)) + 1):
            at, mask = Filter._places(keys[levels >= q], q, _U(size))
            np.bitwise_or.at(own, at, mask)
        return own

    @staticmethod
    def _places(keys: np.ndarray, level: int, size) -> tuple[np.ndarray, np.ndarray]:
        """The word of each key at a level, and the bits it has there."""
        h = _mix(keys + _salt(level))
        bits = _mix(h)
        mask = _U(1) << (bits & _U(63))
        for i in range(1, PROBES):
            mask |= _U(1) << (bits >> _U(6 * i) & _U(63))
        return (h % size).astype(np.int64), mask

    def levels(self, buckets: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """The level of each pair, 0 if it isn't in the filter."""
        if len(keys) > SLICE:
            return np.concatenate([self.levels(buckets[at : at + SLICE], keys[at : at + SLICE]) for at in range(0, len(keys), SLICE)])
        out = np.zeros(len(keys), dtype=np.uint8)
        at = np.flatnonzero(self.sizes[buckets] > 0)
        sizes, first, k = self.sizes[buckets[at]], self.offsets[buckets[at]], keys[at]
        level = 1
        while len(at):
            place, mask = self._places(k, level, sizes)
            ok = (self.words[first + place] & mask) == mask
            at, sizes, first, k = at[ok], sizes[ok], first[ok], k[ok]
            out[at] = level
            level += 1
        return out


def chunks(docs: DataFrame) -> DataFrame:
    """The corpus as token numbers: chunk, ids, held (bytes), sizes (words of each text), tokens, hashes (sorted),
    train (count of each word in training texts), n_words (distinct), n_pairs (of training texts)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, serial, held = TaskContext.get().partitionId(), 0, []
        size = 0
        for batch in batches:
            for i, h, x in zip(batch.column(0), batch.column(1), batch.column(2)):
                text = x.as_py() or b""
                held.append((i.as_py(), h.as_py(), text))
                size += len(text) + 64
                if size >= CHUNK:
                    yield make(f"{part}-{serial}", held)
                    serial, held, size = serial + 1, [], 0
        if held:
            yield make(f"{part}-{serial}", held)

    def make(name: str, rows: list) -> pa.RecordBatch:
        number: dict = defaultdict()
        number.default_factory = number.__len__
        tokens, sizes = [], []
        for _, _, text in rows:
            words = text.lower().split()
            sizes.append(len(words))
            tokens.append(np.fromiter(map(number.__getitem__, words), dtype=np.uint32, count=len(words)))
        flat = np.concatenate(tokens) if tokens else np.array([], dtype=np.uint32)
        hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in number), dtype=np.uint64, count=len(number)) >> _U(8)
        order = np.argsort(hashes, kind="stable")
        place = np.empty(len(order), dtype=np.uint32)
        place[order] = np.arange(len(order), dtype=np.uint32)
        flat = place[flat]
        sizes, out = np.array(sizes, dtype=np.uint32), np.array([h for _, h, _ in rows], dtype=bool)
        train = np.bincount(flat[np.repeat(~out, sizes)], minlength=len(order)).astype(np.uint32)
        pairs = int(sizes[~out].sum() + (~out).sum())
        values = {
            "chunk": [name], "ids": [[r[0] for r in rows]], "held": [out.tobytes()], "sizes": [sizes.tobytes()], "tokens": [zlib.compress(flat.tobytes(), 1)],
            "hashes": [zlib.compress(_pack(hashes[order], 7), 1)], "train": [zlib.compress(train.tobytes(), 1)], "n_words": [len(order)], "n_pairs": [pairs],
        }
        return pa.RecordBatch.from_pydict(values, schema=schema)

    ids = pa.field("ids", pa.list_(to_arrow_type(docs.schema["doc_id"].dataType)))
    blob = [pa.field(n, pa.binary()) for n in ("held", "sizes", "tokens", "hashes", "train")]
    schema = pa.schema([pa.field("chunk", pa.string()), ids, *blob, pa.field("n_words", pa.int64()), pa.field("n_pairs", pa.int64())])
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    rows = docs.select("doc_id", held.alias("h"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"chunk string, ids array<{kind}>, held binary, sizes binary, tokens binary, hashes binary, train binary, n_words bigint, n_pairs bigint")


def _bits(n: float) -> int:
    return max(0, int(np.ceil(np.log2(max(n, 1)))))


def word_counts(parts: DataFrame, bits: int) -> DataFrame:
    """(chunk, bucket, counts, n, v): corpus counts of the words of each chunk in each of 2**bits hash buckets, in
    the order of their hashes; n and v (tokens, distinct words) are given once for each bucket."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, h, t in zip(*(batch.column(i).to_pylist() for i in range(3))):
                hashes, train = _unpack(zlib.decompress(h), 7), np.frombuffer(zlib.decompress(t), dtype=np.uint32)
                edge = np.searchsorted(hashes >> _U(56 - bits) if bits else np.zeros(len(hashes), dtype=np.uint64), np.arange((1 << bits) + 1))
                rows = [(b, s, e) for b, (s, e) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist())) if e > s]
                yield pa.RecordBatch.from_pydict({
                    "bucket": pa.array([b for b, _, _ in rows], pa.int32()), "chunk": pa.array([chunk] * len(rows), pa.string()),
                    "h": pa.array([_pack(hashes[s:e], 7) for _, s, e in rows], pa.binary()), "t": pa.array([zlib.compress(train[s:e].tobytes(), 1) for _, s, e in rows], pa.binary()),
                })

    def add(group: pa.Table) -> pa.Table:
        hs = [_unpack(x, 7) for x in group["h"].to_pylist()]
        ts = [np.frombuffer(zlib.decompress(x), dtype=np.uint32) for x in group["t"].to_pylist()]
        keys, back = np.unique(np.concatenate(hs), return_inverse=True)
        total = np.bincount(back, weights=np.concatenate(ts), minlength=len(keys)).astype(np.int64)
        cut = np.cumsum([len(h) for h in hs])[:-1]
        out = [zlib.compress(x.tobytes(), 1) for x in np.split(total[back], cut)]
        n, v = [0] * len(out), [0] * len(out)
        n[0], v[0] = int(total.sum()), int((total > 0).sum())
        return pa.table({"chunk": group["chunk"], "bucket": group["bucket"], "counts": pa.array(out, pa.binary()), "n": pa.array(n, pa.int64()), "v": pa.array(v, pa.int64())})

    rows = parts.select("chunk", "hashes", "train").mapInArrow(spread, "bucket int, chunk string, h binary, t binary")
    return rows.groupBy("bucket").applyInArrow(add, "chunk string, bucket int, counts binary, n bigint, v bigint")


def _sequence(tokens: bytes, sizes: bytes, hashes: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number of the word or -1 for the end, hash, hash before it, number of the text) of each token of a chunk."""
    flat, sizes = np.frombuffer(zlib.decompress(tokens), dtype=np.uint32), np.frombuffer(sizes, dtype=np.uint32).astype(np.int64)
    text = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes + 1)
    ends = np.cumsum(sizes + 1) - 1
    word = np.full(len(text), -1, dtype=np.int32)
    is_word = np.ones(len(text), dtype=bool)
    is_word[ends] = False
    word[is_word] = flat
    h = np.full(len(text), END)
    h[is_word] = _unpack(zlib.decompress(hashes), 7)[flat]
    before = np.r_[START, h[:-1]] if len(h) else h
    before[np.r_[0, ends[:-1] + 1] if len(ends) else ends] = START
    return word, h, before, text


def _split_key(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and the 40 bits after it."""
    bucket = (keys >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), dtype=np.int64)
    return bucket, (keys << _U(bits)) >> _U(24)


def pair_counts(parts: DataFrame, bits: int) -> DataFrame:
    """(bucket, keys, counts, entries): all pairs of training texts."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for held, sizes, tokens, hashes in zip(*(batch.column(i).to_pylist() for i in range(4))):
                _, h, before, text = _sequence(tokens, sizes, hashes)
                train = ~np.frombuffer(held, dtype=bool)[text]
                keys, n = np.unique(pair_keys(before[train], h[train]), return_counts=True)
                bucket, low = _split_key(keys, bits)
                edge = np.searchsorted(bucket, np.arange((1 << bits) + 1))
                rows = [(b, slice(s, e)) for b, (s, e) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist())) if e > s]
                once = n == 1
                yield pa.RecordBatch.from_pydict({
                    "bucket": pa.array([b for b, _ in rows], pa.int32()), "one": pa.array([_pack(low[s][once[s]], 5) for _, s in rows], pa.binary()),
                    "more": pa.array([_pack(low[s][~once[s]], 5) for _, s in rows], pa.binary()), "n": pa.array([n[s][~once[s]].astype(np.uint32).tobytes() for _, s in rows], pa.binary()),
                })

    def add(group: pa.Table) -> pa.Table:
        one = [_unpack(x, 5) for x in group["one"].to_pylist()]
        more = [_unpack(x, 5) for x in group["more"].to_pylist()]
        keys, back = np.unique(np.concatenate([*one, *more]), return_inverse=True)
        n = np.concatenate([np.ones(sum(map(len, one)), dtype=np.int64), *(np.frombuffer(x, dtype=np.uint32).astype(np.int64) for x in group["n"].to_pylist())])
        total = np.bincount(back, weights=n, minlength=len(keys)).astype(np.int64)
        return pa.table({"bucket": group["bucket"][:1], "keys": pa.array([zlib.compress(_pack(keys, 5), 1)], pa.binary()), "levels": pa.array([zlib.compress(level_of(total).astype(np.uint8).tobytes(), 1)], pa.binary()), "entries": pa.array([int(level_of(total).sum())], pa.int64())})

    rows = parts.select("held", "sizes", "tokens", "hashes").mapInArrow(spread, "bucket int, one binary, more binary, n binary")
    return rows.groupBy("bucket").applyInArrow(add, "bucket int, keys binary, levels binary, entries bigint")


def filter_groups(pairs: DataFrame, bits: int, most: int) -> Iterator[Filter]:
    """The filter in parts of at most `most` bytes (one bucket at least), each built on the executors."""
    held = sorted((r["bucket"], r["entries"]) for r in pairs.where("entries > 0").select("bucket", "entries").collect())  # 2**bits rows
    groups: list[list[tuple[int, int]]] = []
    size = most + 1
    for b, n in held:
        m = max(1, -(-n * BITS // 64))
        if size + 8 * m > most:
            groups.append([])
            size = 0
        groups[-1].append((b, m))
        size += 8 * m

    for group in groups:
        sizes = dict(group)

        def build(batches: Iterator[pa.RecordBatch], sizes: dict = sizes) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for b, k, q in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    own = Filter.segment(_unpack(zlib.decompress(k), 5) | (_U(b) << _U(40)), np.frombuffer(zlib.decompress(q), dtype=np.uint8), sizes[b])
                    yield pa.RecordBatch.from_pydict({"bucket": pa.array([b], pa.int32()), "words": pa.array([own.tobytes()], pa.binary())})

        first, last = group[0][0], group[-1][0]
        rows = pairs.where(F.col("bucket").between(first, last) & (F.col("entries") > 0)).select("bucket", "keys", "levels")
        size, offset = np.zeros(1 << bits, dtype=np.uint64), np.zeros(1 << bits, dtype=np.int64)
        data = np.zeros(sum(m for _, m in group), dtype=np.uint64)
        at = 0
        for b, m in group:
            size[b], offset[b] = m, at
            at += m
        for r in rows.mapInArrow(build, "bucket int, words binary").toLocalIterator():
            data[offset[r["bucket"]] : offset[r["bucket"]] + len(r["words"]) // 8] = np.frombuffer(r["words"], dtype=np.uint64)
        yield Filter(size, offset, data)


def pair_levels(parts: DataFrame, own: Filter, bits: int) -> DataFrame:
    """(chunk, levels): the level of each token's pair, 0 where it isn't in this part of the filter."""
    shared = parts.sparkSession.sparkContext.broadcast(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, sizes, tokens, hashes in zip(*(batch.column(i).to_pylist() for i in range(4))):
                _, h, before, _ = _sequence(tokens, sizes, hashes)
                bucket, low = _split_key(pair_keys(before, h), bits)
                got = shared.value.levels(bucket, low | (bucket.astype(np.uint64) << _U(40)))
                yield pa.RecordBatch.from_pydict({"chunk": [chunk], "levels": pa.array([zlib.compress(got.tobytes(), 1)], pa.binary())})

    return parts.select("chunk", "sizes", "tokens", "hashes").mapInArrow(run, "chunk string, levels binary")


def text_scores(word: np.ndarray, text: np.ndarray, texts: int, counts: np.ndarray, ends: int, tokens: int, words: int, levels: np.ndarray) -> tuple:
    """(tokens, known tokens, base score, model score) of each text of a chunk."""
    c = np.where(word >= 0, counts[np.maximum(word, 0)] if len(counts) else 0, ends)
    p1 = (c + 1) / (tokens + (words + 1))
    before = np.r_[ends, c[:-1]] if len(c) else c
    first = np.r_[True, text[1:] != text[:-1]] if len(c) else np.array([], dtype=bool)
    before[first] = ends
    p2 = np.minimum(1.0, np.divide(count_of(levels), before, out=np.zeros(len(c)), where=before > 0))
    share = lambda x: np.bincount(text, weights=x, minlength=texts)
    base = share(np.log10(p1))
    ways = []
    for s in SHARES:
        s = np.where(before > 0, s, 0.0)
        ways.append(share(np.log10((1 - s) * p1 + s * p2)))
    ways = np.array(ways)
    top = ways.max(axis=0)
    score = top + np.log10((10 ** (ways - top)).mean(axis=0))
    return np.bincount(text, minlength=texts), share(c > 0).astype(np.int64), base, score


def score(docs: DataFrame, most_filter: int = MOST_FILTER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (the model's log10 probability)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    bounded_batches(docs.sparkSession)
    parts = materialize(chunks(docs), "chunks", "none")
    sums = parts.agg(F.sum("n_words"), F.sum("n_pairs")).first()
    bits = min(16, _bits((sums[0] or 0) / 1_000_000))
    counts = materialize(word_counts(parts, bits), "counts", "none")
    total = counts.agg(F.sum("n"), F.sum("v")).first()
    ends = int((sums[1] or 0) - (total[0] or 0))  # one pair more than words in each training text
    tokens, words = int((total[0] or 0) + ends), int((total[1] or 0) + (ends > 0))
    pair_bits = min(20, _bits((sums[1] or 0) / 1_500_000))
    pairs = materialize(pair_counts(parts, pair_bits), "pairs", "none")
    found = None
    for own in filter_groups(pairs, pair_bits, most_filter):
        levels = materialize(pair_levels(parts, own, pair_bits), "levels", "none")
        found = levels if found is None else found.unionByName(levels)
    discard(pairs)
    side = counts.select("chunk", "bucket", F.col("counts").alias("data"))
    if found is not None:
        side = side.unionByName(found.select("chunk", F.lit(-1).alias("bucket"), F.col("levels").alias("data")))

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [pa.array([], t) for t in (left.schema.field("ids").type.value_type, pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]
        rows = []
        data = sorted(zip(right["bucket"].to_pylist(), right["data"].to_pylist()), key=lambda x: x[0])
        own = [np.frombuffer(zlib.decompress(x), dtype=np.int64) for b, x in data if b >= 0]
        own = np.concatenate(own) if own else np.array([], dtype=np.int64)
        for ids, held, sizes, toks, hashes in zip(*(left[n].to_pylist() for n in ("ids", "held", "sizes", "tokens", "hashes"))):
            word, h, _, text = _sequence(toks, sizes, hashes)
            level = np.zeros(len(word), dtype=np.uint8)
            for b, x in data:
                if b < 0:
                    level = np.maximum(level, np.frombuffer(zlib.decompress(x), dtype=np.uint8))
            n, known, base, model = text_scores(word, text, len(ids), own, ends, tokens, words, level)
            held = np.frombuffer(held, dtype=bool)
            rows.append([pa.array(ids, out[0].type), pa.array(held), pa.array(n, pa.int64()), pa.array(known), pa.array(np.full(len(ids), tokens)), pa.array(base), pa.array(model)])
        out = [pa.concat_arrays(x) for x in zip(*rows)] if rows else out
        return pa.table(out, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    left = parts.select("chunk", "ids", "held", "sizes", "tokens", "hashes")
    both = left.groupBy("chunk").cogroup(side.groupBy("chunk"))
    return both.applyInArrow(finish, f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")

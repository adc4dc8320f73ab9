"""Benchmark decontamination by spaced-seed hashing, with DataFrame functions only.

A mask such as 11011 keeps some token positions and ignores the others, so two token windows that differ only at
ignored positions have the same hash. The hashes of all windows of the benchmark join those of the documents; around
each hit the benchmark item is laid over the document on the hit's diagonal, and a pair is reported if some stretch of
`STRETCH` item tokens (or the whole item, if shorter) has at least `SIMILARITY` of its tokens in place.

Tokens are lower-case runs of letters and digits. The masks find every stretch of 20 or more tokens whose substitutions
are at most a fifth and no two within two tokens of each other, and nearly all others; items shorter than a mask are found
by contiguous masks of their own length, those of five tokens also by two masks with a gap. The benchmark's hashes are
broadcast while they number at most `BROADCAST_SEEDS`; beyond it they are joined by shuffle with narrow rows. Both ways give
the same rows. No pairs of documents are formed; texts are known by two 64-bit hashes.

Null and empty texts have no tokens and no hits; null items are skipped. Rows that share a doc_id are one document in
the report; a null doc_id is reported as such. Extra columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, materialize

# Fixed values of this operator: the seed masks, tried on every window.
MASKS = ("1111", "11011", "1010101")
FIVE = ("10111", "11101")  # besides, if there are items of five tokens: their second or fourth may differ
STRETCH = 20
SIMILARITY = 0.8
BROADCAST_SEEDS = 2_000_000
MOST_BROADCAST = 1_000_000  # pairs of hashes


def tokens(text: str) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _keys(h: str, p: Column, masks: tuple[str, ...]) -> Column:
    """The hash of each mask on the window that begins at p; null where the window ends after the text."""
    out = []
    for m in masks:
        at = [k for k, x in enumerate(m) if x == "1"]
        key = F.xxhash64(F.lit(m), *(F.get(h, p + k) for k in at))
        out.append(F.when(F.get(h, p + at[-1]).isNotNull(), key))
    return F.array(*out)


def _seeds(items: DataFrame, masks: tuple[str, ...]) -> DataFrame:
    """item, q, key of every window of the items."""
    rows = items.select("item", "words", F.transform("words", lambda x: F.xxhash64(x)).alias("h"))
    rows = rows.select("item", "h", F.explode_outer(F.sequence(F.lit(0), F.greatest(F.size("h") - 1, F.lit(0)))).alias("q"))
    return rows.select("item", "q", F.explode(_keys("h", F.col("q"), masks)).alias("key")).where("key is not null").distinct()


def _similarity(words: str, item_words: str, start: Column) -> Column:
    """The best share of tokens in place over the stretches of the item, when its first token lies at start."""
    same = F.transform(item_words, lambda x, i: F.when((start + i >= 0) & (F.get(words, F.greatest(start + i, F.lit(0))) == x), 1).otherwise(0))
    n = F.least(F.size(item_words), F.lit(STRETCH))
    sums = F.transform(F.sequence(F.lit(1), F.size(item_words) - n + 1), lambda s: F.aggregate(F.slice(same, s, n), F.lit(0), lambda a, x: a + x))
    return F.array_max(sums) / n


def _keyed(docs: DataFrame, key: str | None = None) -> DataFrame:
    """(id if key, t1, t2, text): texts by two hashes; null counts as empty."""
    t = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(*([F.col(key).alias("id")] if key else []), F.xxhash64(t).alias("t1"), F.xxhash64(F.lit(7), t).alias("t2"), "text")


def found_texts(docs: DataFrame, benchmark: DataFrame, most_broadcast: int = BROADCAST_SEEDS) -> DataFrame:
    """(t1, t2, item, similarity, start) of each pair of a different text and an item that it contains, written as a table.

    Hits are narrow rows, made distinct by diagonal before any is verified; then the texts with hits are read again, and
    each is laid under its items once for a diagonal, whatever the number of seeds and of copies."""
    items = benchmark.select(F.col("item_id").alias("item"), tokens("text").alias("words")).where("size(words) > 0")
    span = max(map(len, MASKS))
    short = [r[0] for r in items.where(F.size("words") < span).select(F.size("words")).distinct().collect()]  # at most span rows
    masks = (*MASKS, *(m for n in sorted(short) if (m := "1" * n) not in MASKS), *(FIVE if 5 in short else ()))
    seeds = _seeds(items, masks)
    few = seeds.limit(most_broadcast + 1).count() <= most_broadcast
    at = _keyed(docs).select("t1", "t2", F.transform(tokens("text"), lambda x: F.xxhash64(x)).alias("h"))
    at = at.select("t1", "t2", "h", F.posexplode("h").alias("p", "h0"))
    at = at.select("t1", "t2", "p", F.explode(_keys("h", F.col("p"), masks)).alias("key")).where("key is not null")
    hits = at.join(F.broadcast(seeds) if few else seeds, "key").select("t1", "t2", "item", (F.col("p") - F.col("q")).alias("start")).distinct()
    hits = materialize(hits, "hits")
    own = hits.select("t1", "t2").distinct()
    if hits.count() <= MOST_BROADCAST:
        own = F.broadcast(own)
    texts = _keyed(docs).join(own, ["t1", "t2"]).groupBy("t1", "t2").agg(F.first("text").alias("text")).select("t1", "t2", tokens("text").alias("words"))
    laid = texts.join(hits, ["t1", "t2"]).join(items.withColumnRenamed("words", "item_words"), "item")
    laid = laid.select("t1", "t2", "item", "start", _similarity("words", "item_words", F.col("start")).alias("similarity")).where(F.col("similarity") >= SIMILARITY)
    best = laid.groupBy("t1", "t2", "item").agg(F.min(F.struct((-F.col("similarity")).alias("s"), F.col("start").alias("start"))).alias("b"))
    out = materialize(best.select("t1", "t2", "item", (-F.col("b.s")).alias("similarity"), F.col("b.start").cast("bigint").alias("start")), "found")
    discard(hits)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", most_broadcast: int = BROADCAST_SEEDS) -> DataFrame:
    """(key, item_id, similarity, start) of each pair of a document and a benchmark item that it contains; start is
    the least token place of the item in the document among its best ones."""
    found = found_texts(docs, benchmark, most_broadcast)
    if found.count() <= MOST_BROADCAST:
        found = F.broadcast(found)
    pairs = _keyed(docs, key).select("id", "t1", "t2").join(found, ["t1", "t2"])
    best = pairs.groupBy("id", "item").agg(F.min(F.struct((-F.col("similarity")).alias("s"), F.col("start").alias("start"))).alias("b"))
    return best.select(F.col("id").alias(key), F.col("item").alias("item_id"), (-F.col("b.s")).alias("similarity"), F.col("b.start").alias("start"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that contain no benchmark item. Texts are judged, by two hashes of theirs, whatever the doc_id."""
    gone = found_texts(docs, benchmark).select("t1", "t2").distinct()
    if gone.count() <= MOST_BROADCAST:
        gone = F.broadcast(gone)
    t = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64(t).alias("t1"), F.xxhash64(F.lit(7), t).alias("t2"))
    return rows.join(gone, ["t1", "t2"], "left_anti").select("row.*")


def oracle() -> str:
    """The definition itself, without seeds: every place of every item over every document where enough tokens agree."""
    split = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
    return rf"""
WITH d AS (SELECT doc_id, unnest({split}) AS t, generate_subscripts({split}, 1) - 1 AS p FROM documents),
i AS (SELECT item_id, {split} AS w FROM benchmark),
b AS (SELECT item_id, len(w) AS n, least(len(w), {STRETCH}) AS m, unnest(w) AS t, generate_subscripts(w, 1) - 1 AS q FROM i WHERE len(w) > 0),
hit AS (SELECT doc_id, item_id, n, m, p - q AS start, list(q) AS qs FROM d JOIN b USING (t) GROUP BY doc_id, item_id, n, m, p - q HAVING count(*) >= {SIMILARITY} * m),
best AS (SELECT doc_id, item_id, start, list_max(list_transform(range(0, n - m + 1), lambda s: len(list_filter(qs, lambda q: q >= s AND q < s + m)))) / m AS similarity FROM hit),
first AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) AS r FROM best WHERE similarity >= {SIMILARITY})
SELECT doc_id, item_id, similarity, CAST(start AS BIGINT) AS start FROM first WHERE r = 1"""

"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Words are runs of anything but ASCII white space. Each rule is a ratio with a least and a most value; a text is kept if
the base rules and every rule hold. All is computed row by row: no shuffle, so neither hot sources nor groups of copies
matter, and a text of any length is one array of its words.

Nulls count as empty texts: no words, so base_failed. Extra columns are ignored by `quality` and kept by
`keep_good`; repeated rows are judged alike; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SPACE

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their they this to was we were which with you "
    "au ce ces dans de des du elle en est et il la le les ne nous pas pour que qui sa se son sur un une vous "
    "als auf aus bei das dem den der die ein eine er es für hat ich im ist mit nicht sich sie sind und von war wie zu "
    "al como con del el es esta fue la las lo los más mi no para pero por se si sin su una y ya"
)


@dataclass(frozen=True)
class Rule:
    """value (SQL over the measures below) has to lie between least and most; judged from `of_words` words on."""

    name: str
    value: str
    least: float
    most: float
    of_words: int = 0


#: The threshold table.
RULES = (
    Rule("mean_word_length", "word_chars / n_words", 2.0, 20.0),
    Rule("symbols_per_word", "n_symbols / n_words", 0.0, 0.3),
    Rule("stop_word_share", "n_stop_words / n_words", 0.02, 1.0, of_words=50),
    Rule("repeated_line_share", "n_dup_lines / n_lines", 0.0, 0.5),
)
LEAST_WORDS, MOST_REPEATED = 10, 20


def measures(df: DataFrame, text: str = "text") -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_stop_words, n_repeat_words (long) added under
    a struct column `measures`."""
    t = F.coalesce(F.col(text), F.lit(""))
    out = df.select(F.struct("*").alias("row"), t.alias("t"))
    out = out.withColumn("w", F.array_remove(F.split("t", SPACE + "+"), ""))
    lines = F.filter(F.split("t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    window = F.transform(F.slice("w", 1, F.greatest(F.size("w") - 4, F.lit(0))), lambda x, i: F.xxhash64(x, *(F.get("w", i + k) for k in range(1, 5))))
    out = out.select(
        "row", "w", window.alias("h"), lines.alias("lines"),
        F.length(F.regexp_replace("t", SPACE + "+", "")).cast("bigint").alias("word_chars"),
        F.length(F.regexp_replace("t", r"[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
    )
    repeated = F.size(F.array_distinct("h")) < F.size("h")
    # Windows by hash and place: a window is repeated if a neighbour in that order has the same hash.
    order = F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    out = out.withColumn("o", F.when(repeated, order))
    same = lambda x, i: (F.get("o", i + 1)["h"] == x["h"]) | (F.get("o", F.when(i > 0, i - 1))["h"] == x["h"])
    at = F.sort_array(F.transform(F.filter("o", lambda x, i: F.coalesce(same(x, i), F.lit(False))), lambda x: x["i"]))
    out = out.withColumn("at", at)
    gaps = F.zip_with("at", F.slice("at", 2, F.greatest(F.size("at"), F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(5)), F.lit(5)))
    covered = F.aggregate(gaps, F.lit(0).cast("bigint"), lambda s, x: s + x)
    stops = F.filter("w", lambda x: F.lower(x).isin(sorted(set(STOP_WORDS.split()))))
    got = F.struct(
        F.size("w").cast("bigint").alias("n_words"), "word_chars", "n_symbols",
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.size(stops).cast("bigint").alias("n_stop_words"),
        F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_repeat_words"),
    )
    return out.select("row", got.alias("measures"))


def base_failed(m: str = "measures") -> Column:
    return (F.col(f"{m}.n_words") < LEAST_WORDS) | (F.col(f"{m}.n_repeat_words") * 100 > F.col(f"{m}.n_words") * MOST_REPEATED)


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """The table as one condition over the columns of `measures`."""
    held = F.lit(True)
    for r in rules:
        v = F.coalesce(F.expr(_safe(r.value)), F.lit(0.0))
        held = held & ((F.col("n_words") < r.of_words) | v.between(r.least, r.most))
    return held


def _safe(value: str) -> str:
    top, _, below = value.partition(" / ")
    return f"cast({top} as double) / nullif({below}, 0)"


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the measures, base_failed and kept."""
    out = measures(docs.select("doc_id", "text")).withColumn("base_failed", base_failed())
    out = out.select("row.doc_id", "measures.*", "base_failed")
    kept = ~F.col("base_failed") & verdict(rules)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return out.select("doc_id", *names, "base_failed", kept.alias("kept"))


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs that the rules keep, with their columns as they were."""
    # The row number keeps the filter above the projection: below it, it would hold every measure written out anew.
    out = measures(docs).withColumn("at", F.monotonically_increasing_id())
    return out.select("row", "measures.*", "at", base_failed().alias("failed")).where((F.col("at") >= 0) & ~F.col("failed") & verdict(rules)).select("row.*")


def oracle() -> str:
    stop = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS.split())))
    checks = " AND ".join(
        f"(n_words < {r.of_words} OR coalesce(CAST({r.value.partition(' / ')[0]} AS DOUBLE) / nullif({r.value.partition(' / ')[2]}, 0), 0) BETWEEN {r.least} AND {r.most})" for r in RULES
    )
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
p AS (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5),
g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, array_to_string(w[i:i+4], ' ')) AS n FROM p),
c AS (SELECT rid, count(DISTINCT j) AS n_repeat_words FROM (SELECT rid, unnest(range(i, i + 5)) AS j FROM g WHERE n > 1) GROUP BY rid),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  len(list_filter(w, lambda x: lower(x) IN ({stop}))) AS n_stop_words,
  CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN c USING (rid)),
b AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {checks} AS kept FROM b"""

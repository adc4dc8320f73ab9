"""Records about datasets: history, jobs, annotations, transforms, differences, terms, companions, state.

Everything is a DataFrame keyed by names; a change gives a new table. Lists that a user typed are small, tables are not.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import scalars
from tessera.operators.tables import glob_pattern

#: Kinds of shape annotations, and states that end a job.
KINDS = ("point", "line", "rectangle", "ellipse", "polygon", "text")
TERMINAL = ("completed", "failed", "cancelled")
STATE_VERSION = 3


# History and jobs.


def steps_of(history: DataFrame) -> DataFrame:
    """(seq, function, params) of the completed records, in the order they ran."""
    return history.where("status = 'completed'").select("seq", "function", "params").orderBy("seq")


def public(records: DataFrame) -> DataFrame:
    """records without their private columns (a leading underscore)."""
    return records.select(*(c for c in records.columns if not c.startswith("_")))


def next_in_queue(jobs: DataFrame, by: str = "session") -> DataFrame:
    """The first queued job (seq) of each session that runs none: jobs of a session run one after the other."""
    busy = jobs.where("status = 'running'").select(by).distinct()
    first = F.row_number().over(Window.partitionBy(by).orderBy("seq"))
    return jobs.where("status = 'queued'").join(busy, by, "left_anti").withColumn("_r", first).where("_r = 1").drop("_r")


def moved(jobs: DataFrame, seq: int, to: str) -> DataFrame:
    """jobs after one changed its state: staged to queued or deleted, queued to running or cancelled, running to an end.
    Any other change of that job is an error, as is an unknown one."""
    allowed = {"staged": ("queued", "deleted"), "queued": ("running", "cancelled"), "running": TERMINAL}
    found = jobs.where(F.col("seq") == seq).select("status").collect()  # one job
    if not found or to not in allowed.get(found[0][0], ()):
        raise ValueError(f"job {seq} is {found[0][0] if found else 'unknown'} and can't become {to}")
    if to == "deleted":
        return jobs.where(F.col("seq") != seq)
    return jobs.withColumn("status", F.when(F.col("seq") == seq, to).otherwise(F.col("status")))


def retained(jobs: DataFrame, most: int = 200) -> DataFrame:
    """jobs without the oldest ended ones beyond `most`; those still under way stay."""
    ended = jobs.where(F.col("status").isin(*TERMINAL))
    keep = ended.orderBy(F.desc("seq")).limit(most)
    return jobs.where(~F.col("status").isin(*TERMINAL)).unionByName(keep)


def run_status(records: DataFrame, by: str) -> DataFrame:
    """by, n_steps, n_failed, state: ok without failed steps, failed if all are, else partial."""
    g = records.groupBy(by).agg(F.count("*").alias("n_steps"), F.count_if(F.col("status") == "failed").alias("n_failed"))
    return g.withColumn("state", F.when(F.col("n_failed") == 0, "ok").when(F.col("n_failed") == F.col("n_steps"), "failed").otherwise("partial"))


def report_json(df: DataFrame, by: str, sections: dict[str, list[str]]) -> DataFrame:
    """(by, report): the columns of each section as one JSON text."""
    return df.select(by, F.to_json(F.struct(*(F.struct(*columns).alias(name) for name, columns in sections.items()))).alias("report"))


# Categories of regions.


def category_counts(values: DataFrame, categories: DataFrame, column: str) -> DataFrame:
    """(category, n) of every category, those without rows too."""
    n = values.groupBy(F.col(column).alias("category")).agg(F.count("*").alias("n"))
    return categories.select("category").join(n, "category", "left").fillna(0, ["n"])


def recounted(registry: DataFrame, obs: DataFrame) -> DataFrame:
    """(name, category, n) of a registry (name: a column of obs, category) after a subset: sets whose column is gone, and
    categories without rows, are dropped."""
    names = [r["name"] for r in registry.select("name").distinct().collect() if r["name"] in obs.columns]  # sets a user made
    if not names:
        return registry.where("false").select("name", "category", F.lit(0).cast("bigint").alias("n"))
    long = obs.select(F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).cast("string").alias("category")) for n in names))).alias("x")).select("x.*")
    n = long.groupBy("name", "category").agg(F.count("*").alias("n"))
    return registry.select("name", "category").join(n, ["name", "category"])


# Annotations, transforms, display state.


def _valid(kind: str, points: list[tuple[float, float]]) -> None:
    least = {"point": 1, "text": 1, "line": 2, "rectangle": 2, "ellipse": 2, "polygon": 3}
    if kind not in KINDS:
        raise ValueError(f"annotations are of {KINDS}, not {kind!r}")
    if len(points) < least[kind]:
        raise ValueError(f"{kind} needs {least[kind]} points")


SHAPE = "id string, kind string, label string, points array<struct<x:double,y:double>>, pos bigint"


def with_annotation(shapes: DataFrame, id: str, kind: str, label: str, points: list[tuple[float, float]]) -> DataFrame:  # noqa: A002
    """shapes (id, kind, label, points, pos) with one more at the end; an id that is there is replaced and moves there."""
    _valid(kind, points)
    last = shapes.agg(F.coalesce(F.max("pos") + 1, F.lit(0)).alias("pos"))
    new = shapes.sparkSession.createDataFrame([(id, kind, label, points)], SHAPE.rpartition(",")[0]).crossJoin(last)  # one row
    return shapes.where(F.col("id") != id).unionByName(new.select(*shapes.columns))


def without_annotations(shapes: DataFrame, ids: list[str]) -> DataFrame:
    unknown = set(ids) - {r["id"] for r in shapes.where(F.col("id").isin(ids)).select("id").collect()}  # those asked for
    if unknown:
        raise ValueError(f"no annotation {sorted(unknown)}")
    return shapes.where(~F.col("id").isin(ids))


def annotation_ring(kind: Column, points: Column, segments: int = 64) -> Column:
    """The ring of an annotation: corners of rectangles, `segments` vertices of ellipses, a polygon's own; else null."""
    a, b = F.get(points, F.lit(0)), F.get(points, F.lit(1))
    lo, hi = (lambda k: F.least(a[k], b[k])), (lambda k: F.greatest(a[k], b[k]))
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    corners = F.array(at(lo("x"), lo("y")), at(hi("x"), lo("y")), at(hi("x"), hi("y")), at(lo("x"), hi("y")))
    mid, half = (lambda k: (a[k] + b[k]) / 2), (lambda k: F.abs(a[k] - b[k]) / 2)
    round_ = scalars.ellipse(mid("x"), mid("y"), half("x"), half("y"), segments)
    return F.when(kind == "rectangle", corners).when(kind == "ellipse", round_).when(kind == "polygon", points)


def with_transform(transforms: DataFrame, element: str, m: scalars.Affine) -> DataFrame:
    """transforms (element, a..f) with the map of one element set; a map without an inverse is an error."""
    scalars.inverse(m)
    new = transforms.sparkSession.createDataFrame([(element, *map(float, m))], "element string, a double, b double, c double, d double, e double, f double")
    return transforms.where(F.col("element") != element).unionByName(new)


def difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """(facet, key, change) of two inventories (facet, key, version): added, removed or changed."""
    b, a = before.select("facet", "key", F.col("version").alias("vb")), after.select("facet", "key", F.col("version").alias("va"))
    change = F.when(F.col("vb").isNull(), "added").when(F.col("va").isNull(), "removed").when(F.col("va") != F.col("vb"), "changed")
    return b.join(a, ["facet", "key"], "full").select("facet", "key", change.alias("change")).where("change is not null")


def bumped(versions: DataFrame, changed: DataFrame) -> DataFrame:
    """versions (field, version) after a run changed fields (field): one more for each, from 1; none is ever reset."""
    one = changed.select("field").distinct().withColumn("one", F.lit(1))
    return versions.join(one, "field", "full").select("field", (F.coalesce("version", F.lit(0)) + F.coalesce("one", F.lit(0))).cast("bigint").alias("version"))


def pruned_display(display: DataFrame, present: DataFrame) -> DataFrame:
    """display (view, reference, ..) with references to fields (field) that are gone set to null."""
    here = present.select(F.col("field").alias("reference")).distinct().withColumn("_here", F.lit(True))
    return display.join(here, "reference", "left").withColumn("reference", F.when(F.col("_here"), F.col("reference"))).select(*display.columns)


def migrated(state: dict) -> dict:
    """A stored state in its present version: 1 knew a single selection, 2 kept plots without a status. States of later
    versions, and of none, are an error; unknown keys stay."""
    out = json.loads(json.dumps(state))
    version = out.get("version")
    if not isinstance(version, int) or not 1 <= version <= STATE_VERSION:
        raise ValueError(f"state of version {version!r}; this engine knows 1 to {STATE_VERSION}")
    if version == 1:
        one = out.pop("selection", None)
        out["selections"] = [] if one is None else [one]
    if version <= 2:
        out["plots"] = [{"status": "drawn", **p} for p in out.get("plots", [])]
    # A plot that was being drawn when the state was written can't be found again.
    out["plots"] = [{**p, "status": "lost" if p.get("status") in ("queued", "running") else p.get("status", "drawn")} for p in out.get("plots", [])]
    out["version"] = STATE_VERSION
    for key in ("selections", "plots"):
        if not isinstance(out.get(key, []), list):
            raise ValueError(f"{key} of a state is a list")
    return out


# Terms, parameters, files.


def matched_terms(parameters: DataFrame, terms: DataFrame) -> DataFrame:
    """(function, parameter, term): the best term of each parameter (function, parameter, type) among terms (term, pos, scope,
    name, pattern, type): one scoped to the function wins over one of the same name, that over one whose glob fits the
    name, that over one of the type; earlier terms win ties; null without any. terms is a dictionary of some hundred
    entries, which the check below keeps so."""
    if terms.count() > 10_000:
        raise ValueError("a dictionary of terms has at most 10,000 entries")
    p = parameters.select("function", "parameter", "type")
    t = terms.select("term", "pos", "scope", "name", "pattern", F.col("type").alias("of_type"))
    fits = F.expr("parameter rlike pattern")
    score = F.when((F.col("scope") == F.col("function")) & (F.col("name") == F.col("parameter")), 4).when(F.col("scope").isNull() & (F.col("name") == F.col("parameter")), 3)
    score = score.when(F.col("scope").isNull() & F.coalesce(fits, F.lit(False)), 2).when(F.col("scope").isNull() & (F.col("of_type") == F.col("type")), 1)
    hits = p.join(F.broadcast(t), score.isNotNull()).withColumn("s", score)
    best = hits.groupBy("function", "parameter").agg(F.max_by("term", F.struct("s", (-F.col("pos")).alias("k"))).alias("term"))
    return p.join(best, ["function", "parameter"], "left").select("function", "parameter", "term")


def term_coverage(matched: DataFrame) -> DataFrame:
    """One row: n, matched, rate (three places)."""
    g = matched.agg(F.count("*").alias("n"), F.count("term").alias("matched"))
    return g.withColumn("rate", F.round(F.col("matched") / F.col("n"), 3))


def unmatched_by_reuse(matched: DataFrame) -> DataFrame:
    """(parameter, n, functions) of parameters without a term, the most used first, then by name."""
    g = matched.where("term is null").groupBy("parameter").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("function")).alias("functions"))
    return g.orderBy(F.desc("n"), "parameter")


def common_parameters(types: DataFrame, common: DataFrame) -> DataFrame:
    """(type, parameter) of the common parameters (parameter, applies_to: array) of each type (type)."""
    return types.select("type").join(common.select("parameter", F.explode("applies_to").alias("type")), "type")


def without_companion(files: DataFrame, path: str, suffix: str, other: str) -> DataFrame:
    """Files that end in suffix and whose companion, with the other suffix in its place, is not listed."""
    own = files.where(F.endswith(F.col(path), F.lit(suffix)))
    stem = F.expr(f"substring({path}, 1, length({path}) - {len(suffix)})")
    have = files.select(F.col(path).alias("_want")).distinct()
    return own.withColumn("_want", F.concat(stem, F.lit(other))).join(have, "_want", "left_anti").drop("_want")


def resolved_names(names: DataFrame, columns: DataFrame, genes: DataFrame) -> DataFrame:
    """(name, found): whether each name is a column of the table (obs), else a gene (var), else null."""
    c = columns.select("name").distinct().withColumn("_c", F.lit("obs"))
    g = genes.select("name").distinct().withColumn("_g", F.lit("var"))
    return names.select("name").join(F.broadcast(c), "name", "left").join(g, "name", "left").select("name", F.coalesce("_c", "_g").alias("found"))  # the columns of a table


def search_functions(functions: DataFrame, text: str, namespace: str | None = None) -> DataFrame:
    """functions (key, summary, custom, pos) whose key or summary contains the text; custom ones first, else in order."""
    q = text.lower()
    hit = functions.where(F.lower("key").contains(q) | F.lower("summary").contains(q)) if q else functions
    if namespace:
        hit = hit.where(F.startswith(F.col("key"), F.lit(namespace + ".")))
    return hit.orderBy(F.desc("custom"), "pos")


def classified_folders(listing: DataFrame, types: list[dict]) -> DataFrame:
    """(folder, type) of folders of a listing (folder, name) by types {type, all_of, any_of, none_of: lists of globs}: every
    glob of all_of, one of any_of, none of none_of has a file. The type with most conditions wins; a tie is an error."""
    has = lambda g: F.count_if(F.col("name").rlike(glob_pattern(g))) > 0

    def fits(t: dict) -> Column:
        ok = reduce(lambda a, b: a & b, [has(g) for g in t.get("all_of", [])], F.lit(True))
        if t.get("any_of"):
            ok = ok & reduce(lambda a, b: a | b, [has(g) for g in t["any_of"]])
        return reduce(lambda a, b: a & ~b, [has(g) for g in t.get("none_of", [])], ok)

    weight = lambda t: sum(len(t.get(k, [])) for k in ("all_of", "any_of", "none_of"))
    score = [F.when(fits(t), F.struct(F.lit(weight(t)).alias("w"), F.lit(t["type"]).alias("type"))) for t in types]
    g = listing.groupBy("folder").agg(F.array_compact(F.array(*score)).alias("fit"))
    top = g.select("folder", F.filter("fit", lambda x: x["w"] == F.array_max(F.transform("fit", lambda y: y["w"]))).alias("best")).where(F.size("best") > 0)
    one = F.when(F.size("best") > 1, F.raise_error(F.concat(F.lit("several types fit "), "folder"))).otherwise(F.get("best", F.lit(0))["type"])
    return top.select("folder", one.alias("type"))


def datasets_newest_first(files: DataFrame, most: int = 1000) -> DataFrame:
    """files (path, modified) without hidden and internal folders, newest first, then by path, at most `most`."""
    inner = F.col("path").rlike(r"(^|/)([._][^/]*|tessera-[^/]*)(/|$)")
    return files.where(~inner).orderBy(F.desc("modified"), "path").limit(most)


def sizes(files: DataFrame, by: str, factor: float = 4.0, resident: float = 0.3) -> DataFrame:
    """by, bytes on disk, bytes estimated when unpacked and those of them that stay in memory, of files (by, bytes)."""
    g = files.groupBy(by).agg(F.sum("bytes").alias("bytes"))
    return g.withColumn("unpacked", F.col("bytes") * factor).withColumn("resident", F.col("bytes") * factor * resident)

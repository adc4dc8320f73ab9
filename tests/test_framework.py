"""Contracts of operators, staged runs, recipes as text, listings, sidecars, streams."""

import gzip
import json
import os

import pytest
from pyspark.sql import functions as F

from tessera.plans import framework as fw
from tessera.plans import recipes
from tessera.sources import listing, writers
from tessera.streaming import windows


@pytest.fixture(scope="module")
def state(spark):
    rows = [(i, g, float(1 + (i * g) % 5)) for i in range(30) for g in range(12) if (i + g) % 3]
    obs = spark.createDataFrame([(i, f"t{i % 2}", f"r{i % 3}") for i in range(30)], "row bigint, kind string, region string")
    return {"counts": spark.createDataFrame(rows, "row bigint, var int, value double"), "obs": obs}


def test_registry(spark):
    assert fw.faults() == [] and "tessera.plans.recipes" in fw.discovered()
    d = fw.described(spark)
    assert d.where("effect not in ('transform', 'query')").isEmpty() and d.select("key").distinct().count() == len(recipes.OPERATORS)
    assert d.where("key = 'marker_genes' and parameter = 'method'").first()["kind"] == "text"


def test_calls(state):
    good = fw.call("filter_cells", state, {"min_counts": "30", "max_genes": None, "min_genes": ""})
    assert good.status == "completed" and good.changed == {"counts": "changed", "obs": "changed"} and good.log
    assert good.frames["obs"].count() < 30
    for key, given, says in (("nothing", {}, "no operator"), ("filter_cells", {"odd": 1}, "has no odd"), ("filter_cells", {"min_counts": "many"}, "is a number"), ("umap", {}, "needs"), ("region_features", {"celltype_key": "kind", "region_key": "absent"}, "no absent"), ("score_genes", {"gene_list": [1, 99]}, "no 99"), ("differential_abundance", {"refine": "maybe", "sample_key": "kind", "condition_key": "region"}, "true or false"), ("region_boundary", {"interior_labels": "x"}, "is a list")):
        bad = fw.call(key, state, given)
        assert bad.status == "failed" and says in bad.error and not bad.frames, key
    assert fw.typed(recipes.OPERATORS["regress_out"], {"keys": ["a"]}) == {"keys": ["a"]}


def test_staged_runs(spark, state):
    r = recipes.Recipe("r", {"least": 20, "method": recipes.REQUIRED}, (("filter_cells", {"min_counts": "$least"}), ("normalize", {}), ("marker_genes", {"method": "$method", "groupby": "kind", "n_genes": 2})))
    back = fw.from_json(fw.to_json(r))
    assert back == r
    jobs = fw.staged(spark, r, "s", {"method": "t-test"})
    jobs = fw.edited(jobs, 1, {"min_counts": 25})
    with pytest.raises(ValueError):
        fw.edited(jobs, 9, {})
    done, out = fw.run_staged(jobs, state)
    assert [x["status"] for x in done.orderBy("seq").collect()] == ["completed"] * 3 and out["markers"].count() == 4
    again = fw.recipe_of_history(done, "h")
    assert [k for k, _ in again.steps] == ["filter_cells", "normalize", "marker_genes"] and again.steps[0][1]["min_counts"] == 25
    broken = fw.staged(spark, recipes.Recipe("b", {}, (("normalize", {}), ("umap", {}), ("log1p", {}))), "s")
    done, _ = fw.run_staged(broken, state)
    assert [x["status"] for x in done.orderBy("seq").collect()] == ["completed", "failed", "staged"]
    for text in ("[]", "{}", json.dumps({"key": "x", "steps": [{"operator": "none"}]})):
        with pytest.raises(ValueError):
            fw.from_json(text)


def test_listings(spark, tmp_path):
    for p in ("a/b/c.txt", "a/.hidden/x", "a/_internal/y", "d.txt", "a/z.txt"):
        os.makedirs(os.path.dirname(f"{tmp_path}/{p}"), exist_ok=True)
        with open(f"{tmp_path}/{p}", "w") as f:
            f.write("1234")
    assert [r["name"] for r in listing.browse(spark, f"{tmp_path}").collect()] == ["a", "d.txt"]
    assert [r["name"] for r in listing.browse(spark, f"{tmp_path}/a", include_files=False).collect()] == ["b"]
    got = {(r["name"], r["depth"]) for r in listing.listed(spark, [f"{tmp_path}"], 2).collect()}
    assert got == {("a", 1), ("d.txt", 1), ("b", 2), ("z.txt", 2)}
    with pytest.raises(ValueError):
        listing.listed(spark, [f"{tmp_path}"], most=1)
    assert listing.input_roots("/x/") == {"": "/x"} and listing.input_roots('{"b": "/y", "/a/": "/z"}') == {"a": "/z", "b": "/y"}
    with pytest.raises(ValueError):
        listing.input_roots({"a": ""})
    os.makedirs(f"{tmp_path}/logs")
    with gzip.open(f"{tmp_path}/logs/7.log.gz", "wt") as f:
        f.write("one\ntwo\n")
    assert [tuple(r) for r in listing.logs(spark, f"{tmp_path}/logs").collect()] == [("7", "one"), ("7", "two")]
    with open(f"{tmp_path}/index.json", "w") as f:
        json.dump([{"name": "b"}, {"name": "a"}], f)
    assert [r["name"] for r in listing.collection(spark, f"{tmp_path}/index.json").collect()] == ["b", "a"]
    with open(f"{tmp_path}/plot.svg", "wb") as f:
        f.write(b"<svg/>")
    assert listing.figure(spark, f"{tmp_path}", "plot", "svg") == b"<svg/>"
    with pytest.raises(ValueError, match="svg"):
        listing.figure(spark, f"{tmp_path}", "plot", "pdf")


def test_sidecar_and_load(spark, tmp_path):
    t = {"a": spark.range(4), "b": spark.range(2).withColumn("x", F.lit(1))}
    writers.save(t, f"{tmp_path}/c", {"version": 2, "plots": [{"name": "p"}]})
    m = listing.write_sidecar(t, f"{tmp_path}/c", {"b": (1, 0, 0, 0, 1, 0)}, "ab")
    assert m["elements"]["a"]["rows"] == 4 and json.load(open(f"{tmp_path}/c/manifest.json")) == m
    tables, state = listing.load_checkpoint(spark, f"{tmp_path}/c", ["a"])
    assert set(tables) == {"a"} and state["version"] == 3 and state["plots"][0]["status"] == "drawn"


def test_bus(spark):
    events = spark.range(10, 110).withColumnRenamed("id", "event_id")
    got = windows.resume(events, 104, 50).collect()
    assert [r["event_id"] for r in got] == [105, 106, 107, 108, 109] and not any(r["lost"] for r in got)
    got = windows.resume(events, 20, 50).collect()
    assert len(got) == 50 and all(r["lost"] for r in got) and got[0]["event_id"] == 60
    assert windows.resume(events, None).count() == 0


def test_stateful_streams(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:{i:02d}:00", f"u{i % 3}", float(i)) for i in range(30)]
    df = spark.createDataFrame(rows, "seq int, ts string, user string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = windows.running_totals(stream(), "user", "value", "10 minutes").writeStream.format("memory").queryName("totals").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r["user"]: (r["n"], r["total"]) for r in spark.table("totals").collect()} == {f"u{k}": (10, float(sum(range(k, 30, 3)))) for k in range(3)}
    path = f"{tmp_path}/seen"
    os.makedirs(path)

    def handle(r):
        with open(f"{path}/{r['user']}", "a") as f:
            f.write(f"{r['seq']}\n")

    q = windows.in_order(stream(), handle, "user", "seq")
    q.processAllAvailable()
    q.stop()
    for k in range(3):
        assert [int(x) for x in open(f"{path}/u{k}")] == list(range(k, 30, 3))

"""Readers, writers, streams and fitted operators on small made tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import expression as ex
from tessera.operators import spatial
from tessera.sources import readers, writers
from tessera.streaming import windows


def test_pseudobulk_planted(spark):
    rng = np.random.default_rng(5)
    genes, samples = 600, 8
    base, fold = rng.lognormal(4, 1, genes), np.where(np.arange(genes) < 60, rng.choice([-1.5, 1.5], genes), 0.0)
    depth = rng.uniform(0.6, 1.6, samples)
    mu = base[:, None] * depth * 2 ** (fold[:, None] * (np.arange(samples) >= 4))
    y = rng.negative_binomial(1 / 0.05, 1 / (1 + 0.05 * mu))
    x = spark.createDataFrame([(f"s{j}", i, int(y[i, j])) for i in range(genes) for j in range(samples) if y[i, j]], "sample string, var int, value bigint")
    s = spark.createDataFrame([(f"s{j}", "b" if j >= 4 else "a") for j in range(samples)] + [("s9", "c")], "sample string, condition string")
    got = {r["var"]: r for r in ex.pseudobulk_test(x, s, "b", "a").collect()}
    found = {v for v, r in got.items() if r["padj"] < 0.05}
    assert len(found & set(range(60))) >= 48 and len(found - set(range(60))) <= 54
    assert np.corrcoef([got[i]["log2_fold"] for i in range(60)], fold[:60])[0, 1] > 0.9
    with pytest.raises(ValueError):
        ex.pseudobulk_test(x, s.where("condition <> 'a'"), "b", "a")


def test_normal_tail(spark):
    got = spark.createDataFrame([(z,) for z in (0.0, -1.0, 1.96, 4.0)], "z double").select(ex.normal_tail(F.col("z")).alias("p")).collect()
    assert all(abs(r["p"] - math.erfc(abs(z) / 2**0.5)) < 1e-6 for r, z in zip(got, (0.0, -1.0, 1.96, 4.0)))


def test_hilbert_is_a_walk(spark):
    rows = [(float(i), float(j)) for i in range(16) for j in range(16)] + [(None, 1.0), (float("nan"), 1.0)]
    df = spark.createDataFrame(rows, "x double, y double").withColumn("h", spatial.hilbert(F.col("x"), F.col("y"), (0.0, 0.0, 16.0, 16.0), 4))
    got = sorted((r["h"], r["x"], r["y"]) for r in df.collect() if r["h"] is not None)
    assert [h for h, _, _ in got] == list(range(256)) and df.where("h is null").count() == 2
    assert all(abs(a[1] - b[1]) + abs(a[2] - b[2]) == 1 for a, b in zip(got, got[1:]))


def test_checkpoint(spark, tmp_path):
    path = f"{tmp_path}/c"
    a, b = spark.range(5), spark.range(3).withColumn("x", F.lit(1.0))
    writers.save({"a": a, "b": b}, path, {"step": 1})
    assert writers.update({"b": b.limit(1)}, path, {"step": 2}) == 2
    tables, state = writers.load(spark, path)
    assert {k: v.count() for k, v in tables.items()} == {"a": 5, "b": 1} and state == {"step": 2}
    assert writers.load(spark, path, version=1)[0]["b"].count() == 3
    assert set(writers.load(spark, path, ["a"])[0]) == {"a"}
    with pytest.raises(KeyError):
        writers.load(spark, path, ["z"])
    with pytest.raises(KeyError):
        writers.trim(b, ["q"], ["id"])
    assert writers.trim(b, ["x"], ["id"]).columns == ["id", "x"]


def test_spatial_and_gene_files(spark, tmp_path):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(rng.random((4000, 2)))] + [(9999, None, None)], "id int, x double, y double")
    writers.write_spatial(df, f"{tmp_path}/s", partitions=16)
    back = spark.read.parquet(f"{tmp_path}/s")
    assert back.count() == 4001 and back.where("id = 9999").first()["hilbert"] is None
    area = back.where("x is not null").groupBy(F.input_file_name()).agg(((F.max("x") - F.min("x")) * (F.max("y") - F.min("y"))).alias("a"))
    assert area.agg(F.sum("a")).first()[0] < 3.0
    x = spark.createDataFrame([(i % 50, i // 50, 1.0) for i in range(2000)], "row int, var int, value double")
    writers.write_gene_major(x, f"{tmp_path}/g", 4)
    assert spark.read.parquet(f"{tmp_path}/g").where("var = 7").count() == 50


def test_readers(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m/cell_metadata.csv").write_text(",fov,center_x,center_y\n11,0,1.5,2\n12,0,3,4\n")
    (tmp_path / "m/cell_by_gene.csv").write_text("cell,A,B.2\n11,0,3\n12,2,0\n")
    (tmp_path / "m/detected_transcripts.csv").write_text("gene,global_x,global_y\nA,1,2\n")
    m = readers.read_merscope(spark, f"{tmp_path}/m")
    assert sorted(map(tuple, m["counts"].collect())) == [("11", "B.2", 3.0), ("12", "A", 2.0)]
    assert sorted((r["row"], r["x"], r["y"]) for r in m["cells"].collect()) == [("11", 1.5, 2.0), ("12", 3.0, 4.0)] and m["transcripts"].count() == 1
    (tmp_path / "c").mkdir()
    (tmp_path / "c/s_metadata_file.csv").write_text("fov,cell_ID,CenterX_global_px,CenterY_global_px\n1,1,5,6\n2,1,7,8\n")
    (tmp_path / "c/s_exprMat_file.csv").write_text("fov,cell_ID,G0,G1\n1,0,9,9\n1,1,1,0\n2,1,0,4\n")
    (tmp_path / "c/s_fov_positions_file.csv").write_text("fov,x_global_px,y_global_px\n1,0,0\n2,10,0\n")
    c = readers.read_cosmx(spark, f"{tmp_path}/c")
    assert sorted(map(tuple, c["counts"].collect())) == [("1_1", "G0", 1.0), ("2_1", "G1", 4.0)] and c["cells"].count() == c["fields"].count() == 2
    (tmp_path / "q/quantification").mkdir(parents=True)
    (tmp_path / "q/markers.csv").write_text("channel_number,marker_name\n1,DNA\n2,CD3\n")
    (tmp_path / "q/quantification/a.csv").write_text("CellID,DNA_mask,CD3_mask,X_centroid,Y_centroid,Area\n1,5,0,1,2,30\n")
    q = readers.read_mcmicro(spark, f"{tmp_path}/q")
    assert [tuple(r) for r in q["counts"].collect()] == [(1, "DNA_mask", 5.0)]
    before = readers.content_hash(spark, f"{tmp_path}/c")
    (tmp_path / "c/s_fov_positions_file.csv").write_text("fov\n1\n")
    assert before != readers.content_hash(spark, f"{tmp_path}/c")


def test_paths():
    assert readers.inside("/data", "a/../b") == "/data/b"
    readers.check_paths("/data", {"a": ["x/y", {"b": "/data/z"}], "n": 3})
    for bad in ("../x", "/etc/x", "/database/x"):
        with pytest.raises(ValueError):
            readers.check_paths("/data", {"a": [bad]})


def test_discover(spark):
    paths = ["r/a/x.csv", "r/a/y.csv", "r/a/in/x.csv", "r/b/x.csv", "r/b/stop", "r/c/z.h5", "r/d/p.txt", "r/d/q.txt"]
    types = [readers.DataType("x", ("x.*",), (), ("stop",)), readers.DataType("xy", ("x.*", "y.*")), readers.DataType("h5", (), ("*.h5", "*.hdf")), readers.DataType("p", ("p.*",)), readers.DataType("q", ("q.*",))]
    got = {r["folder"]: (r["type"], r["tied"]) for r in readers.discover(spark.createDataFrame([(p,) for p in paths], "path string"), types).collect()}
    assert got == {"r/a": ("xy", ["xy"]), "r/c": ("h5", ["h5"]), "r/d": (None, ["p", "q"])}


def test_streams(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in src.schema)
    src.orderBy("ts").coalesce(1).write.parquet(f"{tmp_path}/in")
    src.orderBy("ts").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")  # every event twice
    stream = windows.read_events(spark, f"{tmp_path}/in", schema)
    windows.run_available(windows.once_each(stream, "60 days"), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == src.count()
    q = windows.windowed(stream, "1 day").writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("daily").agg(F.sum("n")).first()[0] == 2 * src.count()
    batch = src.withColumn("ts", F.col("ts").cast("timestamp"))
    assert windows.windowed(batch, "1 day", "6 hours").agg(F.sum("n")).first()[0] == 4 * src.count()
    assert windows.presence(batch).agg(F.sum("n")).first()[0] == src.count()
    assert windows.read_after(src, None).count() == 0
    first = [r["event_id"] for r in windows.read_after(src, 10, 5).collect()]
    assert first == sorted(first) and len(first) == 5 and first[0] > 10

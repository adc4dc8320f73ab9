"""Stores, archives, instrument exports and the shape index on small made files."""

import gzip
import io
import json
import os
import tarfile
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import fields, polygons
from tessera.sources import archives, instruments, writers, zarr


def put(path, data):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data if isinstance(data, bytes) else data.encode())


def put_v2(path, values, chunks, codec=None, sep="."):
    values = np.asarray(values)
    meta = {"zarr_format": 2, "shape": values.shape, "chunks": chunks, "dtype": values.dtype.str, "compressor": codec and {"id": codec}, "fill_value": 0, "order": "C", "filters": None, "dimension_separator": sep}
    text = values.dtype.kind in "UO"
    if text:
        meta |= {"dtype": "|O", "filters": [{"id": "vlen-utf8"}], "fill_value": ""}
    put(f"{path}/.zarray", json.dumps(meta))
    for at in np.ndindex(*(-(-s // c) for s, c in zip(values.shape, chunks))):
        part = values[tuple(slice(k * c, (k + 1) * c) for k, c in zip(at, chunks))]
        if text:
            part = [*part, *[""] * (chunks[0] - len(part))]
            raw = len(part).to_bytes(4, "little") + b"".join(len(t.encode()).to_bytes(4, "little") + t.encode() for t in part)
        else:
            full = np.zeros(chunks, dtype=values.dtype)
            full[tuple(slice(0, n) for n in part.shape)] = part
            raw = full.tobytes()
        put(f"{path}/{sep.join(map(str, at))}", zlib.compress(raw) if codec == "zlib" else gzip.compress(raw) if codec == "gzip" else raw)


@pytest.fixture
def store(tmp_path):
    t = f"{tmp_path}/s/tables/table"
    x = np.array([[0, 2, 0], [1, 0, 0], [0, 0, 3], [4, 5, 0], [0, 0, 0]], dtype="<f4")
    rows, cols = np.nonzero(x)
    put(f"{t}/.zattrs", json.dumps({"encoding-type": "anndata"}))
    put(f"{t}/X/.zattrs", json.dumps({"encoding-type": "csr_matrix", "shape": x.shape}))
    put(f"{t}/X/.zgroup", "{}")
    put_v2(f"{t}/X/data", x[rows, cols], (2,), "zlib")
    put_v2(f"{t}/X/indices", cols.astype("<i4"), (3,), "gzip")
    put_v2(f"{t}/X/indptr", np.r_[0, np.cumsum((x != 0).sum(axis=1))].astype("<i8"), (4,))
    o, vo = np.nonzero(x.T)
    put(f"{t}/layers/csc/.zattrs", json.dumps({"encoding-type": "csc_matrix", "shape": x.shape}))
    put(f"{t}/layers/csc/.zgroup", "{}")
    put_v2(f"{t}/layers/csc/data", x.T[o, vo], (2,))
    put_v2(f"{t}/layers/csc/indices", vo.astype("<i4"), (2,))
    put_v2(f"{t}/layers/csc/indptr", np.r_[0, np.cumsum((x != 0).sum(axis=0))].astype("<i8"), (2,))
    put_v2(f"{t}/layers/dense", x, (2, 2), "zlib")
    put(f"{t}/obs/.zattrs", json.dumps({"encoding-type": "dataframe", "_index": "_index", "column-order": ["kind", "depth"]}))
    put_v2(f"{t}/obs/_index", np.array([f"cell{i}" for i in range(5)], dtype=object), (2,))
    put_v2(f"{t}/obs/depth", np.arange(5, dtype="<f8"), (5,))
    put(f"{t}/obs/kind/.zattrs", json.dumps({"encoding-type": "categorical"}))
    put_v2(f"{t}/obs/kind/codes", np.array([1, 0, -1, 1, 0], dtype="|i1"), (3,))
    put_v2(f"{t}/obs/kind/categories", np.array(["a", "bé"], dtype=object), (2,))
    put(f"{t}/var/.zattrs", json.dumps({"encoding-type": "dataframe", "_index": "_index", "column-order": []}))
    put_v2(f"{t}/var/_index", np.array(["g0", "g1", "g0"], dtype=object), (3,))
    put_v2(f"{t}/obsm/spatial", np.arange(10, dtype="<f8").reshape(5, 2), (2, 2))
    return f"{tmp_path}/s", x


def dense(df, shape):
    out = np.zeros(shape)
    for r in df.collect():
        out[r["row"], r["var"]] += r["value"]
    return out


def test_store(spark, store):
    path, x = store
    ds = zarr.read_store(spark, path)["tables/table"]
    assert (dense(ds.x, x.shape) == x).all() and (dense(ds.layers["csc"], x.shape) == x).all() and (dense(ds.layers["dense"], x.shape) == x).all()
    assert [(r["name"], r["kind"], r["depth"]) for r in ds.obs.orderBy("row").collect()] == [("cell0", "bé", 0.0), ("cell1", "a", 1.0), ("cell2", None, 2.0), ("cell3", "bé", 3.0), ("cell4", "a", 4.0)]
    assert {r["row"]: r["v"] for r in ds.obsm["spatial"].collect()}[3] == [6.0, 7.0]
    for layer in ("X", "layers/csc"):
        assert {r["row"]: r["value"] for r in zarr.gene(spark, f"{path}/tables/table/{layer}", 1).collect()} == {0: 2.0, 3: 5.0}
    assert {r["row"]: r["value"] for r in fields.resolve(ds, "X:g0").collect()} == {0: 0.0, 1: 1.0, 2: 0.0, 3: 4.0, 4: 0.0}  # the first of that name
    kinds = fields.resolve(ds, "obs:kind").orderBy("row").collect()
    assert [(r["code"], r["label"]) for r in kinds] == [(1, "bé"), (0, "a"), (-1, None), (1, "bé"), (0, "a")]
    with pytest.raises(ValueError, match="no 'nothing'"):
        fields.resolve(ds, "obs:nothing")
    with pytest.raises(ValueError, match="no gene"):
        fields.resolve(ds, "X:nothing")
    put(f"{path}/tables/table/X/.zattrs", json.dumps({"encoding-type": "odd"}))
    with pytest.raises(ValueError, match="odd"):
        zarr.matrix(spark, f"{path}/tables/table/X")


def test_third_version_and_images(spark, tmp_path):
    v = np.arange(2 * 5 * 6, dtype="<u2").reshape(2, 5, 6)
    meta = {"zarr_format": 3, "node_type": "array", "shape": v.shape, "data_type": "uint16", "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": [1, 3, 4]}}, "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}}, "fill_value": 0, "codecs": [{"name": "bytes", "configuration": {"endian": "big"}}, {"name": "gzip"}]}
    put(f"{tmp_path}/i/0/zarr.json", json.dumps(meta))
    for at in np.ndindex(2, 2, 2):
        full = np.zeros((1, 3, 4), dtype=">u2")
        part = v[at[0] : at[0] + 1, 3 * at[1] : 3 * at[1] + 3, 4 * at[2] : 4 * at[2] + 4]
        full[:, : part.shape[1], : part.shape[2]] = part
        put(f"{tmp_path}/i/0/c/{at[0]}/{at[1]}/{at[2]}", gzip.compress(full.tobytes()))
    assert (zarr.array(f"{tmp_path}/i/0").read() == v).all()
    for name in ("10", "2"):
        put(f"{tmp_path}/i/{name}/zarr.json", json.dumps(meta))
    assert zarr.levels(f"{tmp_path}/i") == ["0", "2", "10"]
    image = zarr.pixels(spark, f"{tmp_path}/i/0")
    assert image.agg(F.sum("value")).first()[0] == v.sum()
    got = {r["c"]: (r["low"], r["high"]) for r in zarr.channel_ranges(image, v.shape, False).collect()}
    assert got == {c: (float(v[c].min()), pytest.approx(np.percentile(v[c], 99.9))) for c in range(2)}
    half = {(r["c"], r["y"], r["x"]): r["value"] for r in zarr.downsampled(image).collect()}
    assert half[1, 0, 0] == v[1, :2, :2].mean() and half[0, 1, 2] == v[0, 2:4, 4:6].mean()
    meta["codecs"].append({"name": "blosc"})
    put(f"{tmp_path}/i/0/zarr.json", json.dumps(meta))
    with pytest.raises(ValueError, match="blosc"):
        zarr.array(f"{tmp_path}/i/0")


def test_archives(tmp_path):
    put(f"{tmp_path}/d/b/two.txt", "2")
    put(f"{tmp_path}/d/one.txt", "1" * 3_000_000)
    digest = archives.unpack(f"{tmp_path}/d")
    assert archives.pack(f"{tmp_path}/d", f"{tmp_path}/d.zarr.zip") == digest
    with tarfile.open(f"{tmp_path}/d.tar.gz", "w:gz") as t:
        t.add(f"{tmp_path}/d/one.txt", "one.txt")
        t.add(f"{tmp_path}/d/b/two.txt", "b/two.txt")
    name = archives.stamped(f"{tmp_path}/d.zarr.zip", digest)
    assert name.endswith(f"d-{digest[:12]}.zarr.zip") and archives.stamped(name, "f" * 64).endswith(f"d-{'f' * 12}.zarr.zip")
    os.rename(f"{tmp_path}/d.zarr.zip", name)
    root, fine = archives.open_store(name, f"{tmp_path}/work")
    assert fine is True and open(f"{root}/b/two.txt").read() == "2"
    root, fine = archives.open_store(f"{tmp_path}/d.tar.gz", f"{tmp_path}/work")
    assert fine is None and archives.unpack(root) == digest
    with zipfile.ZipFile(f"{tmp_path}/x-{'0' * 12}.zip", "w") as z:
        z.writestr("a", "other")
    assert archives.open_store(f"{tmp_path}/x-{'0' * 12}.zip", f"{tmp_path}/work")[1] is False
    with zipfile.ZipFile(f"{tmp_path}/bad.zip", "w") as z:
        z.writestr("../out.txt", "x")
    before = set(os.listdir(f"{tmp_path}/work"))
    with pytest.raises(ValueError, match="leaves"):
        archives.open_store(f"{tmp_path}/bad.zip", f"{tmp_path}/work")
    assert set(os.listdir(f"{tmp_path}/work")) == before and not os.path.exists(f"{tmp_path}/out.txt")
    with tarfile.open(f"{tmp_path}/link.tar", "w") as t:
        m = tarfile.TarInfo("l")
        m.type, m.linkname = tarfile.SYMTYPE, "/etc/passwd"
        t.addfile(m, io.BytesIO())
    with pytest.raises(ValueError, match="plain"):
        archives.unpack(f"{tmp_path}/link.tar")
    put(f"{tmp_path}/new/x", "new")
    archives.replace_folder(f"{tmp_path}/new", f"{tmp_path}/d")
    assert os.listdir(f"{tmp_path}/d") == ["x"] and not [f for f in os.listdir(tmp_path) if ".old-" in f]


def coordinates(path, x, barcodes, genes, zipped=True):
    rows, cols = np.nonzero(x.T)
    body = f"%%MatrixMarket matrix coordinate integer general\n%\n{x.shape[1]} {x.shape[0]} {len(rows)}\n" + "".join(f"{g + 1} {c + 1} {x[c, g]}\n" for g, c in zip(rows, cols))
    for name, text in (("matrix.mtx", body), ("barcodes.tsv", "\n".join(barcodes) + "\n"), ("features.tsv", "\n".join(f"id{i}\t{g}\tGene Expression" for i, g in enumerate(genes)) + "\n")):
        put(f"{path}/{name}.gz" if zipped else f"{path}/{name}", gzip.compress(text.encode()) if zipped else text)


X = np.array([[0, 2, 0], [1, 0, 0], [0, 0, 3], [4, 5, 6]])


@pytest.mark.parametrize("zipped", [True, False])
def test_coordinates(spark, tmp_path, zipped):
    coordinates(f"{tmp_path}/m", X, [f"b{i}-1" for i in range(4)], ["A", "B", "C"], zipped)
    names, features, x = instruments.read_coordinates(spark, f"{tmp_path}/m")
    assert (dense(x, X.shape) == X).all() and [r["name"] for r in names.orderBy("row").collect()] == [f"b{i}-1" for i in range(4)]
    assert [(r["name"], r["id"], r["kind"]) for r in features.orderBy("var").collect()] == [(g, f"id{i}", "Gene Expression") for i, g in enumerate("ABC")]
    one = np.zeros((2, 2), dtype=int)
    one[1, 1] = 1  # its only entry looks like the line of sizes
    coordinates(f"{tmp_path}/n", one, ["p", "q"], ["A", "B"], zipped)
    assert (dense(instruments.read_coordinates(spark, f"{tmp_path}/n")[2], one.shape) == one).all()


def test_exports(spark, tmp_path):
    codes = [f"b{i}-1" for i in range(4)]
    xen = f"{tmp_path}/xen"
    coordinates(f"{xen}/cell_feature_matrix", X, codes, ["A", "B", "C"])
    put(f"{xen}/cells.csv.gz", gzip.compress(("cell_id,x_centroid,y_centroid\n" + "".join(f"{c},{i}.5,{2 * i}\n" for i, c in enumerate(codes))).encode()))
    put(f"{xen}/cell_boundaries.csv", "cell_id,vertex_x,vertex_y\n" + "".join(f"{c},{i + dx},{i + dy}\n" for i, c in enumerate(codes) for dx, dy in ((0, 0), (1, 0), (1, 1), (0, 1))))
    put(f"{xen}/transcripts.csv", "transcript_id,cell_id,feature_name,x_location,y_location\n1,b0-1,A,0.1,0.2\n")
    ds = instruments.reader("io.xenium")(spark, xen)
    assert (dense(ds.x, X.shape) == X).all() and [(r["x"], r["y"]) for r in ds.obs.orderBy("row").collect()] == [(i + 0.5, 2 * i) for i in range(4)]
    hit = polygons.polygon_query(ds.shapes["cell_boundaries"], "ring", [[(1.5, 1.5), (1.6, 1.5), (1.5, 1.6)]])
    assert [r["name"] for r in hit.collect()] == ["b1-1"] and ds.shapes["transcripts"].first()["gene"] == "A"

    vis = f"{tmp_path}/vis"
    coordinates(f"{vis}/filtered_feature_bc_matrix", X, codes, ["A", "B", "C"])
    put(f"{vis}/spatial/tissue_positions.csv", "barcode,in_tissue,array_row,array_col,pxl_row_in_fullres,pxl_col_in_fullres\n" + "".join(f"{c},1,{i},{i},{10 * i},{20 * i}\n" for i, c in enumerate(codes)) + "other,0,9,9,9,9\n")
    put(f"{vis}/spatial/scalefactors_json.json", json.dumps({"spot_diameter_fullres": 8.0, "tissue_hires_scalef": 0.2, "tissue_lowres_scalef": 0.05}))
    ds = instruments.read_visium(spark, vis)
    spots = ds.shapes["spots"].orderBy("row").collect()
    assert [(r["x"], r["y"], r["radius"]) for r in spots] == [(20.0 * i, 10.0 * i, 4.0) for i in range(4)] and ds.transforms["downscaled_hires"][0] == 0.2
    os.makedirs(f"{tmp_path}/hd/binned_outputs")
    os.rename(vis, f"{tmp_path}/hd/binned_outputs/square_008um")
    assert len(instruments.read_visium_hd(spark, f"{tmp_path}/hd").shapes["bins"].first()["ring"]) == 4

    st = f"{tmp_path}/st"
    for image in ("i1", "i2"):
        put(f"{st}/intensities/{image}.csv", "Object,CD3,CD8\n1,0.5,0\n2,1.5,2\n")
        put(f"{st}/regionprops/{image}.csv", "Object,area,centroid-0,centroid-1\n1,10,1.0,2.0\n2,20,3.0,4.0\n")
        put(f"{st}/neighbors/{image}.csv", "Object,Neighbor,Distance\n1,2,2.8\n")
    ds = instruments.read_steinbock(spark, st)
    assert ds.obs.count() == 4 and ds.x.count() == 6 and ds.obsp["neighbors"].join(ds.obs, F.col("i") == F.col("row")).count() == 2
    coordinates(f"{tmp_path}/cu/counts", X, codes, ["A", "B", "C"])
    put(f"{tmp_path}/cu/s_MatchedBeadLocation.csv", "b0-1,1.0,2.0\nb1-1,3.0,4.0\n")
    assert instruments.read_curio(spark, f"{tmp_path}/cu").obs.where("x is not null").count() == 2
    put(f"{tmp_path}/m.csv", "a,b,c\n1,,3\n4,5,6\n")
    assert instruments.summary(spark, f"{tmp_path}/m.csv", ("a", "b", "z")) == {"a": "1"}
    with pytest.raises(ValueError, match="io.visium"):
        instruments.reader("visium")


def test_shape_index(spark, tmp_path):
    rng = np.random.default_rng(2)
    at = rng.uniform(0, 1000, (20_000, 2))
    rows = [(i, [(x, y), (x + 2, y), (x + 2, y + 2)]) for i, (x, y) in enumerate(at.tolist())] + [(-1, None), (-2, [])]
    df = spark.createDataFrame(rows, "id bigint, ring array<struct<x:double,y:double>>").repartition(4)
    path = f"{tmp_path}/shapes"
    assert writers.write_shapes(df, path, partitions=2) == 4096
    box = (100.0, 200.0, 180.0, 260.0)
    hit = writers.scan_shapes(spark, path, box, columns=["id"])
    assert {r["id"] for r in hit.collect()} == {i for i, (x, y) in enumerate(at) if x <= box[2] and x + 2 >= box[0] and y <= box[3] and y + 2 >= box[1]}
    plan = hit._jdf.queryExecution().toString()
    assert "bbox.xmin" in plan.split("PushedFilters", 1)[1] and "ring" not in plan.split("ReadSchema", 1)[1].split("\n")[0]
    assert writers.scan_shapes(spark, path, box, limit=5).count() == 0 < writers.scan_shapes(spark, path, box, limit=10_000).count()
    back = spark.read.parquet(path)
    assert back.count() == 20_002 and back.where("bbox is null").count() == 2
    report = writers.index_report(back.coalesce(1), 1024).first()
    loose = writers.index_report(df.withColumn("bbox", writers.ring_box_column()).coalesce(1), 1024).first()
    assert report["n"] == 20_000 and report["selectivity"] < loose["selectivity"] / 2 and report["xmax"] == pytest.approx(at[:, 0].max() + 2)
    again = f"{tmp_path}/again"
    writers.write_shapes(back, again, partitions=2)
    order = lambda p: [r["id"] for r in spark.read.parquet(p).coalesce(1).collect() if r["id"] >= 0]
    assert sorted(order(path)) == sorted(order(again))
    x = spark.createDataFrame([(i, v, 1.0) for v in range(10) for i in range(10 * v)], "row bigint, var int, value double")
    assert writers.chunk_length(x) == 16384
    names = {"tables/a": x, "tables/b": x, "shapes/s": df}
    assert set(writers.select_elements(names, {"tables": ["b"]})) == {"tables/b", "shapes/s"}
    with pytest.raises(KeyError):
        writers.select_elements(names, {"tables": ["z"]})
    import pyarrow as pa

    held = pa.ipc.open_stream(writers.to_ipc(spark.range(5))).read_all()
    assert held["id"].to_pylist() == list(range(5))


def test_binary_geometry(spark):
    import struct

    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 0.0)]
    flat = lambda o, r, z=(): struct.pack(f"{o}I", len(r)) + b"".join(struct.pack(f"{o}{2 + len(z)}d", *p, *z) for p in r)
    little = struct.pack("<BII", 1, 3, 2) + flat("<", ring) + flat("<", ring)
    big = struct.pack(">BII", 0, 1003, 1) + flat(">", ring, (9.0,))
    multi = struct.pack("<BII", 1, 6, 2) + little + struct.pack(">BII", 0, 3, 1) + flat(">", ring)
    extended = struct.pack("<BIII", 1, 3 | 0x80000000 | 0x20000000, 4326, 1) + flat("<", ring, (1.0,))
    open_ = ring[:-1]
    assert polygons.rings_of(little) == [open_] * 2 and polygons.rings_of(big) == [open_] and polygons.rings_of(multi) == [open_] * 3 and polygons.rings_of(extended) == [open_]
    with pytest.raises(ValueError):
        polygons.rings_of(struct.pack("<BIdd", 1, 1, 0.0, 0.0))
    df = spark.createDataFrame([(1, bytearray(little)), (2, None)], "id bigint, wkb binary")
    got = polygons.decode(df, "wkb", "id")
    assert {r["id"]: r["rings"] and len(r["rings"]) for r in got.collect()} == {1: 2, 2: None}
    back = polygons.decode(polygons.encode(got, "rings", "id"), "wkb", "id")
    assert {r["id"]: r["rings"] for r in back.collect()} == {r["id"]: r["rings"] for r in got.collect()}

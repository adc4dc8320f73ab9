"""Chunked array stores (Zarr, versions 2 and 3) read as DataFrames: arrays, tables of observations, sparse matrices.

Chunks are files; each is read by the task that needs it, through pyarrow's file systems, so a store can lie anywhere that
all executors see. Codecs: none, gzip, zlib, zstd, and variable-length UTF-8 text. Blosc and sharded chunks are refused with
their names, as no library for them is assumed.
"""

from __future__ import annotations

import gzip
import itertools
import json
import math
import struct
import zlib
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.fields import Dataset

#: Most rows whose offsets (8 bytes each) a sparse matrix's readers get.
MOST_ROWS = 50_000_000


def _file(path: str) -> bytes | None:
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    if system.get_file_info(at).type != fs.FileType.File:
        return None
    with system.open_input_stream(at, compression=None) as f:
        return f.read()


def _json(path: str) -> dict | None:
    data = _file(path)
    return None if data is None else json.loads(data)


def attributes(path: str) -> dict:
    """The attributes of a group or an array."""
    v3 = _json(f"{path}/zarr.json")
    return v3.get("attributes", {}) if v3 is not None else _json(f"{path}/.zattrs") or {}


def exists(path: str) -> bool:
    return any(_file(f"{path}/{name}") is not None for name in ("zarr.json", ".zarray", ".zgroup"))


def _decoded(data: bytes, codec: str) -> bytes:
    if codec == "gzip":
        return gzip.decompress(data)
    if codec == "zlib":
        return zlib.decompress(data)
    if codec == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    raise ValueError(f"codec {codec!r} can't be read")


def _texts(data: bytes) -> np.ndarray:
    n, at, out = struct.unpack_from("<I", data)[0], 4, []
    for _ in range(n):
        size = struct.unpack_from("<I", data, at)[0]
        out.append(data[at + 4 : at + 4 + size].decode())
        at += 4 + size
    return np.array(out, dtype=object)


@dataclass(frozen=True)
class Array:
    """What it takes to read an array's chunks: kept small, as it goes to every task."""

    path: str
    shape: tuple[int, ...]
    chunks: tuple[int, ...]
    dtype: str  # "text" for variable-length text
    fill: object
    order: str
    codecs: tuple[str, ...]
    prefix: str
    separator: str

    @property
    def grid(self) -> tuple[int, ...]:
        return tuple(-(-s // c) for s, c in zip(self.shape, self.chunks))

    def chunk(self, at: tuple[int, ...]) -> np.ndarray:
        """The part of the array in one chunk; fill values where its file is missing."""
        keep = tuple(slice(0, min(c, s - k * c)) for k, c, s in zip(at, self.chunks, self.shape))
        name = self.separator.join(map(str, at)) if at else "0"
        if self.prefix == "c" and not at:
            name = ""
        data = _file("/".join(x for x in (self.path, self.prefix, name) if x))
        if data is None:
            fill = "" if self.dtype == "text" and not self.fill else self.fill or 0
            return np.full([s.stop for s in keep], fill, dtype=object if self.dtype == "text" else self.dtype)
        for codec in reversed(self.codecs):
            data = _decoded(data, codec)
        flat = _texts(data) if self.dtype == "text" else np.frombuffer(data, dtype=self.dtype)
        return flat.reshape(self.chunks, order=self.order)[keep] if at else flat.reshape(())

    def read(self) -> np.ndarray:
        """The whole array: only for arrays whose size the caller knows to be bounded."""
        out = np.empty(self.shape, dtype=object if self.dtype == "text" else self.dtype)
        for at in itertools.product(*map(range, self.grid)):
            part = self.chunk(at)
            out[tuple(slice(k * c, k * c + n) for k, c, n in zip(at, self.chunks, part.shape))] = part
        return out


def array(path: str) -> Array:
    """The array at a path, of either version."""
    v3 = _json(f"{path}/zarr.json")
    if v3 is not None:
        if v3.get("node_type") != "array":
            raise ValueError(f"{path} is no array")
        codecs, order, dtype = [], "C", v3["data_type"]
        for c in v3["codecs"]:
            name, conf = c["name"], c.get("configuration") or {}
            if name == "bytes":
                little = conf.get("endian", "little") == "little"
                dtype = np.dtype({"bool": "?"}.get(dtype, dtype)).newbyteorder("<" if little else ">").str
            elif name == "vlen-utf8":
                dtype = "text"
            elif name in ("gzip", "zstd"):
                codecs.append(name)
            elif name == "transpose" and list(conf.get("order", [])) == list(range(len(v3["shape"])))[::-1]:
                order = "F"
            elif name != "crc32c":
                raise ValueError(f"codec {name!r} of {path} can't be read")
            else:
                raise ValueError(f"codec 'crc32c' of {path} can't be read")
        key = v3["chunk_key_encoding"]
        default = key["name"] == "default"
        sep = (key.get("configuration") or {}).get("separator", "/" if default else ".")
        return Array(path, tuple(v3["shape"]), tuple(v3["chunk_grid"]["configuration"]["chunk_shape"]), dtype, v3.get("fill_value"), order, tuple(codecs), "c" if default else "", sep)
    v2 = _json(f"{path}/.zarray")
    if v2 is None:
        raise ValueError(f"no array at {path}")
    codecs = []
    if v2.get("compressor"):
        name = v2["compressor"]["id"]
        if name not in ("gzip", "zlib", "zstd"):
            raise ValueError(f"codec {name!r} of {path} can't be read")
        codecs.append(name)
    filters = [f["id"] for f in v2.get("filters") or []]
    if [f for f in filters if f != "vlen-utf8"]:
        raise ValueError(f"filters {filters} of {path} can't be read")
    dtype = "text" if filters else np.dtype(v2["dtype"]).str
    return Array(path, tuple(v2["shape"]), tuple(v2["chunks"]), dtype, v2.get("fill_value"), v2.get("order", "C"), tuple(codecs), "", v2.get("dimension_separator", "."))


def _kind(a: Array) -> str:
    if a.dtype == "text" or np.dtype(a.dtype).kind in "USO":
        return "string"
    d = np.dtype(a.dtype)
    return "boolean" if d.kind == "b" else "double" if d.kind == "f" else "bigint"


def _plain(v: np.ndarray) -> np.ndarray:
    if v.dtype.kind == "S":
        return np.char.decode(v, "utf-8").astype(object)
    if v.dtype.kind in "UO":
        return v.astype(object)
    return v.astype("float64" if v.dtype.kind == "f" else "bool" if v.dtype.kind == "b" else "int64")


def column(spark: SparkSession, path: str) -> DataFrame:
    """(row, value) of an array of one dimension, each chunk read by its own task."""
    a = array(path)
    if len(a.shape) != 1:
        raise ValueError(f"{path} has {len(a.shape)} dimensions")

    def run(batches):
        for g in batches:
            for k in g["id"]:
                v = _plain(a.chunk((int(k),)))
                yield pd.DataFrame({"row": np.arange(len(v)) + int(k) * a.chunks[0], "value": v})

    return spark.range(0, a.grid[0], 1, max(1, min(a.grid[0], 2000))).mapInPandas(run, f"row bigint, value {_kind(a)}")


def vectors(spark: SparkSession, path: str) -> DataFrame:
    """(row, v) of an array of two dimensions whose chunks are read by rows."""
    a = array(path)
    n, width = a.grid[0], a.grid[1]

    def run(batches):
        for g in batches:
            for k in g["id"]:
                v = np.concatenate([a.chunk((int(k), c)) for c in range(width)], axis=1).astype("float64")
                yield pd.DataFrame({"row": np.arange(len(v)) + int(k) * a.chunks[0], "v": list(v)})

    return spark.range(0, n, 1, max(1, min(n, 2000))).mapInPandas(run, "row bigint, v array<double>")


def matrix(spark: SparkSession, path: str) -> DataFrame:
    """(row, var, value) without zeros of a dense array, or of a sparse group by rows (csr) or columns (csc). Other encodings
    are refused. Each chunk of a sparse matrix finds its rows in the offsets, of which there are at most MOST_ROWS."""
    kind = attributes(path).get("encoding-type", "array")
    if kind == "array":
        a = array(path)

        def dense(batches):
            for g in batches:
                for k in g["id"]:
                    for c in range(a.grid[1]):
                        v = a.chunk((int(k), c)).astype("float64")
                        i, j = np.nonzero(v)
                        yield pd.DataFrame({"row": i + int(k) * a.chunks[0], "var": j + c * a.chunks[1], "value": v[i, j]})

        return spark.range(0, a.grid[0], 1, max(1, min(a.grid[0], 2000))).mapInPandas(dense, "row bigint, var bigint, value double")
    if kind not in ("csr_matrix", "csc_matrix"):
        raise ValueError(f"encoding {kind!r} of {path} can't be read")
    data, indices, offsets = (array(f"{path}/{n}") for n in ("data", "indices", "indptr"))
    if offsets.shape[0] > MOST_ROWS + 1:
        raise ValueError(f"{path} has {offsets.shape[0] - 1} offsets; at most {MOST_ROWS} are read")
    first = spark.sparkContext.broadcast(offsets.read().astype("int64"))
    by_rows, same = kind == "csr_matrix", data.chunks == indices.chunks

    def sparse(batches):
        for g in batches:
            for k in g["id"]:
                k = int(k)
                v = data.chunk((k,)).astype("float64")
                lo = k * data.chunks[0]
                if same:
                    other = indices.chunk((k,)).astype("int64")
                else:
                    size = indices.chunks[0]
                    parts = [indices.chunk((c,)) for c in range(lo // size, -(-(lo + len(v)) // size))]
                    other = np.concatenate(parts).astype("int64")[lo - lo // size * size :][: len(v)]
                own = np.searchsorted(first.value, np.arange(lo, lo + len(v)), side="right") - 1
                rows, cols = (own, other) if by_rows else (other, own)
                keep = v != 0
                yield pd.DataFrame({"row": rows[keep], "var": cols[keep], "value": v[keep]})

    return spark.range(0, max(data.grid[0], 1) if data.shape[0] else 0, 1, max(1, min(data.grid[0], 2000))).mapInPandas(sparse, "row bigint, var bigint, value double")


def gene(spark: SparkSession, path: str, var: int) -> DataFrame:
    """(row, value) of one column: of a csc group only the chunks that hold it are read, of others the matrix is filtered."""
    if attributes(path).get("encoding-type") != "csc_matrix":
        return matrix(spark, path).where(F.col("var") == var).select("row", "value")
    offsets, data, indices = (array(f"{path}/{n}") for n in ("indptr", "data", "indices"))
    size = offsets.chunks[0]
    at = lambda i: int(offsets.chunk((i // size,))[i % size])
    lo, hi = at(var), at(var + 1)

    def part(a: Array) -> np.ndarray:
        c = a.chunks[0]
        joined = [a.chunk((k,)) for k in range(lo // c, -(-hi // c))] if hi > lo else [np.array([], dtype=a.dtype)]
        return np.concatenate(joined)[lo - lo // c * c :][: hi - lo]

    rows = pd.DataFrame({"row": part(indices).astype("int64"), "value": part(data).astype("float64")})  # one gene
    return spark.createDataFrame(rows, "row bigint, value double").where("value <> 0")


def table(spark: SparkSession, path: str, key: str) -> DataFrame:
    """key (from 0), name (the index) and the columns of a stored data frame; categories come as their labels, null for a
    missing one."""
    at = attributes(path)
    index = at.get("_index", "_index")

    def one(name: str) -> DataFrame:
        own = f"{path}/{name}"
        if attributes(own).get("encoding-type") == "categorical":
            labels = F.array(*(F.lit(str(v)) for v in array(f"{own}/categories").read()))  # categories, not rows
            return column(spark, f"{own}/codes").select("row", F.when(F.col("value") >= 0, F.get(labels, F.col("value").cast("int"))).alias(name))
        return column(spark, own).withColumnRenamed("value", name)

    columns = [one(index).withColumnRenamed(index, "name"), *(one(c) for c in at.get("column-order", []) if c not in ("row", "name"))]
    return reduce(lambda a, b: a.join(b, "row"), columns).withColumnRenamed("row", key)


def _members(path: str) -> list[str]:
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    if system.get_file_info(at).type != fs.FileType.Directory:
        return []
    found = system.get_file_info(fs.FileSelector(at))
    return sorted(f.base_name for f in found if f.type == fs.FileType.Directory and not f.base_name.startswith("."))


def read_table(spark: SparkSession, path: str) -> Dataset:
    """A stored annotated matrix (obs, var, X, layers, obsm, obsp) as a dataset; X may be missing."""
    obsp = {}
    for k in _members(f"{path}/obsp"):
        obsp[k] = matrix(spark, f"{path}/obsp/{k}").toDF("i", "j", "w")
    return Dataset(
        obs=table(spark, f"{path}/obs", "row"), var=table(spark, f"{path}/var", "var"), x=matrix(spark, f"{path}/X") if exists(f"{path}/X") else None,
        layers={k: matrix(spark, f"{path}/layers/{k}") for k in _members(f"{path}/layers")}, obsm={k: vectors(spark, f"{path}/obsm/{k}") for k in _members(f"{path}/obsm") if exists(f"{path}/obsm/{k}")}, obsp=obsp,
    )


def read_store(spark: SparkSession, path: str) -> dict[str, Dataset | DataFrame]:
    """Every table of a multi-element store by `tables/<name>`, and every Parquet of its points and shapes by their names."""
    out: dict[str, Dataset | DataFrame] = {f"tables/{k}": read_table(spark, f"{path}/tables/{k}") for k in _members(f"{path}/tables")}
    for kind, inner in (("points", "points.parquet"), ("shapes", "shapes.parquet")):
        for k in _members(f"{path}/{kind}"):
            out[f"{kind}/{k}"] = spark.read.parquet(f"{path}/{kind}/{k}/{inner}")
    if not out:
        raise ValueError(f"{path} holds no tables, points or shapes")
    return out


def levels(path: str) -> list[str]:
    """The arrays of an image pyramid, finest first, by the number of their names."""
    return sorted((m for m in _members(path) if exists(f"{path}/{m}")), key=lambda m: (int("".join(c for c in m if c.isdigit()) or 10**9), m))


def pixels(spark: SparkSession, path: str) -> DataFrame:
    """(c, y, x, value) of the pixels that are not 0 of an image (channels, rows, columns), a task for each chunk."""
    a = array(path)
    if len(a.shape) != 3:
        raise ValueError(f"{path} has {len(a.shape)} dimensions")
    places = list(itertools.product(*map(range, a.grid)))

    def run(batches):
        for g in batches:
            for k in g["id"]:
                at = np.unravel_index(int(k), a.grid)
                v = a.chunk(tuple(map(int, at)))
                c, y, x = np.nonzero(v)
                yield pd.DataFrame({"c": c + at[0] * a.chunks[0], "y": y + at[1] * a.chunks[1], "x": x + at[2] * a.chunks[2], "value": v[c, y, x].astype("float64")})

    n = math.prod(a.grid)
    return spark.range(0, len(places), 1, max(1, min(n, 2000))).mapInPandas(run, "c bigint, y bigint, x bigint, value double")


def channel_ranges(image: DataFrame, shape: tuple[int, ...], eight_bit: bool) -> DataFrame:
    """(c, low, high) to show each channel: 0..255 for 8 bits, else from the least value to the 99.9th percentile (1 at least),
    the pixels of value 0 counted."""
    n = shape[1] * shape[2]
    counts = image.groupBy("c", "value").agg(F.count("*").alias("k"))
    if eight_bit:
        return counts.select("c").distinct().select("c", F.lit(0.0).alias("low"), F.lit(255.0).alias("high"))
    zero = counts.groupBy("c").agg((F.lit(n) - F.sum("k")).alias("k")).where("k > 0").select("c", F.lit(0.0).alias("value"), "k")
    g = counts.unionByName(zero).groupBy("c").agg(F.min("value").alias("low"), F.expr("percentile(value, 0.999, k)").alias("p"))
    return g.select("c", "low", F.greatest("p", F.lit(1.0)).alias("high"))


def downsampled(image: DataFrame, factor: int = 2) -> DataFrame:
    """(c, y, x, value): means of blocks of factor x factor pixels, those of value 0 counted: the next level of a pyramid."""
    b = image.select("c", F.floor(F.col("y") / factor).alias("y"), F.floor(F.col("x") / factor).alias("x"), "value")
    return b.groupBy("c", "y", "x").agg((F.sum("value") / (factor * factor)).alias("value"))

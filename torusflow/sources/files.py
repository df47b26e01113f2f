"""Readers and writers of the files such studies exchange.

Binary files come through Spark's ``binaryFile`` source, so any store that Spark reads
will do; each file is one row and is decoded where it is read.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import time
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import digests


def encode_raw(solid: np.ndarray) -> bytes:
    """A 3D structure [z, y, x] of 0 and 1: three 32-bit sizes nx, ny, nz, then bytes with x fastest."""
    if solid.ndim != 3 or not np.isin(solid, (0, 1)).all():
        raise ValueError("a structure has three axes and values 0 and 1")
    nz, ny, nx = solid.shape
    return struct.pack("<3i", nx, ny, nz) + np.ascontiguousarray(solid, np.uint8).tobytes()


def decode_raw(data: bytes) -> np.ndarray:
    """The structure of an encoded file; its length and values must fit."""
    nx, ny, nz = struct.unpack_from("<3i", data)
    body = np.frombuffer(data, np.uint8, offset=12)
    if min(nx, ny, nz) < 1 or len(body) != nx * ny * nz or body.max(initial=0) > 1:
        raise ValueError("the file doesn't hold the structure it declares")
    return body.reshape(nz, ny, nx)


def _decoded(files: DataFrame, decode, schema: str, names: list[str]) -> DataFrame:
    def work(batches):
        for batch in batches:
            rows = [r for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for r in decode(path, content)]
            columns = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, columns)))) if rows else None

    def full(batches):
        return (b for b in work(batches) if b is not None)

    return files.select("path", "content").mapInArrow(full, schema)


def sample_id(path: Column) -> Column:
    """The number in sample_NNNNNN or a bare NNNNNN of a file's name; null without one."""
    return F.regexp_extract(path, r"(?:^|/)(?:sample_)?(\d{6})[^/]*$", 1).try_cast("long")


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, nx, ny, nz, grid): a packed structure for each .raw file."""

    def one(name, content):
        g = decode_raw(content)
        return [(name, g.shape[2], g.shape[1], g.shape[0], g.ravel().astype(int).tolist())]

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.raw").option("recursiveFileLookup", "true").load(path)
    rows = _decoded(files, one, "path string, nx long, ny long, nz long, grid array<long>", ["path", "nx", "ny", "nz", "grid"])
    return rows.select(sample_id(F.col("path")).alias("sample_id"), "nx", "ny", "nz", F.col("grid").cast("array<tinyint>").alias("grid"))


def read_pgm(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, nx, ny, grid) of binary grey images (P5): black is solid."""

    def one(name, content):
        head, at = [], 0
        while len(head) < 4:
            end = next(i for i in range(at, len(content)) if content[i : i + 1].isspace())
            if end > at:
                head.append(content[at:end])
            at = end + 1
        if head[0] != b"P5":
            raise ValueError("not a binary grey image")
        nx, ny = int(head[1]), int(head[2])
        body = np.frombuffer(content, np.uint8, nx * ny, at)
        return [(name, nx, ny, (body == 0).astype(int).tolist())]

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pgm").option("recursiveFileLookup", "true").load(path)
    rows = _decoded(files, one, "path string, nx long, ny long, grid array<long>", ["path", "nx", "ny", "grid"])
    return rows.select(sample_id(F.col("path")).alias("sample_id"), "nx", "ny", F.col("grid").cast("array<tinyint>").alias("grid"))


def read_text_grids(spark: SparkSession, path: str, side: int | None = None) -> DataFrame:
    """(sample_id, nx, ny, grid) of plain images: .ppm (P3, its red values; black is solid) and
    .dat (numbers; 0 is pore), by the ending of each file. A .dat has no sizes, so it must be
    a square, or have the side given."""

    def one(name, content):
        if name.endswith(".ppm"):
            words = [w for line in content.decode("ascii").split("\n") for w in line.split("#")[0].split()]
            if words[0] != "P3":
                raise ValueError("not a plain colour image")
            nx, ny = int(words[1]), int(words[2])
            values = [int(int(w) == 0) for w in words[4::3]]
        else:
            values = [int(float(w) != 0) for w in content.decode("ascii").split()]
            nx = ny = side or round(len(values) ** 0.5)
        if len(values) != nx * ny:
            raise ValueError(f"{name}: {len(values)} values for {nx} * {ny} cells")
        return [(name, nx, ny, values)]

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{ppm,dat}").option("recursiveFileLookup", "true").load(path)
    rows = _decoded(files, one, "path string, nx long, ny long, grid array<long>", ["path", "nx", "ny", "grid"])
    return rows.select(sample_id(F.col("path")).alias("sample_id"), "nx", "ny", F.col("grid").cast("array<tinyint>").alias("grid"))


#: Scanned rocks by name, with the edge in voxels and the voxel's size in micrometres.
ROCKS = {"berea": (400, 5.345)} | dict.fromkeys(("BanderaBrown", "BanderaGray", "Bentheimer", "Berea", "BSG", "BUG", "BB", "CastleGate", "Kirby", "Leopard", "Parker"), (1000, 2.25))


def read_rocks(spark: SparkSession, path: str, rocks: dict[str, tuple[int, float]] = ROCKS) -> DataFrame:
    """(rock, n, voxel_um, z, plane): the planes of headerless volumes of bytes (0 pore, 1 solid), a row each.

    The rock is the one whose name begins the file's; the length must be that of its edge
    cubed. A plane is a record of fixed length, so a volume is read in ranges by many tasks
    and none holds more than a plane at a time, whatever the volume's size.
    """
    jvm, names = spark._jvm, sorted(rocks, key=len, reverse=True)
    top = jvm.org.apache.hadoop.fs.Path(path)
    listed, parts = top.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(top, True), []
    while listed.hasNext():  # a file a rock
        file = listed.next()
        stem = file.getPath().getName()
        if not stem.endswith(".raw"):
            continue
        name = next((r for r in names if stem.startswith(r)), None) or next((r for r in names if stem.lower().startswith(r.lower())), None)
        if name is None:
            raise ValueError(f"no rock is called {stem}")
        n, um = rocks[name]
        if file.getLen() != n**3:
            raise ValueError(f"{stem} is no volume of {n} voxels a side")

        def plane(record, name=name, n=n, um=um, stem=stem):
            body, z = record
            if body.translate(None, b"\0\1"):
                raise ValueError(f"{stem} has values beyond 0 and 1")
            return name, n, um, z, bytearray(body)

        parts.append(spark.sparkContext.binaryRecords(file.getPath().toString(), n * n).zipWithIndex().map(plane))
    kinds = "rock string, n long, voxel_um double, z long, plane binary"
    return spark.createDataFrame(spark.sparkContext.union(parts), kinds) if parts else spark.createDataFrame([], kinds)


def read_table(spark: SparkSession, path, schema: str, required: tuple[str, ...] = ()) -> DataFrame:
    """Typed CSV files with a header, one path or several; a required column that a file lacks raises,
    and so does a value that isn't of its type."""
    rows = spark.read.schema(schema).option("header", "true").option("enforceSchema", "false").option("mode", "FAILFAST").csv(path)
    lost = [c for c in required if c not in rows.columns]
    if lost:
        raise ValueError(f"no columns {', '.join(lost)}")
    return rows


def read_union(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """Tables of one schema under several paths or patterns, one after another."""
    out = None
    for path in paths:
        one = read_table(spark, path, schema)
        out = one if out is None else out.unionByName(one)
    return out


#: Columns without which a solve isn't finished.
REQUIRED = ("K_xx", "K_yy", "K_zz", "k_xy", "k_xz", "k_yz", "conv_fx", "conv_fy", "conv_fz")


def complete(labels: DataFrame, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """Rows whose required columns are all there and finite; a table that lacks one has none. Names by case."""
    if not set(required) <= set(labels.columns):
        return labels.limit(0)
    fine = None
    for c in required:
        v = F.col(f"`{c}`").cast("double")
        ok = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
        fine = ok if fine is None else fine & ok
    return labels.where(fine)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """(kind, tag, sample_id, values) of flat .npy vectors laid out as kind/tag/sample_NNNNNN.npy."""

    def one(name, content):
        return [(name, np.load(io.BytesIO(content), allow_pickle=False).astype(float).ravel().tolist())]

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").option("recursiveFileLookup", "true").load(path)
    rows = _decoded(files, one, "path string, values array<double>", ["path", "values"])
    parts = F.split("path", "/")
    return rows.select(F.element_at(parts, -3).alias("kind"), F.element_at(parts, -2).alias("tag"), sample_id(F.col("path")).alias("sample_id"), "values").where("sample_id is not null")


def read_velocity(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, x, y, z, u, v, w) of .vel files: sizes nx, ny, nz, 3, then float triples with x fastest."""

    def one(name, content):
        nx, ny, nz, c = struct.unpack_from("<4i", content)
        v = np.frombuffer(content, "<f4", offset=16)
        if c != 3 or len(v) != 3 * nx * ny * nz:
            raise ValueError("the file doesn't hold the field it declares")
        v = v.reshape(nz, ny, nx, 3).astype(float)
        return [(name, x, y, z, *v[z, y, x].tolist()) for z in range(nz) for y in range(ny) for x in range(nx)]

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.vel").option("recursiveFileLookup", "true").load(path)
    rows = _decoded(files, one, "path string, x long, y long, z long, u double, v double, w double", ["path", "x", "y", "z", "u", "v", "w"])
    return rows.select(sample_id(F.col("path")).alias("sample_id"), "x", "y", "z", "u", "v", "w")


def read_results(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """All results.csv under a root: kind is the first folder, run the rest; a missing mode is single."""
    rows = spark.read.schema(schema).option("header", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "results.csv").csv(root)
    parts = F.split(F.regexp_extract(F.col("_metadata.file_path"), f"{root.rstrip('/')}/(.*)/results.csv$", 1), "/")
    rows = rows.select("*", F.element_at(parts, 1).alias("kind"), F.array_join(F.slice(parts, 2, 100), "/").alias("run")).where("kind <> ''")
    return rows.withColumn("mode", F.coalesce("mode", F.lit("single"))) if "mode" in rows.columns else rows


def read_metrics(spark: SparkSession, spec: str) -> DataFrame:
    """A row a fold of metrics.json files: (kind, seed, n_rows, koff_ceiling, group, target, mode,
    n_features, fold, n_test, r2, mae, mse). spec is a path, or path:group for one group alone;
    a group that no experiment has raises."""
    store, _, rest = spec.rpartition("/")
    name, _, group = rest.partition(":")
    path = f"{store}/{name}" if store else name
    folds = "array<struct<fold:int,n_test:int,r2:double,mae:double,mse:double>>"
    schema = f"kind string, seed long, n_rows long, koff_ceiling double, experiments array<struct<`group`:string,target:string,mode:string,n_features:long,folds:{folds}>>"
    rows = spark.read.schema(schema).option("multiLine", "true").option("pathGlobFilter", "*.json").json(path)
    rows = rows.select("kind", "seed", "n_rows", "koff_ceiling", F.explode("experiments").alias("e"))
    if group:
        rows = rows.where(F.col("e.group") == group)
        if rows.isEmpty():
            raise ValueError(f"no experiment of {group} in {path}")
    return rows.select("kind", "seed", "n_rows", "koff_ceiling", "e.group", "e.target", F.coalesce("e.mode", F.lit("single")).alias("mode"), "e.n_features", F.inline("e.folds"))


def read_velocity_dat(spark: SparkSession, path: str, nx: int, ny: int) -> DataFrame:
    """(sample_id, name, x, y, u, v) of .dat files: a line a cell with both components, x fastest. A file
    of another number of cells or columns raises."""

    def one(name, content):
        rows = [line.split() for line in content.decode().splitlines() if line.strip()]
        if len(rows) != nx * ny or any(len(r) != 2 for r in rows):
            raise ValueError(f"{name}: not {nx * ny} rows of 2")
        return [(name, i % nx, i // nx, float(u), float(v)) for i, (u, v) in enumerate(rows)]

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.dat").option("recursiveFileLookup", "true").load(path)
    rows = _decoded(files, one, "path string, x long, y long, u double, v double", ["path", "x", "y", "u", "v"])
    return rows.select(sample_id(F.col("path")).alias("sample_id"), F.element_at(F.split("path", "/"), -1).alias("name"), "x", "y", "u", "v")


POINTER = "CURRENT"


def _swapped(spark: SparkSession, new, place) -> None:
    """Renames a file over another one in one step; the store raises where it can't."""
    jvm = spark._jvm
    how = spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), spark._jsc.hadoopConfiguration()).rename(new, place, how)


def version(spark: SparkSession, path: str) -> str | None:
    """The folder of the version that is published under a path, None before the first."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{POINTER}")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return None
    return f"{path}/{spark.read.text(f'{path}/{POINTER}').first()[0]}"


def read_published(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows of the version that is published now; a reader keeps its version until ``kept`` later ones have come."""
    found = version(spark, path)
    if not found:
        raise FileNotFoundError(f"nothing is published under {path}")
    return spark.read.schema(schema).option("header", "true").csv(found)


def published(df: DataFrame, path: str, check=None, kept: int = 2) -> DataFrame:
    """Writes a table as CSV into a folder of its own version, checks what was written, and only then
    lets the pointer name it.

    check(rows) raises if the rows must not be published. The pointer is a small file that is
    replaced in one step, last of all: whenever a step fails, readers have the table of before.
    The ``kept`` latest versions stay, older ones are deleted after the swap.
    """
    spark, name = df.sparkSession, f"v{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    new, place = fs_path(f"{path}/{name}"), fs_path(f"{path}/{POINTER}")
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    seen = Observation()
    try:
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.option("header", "true").csv(f"{path}/{name}")
        rows = spark.read.schema(df.schema).option("header", "true").csv(f"{path}/{name}")
        if rows.count() != seen.get["n"]:
            raise ValueError("rows were lost in writing")
        if check:
            check(rows)
        sign = fs_path(f"{path}/.{name}")
        out = fs.create(sign, True)
        out.write(bytearray(name.encode()))
        out.close()
        _swapped(spark, sign, place)
    except BaseException:
        if version(spark, path) != f"{path}/{name}":  # the swap may have been done before it failed
            fs.delete(new, True)
            fs.delete(fs_path(f"{path}/.{name}"), True)
        raise
    old = sorted(s.getPath().getName() for s in fs.listStatus(fs_path(path)) if s.isDirectory() and s.getPath().getName().startswith("v"))
    for gone in [o for o in old if o < name][: -(kept - 1) or None]:
        fs.delete(fs_path(f"{path}/{gone}"), True)
    return rows


def write_run(folds: DataFrame, path: str, *, kind: str, arguments: dict) -> None:
    """results.csv (a row an experiment), metrics.json (with its folds) and arguments.json of a
    run, under a path. folds: (group, target, mode, n_features, seconds, fold, n_test, r2, mae, mse)."""
    spark, keys = folds.sparkSession, ["group", "target", "mode", "n_features"]
    stat = lambda c: [F.avg(c).alias(f"{c}_mean"), F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"{c}_std")]
    results = folds.groupBy(*keys).agg(*stat("r2"), *stat("mae"), *stat("mse"), F.sum("n_test").alias("n"), F.max("seconds").alias("seconds"))
    results.orderBy("group", "target", "mode").coalesce(1).write.mode("overwrite").option("header", "true").csv(f"{path}/results.csv")
    one = folds.groupBy(*keys).agg(F.sum("n_test").alias("n"), F.max("seconds").alias("seconds"), F.array_sort(F.collect_list(F.struct("fold", "n_test", "r2", "mae", "mse"))).alias("folds"))
    # An experiment's folds are few, and experiments are those of one run.
    whole = one.agg(F.array_sort(F.collect_list(F.struct(*keys, "n", "seconds", "folds"))).alias("experiments"))
    more = [F.lit(v).alias(k) for k, v in arguments.items() if k in ("seed", "n_rows", "koff_ceiling")]
    whole.select(F.lit(kind).alias("kind"), *more, "experiments").coalesce(1).write.mode("overwrite").json(f"{path}/metrics.json")
    spark.createDataFrame([(json.dumps(arguments, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/arguments.json")


def write_raw(structures: DataFrame, path: str) -> None:
    """A packed structure (sample_id, nx, ny, nz, grid) as .raw bytes a row, in a Parquet table of files
    (sample_id, name, content): stores differ in how single files are put, a table of them is the same in all."""

    def work(batches):
        for batch in batches:
            out = [(i, f"sample_{i:06d}.raw", encode_raw(np.array(g, np.uint8).reshape(nz, ny, nx))) for i, nx, ny, nz, g in zip(*(batch.column(k).to_pylist() for k in range(5)))]
            yield pa.RecordBatch.from_pydict(dict(zip(("sample_id", "name", "content"), map(list, zip(*out)))), schema=pa.schema([("sample_id", pa.int64()), ("name", pa.string()), ("content", pa.binary())])) if out else pa.RecordBatch.from_pydict({"sample_id": pa.array([], pa.int64()), "name": pa.array([], pa.string()), "content": pa.array([], pa.binary())})

    structures.select("sample_id", "nx", "ny", "nz", "grid").mapInArrow(work, "sample_id long, name string, content binary").write.mode("overwrite").parquet(path)


def verified_split(split: DataFrame, sha256: str) -> DataFrame:
    """The split, if its golden ids, sorted and joined by commas, have this digest; else it raises."""
    found = digests.id_digests(split.where("split = 'golden'"), []).first()
    if (found["ids_sha256"] if found else hashlib.sha256().hexdigest()) != sha256:
        raise ValueError("the golden ids differ from the manifest")
    return split


def vtk(fields: dict[str, np.ndarray], title: str = "fields") -> bytes:
    """A legacy VTK file of scalar [z, y, x] and vector [z, y, x, 3] fields: big-endian, x fastest."""
    nz, ny, nx = next(iter(fields.values())).shape[:3]
    out = [f"# vtk DataFile Version 3.0\n{title}\nBINARY\nDATASET STRUCTURED_POINTS\nDIMENSIONS {nx} {ny} {nz}\nORIGIN 0 0 0\nSPACING 1 1 1\nPOINT_DATA {nx * ny * nz}\n".encode()]
    for name, values in fields.items():
        head = f"VECTORS {name} float\n" if values.ndim == 4 else f"SCALARS {name} float 1\nLOOKUP_TABLE default\n"
        out += [head.encode(), np.ascontiguousarray(values, ">f4").tobytes(), b"\n"]
    return b"".join(out)


def write_vtk(structures: DataFrame, path: str, tiles: int = 1) -> None:
    """Legacy VTK bytes a row (sample_id, name, content) of structures (sample_id, nx, ny, nz, fields, flow), as a
    Parquet table of files.

    fields: a map of names to values of the cells, x fastest; flow: arrays of (u, v, w), null where
    there is none, which add ``velocity`` and its ``magnitude``. tiles: periods drawn along each axis.
    """

    def draw(r: dict) -> bytes:
        shape = (r["nz"], r["ny"], r["nx"])
        named = {e["name"]: np.array(e["values"], float).reshape(shape) for e in r["fields"]}
        if r["flow"] is not None:
            flow = np.array([[c["u"], c["v"], c["w"]] for c in r["flow"]], float).reshape(*shape, 3)
            named |= {"velocity": flow, "magnitude": np.sqrt(np.square(flow).sum(3))}
        return vtk({k: np.tile(v, [tiles] * 3 + [1] * (v.ndim - 3)) for k, v in named.items()}, f"sample {r['sample_id']}")

    def work(batches):
        for batch in batches:
            rows = batch.to_pylist()
            out = [[r["sample_id"] for r in rows], [f"sample_{r['sample_id']:06d}.vtk" for r in rows], [draw(r) for r in rows]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.string(), pa.binary()))], ["sample_id", "name", "content"])

    ordered = structures.select("sample_id", "nx", "ny", "nz", F.map_entries("fields").alias("entries"), "flow")
    ordered = ordered.select("sample_id", "nx", "ny", "nz", F.transform(F.array_sort("entries"), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("values"))).alias("fields"), "flow")
    ordered.mapInArrow(work, "sample_id long, name string, content binary").write.mode("overwrite").parquet(path)

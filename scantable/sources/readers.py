"""Readers and sinks of the file formats: candidate JSON, JSON lines, CSV tables, label text, meshes, reports, signed caches."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: fixed values: numpy types of the scalar names in mesh headers
PLY_TYPES = {"char": "i1", "uchar": "u1", "short": "i2", "ushort": "u2", "int": "i4", "uint": "u4", "float": "f4", "double": "f8", "int8": "i1", "uint8": "u1", "int16": "i2", "uint16": "u2", "int32": "i4", "uint32": "u4", "float32": "f4", "float64": "f8"}
CANDIDATE_SCHEMA = """scene_name string, candidates array<struct<candidate_id bigint, class_id int, class_name string, score double, fusion_score double, support_view_count int, num_seed_points int, seed_points_path string, support_views array<struct<frame_index int>>>>"""


def read_candidates(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Candidates of one file, several, or a folder, one row each, with their scene and source file."""
    raw = spark.read.schema(CANDIDATE_SCHEMA).option("multiLine", True).json(paths).withColumn("source_json", F.input_file_name())
    return raw.select("scene_name", "source_json", F.explode("candidates").alias("c")).select("scene_name", "source_json", "c.*")


def read_json_or_lines(spark: SparkSession, json_paths: list[str], line_paths: list[str], schema: str) -> DataFrame:
    """Records of JSON files (an object or an array each) and JSON lines files in one table; missing fields are NULL."""
    parts = []
    if json_paths:
        parts.append(spark.read.schema(schema).option("multiLine", True).json(json_paths))
    if line_paths:
        parts.append(spark.read.schema(schema).json(line_paths))
    if not parts:
        return spark.createDataFrame([], schema)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def append_lines(df: DataFrame, path: str) -> None:
    """Append rows as JSON lines."""
    df.write.mode("append").json(path)


def read_evaluation(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation table: class, class id, ap, ap50, ap25 with a header."""
    return spark.read.schema("class string, `class id` int, ap double, ap50 double, ap25 double").option("header", True).csv(path)


def write_evaluation(df: DataFrame, path: str) -> None:
    """Write an evaluation table with a header."""
    df.select(F.col("class_name").alias("class"), F.col("class_id").alias("class id"), "ap", "ap50", "ap25").write.mode("overwrite").option("header", True).csv(path)


def read_label_text(spark: SparkSession, path: str) -> DataFrame:
    """(scene, point_id, gt_id): one integer a line, the line's number being the point's.

    Files are read whole, as a line number exists only within its file; a file is one scene's points, some MB.
    """
    raw = spark.read.text(path, wholetext=True).withColumn("f", F.input_file_name())
    scene = F.regexp_extract("f", r"([^/]+?)\.[^./]*$", 1)
    lines = raw.select(scene.alias("scene"), F.posexplode(F.split(F.regexp_replace("value", r"\s+$", ""), r"\r?\n")).alias("point_id", "v"))
    return lines.select("scene", F.col("point_id").cast("long"), F.col("v").try_cast("int").alias("gt_id"))


def parse_ply(content: bytes) -> dict[str, dict[str, np.ndarray | list]]:
    """Elements of a mesh file (ascii or binary, little or big endian): name -> property -> values; lists as lists of arrays."""
    end = content.index(b"end_header") + len(b"end_header")
    header = content[:end].decode("ascii", "replace").split("\n")
    start = content.index(b"\n", end - 1) + 1
    kind, elements = "ascii", []
    for line in header:
        word = line.split()
        if not word:
            continue
        if word[0] == "format":
            kind = word[1]
        elif word[0] == "element":
            elements.append((word[1], int(word[2]), []))
        elif word[0] == "property":
            elements[-1][2].append((word[-1], word[1:-1]))
    out: dict[str, dict] = {}
    if kind == "ascii":
        tokens, at = content[start:].split(), 0
        for name, count, props in elements:
            cols: dict[str, list] = {p: [] for p, _ in props}
            for _ in range(count):
                for p, t in props:
                    if t[0] == "list":
                        n = int(tokens[at])
                        cols[p].append(np.array(tokens[at + 1 : at + 1 + n], dtype=float))
                        at += 1 + n
                    else:
                        cols[p].append(float(tokens[at]))
                        at += 1
            out[name] = {p: v if t[0] == "list" else np.array(v) for (p, t), v in zip(props, cols.values())}
        return out
    order, at = "<" if "little" in kind else ">", start
    for name, count, props in elements:
        if all(t[0] != "list" for _, t in props):
            dtype = np.dtype([(p, order + PLY_TYPES[t[0]]) for p, t in props])
            table = np.frombuffer(content, dtype, count, at)
            at += dtype.itemsize * count
            out[name] = {p: table[p] for p, _ in props}
            continue
        cols = {p: [] for p, _ in props}
        for _ in range(count):
            for p, t in props:
                if t[0] == "list":
                    size = np.dtype(order + PLY_TYPES[t[1]])
                    n = int(np.frombuffer(content, size, 1, at)[0])
                    item = np.dtype(order + PLY_TYPES[t[2]])
                    cols[p].append(np.frombuffer(content, item, n, at + size.itemsize))
                    at += size.itemsize + n * item.itemsize
                else:
                    one = np.dtype(order + PLY_TYPES[t[0]])
                    cols[p].append(np.frombuffer(content, one, 1, at)[0])
                    at += one.itemsize
        out[name] = {p: v if t[0] == "list" else np.array(v) for (p, t), v in zip(props, cols.values())}
    return out


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """(scene, point_id, x, y, z, r, g, b): vertices of mesh files; colours from red/green/blue or r/g/b, 0-255 brought to 0-1, else 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                v = parse_ply(content)["vertex"]
                n = len(v["x"])
                rgb = next(([np.asarray(v[c], dtype=np.float32) for c in names] for names in (("red", "green", "blue"), ("r", "g", "b")) if all(c in v for c in names)), [np.zeros(n, dtype=np.float32)] * 3)
                if max((c.max(initial=0) for c in rgb), default=0) > 1:
                    rgb = [c / np.float32(255) for c in rgb]
                scene = p.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                cols = [pa.array([scene] * n), pa.array(np.arange(n, dtype=np.int64)), *[pa.array(np.asarray(v[a], dtype=np.float32)) for a in "xyz"], *[pa.array(c) for c in rgb]]
                yield pa.RecordBatch.from_arrays(cols, names=["scene", "point_id", "x", "y", "z", "r", "g", "b"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "scene string, point_id long, x float, y float, z float, r float, g float, b float")


def read_faces(spark: SparkSession, path: str) -> DataFrame:
    """(scene, face_id, v0, v1, v2): triangles of mesh files; other polygons are an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                faces = parse_ply(content)["face"]
                lists = faces.get("vertex_indices", faces.get("vertex_index"))
                if any(len(f) != 3 for f in lists):
                    raise ValueError(f"{p} has faces that aren't triangles")
                tri = np.array(lists, dtype=np.int64).reshape(-1, 3)
                scene = p.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                yield pa.RecordBatch.from_arrays([pa.array([scene] * len(tri)), pa.array(np.arange(len(tri), dtype=np.int64)), *[pa.array(tri[:, i]) for i in range(3)]], names=["scene", "face_id", "v0", "v1", "v2"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "scene string, face_id long, v0 long, v1 long, v2 long")


def write_ply(points: list[tuple[float, ...]], faces: list[tuple[int, ...]] = ()) -> bytes:
    """A small binary mesh file with colours, for exports and tests: points are x, y, z, red, green, blue."""
    head = f"ply\nformat binary_little_endian 1.0\nelement vertex {len(points)}\n" + "".join(f"property float {a}\n" for a in "xyz") + "".join(f"property uchar {c}\n" for c in ("red", "green", "blue"))
    if faces:
        head += f"element face {len(faces)}\nproperty list uchar int vertex_indices\n"
    body = b"".join(struct.pack("<fffBBB", *p[:3], *map(int, p[3:])) for p in points) + b"".join(struct.pack("<Biii", 3, *f) for f in faces)
    return (head + "end_header\n").encode() + body


def markdown_report(df: DataFrame, name: str, value: str, top: int = 10) -> str:
    """The top gains and drops of a comparison as a Markdown table; only these rows are collected."""
    lines = [f"| {name} | {value} |", "| --- | --- |"]
    for order in (F.col(value).desc_nulls_last(), F.col(value).asc_nulls_last()):
        lines += [f"| {r[0]} | {r[1]:+.4f} |" for r in df.where(F.col(value).isNotNull()).orderBy(order, name).limit(top).select(name, value).collect()]
    return "\n".join(lines)


def config_hash(config: dict) -> str:
    """sha1 of a configuration, whatever the order of its keys."""
    import hashlib

    return hashlib.sha1(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()


def write_signed(df: DataFrame, path: str, config: dict, version: int = 1) -> None:
    """Write a table with its schema version and configuration hash beside it."""
    df.write.mode("overwrite").parquet(f"{path}/data")
    df.sparkSession.createDataFrame([(version, config_hash(config))], "schema_version int, config_hash string").coalesce(1).write.mode("overwrite").json(f"{path}/signature")


def read_signed(spark: SparkSession, path: str, config: dict, version: int = 1) -> DataFrame:
    """Read a signed table; ValueError if version or configuration differ."""
    r = spark.read.schema("schema_version int, config_hash string").json(f"{path}/signature").first()
    if r is None or (r.schema_version, r.config_hash) != (version, config_hash(config)):
        raise ValueError(f"{path} was written with another version or configuration")
    return spark.read.parquet(f"{path}/data")


def require_complete(expected: DataFrame, present: DataFrame, keys: list[str]) -> None:
    """ValueError naming up to ten keys that are expected but absent."""
    lost = expected.select(*keys).distinct().join(present, keys, "left_anti").limit(10).collect()
    if lost:
        raise ValueError(f"missing: {[tuple(r) for r in lost]}")


def read_table(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """A CSV table with a header and explicit columns; what doesn't fit its type is NULL."""
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)


def read_arrays(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """(scene, row, columns): numeric arrays of .npy files, a file a scene, its rows in order; a 1-D array is one column.

    Files are parsed by map tasks, in slices of rows: convert once to parquet, whose column pruning takes the place of memory maps.
    """
    import io

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                data = np.load(io.BytesIO(raw), allow_pickle=False)
                data = data.reshape(len(data), -1)
                if data.shape[1] < len(columns):
                    raise ValueError(f"{p} has {data.shape[1]} columns")
                scene = p.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                for at in range(0, len(data), 65536):
                    part = data[at : at + 65536].astype(np.float64)
                    yield pa.RecordBatch.from_arrays([pa.array([scene] * len(part)), pa.array(np.arange(at, at + len(part))), *[pa.array(part[:, i]) for i in range(len(columns))]], names=["scene", "row", *columns])

    schema = "scene string, row long, " + ", ".join(f"`{c}` double" for c in columns)
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, schema)


def read_matrices(spark: SparkSession, path: str) -> DataFrame:
    """(scene, name, rows, columns, values): text files of numbers separated by blanks - poses and intrinsics -, values by rows.

    The scene is the file's folder, the name the file's without suffix. A matrix whose rows differ in length raises ValueError.
    """
    raw = spark.read.text(path, wholetext=True).withColumn("f", F.input_file_name())
    lines = F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "")
    m = F.transform(lines, lambda x: F.transform(F.split(F.trim(x), r"\s+"), lambda y: y.try_cast("double")))
    out = raw.select(F.element_at(F.split("f", "/"), -2).alias("scene"), F.regexp_replace(F.element_at(F.split("f", "/"), -1), r"\.[^.]*$", "").alias("name"), m.alias("m"))
    even = F.forall("m", lambda r: F.size(r) == F.size(F.get("m", F.lit(0))))
    rows = F.when(even, F.size("m")).otherwise(F.raise_error(F.concat(F.lit("rows of different length in "), "name")).cast("int"))
    return out.select("scene", "name", rows.alias("rows"), F.coalesce(F.size(F.get("m", F.lit(0))), F.lit(0)).alias("columns"), F.flatten("m").alias("values"))


def read_depth(spark: SparkSession, path: str, scale: float) -> DataFrame:
    """(scene, frame_id, px, py, depth): depth maps as binary PGM files of 8 or 16 bits, over scale; 0 is no measurement and no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                kind, width, height, most, start = _pgm_header(raw, p)
                data = np.frombuffer(raw, dtype=">u2" if most > 255 else "u1", count=width * height, offset=start)
                at = np.flatnonzero(data)
                parts = p.rsplit("/", 2)
                frame = int("".join(c for c in parts[-1].rsplit(".", 1)[0] if c.isdigit()) or -1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([parts[-2]] * len(at)), pa.array(np.full(len(at), frame, dtype=np.int32)), pa.array((at % width).astype(np.int32)), pa.array((at // width).astype(np.int32)), pa.array(data[at].astype(np.float64) / scale)],
                    names=["scene", "frame_id", "px", "py", "depth"],
                )

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "scene string, frame_id int, px int, py int, depth double")


def _pgm_header(raw: bytes, path: str) -> tuple[str, int, int, int, int]:
    """(kind, width, height, largest value, where the pixels start) of a binary grey image."""
    fields, at = [], 0
    while len(fields) < 4:
        while raw[at : at + 1].isspace():
            at += 1
        if raw[at : at + 1] == b"#":
            at = raw.index(b"\n", at)
            continue
        end = at
        while end < len(raw) and not raw[end : end + 1].isspace():
            end += 1
        fields.append(raw[at:end])
        at = end
    if fields[0] != b"P5":
        raise ValueError(f"{path} is no binary grey image")
    return fields[0].decode(), int(fields[1]), int(fields[2]), int(fields[3]), at + 1


def audit_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256): size and checksum of every file, computed where it is read."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def read_modes(spark: SparkSession, folder: str, modes: list[str]) -> DataFrame:
    """Parquet folders of several modes (train, validation, ...) as one table with the mode; fields that a mode lacks are NULL."""
    parts = [spark.read.parquet(f"{folder}/{m}").withColumn("mode", F.lit(m)) for m in modes]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def write_colourised(points: DataFrame, masks: DataFrame, folder: str, least_score: float = 0.1) -> None:
    """One binary mesh file a scene: points in the colour of their class, grey without one.

    points: scene, point_id, x, y, z; masks: scene, mask_id, class_id, score, point_ids. Of each class the best mask of at least least_score counts (the smallest id on a
    tie); a point in several takes the best score. Each scene is written by one task, as a file is one stream: its points are sorted, then passed on in batches.
    """
    best = masks.where(F.col("score") >= least_score).groupBy("scene", "class_id").agg(F.max_by(F.struct("mask_id", "score", "point_ids"), F.struct("score", -F.col("mask_id"))).alias("m"))
    owned = best.select("scene", "class_id", "m.score", F.explode("m.point_ids").alias("point_id")).groupBy("scene", "point_id").agg(F.max_by("class_id", F.struct("score", -F.col("class_id"))).alias("class_id"))
    hue = lambda shift: F.when(F.col("class_id").isNull(), 128).otherwise(F.pmod(F.shiftright(F.xxhash64("class_id"), shift), F.lit(256))).cast("int")
    rows = points.select("scene", "point_id", "x", "y", "z").join(owned, ["scene", "point_id"], "left").select("scene", "point_id", "x", "y", "z", hue(0).alias("red"), hue(8).alias("green"), hue(16).alias("blue"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        kind = np.dtype([("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("red", "u1"), ("green", "u1"), ("blue", "u1")])
        os.makedirs(folder, exist_ok=True)
        counts: dict[str, int] = {}
        for batch in batches:
            scenes = np.array(batch.column("scene").to_pylist(), dtype=object)
            for scene in dict.fromkeys(scenes):
                own = batch.filter(pa.array(scenes == scene))
                body = np.zeros(own.num_rows, dtype=kind)
                for c in kind.names:
                    body[c] = own.column(c).to_numpy()
                with open(f"{folder}/{scene}.body", "ab" if scene in counts else "wb") as f:
                    f.write(body.tobytes())
                counts[scene] = counts.get(scene, 0) + own.num_rows
        for scene, n in counts.items():
            head = f"ply\nformat binary_little_endian 1.0\nelement vertex {n}\n" + "".join(f"property float {a}\n" for a in "xyz") + "".join(f"property uchar {c}\n" for c in ("red", "green", "blue")) + "end_header\n"
            with open(f"{folder}/{scene}.ply", "wb") as out, open(f"{folder}/{scene}.body", "rb") as f:
                out.write(head.encode())
                while part := f.read(1 << 20):
                    out.write(part)
            os.remove(f"{folder}/{scene}.body")
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["scene", "points"])

    rows.repartition("scene").sortWithinPartitions("scene", "point_id").mapInArrow(run, "scene string, points long").write.format("noop").mode("overwrite").save()

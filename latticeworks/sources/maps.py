"""Density maps (MRC files, plain or compressed) as a splittable source, and a sink that writes them.

A file is cut into ranges of sections, its slowest axis, whatever coordinate that is; a task opens the file where its range
begins and reads only the rows that the box asks for. Gzip and bzip2 files are one range each.
"""

from __future__ import annotations

import bz2
import gzip
import json
import re
import struct
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

VOXEL = "path string, z int, y int, x int, density float"
GRID = "path string, nz int, ny int, nx int, origin array<double>, spacing array<double>"
# Fixed values of the format: length of the header, sample types by mode, machine stamps.
HEADER, KINDS, STAMPS = 1024, {0: "i1", 1: "i2", 2: "f4", 6: "u2", 12: "f2"}, {"<": b"\x44\x44\x00\x00", ">": b"\x11\x11\x00\x00"}
#: Bytes of samples in one range, and rows in one Arrow batch.
WINDOW, BATCH = 32 << 20, 65_536
#: Opening a range counts as reading so large a part of a window, so no task gets more of them.
OPENED = 32
#: Stores that tasks open by position.
STORES = ("file", "hdfs", "s3", "s3a", "gs", "gcs")


@dataclass(frozen=True)
class Header:
    """``counts`` and ``axes`` by file axis, fastest first (axes: 0 x, 1 y, 2 z); ``origin``, ``spacing`` by x, y, z."""

    sample: str
    counts: tuple[int, int, int]
    axes: tuple[int, int, int]
    origin: tuple[float, float, float]
    spacing: tuple[float, float, float]
    first: int

    @property
    def section(self) -> int:
        """Bytes of one section."""
        return np.dtype(self.sample).itemsize * self.counts[0] * self.counts[1]

    @property
    def shape(self) -> tuple[int, int, int]:
        """Voxels along z, y, x."""
        return tuple(self.counts[self.axes.index(a)] for a in (2, 1, 0))


def parse_header(content: bytes) -> Header:
    """The header of an MRC file, or ValueError.

    A zero origin is taken from the start indices; angles must be 90 degrees, spacing finite and positive, the axis order
    a permutation, every axis at least 2 long, the mode one of real samples, and the file one volume.
    """
    if len(content) < HEADER:
        raise ValueError("the header is cut short")
    order = "<" if content[212:213] in (b"D", b"\x00") else ">"
    whole = lambda at, n: struct.unpack(f"{order}{n}i", content[at : at + 4 * n])
    real = lambda at, n: np.array(struct.unpack(f"{order}{n}f", content[at : at + 4 * n]), float)
    counts, (mode,), starts, axes = whole(0, 3), whole(12, 1), whole(16, 3), whole(64, 3)
    if mode not in KINDS or min(counts) < 2 or 401 <= whole(88, 1)[0] <= 630:
        raise ValueError("not a three-dimensional map of a known mode")
    if sorted(axes) != [1, 2, 3]:
        raise ValueError("the axis order is no permutation")
    if not np.allclose(real(52, 3), 90.0):
        raise ValueError("cell angles are not 90 degrees")
    spacing, origin = real(40, 3) / np.maximum(whole(28, 3), 1), real(196, 3)
    if np.allclose(origin, 0):
        origin = np.array([starts[axes.index(a)] for a in (1, 2, 3)], float) * spacing
    if not np.isfinite(origin).all() or not (np.isfinite(spacing) & (spacing > 0)).all():
        raise ValueError("origin or spacing is not finite and positive")
    return Header(order + KINDS[mode], counts, tuple(a - 1 for a in axes), tuple(origin.tolist()), tuple(spacing.tolist()), HEADER + whole(92, 1)[0])


def decode_map(content: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Density (z, y, x), origin and spacing (x, y, z) of a whole file; all densities must be finite."""
    content = _plain(pa.BufferReader(content)).read()
    h = parse_header(content)
    data = np.frombuffer(content, h.sample, int(np.prod(h.counts)), h.first).reshape(h.counts[::-1])
    data = np.transpose(data, [2 - h.axes.index(a) for a in (2, 1, 0)]).astype(np.float32)
    if not np.isfinite(data).all():
        raise ValueError("a density is not finite")
    return data, np.array(h.origin), np.array(h.spacing)


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    """The store and the path in it of a URI as Spark names it."""
    return fs.FileSystem.from_uri(re.sub("^s3a:", "s3:", re.sub("^(file:)?/+", "file:///", uri)))


def _open(uri: str):
    store, place = _place(uri)
    return store.open_input_file(place)


def _plain(file):
    """``file``, or what it unpacks to."""
    magic = file.read(3)
    file.seek(0)
    return gzip.GzipFile(fileobj=file) if magic[:2] == b"\x1f\x8b" else bz2.BZ2File(file) if magic == b"BZh" else file


def _exactly(file, n: int) -> bytes:
    got = file.read(n)
    if len(got) < n:
        raise ValueError("the densities are cut short")
    return got


@dataclass(frozen=True)
class Range:
    """Sections ``lo`` to before ``hi`` of a file; ``box`` has the first and last index by x, y, z."""

    uri: str
    header: Header
    lo: int
    hi: int
    box: tuple[tuple[int, int], ...]

    def sections(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """Section, first row, and the samples (rows, columns) of the box in it."""
        h = self.header
        (c0, c1), (r0, r1), _ = (self.box[a] for a in h.axes)
        c1, r1 = min(c1, h.counts[0] - 1), min(r1, h.counts[1] - 1)
        if c1 < c0 or r1 < r0:
            return
        line = np.dtype(h.sample).itemsize * h.counts[0]
        with _open(self.uri) as raw:
            file = _plain(raw)
            for s in range(self.lo, self.hi):
                file.seek(h.first + (s * h.counts[1] + r0) * line)
                rows = np.frombuffer(_exactly(file, (r1 - r0 + 1) * line), h.sample).reshape(-1, h.counts[0])
                yield s, r0, rows[:, c0 : c1 + 1].astype(np.float32)


def ranges(uri: str, box: tuple[tuple[int, int], ...], window: int) -> list[Range]:
    """The ranges of one file that meet ``box``; only its header is read."""
    box = tuple((max(lo, 0), hi) for lo, hi in box)
    with _open(uri) as raw:
        file = _plain(raw)
        h = parse_header(file.read(HEADER))
        size = raw.size() if file is raw else None
    if size is not None and size < h.first + h.section * h.counts[2]:
        raise ValueError(f"the densities of {uri} are cut short")
    lo, hi = box[h.axes[2]][0], min(box[h.axes[2]][1] + 1, h.counts[2])
    step = max(1, window // h.section) if size is not None else h.counts[2]
    return [Range(uri, h, s, min(s + step, hi), box) for s in range(lo, hi, step)]


@dataclass
class Ranges(InputPartition):
    """What one task reads: one large range, or small ones up to the window."""

    parts: list[Range]


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.uris = json.loads(options["uris"])
        self.window = int(options.get("window", WINDOW))
        self.floor = float(options["floor"]) if "floor" in options else None
        self.box = [tuple(b) for b in json.loads(options["box"])] if "box" in options else [(0, 2**31 - 1)] * 3

    def partitions(self) -> list[Ranges]:
        box, tasks, left = tuple(self.box), [], 0
        with ThreadPoolExecutor(16) as pool:
            for own in pool.map(lambda uri: ranges(uri, box, self.window), self.uris):
                for r in own:
                    size = r.header.section * (r.hi - r.lo) + max(HEADER, self.window // OPENED)
                    if not tasks or size > left:
                        tasks.append(Ranges([]))
                        left = self.window
                    tasks[-1].parts.append(r)
                    left -= size
        return tasks

    def read(self, partition: Ranges | None) -> Iterator[pa.RecordBatch]:
        for part in partition.parts if partition else ():  # none where no file meets the box
            yield from self._voxels(part)

    def _voxels(self, part: Range) -> Iterator[pa.RecordBatch]:
        h = part.header
        names = ["xyz"[a] for a in h.axes]
        for s, first_row, rows in part.sections():
            if not np.isfinite(rows).all():
                raise ValueError(f"a density of {part.uri} is not finite")
            r, c = np.nonzero(rows > self.floor) if self.floor is not None else np.indices(rows.shape).reshape(2, -1)
            at = {names[2]: np.full(len(r), s), names[1]: r + first_row, names[0]: c + part.box[h.axes[0]][0]}
            density = rows[r, c]
            for k in range(0, len(r), BATCH):
                cut = [pa.array(at[a][k : k + BATCH].astype(np.int32)) for a in "zyx"]
                yield pa.RecordBatch.from_arrays([pa.repeat(part.uri, len(cut[0])), *cut, pa.array(density[k : k + BATCH])], ["path", "z", "y", "x", "density"])


class _PushingReader(_Reader):
    """Also takes comparisons of z, y and x with constants, which narrow the box."""

    def pushFilters(self, filters):
        for f in filters:
            axis = "xyz".find(f.attribute[0]) if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and len(f.attribute) == 1 and len(f.attribute[0]) == 1 else -1
            if axis < 0 or not isinstance(f.value, int):
                yield f
                continue
            lo, hi = self.box[axis]
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                lo = max(lo, f.value + isinstance(f, GreaterThan))
            if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                hi = min(hi, f.value - isinstance(f, LessThan))
            self.box[axis] = (lo, hi)


class DensityMaps(DataSource):
    """Options: uris (a JSON list), floor, box (a JSON list of first and last index by x, y, z), window, filters."""

    @classmethod
    def name(cls) -> str:
        return "density_map"

    def schema(self) -> str:
        return VOXEL

    def reader(self, schema) -> DataSourceReader:
        return (_PushingReader if self.options.get("filters") == "true" else _Reader)(dict(self.options))


def _listed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


def _openable(uris: list[str]) -> bool:
    return all((re.match(r"(\w+):", u) or [None, "file"])[1] in STORES for u in uris)


def read_maps(spark: SparkSession, path: str, floor: float | None = 0.0, box: dict[str, tuple[int, int]] | None = None, window: int = WINDOW) -> DataFrame:
    """path, z, y, x, density of the voxels above ``floor`` (None: all) of the maps at ``path`` (file, folder or pattern).

    ``box``: first and last index of some of z, y, x; only sections and rows that it meets are read. Where
    ``spark.sql.python.filterPushdown.enabled`` is set, filters of the plan on z, y and x narrow it too. Headers, a
    kilobyte a file, are read on the driver when the plan is made, as file footers are. Densities that are read must be
    finite. Stores that tasks cannot open by position are read file by file.
    """
    limits = [list((box or {}).get(a, (0, 2**31 - 1))) for a in "xyz"]
    uris = _listed(spark, path).inputFiles()
    if _openable(uris):
        spark.dataSource.register(DensityMaps)
        read = spark.read.format("density_map").option("uris", json.dumps(sorted(uris))).option("box", json.dumps(limits)).option("window", window)
        read = read.option("filters", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false"))
        return (read if floor is None else read.option("floor", floor)).load()

    def run(batches):
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                data, _, _ = decode_map(bytes(content))
                for z, plane in enumerate(data):
                    y, x = np.nonzero(plane > floor) if floor is not None else np.indices(plane.shape).reshape(2, -1)
                    yield pd.DataFrame({"path": name, "z": np.int32(z), "y": y.astype(np.int32), "x": x.astype(np.int32), "density": plane[y, x]})

    inside = [F.col(a).between(*limits["xyz".index(a)]) for a in "zyx"]
    return _listed(spark, path).select("path", "content").mapInPandas(run, VOXEL).where(inside[0] & inside[1] & inside[2])


def read_grids(spark: SparkSession, path: str) -> DataFrame:
    """path, nz, ny, nx, origin and spacing (arrays x, y, z) of each map; tasks read headers only where they can."""
    listed = _listed(spark, path)
    direct = _openable(listed.inputFiles())

    def run(batches):
        for pdf in batches:
            rows = []
            for k, name in enumerate(pdf["path"]):
                with _open(name) if direct else pa.BufferReader(pdf["content"][k]) as raw:
                    h = parse_header(_plain(raw).read(HEADER))
                rows.append((name, *h.shape, list(h.origin), list(h.spacing)))
            yield pd.DataFrame(rows, columns=["path", "nz", "ny", "nx", "origin", "spacing"])

    return listed.select("path", *([] if direct else ["content"])).mapInPandas(run, GRID)


def _header_bytes(m: dict) -> bytes:
    """The header of a map that is written: ``m`` has nz, ny, nx, mode, axes, origin, spacing and big."""
    order = ">" if m["big"] else "<"
    size = (m["nx"], m["ny"], m["nz"])
    head = bytearray(HEADER)
    struct.pack_into(order + "10i", head, 0, *[size[a - 1] for a in m["axes"]], m["mode"], 0, 0, 0, *size)
    struct.pack_into(order + "6f3i3f2i", head, 40, *[n * s for n, s in zip(size, m["spacing"], strict=True)], 90, 90, 90, *m["axes"], 0, -1, -2, 1, 0)
    struct.pack_into(order + "i", head, 108, 20140)
    struct.pack_into(order + "3f", head, 196, *m["origin"])
    head[208:212], head[212:216] = b"MAP ", STAMPS[order]
    struct.pack_into(order + "f", head, 216, -1.0)
    return bytes(head)


def _section_bytes(m: dict, row: dict) -> bytes:
    """One section; a density that the mode cannot hold is an error."""
    columns, rows = ((m["nx"], m["ny"], m["nz"])[a - 1] for a in m["axes"][:2])
    plane = np.zeros((rows, columns), (">" if m["big"] else "<") + KINDS[m["mode"]])
    if row["c0"] is not None:
        values = np.asarray(row["density"], float)
        plane[np.asarray(row["c1"]), np.asarray(row["c0"])] = values
        if KINDS[m["mode"]][0] != "f" and (plane[np.asarray(row["c1"]), np.asarray(row["c0"])] != values).any():
            raise ValueError(f"mode {m['mode']} cannot hold every density of map {m['map_id']}")
    return plane.tobytes()


def write_maps(maps: DataFrame, voxels: DataFrame, path: str) -> None:
    """One file for each row of ``maps`` (map_id string, nz, ny, nx, mode, axes, origin, spacing, big), at ``path``.

    ``axes`` names the file's axes, fastest first (1 x, 2 y, 3 z); ``big`` is the byte order; ``voxels`` (map_id, z, y, x,
    density) may be sparse, and absent ones are 0. Sections are gathered by the cluster; one task then streams those of a
    map into its file, as a file has one writer. It has a name of its own until it is whole, so a task may run twice.
    """
    at = F.array("x", "y", "z")
    own = [F.element_at(at, F.element_at("axes", k)).cast("int").alias(f"c{k - 1}") for k in (1, 2, 3)]
    placed = voxels.join(maps.select("map_id", "axes"), "map_id").select("map_id", *own, F.col("density").cast("double").alias("density"))
    cells = placed.groupBy("map_id", "c2").agg(F.collect_list(F.struct("c1", "c0", "density")).alias("v"))
    fields = [F.col("v")[c].alias(c) for c in ("c1", "c0", "density")]
    rows = maps.join(cells, "map_id", "left").select(*maps.columns, "c2", *fields).repartition("map_id").sortWithinPartitions("map_id", "c2")
    names = ["map_id", "nz", "ny", "nx", "mode", "axes", "origin", "spacing", "big"]

    def run(batches):
        store, folder = _place(path)
        store.create_dir(folder, recursive=True)
        current, out, draft, at_section = None, None, "", 0

        def pad(m: dict, until: int) -> None:
            empty = _section_bytes(m, {"c0": None})
            for _ in range(until):
                out.write(empty)

        def finish(m: dict) -> None:
            pad(m, (m["nx"], m["ny"], m["nz"])[m["axes"][2] - 1] - at_section)
            out.close()
            store.move(draft, f"{folder}/{m['map_id']}.mrc")

        for batch in batches:
            for row in batch.to_pylist():
                if current is None or row["map_id"] != current["map_id"]:
                    if current is not None:
                        finish(current)
                    current, at_section = {n: row[n] for n in names}, 0
                    draft = f"{folder}/_{uuid.uuid4().hex}"
                    out = store.open_output_stream(draft)
                    out.write(_header_bytes(current))
                if row["c2"] is not None:
                    pad(current, row["c2"] - at_section)
                    out.write(_section_bytes(current, row))
                    at_section = row["c2"] + 1
        if current is not None:
            finish(current)
        yield from ()

    rows.mapInArrow(run, "map_id string").write.format("noop").mode("overwrite").save()

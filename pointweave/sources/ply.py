"""PLY point files: a data source with a partition a range of vertices, and a writer.

The header is read on the driver, bounded in size; executors then read only their
range's bytes of a binary file, or lines of an ASCII one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..functions.numeric import SH_0, base_color, logit, norm, resize_harmonics, sigmoid
from ..operators.ordering import evenly
from ..operators.validation import MOST_POINTS
from .files import open_input, staged_output

#: The format's scalar types and the point properties that must be there.
TYPES = {"float": "f4", "float32": "f4", "double": "f8", "float64": "f8", "uchar": "u1", "uint8": "u1", "char": "i1", "int8": "i1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4"}
REQUIRED = ("x", "y", "z", "f_dc_0", "f_dc_1", "f_dc_2", "opacity", "scale_0", "scale_1", "scale_2", "rot_0", "rot_1", "rot_2", "rot_3")
ENDS = {"ascii": "", "binary_little_endian": "<", "binary_big_endian": ">"}
HEADER_BYTES = 1 << 18
ROWS_A_PARTITION = 250_000


@dataclass
class Header:
    format: str
    count: int
    properties: list[tuple[str, str]]
    size: int

    @property
    def rest(self) -> int:
        return sum(name.startswith("f_rest_") for name, _ in self.properties)

    @property
    def degree(self) -> int | None:
        return next((d for d in range(4) if self.rest == 3 * ((d + 1) ** 2 - 1)), None)

    @property
    def dtype(self) -> np.dtype:
        return np.dtype([(name, ENDS[self.format] + TYPES[kind]) for name, kind in self.properties])


def parse_header(raw: bytes) -> Header:
    """The header at the start of a file; anything unusual in it is an error."""
    end = re.search(rb"end_header[ \t]*\r?\n", raw[:HEADER_BYTES])
    if not raw.startswith(b"ply") or end is None:
        raise ValueError("not a PLY file, or its header is incomplete or too large")
    format_, count, properties, inside = None, None, [], False
    for line in raw[: end.start()].decode("ascii").split("\n")[1:]:
        words = line.split()
        if words[:1] == ["format"]:
            format_ = words[1]
        elif words[:1] == ["element"]:
            inside = words[1] == "vertex"
            if inside:
                if count is not None or len(words) != 3 or properties:
                    raise ValueError("PLY vertex element is invalid")
                count = int(words[2])
        elif words[:1] == ["property"] and inside:
            if len(words) != 3 or words[1] not in TYPES:
                raise ValueError(f"PLY property is not a scalar: {line.strip()}")
            properties.append((words[2], words[1]))
    if format_ not in ENDS or not count or count < 1:
        raise ValueError("PLY has no points or an unknown format")
    return Header(format_, count, properties, end.end())


def describe(path: str) -> Header:
    """The checked header of a point file; only its first bytes are read."""
    with open_input(path) as f:
        header = parse_header(f.read(HEADER_BYTES))
    names = {name for name, _ in header.properties}
    missing = [name for name in REQUIRED if name not in names]
    if missing:
        raise ValueError(f"PLY lacks {', '.join(missing)}")
    if header.degree is None or any(f"f_rest_{i}" not in names for i in range(header.rest)):
        raise ValueError("PLY has incomplete harmonics")
    return header


@dataclass
class VertexRange(InputPartition):
    start: int = 0
    stop: int = 0

    def __init__(self, start: int, stop: int):
        super().__init__((start, stop))
        self.start, self.stop = start, stop


class PlyReader(DataSourceReader):
    def __init__(self, path: str, rows: int, budget: int):
        self.path, self.rows = path, rows
        self.header = describe(path)
        if self.header.count > budget:
            raise ValueError(f"PLY has {self.header.count} points; the limit is {budget}")

    def partitions(self) -> list[VertexRange]:
        return [VertexRange(a, min(a + self.rows, self.header.count)) for a in range(0, self.header.count, self.rows)]

    def read(self, partition: VertexRange) -> Iterator[pa.RecordBatch]:
        h, names = self.header, [n for n, _ in self.header.properties]
        with open_input(self.path) as f:
            f.seek(h.size)
            if h.format == "ascii":
                for _ in range(partition.start):
                    f.readline()
                table = np.array([f.readline().split() for _ in range(partition.stop - partition.start)], np.float64)
                columns = list(table.reshape(-1, len(names)).T)
            else:
                f.seek(h.size + partition.start * h.dtype.itemsize)
                wanted = (partition.stop - partition.start) * h.dtype.itemsize
                raw = f.read(wanted)
                if len(raw) != wanted:
                    raise ValueError("PLY ends before its last point")
                rows = np.frombuffer(raw, h.dtype)
                columns = [rows[n].astype(np.float64) for n in names]
        index = np.arange(partition.start, partition.stop, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(index), *map(pa.array, columns)], ["source_index", *names])


class PlySource(DataSource):
    """``spark.read.format("ply").load(path)``: source_index and every property as a double."""

    @classmethod
    def name(cls) -> str:
        return "ply"

    def schema(self) -> StructType:
        names = [name for name, _ in describe(self.options["path"]).properties]
        return StructType([StructField("source_index", LongType(), False), *[StructField(n, DoubleType()) for n in names]])

    def reader(self, schema: StructType) -> PlyReader:
        return PlyReader(self.options["path"], int(self.options.get("rowsPerPartition", ROWS_A_PARTITION)), int(self.options.get("maxPoints", MOST_POINTS)))


def read_raw(spark: SparkSession, path: str, **options: str) -> DataFrame:
    spark.dataSource.register(PlySource)
    return spark.read.format("ply").options(**options).load(path)


def activate(raw: DataFrame, harmonics: bool = True) -> DataFrame:
    """Point rows from a file's properties: opacity by sigmoid, scale by exponential, colour from the constant harmonic."""
    rest = sum(c.startswith("f_rest_") for c in raw.columns)
    degree = next(d for d in range(4) if rest == 3 * ((d + 1) ** 2 - 1))
    bound = lambda c, low, high: F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), F.col(c)))
    columns: list[Column] = [
        F.col("source_index"),
        F.array("x", "y", "z").alias("position"),
        F.array(*[F.exp(bound(f"scale_{i}", -20, 10)) for i in range(3)]).alias("scale"),
        F.array(*[F.col(f"rot_{i}") for i in range(4)]).alias("rotation"),
        F.array(*[base_color(F.col(f"f_dc_{i}")) for i in range(3)]).alias("color"),
        sigmoid(bound("opacity", -30, 30)).alias("opacity"),
        F.lit("unknown").alias("source"),
    ]
    if harmonics:
        n = (degree + 1) ** 2 - 1
        sh = [F.col(x) for c in range(3) for x in (f"f_dc_{c}", *[f"f_rest_{c * n + j}" for j in range(n)])]
        columns += [F.lit(degree).alias("sh_degree"), F.array(*sh).alias("sh")]
    return raw.select(*columns)


def read_points(spark: SparkSession, path: str, harmonics: bool = True, **options: str) -> DataFrame:
    return activate(read_raw(spark, path, **options), harmonics)


def read_preview(spark: SparkSession, path: str, most: int | None = None, harmonics: bool = True, **options: str) -> DataFrame:
    """Points of a file, evenly spaced ones alone if it has more than ``most``; source_index keeps each one's place in the file."""
    raw = read_raw(spark, path, **options)
    if most is not None:
        raw = raw.where(evenly(F.col("source_index"), F.lit(describe(path).count), most, "truncate"))
    return activate(raw, harmonics)


def properties(degree: int) -> list[str]:
    """The properties of a written file, in order."""
    rest = 3 * ((degree + 1) ** 2 - 1)
    return ["x", "y", "z", "nx", "ny", "nz", *[f"f_dc_{i}" for i in range(3)], *[f"f_rest_{i}" for i in range(rest)], "opacity", *[f"scale_{i}" for i in range(3)], *[f"rot_{i}" for i in range(4)]]


def deactivate(points: DataFrame, degree: int) -> DataFrame:
    """File properties of point rows, in file order, for a harmonics degree; missing harmonics come from the colour."""
    at = lambda c, i: F.get(c, F.lit(i)).cast("double")
    n, length = (degree + 1) ** 2, F.greatest(norm(F.col("rotation")), F.lit(1e-300))
    flat = F.array(*[(at("color", c) - 0.5) / SH_0 if k == 0 else F.lit(0.0) for c in range(3) for k in range(n)])
    if "sh" in points.columns:
        resized = F.when(F.col("sh").isNull(), flat)
        for d in range(4):
            resized = resized.when(F.col("sh_degree") == d, resize_harmonics(F.col("sh").cast("array<double>"), d, degree))
        flat = resized
    wide = points.withColumn("__sh", flat)
    columns = [at("position", i) for i in range(3)] + [F.lit(0.0)] * 3 + [at("__sh", c * n) for c in range(3)]
    columns += [at("__sh", c * n + k) for c in range(3) for k in range(1, n)] + [logit(F.col("opacity"))]
    columns += [F.log(F.greatest(F.lit(1e-8), at("scale", i))) for i in range(3)] + [at("rotation", i) / length for i in range(4)]
    return wide.select("source_index", *[c.alias(name) for c, name in zip(columns, properties(degree))])


def write_points(points: DataFrame, path: str, degree: int = 3) -> int:
    """One ASCII file in source order with nine significant digits; rows pass the driver a partition at a time.

    Non-finite values are refused before anything is written.  Returns the count.
    """
    rows = deactivate(points, degree).orderBy("source_index")
    names = properties(degree)
    bad = F.lit(False)
    for name in names:
        bad = bad | F.col(name).isNull() | F.isnan(name) | (F.abs(name) == float("inf"))
    if not rows.where(bad).isEmpty():
        raise ValueError("points have non-finite values")
    count = rows.count()
    with staged_output(path) as f:
        head = f"ply\nformat ascii 1.0\nelement vertex {count}\n" + "".join(f"property float {n}\n" for n in names) + "end_header\n"
        f.write(head.encode("ascii"))
        for row in rows.select(*names).toLocalIterator(prefetchPartitions=True):
            f.write((" ".join(f"{v:.9g}" for v in row) + "\n").encode("ascii"))
    return count

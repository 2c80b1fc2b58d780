"""Packages of files: manifests, safe paths, archives, imports, sidecars and exports.

Contents are read and hashed by executors through Spark's readers, so a package
may lie in any store that Spark reads.  What is written goes to a staging name
first and is moved when it is whole.
"""

from __future__ import annotations

import io
import json
import stat
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.validation import MOST_JSON_BYTES, MOST_JSONL_BYTES, MOST_PLY_BYTES
from . import ply, scene_files

#: Limits of a package and of its files, and of a semantic package.
MOST_FILES, MOST_FILE_BYTES, MOST_PACKAGE_BYTES = 10_000, 1 << 30, 4 << 30
MOST_SEMANTIC_FILES, MOST_SEMANTIC_BYTES = 200, 2 << 30
SEMANTIC_SUFFIXES = (".json", ".npz")
IMPORT_LIMITS = {".ply": MOST_PLY_BYTES, ".json": MOST_JSON_BYTES, ".jsonl": MOST_JSONL_BYTES}
PREVIEW = {"full": None, "fast": 100_000, "balanced": 250_000, "fine": 500_000}
MANIFEST = "manifest.json"


def unsafe_path(path: Column) -> Column:
    """Whether a path leaves its folder, names a drive, hides in a backslash or is empty."""
    return F.coalesce(path.rlike(r"^$|^/|^[A-Za-z]:|(^|/)\.{1,2}(/|$)|//|/$|\\|[\x00-\x1F]"), F.lit(True))


def suffix_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def file_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(path, bytes, sha256) of every file below a folder, hashed where it is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder).toUri().getPath().rstrip("/")
    inner = F.regexp_replace("path", rf"^.*?\Q{root}\E/", "")
    return files.select(inner.alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def archive_members(spark: SparkSession, archives: str) -> DataFrame:
    """(package, path, bytes, sha256, kind, content) of every member of zip files; kind is file, folder, link or encrypted.

    An archive is one row of a task, so it must fit one; members are read one at a
    time, and one that says it is larger than a package may be is not read at all.
    """
    schema = "package string, path string, bytes bigint, sha256 string, kind string, content binary"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        names = ["package", "path", "bytes", "sha256", "kind", "content"]
        types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]
        for batch in batches:
            for package, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with zipfile.ZipFile(io.BytesIO(raw)) as archive:
                    for info in archive.infolist():
                        mode = info.external_attr >> 16
                        kind = "folder" if info.is_dir() else "encrypted" if info.flag_bits & 1 else "file" if stat.S_IFMT(mode) in (0, stat.S_IFREG) else "link"
                        data = archive.read(info) if kind == "file" and info.file_size <= MOST_FILE_BYTES else None
                        row = [package, info.filename, info.file_size, hashlib.sha256(data).hexdigest() if data is not None else None, kind, data]
                        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names)

    files = spark.read.format("binaryFile").load(archives)
    return files.select("path", "content").mapInArrow(read, schema)


def declared_files(members: DataFrame) -> DataFrame:
    """(package, path, bytes, sha256) that each archive's own manifest declares."""
    listed = members.where(F.col("path") == MANIFEST).select("package", F.from_json(F.col("content").cast("string"), "files array<struct<path: string, bytes: bigint, sha256: string>>").alias("m"))
    return listed.select("package", F.explode("m.files").alias("f")).select("package", "f.path", "f.bytes", "f.sha256")


def package_problems(members: DataFrame, most_files: int = MOST_FILES, most_bytes: int = MOST_PACKAGE_BYTES, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """(package, path, problem): why archive members, or whole packages (null path), are refused.

    Members must be plain files at safe paths, no two alike but for case, of the
    given suffixes if any, and just those that the manifest declares, with their
    sizes and hashes.
    """
    alike = members.groupBy("package", F.lower("path").alias("__low")).agg(F.count("*").alias("__n"))
    joined = members.withColumn("__low", F.lower("path")).join(alike, ["package", "__low"])
    suffix = suffix_of(F.col("path")).isin(*suffixes) if suffixes else F.lit(True)
    rule = F.when(unsafe_path(F.col("path")), "unsafe_path").when(F.col("kind") != "file", F.col("kind")).when(F.col("__n") > 1, "repeated").when(F.col("bytes") > MOST_FILE_BYTES, "file_bytes").when(~suffix, "suffix")
    members_bad = joined.select("package", "path", rule.alias("problem")).where("problem IS NOT NULL")
    sums = members.groupBy("package").agg(F.count("*").alias("n"), F.sum("bytes").alias("b"), F.count_if(F.col("path") == MANIFEST).alias("m"))
    whole = F.when(F.col("n") > most_files + 1, "files").when(F.col("b") > most_bytes, "bytes").when(F.col("m") != 1, "manifest")
    whole_bad = sums.select("package", F.lit(None).cast("string").alias("path"), whole.alias("problem")).where("problem IS NOT NULL")
    said = declared_files(members).select("package", "path", F.col("bytes").alias("__b"), F.col("sha256").alias("__h"), F.lit(True).alias("__said"))
    real = members.where(F.col("path") != MANIFEST).select("package", "path", "bytes", "sha256", F.lit(True).alias("__real"))
    differ = F.when(F.col("__real").isNull(), "missing").when(F.col("__said").isNull(), "undeclared").when((F.col("bytes") != F.col("__b")) | ~F.col("sha256").eqNullSafe(F.col("__h")), "changed")
    compared = said.join(real, ["package", "path"], "full_outer").select("package", "path", differ.alias("problem")).where("problem IS NOT NULL")
    return members_bad.unionByName(whole_bad).unionByName(compared)


def build_packages(files: DataFrame) -> DataFrame:
    """(package, archive): files (package, path, content) as one stored zip a package, with its manifest.

    A package is bounded by MOST_PACKAGE_BYTES, so it is one group's work; paths
    must be safe and unlike each other.
    """
    checked = files.withColumn("path", F.when(unsafe_path(F.col("path")), F.raise_error(F.concat(F.lit("unsafe path: "), "path"))).otherwise(F.col("path")))
    schema = "package string, archive binary"

    def build(table: pa.Table) -> pa.Table:
        import hashlib

        rows = sorted(table.to_pylist(), key=lambda r: r["path"])
        if len({r["path"].lower() for r in rows}) != len(rows) or len(rows) > MOST_FILES or sum(len(r["content"]) for r in rows) > MOST_PACKAGE_BYTES:
            raise ValueError("a package needs distinct paths and must stay within its limits")
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as archive:
            listed = [{"path": r["path"], "bytes": len(r["content"]), "sha256": hashlib.sha256(r["content"]).hexdigest()} for r in rows]
            for name, data in [(r["path"], r["content"]) for r in rows] + [(MANIFEST, json.dumps({"files": listed}).encode())]:
                archive.writestr(zipfile.ZipInfo(name), data)
        return pa.table({"package": [rows[0]["package"]], "archive": [out.getvalue()]}, schema=pa.schema({"package": pa.string(), "archive": pa.binary()}))

    return checked.groupBy("package").applyInArrow(build, schema)


def extracted(members: DataFrame, **limits) -> DataFrame:
    """(package, path, content) of the files of packages without any problem; an error names one if there is one."""
    first = package_problems(members, **limits).orderBy("package", "path").first()
    if first is not None:
        raise ValueError(f"{first['package']}: {first['path'] or 'package'}: {first['problem']}")
    return members.where(F.col("path") != MANIFEST).select("package", "path", "content")


def import_route(path: Column, size: Column) -> Column:
    """(reader, problem) of a file to import: by its suffix, within that suffix's byte limit."""
    suffix = suffix_of(path)
    limit = F.try_element_at(F.create_map(*[F.lit(x) for pair in IMPORT_LIMITS.items() for x in pair]), suffix)
    problem = F.when(limit.isNull(), "suffix").when(size > limit, "bytes")
    return F.struct(F.when(problem.isNull(), F.substring(suffix, 2, 10)).alias("reader"), problem.alias("problem"))


def import_scene(spark: SparkSession, path: str, mode: str = "full") -> DataFrame:
    """The points of a scene file, by the reader of its suffix; ``mode`` names the preview's point budget, which only PLY files have."""
    if mode not in PREVIEW:
        raise ValueError(f"mode must be one of {', '.join(PREVIEW)}")
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    size = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).getLen()
    route = spark.range(1).select(import_route(F.lit(path), F.lit(size)).alias("r")).first()["r"]
    if route["problem"]:
        raise ValueError(f"{path}: {route['problem']}")
    readers: dict[str, Callable[[], DataFrame]] = {
        "ply": lambda: ply.read_preview(spark, path, PREVIEW[mode]),
        "jsonl": lambda: scene_files.read_lines(spark, path),
        "json": lambda: spark.read.option("multiLine", "true").json(path).select(F.explode("gaussians").alias("g")).select("g.*"),
    }
    return readers[route["reader"]]()


def write_sidecar(lineage: DataFrame, folder: str, bound_sha256: str, sources: int = 3) -> dict:
    """Lineage rows (source_index, initial_point_index, code) as a table with a record of what it is bound to; returns the record.

    The record holds counts, the bound file's hash and an order-free fingerprint
    of the rows; it is written last, so a table without one was never finished.
    """
    spark = lineage.sparkSession
    stats = lineage.agg(F.count("*"), F.count_distinct("source_index"), F.min("source_index"), F.max("source_index"), F.count_if(~F.coalesce(F.col("code").between(0, sources - 1) & (F.col("initial_point_index") >= 0), F.lit(False)))).first()
    n, distinct, low, high, bad = stats
    if bad or distinct != n or (n and (low, high) != (0, n - 1)):
        raise ValueError("lineage needs every source_index once, known codes and ancestors")
    lineage.select("source_index", "initial_point_index", "code").write.mode("errorifexists").parquet(f"{folder}/rows")
    record = {"bound_sha256": bound_sha256, "rows": n, "fingerprint": str(_fingerprint(spark.read.parquet(f"{folder}/rows")))}
    spark.createDataFrame([(json.dumps(record, sort_keys=True),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{folder}/record")
    return record


def _fingerprint(rows: DataFrame) -> int:
    return rows.agg(F.sum(F.xxhash64("source_index", "initial_point_index", "code").cast("decimal(38,0)"))).first()[0] or 0


def load_sidecar(spark: SparkSession, folder: str, bound_sha256: str) -> DataFrame:
    """The rows of a sidecar, once its record binds the given file and agrees with them."""
    record = json.loads(spark.read.text(f"{folder}/record").first()["value"])
    rows = spark.read.parquet(f"{folder}/rows")
    if record["bound_sha256"] != bound_sha256:
        raise ValueError("the sidecar is bound to another file")
    if record["rows"] != rows.count() or record["fingerprint"] != str(_fingerprint(rows)):
        raise ValueError("the sidecar's rows are not those of its record")
    return rows


def write_summary(results: DataFrame, folder: str, *order: str) -> None:
    """Results as one CSV file with a header, nested fields flattened with dots; a summary has a row a result."""
    flat = []
    for field in results.schema.fields:
        inner = field.dataType.fields if field.dataType.typeName() == "struct" else None
        flat += [F.col(f"`{field.name}`.`{x.name}`").alias(f"{field.name}.{x.name}") for x in inner] if inner else [F.col(f"`{field.name}`")]
    results.orderBy(*order).select(*flat).coalesce(1).write.mode("overwrite").csv(folder, header=True)


class Export:
    """A staged write: nothing is at ``target`` before ``finish``, and nothing stays after ``abort``."""

    def __init__(self, spark: SparkSession, target: str, most_bytes: int = MOST_PACKAGE_BYTES):
        self.spark, self.target, self.most_bytes = spark, target.rstrip("/"), most_bytes
        self.staging = f"{self.target}.staging-{uuid.uuid4().hex}"
        self._paths = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._system = self._paths(self.target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def write(self, rows: DataFrame, form: str = "parquet") -> None:
        rows.write.mode("append").format(form).save(self.staging)
        if self._system.getContentSummary(self._paths(self.staging)).getLength() > self.most_bytes:
            self.abort()
            raise ValueError("the export exceeds its limit")

    def finish(self) -> None:
        if self._system.exists(self._paths(self.target)) or not self._system.rename(self._paths(self.staging), self._paths(self.target)):
            self.abort()
            raise FileExistsError(self.target)

    def abort(self) -> None:
        self._system.delete(self._paths(self.staging), True)


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """(frame, label, xs, ys) of annotation files, JSON objects of frame to a list of (label, polygon of [x, y])."""
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, array<struct<label: string, polygon: array<array<double>>>>>", {"mode": "FAILFAST"}).alias("m"))
    marked = rows.select(F.explode("m").alias("frame", "marks")).select("frame", F.explode("marks").alias("a"))
    return marked.select("frame", "a.label", F.transform("a.polygon", lambda p: p[0]).alias("xs"), F.transform("a.polygon", lambda p: p[1]).alias("ys"))

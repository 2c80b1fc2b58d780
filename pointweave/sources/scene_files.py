"""Scenes as JSON lines and as chunked manifests.

A lines file has a header object and then chunks of consecutive points; a
manifest names the files of its chunks.  Both are validated by counts and
offsets before a point is used.  Point order is ``source_index``, never the order
of a DataFrame.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ordering import with_ordinal
from ..operators.validation import MOST_JSONL_BYTES, MOST_LINE_BYTES, MOST_POINTS
from .files import make_folder, open_input, size_of, staged_output

LINES, CHUNK, MANIFEST = "pointweave-lines/1", "pointweave-chunk/1", "pointweave-manifest/1"
CHUNK_ROWS = 25_000
THRESHOLD = 50_000
POINT = "struct<source_index: bigint, position: array<double>, scale: array<double>, rotation: array<double>, color: array<double>, opacity: double, sh_degree: int, sh: array<double>, source: string, confidence: double, hidden: boolean, object_id: string, semantic_ids: array<string>>"


def chunked(points: DataFrame, size: int = CHUNK_ROWS) -> DataFrame:
    """(chunk, offset, count, rows) with each chunk's rows in source order, as JSON texts."""
    columns = [c for c in points.columns]
    numbered = with_ordinal(points, ["source_index"]).withColumn("chunk", F.floor(F.col("ordinal") / size))
    packed = F.struct("ordinal", F.to_json(F.struct(*columns)).alias("j"))
    grouped = numbered.groupBy("chunk").agg(F.min("ordinal").alias("offset"), F.count("*").alias("count"), F.array_sort(F.collect_list(packed)).alias("p"))
    return grouped.select("chunk", "offset", "count", F.transform("p", lambda x: x["j"]).alias("rows"))


def chunk_lines(points: DataFrame, size: int = CHUNK_ROWS, chunk_format: str = CHUNK, most_bytes: int = MOST_LINE_BYTES) -> DataFrame:
    """(offset, line) of chunk objects; a chunk whose line would be too long is halved until its parts fit."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for offset, rows in zip(pdf["offset"], pdf["rows"]):
                todo = [(int(offset), list(rows))]
                while todo:
                    at, part = todo.pop()
                    line = f'{{"format":{json.dumps(chunk_format)},"offset":{at},"count":{len(part)},"gaussians":[{",".join(part)}]}}'
                    if len(line.encode()) <= most_bytes:
                        out.append((at, line))
                    elif len(part) == 1:
                        raise ValueError("a point does not fit a line")
                    else:
                        half = len(part) // 2
                        todo += [(at + half, part[half:]), (at, part[:half])]
            yield pd.DataFrame(out, columns=["offset", "line"])

    return chunked(points, size).mapInPandas(split, "offset bigint, line string")


def write_lines(points: DataFrame, header: dict, path: str, size: int = CHUNK_ROWS, lines_format: str = LINES, chunk_format: str = CHUNK) -> int:
    """One lines file; chunks pass the driver one partition at a time.  Returns the number of points."""
    count = points.count()
    lines = chunk_lines(points, size, chunk_format).orderBy("offset")
    with staged_output(path) as f:
        f.write((json.dumps({"format": lines_format, "gaussian_count": count, "scene": header}, ensure_ascii=False, allow_nan=False) + "\n").encode())
        for row in lines.toLocalIterator(prefetchPartitions=True):
            f.write((row["line"] + "\n").encode())
    return count


def check_lines_file(path: str) -> None:
    """Size and the final newline, before Spark reads the file."""
    size = size_of(path)
    if size > MOST_JSONL_BYTES:
        raise ValueError("the file is too large")
    with open_input(path) as f:
        f.seek(max(0, size - 1))
        if f.read(1) != b"\n":
            raise ValueError("the last line is incomplete")


def parsed_lines(lines: DataFrame) -> DataFrame:
    """Lines (value) as format, offset, count, gaussian_count, gaussians and size."""
    schema = f"format string, offset bigint, count bigint, gaussian_count bigint, gaussians array<{POINT}>"
    return lines.select(F.octet_length("value").alias("size"), F.from_json("value", schema, {"mode": "FAILFAST"}).alias("j")).select("size", "j.*")


def chunk_problems(chunks: DataFrame, total: int) -> DataFrame:
    """(offset, problem) of chunks (offset, count, held) that break the order or their own count; one row a chunk in the window."""
    w = Window.orderBy("offset")
    expected = F.lag(F.col("offset") + F.col("count"), 1, 0).over(w)
    last = F.lead("offset").over(w).isNull()
    checked = chunks.withColumns({"expected": expected, "last": last})
    problem = (
        F.when(~F.col("count").between(1, CHUNK_ROWS), "count")
        .when(F.col("held") != F.col("count"), "rows")
        .when(F.col("offset") != F.col("expected"), "offset")
        .when(F.col("last") & (F.col("offset") + F.col("count") != total), "total")
    )
    return checked.select("offset", problem.alias("problem")).where("problem IS NOT NULL")


def read_lines(spark: SparkSession, path: str, lines_format: str = LINES, chunk_format: str = CHUNK, most_points: int = MOST_POINTS) -> DataFrame:
    """The points of a lines file with ``ordinal``, their place in it, after all checks."""
    check_lines_file(path)
    parsed = parsed_lines(spark.read.text(path))
    shape = parsed.agg(F.count_if(F.col("format") == lines_format).alias("headers"), F.count_if(~F.col("format").isin(lines_format, chunk_format) | F.col("format").isNull()).alias("other"), F.max("size").alias("longest"), F.max(F.when(F.col("format") == lines_format, F.col("gaussian_count"))).alias("total")).first()
    if shape["headers"] != 1 or shape["other"] or shape["total"] is None or not 0 < shape["total"] <= most_points:
        raise ValueError("the header is missing or invalid")
    if shape["longest"] > MOST_LINE_BYTES:
        raise ValueError("a line is too long")
    chunks = parsed.where(F.col("format") == chunk_format)
    return _points(chunks, shape["total"])


def stream_lines(spark: SparkSession, folder: str, chunk_format: str = CHUNK, files_a_batch: int = 1) -> DataFrame:
    """Points of line files as they arrive in a folder: (ordinal, point fields), chunk by chunk in a batch's order.

    What a whole file's check needs, its header and its end, is ``read_lines``'s;
    here each chunk is checked alone, and a line too long or a chunk whose count
    is not its rows fails the stream.  The query's progress says how far it is.
    """
    lines = spark.readStream.option("maxFilesPerTrigger", files_a_batch).text(folder)
    chunks = parsed_lines(lines).where(F.col("format") == chunk_format)
    wrong = F.coalesce((F.col("size") > MOST_LINE_BYTES) | (F.size("gaussians") != F.col("count")) | (F.col("offset") < 0), F.lit(True))
    # Filters may be reordered, so a line of another format must not reach the error either.
    rows = F.when((F.col("format") == chunk_format) & wrong, F.raise_error(F.lit("a chunk is invalid"))).otherwise(F.col("gaussians"))
    return chunks.withColumn("gaussians", rows.cast(chunks.schema["gaussians"].dataType)).select("offset", F.posexplode("gaussians").alias("pos", "g")).select((F.col("offset") + F.col("pos")).alias("ordinal"), "g.*")


def _points(chunks: DataFrame, total: int) -> DataFrame:
    found = chunk_problems(chunks.select("offset", "count", F.size("gaussians").alias("held")), total).first()
    if found is not None or chunks.isEmpty():
        raise ValueError(f"chunk at {found['offset']}: {found['problem']}" if found else "there are no chunks")
    return chunks.select("offset", F.posexplode("gaussians").alias("pos", "g")).select((F.col("offset") + F.col("pos")).alias("ordinal"), "g.*")


def write_manifest(points: DataFrame, header: dict, folder: str, name: str = "scene", size: int = CHUNK_ROWS, threshold: int = THRESHOLD) -> str | None:
    """Chunk files under a new folder, then the manifest that names them; None for a scene of at most ``threshold`` points.

    Each task writes its chunks; the manifest is put in place last, so a reader
    sees a whole scene or the one before.  ``folder`` is one that all executors share.
    """
    count = points.count()
    if count <= threshold:
        return None
    data = f"{name}.data-{uuid.uuid4().hex}"
    make_folder(posixpath.join(folder, data))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            paths = []
            for chunk, offset, n, rows in zip(pdf["chunk"], pdf["offset"], pdf["count"], pdf["rows"]):
                path = posixpath.join(data, f"chunk-{chunk:06d}.json")
                with staged_output(posixpath.join(folder, path)) as f:
                    f.write(f'{{"format":{json.dumps(CHUNK)},"offset":{offset},"count":{n},"gaussians":[{",".join(rows)}]}}'.encode())
                paths.append(path)
            yield pd.DataFrame({"path": paths, "offset": pdf["offset"], "count": pdf["count"]})

    chunks = [r.asDict() for r in chunked(points, size).mapInPandas(write, "path string, offset bigint, count bigint").orderBy("offset").toLocalIterator()]
    target = posixpath.join(folder, f"{name}.manifest.json")
    with staged_output(target) as f:
        f.write(json.dumps({"format": MANIFEST, "gaussian_count": count, "chunk_size": size, "chunks": chunks, "scene": header}, ensure_ascii=False, allow_nan=False).encode())
    return target


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The points of a manifest's chunks with ``ordinal``; the whole manifest is checked before any chunk is opened."""
    with open_input(path) as f:
        manifest = json.load(f)
    chunks, total = manifest.get("chunks"), manifest.get("gaussian_count")
    if manifest.get("format") != MANIFEST or not isinstance(chunks, list) or not chunks or not isinstance(total, int) or total > MOST_POINTS:
        raise ValueError("the manifest is invalid")
    at = 0
    for c in chunks:
        unsafe = not isinstance(c.get("path"), str) or c["path"].startswith("/") or "\\" in c["path"] or ".." in c["path"].split("/") or ":" in c["path"]
        if unsafe or c.get("offset") != at or not isinstance(c.get("count"), int) or not 1 <= c["count"] <= CHUNK_ROWS:
            raise ValueError(f"chunk at {at} is invalid")
        at += c["count"]
    if at != total:
        raise ValueError("the chunks do not add up")
    root = posixpath.dirname(path)
    lines = spark.read.text([posixpath.join(root, c["path"]) for c in chunks], wholetext=True)
    return _points(parsed_lines(lines).where(F.col("format") == CHUNK), total)


def write_scene(points: DataFrame, path: str) -> None:
    """Point rows as JSON files under ``path``, after a check that every number is finite."""
    numbers = [c for c, kind in points.dtypes if kind in ("double", "float")]
    arrays = [c for c, kind in points.dtypes if kind in ("array<double>", "array<float>")]
    bad = F.lit(False)
    for c in numbers:
        bad = bad | F.coalesce(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(False))
    for c in arrays:
        bad = bad | F.coalesce(F.exists(c, lambda x: F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))
    if not points.where(bad).isEmpty():
        raise ValueError("JSON cannot hold non-finite numbers")
    points.write.mode("error").json(path)

"""Image evidence: mask arrays, region arrays, camera models and photo inventories."""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import focal_from_35mm
from .files import staged_output

#: Parameters of the camera models of a binary reconstruction.
CAMERA_PARAMETERS = {0: 3, 1: 4, 2: 4, 3: 5, 4: 8, 5: 8, 6: 12, 7: 5, 8: 4, 9: 5, 10: 12}
FEWEST_PHOTOS, MOST_PHOTOS = 2, 300
MOST_PHOTO_BYTES, MOST_TOTAL_BYTES = 30_000_000, 1_500_000_000
#: Numbers of tags, and the layout of the tag types that hold a number.
ORIENTATION, FOCAL_35MM, NESTED = 274, 41989, 34665
TAG_TYPES = {1: "B", 3: "H", 4: "I", 5: "II", 8: "h", 9: "i", 10: "ii"}
HEURISTIC_FOCAL = 0.9


def mask_pixels(files: DataFrame, value: float | None = None, threshold: float = 0.0) -> DataFrame:
    """(frame, mask_id, px, py) of set pixels of array files (frame, mask_id, content): equal to ``value``, or above ``threshold``."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for frame, mask, content in zip(pdf["frame"], pdf["mask_id"], pdf["content"]):
                grid = np.load(io.BytesIO(content), allow_pickle=False)
                if grid.ndim != 2:
                    raise ValueError(f"mask {mask} of {frame} has {grid.ndim} dimensions")
                y, x = np.nonzero(grid == value if value is not None else grid > threshold)
                yield pd.DataFrame({"frame": frame, "mask_id": mask, "px": x.astype(np.int64), "py": y.astype(np.int64)})

    return files.select("frame", "mask_id", "content").mapInPandas(read, "frame string, mask_id string, px bigint, py bigint")


def region_pixels(files: DataFrame, levels: tuple[str, ...] = ("l", "m", "s")) -> DataFrame:
    """(frame, level, region, px, py) of arrays (levels, height, width) of region numbers; negative numbers are none."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for frame, content in zip(pdf["frame"], pdf["content"]):
                grid = np.load(io.BytesIO(content), allow_pickle=False)
                if grid.ndim != 3 or len(grid) > len(levels):
                    raise ValueError(f"regions of {frame} have shape {grid.shape}")
                for name, level in zip(levels, grid):
                    y, x = np.nonzero(level >= 0)
                    yield pd.DataFrame({"frame": frame, "level": name, "region": level[y, x].astype(np.int64), "px": x.astype(np.int64), "py": y.astype(np.int64)})

    return files.select("frame", "content").mapInPandas(read, "frame string, level string, region bigint, px bigint, py bigint")


def import_regions(files: DataFrame, split: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pixels, skipped): the split decides which files are opened; held-out and unlisted frames are only named."""
    training = split.where("part = 'train'").select("frame")
    opened = files.join(training, "frame", "left_semi")
    reason = F.coalesce(F.concat(F.lit("part:"), F.col("part")), F.lit("not_in_split"))
    skipped = files.select("frame").join(training, "frame", "left_anti").join(split, "frame", "left").select("frame", reason.alias("reason"))
    return region_pixels(opened), skipped


def _cameras(raw: bytes) -> Iterator[tuple]:
    (n,), at = struct.unpack_from("<Q", raw), 8
    for _ in range(n):
        camera, model, width, height = struct.unpack_from("<iiQQ", raw, at)
        k = CAMERA_PARAMETERS[model]
        yield camera, model, width, height, list(struct.unpack_from(f"<{k}d", raw, at + 24))
        at += 24 + 8 * k


def _images(raw: bytes) -> Iterator[tuple]:
    (n,), at = struct.unpack_from("<Q", raw), 8
    for _ in range(n):
        image, *pose, camera = struct.unpack_from("<i7di", raw, at)
        end = raw.index(b"\0", at + 64)
        (points,) = struct.unpack_from("<Q", raw, end + 1)
        yield image, camera, raw[at + 64 : end].decode(), pose[:4], pose[4:], points
        at = end + 9 + 24 * points


def _points(raw: bytes) -> Iterator[tuple]:
    (n,), at = struct.unpack_from("<Q", raw), 8
    for _ in range(n):
        point, x, y, z, r, g, b, error, track = struct.unpack_from("<Q3d3BdQ", raw, at)
        ids = struct.unpack_from(f"<{2 * track}i", raw, at + 51)
        yield point, [x, y, z], [r, g, b], error, list(ids[::2])
        at += 51 + 8 * track


#: The three files of a binary reconstruction: their rows' parser and schema.
MODEL_FILES = {
    "cameras": (_cameras, "camera_id int, model int, width bigint, height bigint, params array<double>"),
    "images": (_images, "image_id int, camera_id int, name string, rotation array<double>, translation array<double>, points bigint"),
    "points3D": (_points, "point_id bigint, position array<double>, color array<int>, error double, image_ids array<int>"),
}


def read_model(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """Rows of cameras.bin, images.bin or points3D.bin; a file is one task's work, rows leave it in batches."""
    parse, schema = MODEL_FILES[kind]
    names = [part.split()[0] for part in schema.split(", ")]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                held = []
                for row in parse(content):
                    held.append(row)
                    if len(held) == 10_000:
                        yield pd.DataFrame(held, columns=names)
                        held = []
                yield pd.DataFrame(held, columns=names)

    return spark.read.format("binaryFile").load(f"{folder}/{kind}.bin").select("content").mapInPandas(rows, schema)


def write_model(cameras: list[tuple], images: list[tuple], points: Iterator[tuple], count: int, folder: str) -> None:
    """The three binary files.  Images come with [(x, y, point_id)], the ``count`` points with their track [(image_id, index)]; points are streamed."""
    with staged_output(f"{folder}/cameras.bin") as f:
        f.write(struct.pack("<Q", len(cameras)))
        for camera, model, width, height, params in cameras:
            f.write(struct.pack(f"<iiQQ{len(params)}d", camera, model, width, height, *params))
    with staged_output(f"{folder}/images.bin") as f:
        f.write(struct.pack("<Q", len(images)))
        for image, camera, name, rotation, translation, seen in images:
            f.write(struct.pack("<i7di", image, *rotation, *translation, camera) + name.encode() + b"\0" + struct.pack("<Q", len(seen)))
            for x, y, point in seen:
                f.write(struct.pack("<ddq", x, y, point))
    with staged_output(f"{folder}/points3D.bin") as f:
        f.write(struct.pack("<Q", count))
        written = 0
        for point, position, color, error, track in points:
            f.write(struct.pack("<Q3d3BdQ", point, *position, *color, error, len(track)))
            f.write(struct.pack(f"<{2 * len(track)}i", *[x for pair in track for x in pair]))
            written += 1
        if written != count:
            raise ValueError(f"{written} points came of {count}")


def photo_inventory(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, bytes, sha256) of photo files."""
    return spark.read.format("binaryFile").load(pattern).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def _segments(raw: bytes) -> tuple[int | None, int | None, bytes]:
    """(width, height, tag directories) of a JPEG or PNG file; sizes are null where the format is another or the file is cut."""
    width, height, tags = None, None, b""
    try:
        if raw.startswith(b"\x89PNG\r\n\x1a\n"):
            at = 8
            while at + 8 <= len(raw):
                (length,), kind = struct.unpack_from(">I", raw, at), raw[at + 4 : at + 8]
                if kind == b"IHDR":
                    width, height = struct.unpack_from(">II", raw, at + 8)
                elif kind == b"eXIf":
                    tags = raw[at + 8 : at + 8 + length]
                at += length + 12
        elif raw.startswith(b"\xff\xd8"):
            at = 2
            while at + 4 <= len(raw) and raw[at] == 0xFF:
                marker = raw[at + 1]
                if marker == 0xFF or 0xD0 <= marker <= 0xD8 or marker == 1:
                    at += 1 if marker == 0xFF else 2
                    continue
                if marker in (0xD9, 0xDA):
                    break
                (length,) = struct.unpack_from(">H", raw, at + 2)
                if marker == 0xE1 and raw[at + 4 : at + 10] == b"Exif\0\0" and not tags:
                    tags = raw[at + 10 : at + 2 + length]
                elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                    height, width = struct.unpack_from(">HH", raw, at + 5)
                at += 2 + length
    except struct.error:
        pass
    return width, height, tags


def _tag_values(tags: bytes, nested: bool) -> dict[int, float]:
    """Orientation and focal length of the main directory, and with ``nested`` of the photo's own below it; no other tag is kept."""
    found: dict[int, float] = {}
    end = {b"II*\0": "<", b"MM\0*": ">"}.get(tags[:4])
    if end is None or len(tags) < 8:
        return found
    places = [struct.unpack_from(f"{end}I", tags, 4)[0]]
    for depth in range(2):
        try:
            at = places[depth]
            (n,) = struct.unpack_from(f"{end}H", tags, at)
            for entry in range(at + 2, at + 2 + 12 * n, 12):
                tag, kind, count = struct.unpack_from(f"{end}HHI", tags, entry)
                if tag not in (ORIENTATION, FOCAL_35MM, NESTED) or kind not in TAG_TYPES or count != 1:
                    continue
                form = end + TAG_TYPES[kind]
                place = entry + 8 if struct.calcsize(form) <= 4 else struct.unpack_from(f"{end}I", tags, entry + 8)[0]
                value = struct.unpack_from(form, tags, place)
                if tag == NESTED:
                    places += [value[0]] * (nested and depth == 0)
                elif len(value) == 1 or value[1]:
                    found.setdefault(tag, value[0] / (value[1] if len(value) == 2 else 1))
        except (struct.error, IndexError):
            break
    return found


def photo_metadata(photos: DataFrame, nested: bool = False) -> DataFrame:
    """(name, source_sha256, source_width, source_height, orientation, width, height, focal_35mm, intrinsics_source, fx, fy, cx, cy) of photos (name, content).

    Sizes are those of the file and of the upright image.  A 35 mm focal length of
    1 to 2000 gives the intrinsics approximately; without one they are a guess.  It
    is looked for in the main directory, with ``nested`` also in the one below.
    Positions and all other tags never leave the task.  A null content, a cut
    file or another format has null sizes and intrinsics; a broken directory no tags.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name, digest, content in zip(pdf["name"], pdf["source_sha256"], pdf["content"]):
                width, height, tags = _segments(content or b"")
                values = _tag_values(tags, nested)
                rows.append((name, digest, width, height, values.get(ORIENTATION), values.get(FOCAL_35MM)))
            out = pd.DataFrame(rows, columns=["name", "source_sha256", "source_width", "source_height", "orientation", "focal_35mm"])
            yield out.astype({"source_width": "Int64", "source_height": "Int64", "orientation": "float64", "focal_35mm": "float64"})

    hashed = photos.select(F.col("name").cast("string").alias("name"), F.sha2("content", 256).alias("source_sha256"), "content")
    raw = hashed.mapInPandas(read, "name string, source_sha256 string, source_width bigint, source_height bigint, orientation double, focal_35mm double")
    turn = F.when(F.col("orientation").isin(*range(1, 9)), F.col("orientation")).otherwise(1).cast("int")
    focal = F.when(F.col("focal_35mm").between(1, 2000), F.col("focal_35mm"))
    known = raw.select("name", "source_sha256", "source_width", "source_height", turn.alias("orientation"), focal.alias("focal_35mm"))
    turned = F.col("orientation") >= 5
    sized = known.withColumns({"width": F.when(turned, F.col("source_height")).otherwise(F.col("source_width")), "height": F.when(turned, F.col("source_width")).otherwise(F.col("source_height"))})
    return with_intrinsics(sized)


def with_intrinsics(images: DataFrame) -> DataFrame:
    """Images (width, height, focal_35mm) with their source and fx, fy, cx, cy; a null focal length makes 0.9 of the longer side the focal length."""
    w, h, f = F.col("width").cast("double"), F.col("height").cast("double"), F.col("focal_35mm")
    pixels = F.when(f.isNotNull(), focal_from_35mm(f, w, h)).otherwise(HEURISTIC_FOCAL * F.greatest(w, h))
    source = F.when(f.isNotNull(), "exif_35mm_approximate").otherwise("heuristic")
    return images.withColumns({"intrinsics_source": source, "fx": pixels, "fy": pixels, "cx": w / 2, "cy": h / 2})


def camera_template(images: DataFrame, calibrated: DataFrame | None = None) -> DataFrame:
    """(image_name, width, height, source_sha256, intrinsics_source, K) to be filled in and imported: a calibration (name, K) where there is one, else the photo's own intrinsics."""
    zero, one = F.lit(0.0), F.lit(1.0)
    own = F.array(F.array("fx", zero, "cx"), F.array(zero, "fy", "cy"), F.array(zero, zero, one))
    given = F.lit(None).cast("array<array<double>>")
    if calibrated is not None:
        images = images.join(calibrated.select("name", F.col("K").alias("__K")), "name", "left")
        given = F.col("__K")
    source = F.when(given.isNotNull(), "user_calibrated").otherwise(F.col("intrinsics_source"))
    return images.select(F.col("name").alias("image_name"), "width", "height", "source_sha256", source.alias("intrinsics_source"), F.coalesce(given, own).alias("K"))


def photo_limits(photos: DataFrame) -> DataFrame:
    """(photos, distinct, bytes, problem): the first limit that an inventory breaks."""
    sums = photos.agg(F.count("*").alias("photos"), F.count_distinct("sha256").alias("distinct"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.coalesce(F.max("bytes"), F.lit(0)).alias("largest"))
    problem = F.when(~F.col("photos").between(FEWEST_PHOTOS, MOST_PHOTOS), "count").when(F.col("largest") > MOST_PHOTO_BYTES, "photo_bytes").when(F.col("bytes") > MOST_TOTAL_BYTES, "total_bytes")
    return sums.withColumn("problem", problem)


def exploded_tracks(points: DataFrame) -> DataFrame:
    """(point_id, frame, x, y) of a map of frames to pixels."""
    return points.select("point_id", F.explode("observations").alias("frame", "at")).select("point_id", "frame", F.get("at", F.lit(0)).alias("x"), F.get("at", F.lit(1)).alias("y"))


def polygon_pixels(polygons: DataFrame) -> DataFrame:
    """(frame, label, px, py) inside polygons (frame, label, width, height, xs, ys), by the even-odd rule at pixel centres."""

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                x, y = np.asarray(row.xs, float), np.asarray(row.ys, float)
                gx, gy = np.meshgrid(np.arange(row.width) + 0.5, np.arange(row.height) + 0.5)
                inside = np.zeros(gx.shape, bool)
                for x0, y0, x1, y1 in zip(x, y, np.roll(x, -1), np.roll(y, -1)):
                    if y0 != y1:
                        inside ^= ((y0 > gy) != (y1 > gy)) & (gx < (x1 - x0) * (gy - y0) / (y1 - y0) + x0)
                py, px = np.nonzero(inside)
                yield pd.DataFrame({"frame": row.frame, "label": row.label, "px": px.astype(np.int64), "py": py.astype(np.int64)})

    return polygons.mapInPandas(fill, "frame string, label string, px bigint, py bigint").distinct()

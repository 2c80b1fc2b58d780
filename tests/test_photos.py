"""Metadata of photos from hand-made files, and camera templates."""

import hashlib
import struct

import pytest

from pointweave.sources import evidence


def directory(end, main, below=()):
    """Tag directories: entries (tag, type, packed value), with those ``below`` in a nested one."""
    head = (b"II*\0" if end == "<" else b"MM\0*") + struct.pack(end + "I", 8)
    main = list(main)
    nested_at = 8 + 2 + 12 * (len(main) + bool(below)) + 4
    if below:
        main.append((34665, 4, struct.pack(end + "I", nested_at)))
    pack = lambda rows: struct.pack(end + "H", len(rows)) + b"".join(struct.pack(end + "HHI", t, k, 1) + v.ljust(4, b"\0") for t, k, v in rows) + bytes(4)
    return head + pack(main) + (pack(list(below)) if below else b"")


def jpeg(width, height, tags=None):
    out = b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"ab"
    if tags is not None:
        out += b"\xff\xe1" + struct.pack(">H", len(tags) + 8) + b"Exif\0\0" + tags
    return out + b"\xff\xc0" + struct.pack(">HBHHB", 8, 8, height, width, 0) + b"\xff\xda\0\2" + bytes(30)


def png(width, height, tags):
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + bytes(4)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">II", width, height) + bytes(5)) + chunk(b"eXIf", tags) + chunk(b"IEND", b"")


def short(end, n):
    return struct.pack(end + "H", n)


POSITION = (34853, 4, b"\1\2\3\4")
FILES = {
    "turned": jpeg(400, 300, directory("<", [(274, 3, short("<", 6)), POSITION, (41989, 3, short("<", 28))])),
    "big_end": png(640, 480, directory(">", [(274, 3, short(">", 3))], [(41989, 3, short(">", 50))])),
    "plain": jpeg(200, 100),
    "odd_turn": jpeg(200, 100, directory("<", [(274, 3, short("<", 9)), (41989, 3, short("<", 0))])),
    "broken": jpeg(200, 100, b"II*\0\xff\xff\0\0"),
    "cut": jpeg(200, 100)[:14],
    "empty": b"",
    "none": None,
}


@pytest.fixture(scope="module")
def found(spark):
    photos = spark.createDataFrame([(k, None if v is None else bytearray(v), "extra") for k, v in FILES.items()], "name string, content binary, width string")
    return {nested: {r["name"]: r for r in evidence.photo_metadata(photos, nested).collect()} for nested in (False, True)}


def test_tags_and_sizes(found):
    got = {k: (r["width"], r["height"], r["orientation"], r["focal_35mm"]) for k, r in found[False].items()}
    assert got["turned"] == (300, 400, 6, 28.0) and got["big_end"] == (640, 480, 3, None)
    assert got["plain"] == got["odd_turn"] == got["broken"] == (200, 100, 1, None)
    assert got["cut"] == got["empty"] == got["none"] == (None, None, 1, None)
    assert found[True]["big_end"]["focal_35mm"] == 50.0 and found[True]["turned"]["focal_35mm"] == 28.0
    assert "content" not in found[False]["turned"] and len(found[False]["turned"]) == 13


def test_intrinsics_follow_the_focal_length_or_a_guess(found):
    turned, plain = found[False]["turned"], found[False]["plain"]
    assert turned["fx"] == pytest.approx(28 * 500 / (36**2 + 24**2) ** 0.5) and turned["intrinsics_source"] == "exif_35mm_approximate"
    assert (plain["fx"], plain["cx"], plain["cy"], plain["intrinsics_source"]) == (180.0, 100.0, 50.0, "heuristic")
    assert plain["source_sha256"] == hashlib.sha256(FILES["plain"]).hexdigest() and found[False]["none"]["source_sha256"] is None


def test_templates_take_calibrations_first(spark):
    images = evidence.with_intrinsics(spark.createDataFrame([("a", 100, 50, None, "x"), ("b", 10, 20, 36.0, "y")], "name string, width long, height long, focal_35mm double, source_sha256 string"))
    given = spark.createDataFrame([("b", [[1.0, 0.0, 2.0], [0.0, 1.0, 3.0], [0.0, 0.0, 1.0]])], "name string, K array<array<double>>")
    rows = {r["image_name"]: r for r in evidence.camera_template(images, given).collect()}
    assert rows["a"]["K"] == [[90.0, 0.0, 50.0], [0.0, 90.0, 25.0], [0.0, 0.0, 1.0]] and rows["a"]["intrinsics_source"] == "heuristic"
    assert rows["b"]["K"][0] == [1.0, 0.0, 2.0] and rows["b"]["intrinsics_source"] == "user_calibrated"

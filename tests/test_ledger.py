"""Reloading against stored hashes, and a ledger that streams fill."""

import json

from pointweave.sources import ledger

IMAGE = "project string, name string, sha256 string, width long, height long"


def test_reload_names_the_first_problem_of_each_image(spark):
    images = [("p", "a", "1", 4, 3), ("p", "b", "2", 4, 3), ("p", "c", "3", 4, 3), ("p", "d/e", "4", 4, 3), ("p", "f", "5", 4, 3), ("p", "f", "5", 4, 3), ("p", None, "6", 4, 3), ("p", "g", None, 4, 3), ("p", "h", "8", 4, 3)]
    images += [("q", "a", "1", 1, 1), ("q", "A", "1", 1, 1), ("one", "a", "1", 1, 1)]
    stored = [("p", "a", "1", 4, 3), ("p", "b", "x", 4, 3), ("p", "f", "5", 4, 3), ("p", "g", None, 4, 3), ("p", "h", "8", 3, 4), ("q", "a", "1", 1, 1), ("q", "A", "1", 1, 1), ("one", "a", "1", 1, 1)]
    made = [spark.createDataFrame(rows, IMAGE) for rows in (images, stored)]
    got = sorted(map(tuple, ledger.reload_problems(*made).collect()), key=str)
    want = [("one", None, "count"), ("p", "b", "changed"), ("p", "c", "missing"), ("p", "d/e", "name"), ("p", "f", "repeated"), ("p", "g", "changed"), ("p", "h", "size"), ("p", None, "name")]
    assert got == sorted(want, key=str)
    folded = {(r["project"], r["name"]): r["problem"] for r in ledger.reload_problems(*made, fold_case=True).collect()}
    assert folded["q", "a"] == folded["q", "A"] == "repeated"
    assert ledger.reload_problems(spark.createDataFrame([], IMAGE), made[1]).isEmpty()


def rows(spark, folder):
    return sorted(((r["path"], r["sha256"], r["status"]) for r in ledger.entries(spark, folder).collect()), key=str)


def test_a_stream_takes_each_file_once_and_refuses_changes(spark, tmp_path):
    source, folder = tmp_path / "in", str(tmp_path / "ledger")
    source.mkdir()

    def run(name, files):
        (source / name).write_text("".join(json.dumps({"path": p, "sha256": h, "bytes": 5}) + "\n" for p, h in files))
        stream = spark.readStream.schema("path string, sha256 string, bytes long").json(str(source))
        stream.writeStream.foreachBatch(ledger.taker(folder)).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()

    assert rows(spark, folder) == []
    run("1.json", [("a", "1"), ("a", "1"), ("b", "2"), (None, "9")])
    run("2.json", [("a", "1"), ("b", "x"), ("c", "3"), ("c", "4")])
    want = sorted([("a", "1", "taken"), ("b", "2", "taken"), (None, "9", "refused"), ("b", "x", "refused"), ("c", "3", "taken"), ("c", "4", "refused")], key=str)
    assert rows(spark, folder) == want
    again = spark.createDataFrame([("a", "1", 5), ("b", "x", 5), ("c", "3", 5), ("c", "4", 5)], "path string, sha256 string, bytes long")
    ledger.taker(folder)(again, 1)
    assert rows(spark, folder) == want
    ledger.taker(folder)(again, 2)
    assert rows(spark, folder) == want

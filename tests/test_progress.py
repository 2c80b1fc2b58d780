"""Remaining time: rules, batch twin and stream."""

from pointweave.streaming import progress


def follow(*lines):
    run, out = None, []
    for line in lines:
        run, found = progress.observe(run, *line)
        out.append(found)
    return run, out


def test_printed_rates_need_three_samples():
    _, got = follow(*[(100.0 + i, 100 * (i + 1), 1000, 100.0) for i in range(3)])
    assert [g[3] for g in got] == [None, None, 7.0] and got[2][4] == "printed_rate"


def test_observed_intervals_resets_and_gaps():
    steady = [(float(t), n, 1000, None) for t, n in ((10, 10), (12, 50), (14, 90), (16, 130))]
    _, got = follow(*steady, (17.0, 130, 1000, None), (18.0, 5, 1000, None))
    assert got[3][2] == 20 and got[3][3] == 43.5 and got[4] is None and got[5][4] == "collecting"
    run, got = follow(*steady, (100.0, 150, 1000, None))
    assert got[-1][4] == "collecting" and run.first_at == 100.0
    assert follow(*steady, (17.0, None, None, None)) == (None, [*follow(*steady)[1], None])


def test_batch_and_stream_agree(spark):
    import random

    rng = random.Random(1)
    rows, at, n = [], 0.0, 0
    for _ in range(400):
        at += rng.choice([0.5, 1.0, 1.0, 1.1, 50.0]) if rng.random() < 0.2 else 1.0
        n = rng.choice([0, n, n + 3]) if rng.random() < 0.15 else n + 10
        rows.append(("j", at, n, 100_000, rng.choice([None, 10.0, 11.0]) if rng.random() < 0.4 else 10.0))
        if rng.random() < 0.02:
            rows.append(("j", at + 0.1, None, None, None))
    _, want = follow(*[r[1:] for r in rows])
    got = progress.track(spark.createDataFrame(rows, "job_id string, at double, iteration long, total long, printed double")).orderBy("at").collect()
    show = lambda rate, eta, basis: (rate and round(rate, 9), eta and round(eta, 6), basis)
    assert [show(r["rate"], r["eta"], r["basis"]) for r in got] == [show(*w[2:]) for w in want if w]
    assert {w[4] for w in want if w} == {"collecting", "printed_rate", "observed_intervals"}


def test_lines_parse(spark):
    rows = spark.createDataFrame([("Training progress:  30%|x | 300/1000 [00:03<00:07, 100.00it/s]",), ("Loading 3/9",), ("Optimizing splats 5/10 2.0s/it",), ("Training progress: 9/9",)], "line string")
    got = [(r["iteration"], r["total"], r["printed"]) for r in progress.parse_lines(rows).collect()]
    assert got == [(300, 1000, 100.0), (None, None, None), (5, 10, 0.5), (None, None, None)]


def test_batch_twin(spark):
    rows = [("j", float(t), n, 1000) for t, n in ((10, 10), (12, 50), (14, 90), (16, 130), (16.5, 130), (80, 200), (82, 100))]
    got = progress.track(spark.createDataFrame(rows, "job_id string, at double, iteration long, total long")).orderBy("at").collect()
    assert [r["run"] for r in got] == [1, 1, 1, 1, 2, 3] and got[3]["eta"] == 43.5 and not got[4]["stable"]


def test_stream(spark, tmp_path):
    source, sink = tmp_path / "in", tmp_path / "out"
    lines = [("j", 100.0 + i, f"Training progress: {100 * (i + 1)}/1000 [100.00it/s]") for i in range(3)]
    spark.createDataFrame(lines, "job_id string, at double, line string").coalesce(1).write.json(str(source))
    stream = spark.readStream.schema("job_id string, at double, line string").json(str(source))
    run = progress.stream(stream).writeStream.format("json").option("path", str(sink)).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = spark.read.json(str(sink)).where("basis <> 'stale'").orderBy("at").collect()
    assert [r["iteration"] for r in got] == [100, 200, 300] and got[-1]["eta"] == 7.0


def test_a_silent_job_is_stale():
    class Held:
        def exists(self):
            return True

        def get(self):
            return (1000, 10.0, [10.0, 12.0], [10, 50], [None, None])

    processor = progress.ProgressProcessor()
    processor.state = Held()
    (rows,) = processor.handleExpiredTimer(("j",), None, None)
    assert rows.values.tolist()[0][:4] == ["j", 12.0, 50, 1000] and rows["basis"][0] == "stale" and rows["eta"][0] is None

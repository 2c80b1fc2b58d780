"""Row numbers over wide rows and many ranges."""

import pytest
from pyspark.sql import functions as F

from pointweave.operators import ordering


@pytest.mark.parametrize("adaptive", ["true", "false"])
@pytest.mark.parametrize("partitions", ["8", "64"])
def test_each_ordinal_once_over_wide_rows(spark, adaptive, partitions):
    settings = {"spark.sql.adaptive.enabled": adaptive, "spark.sql.shuffle.partitions": partitions}
    old = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        n = 300_000
        wide = spark.range(n).select(F.xxhash64("id").alias("k"), *[F.sha2((F.col("id") * 7 + i).cast("string"), 256).alias(f"c{i}") for i in range(4)])
        numbered = ordering.with_ordinal(wide, ["k"], total="n")
        got = numbered.agg(F.count("*"), F.count_distinct("ordinal"), F.min("ordinal"), F.max("ordinal"), F.max("n"), F.count_distinct("c0")).first()
        assert tuple(got) == (n, n, 0, n - 1, n, n)
        # Neighbours in number are neighbours in order, over every border of ranges.
        after = numbered.select((F.col("ordinal") - 1).alias("ordinal"), F.col("k").alias("next"))
        assert numbered.join(after, "ordinal").where("next <= k").isEmpty()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_ordinals_within_groups(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 != 0, F.col("id") % 7).alias("g"), F.xxhash64("id").alias("k"))
    got = ordering.with_ordinal(rows, ["k"], ["g"], total="n").collect()
    groups = {}
    for r in got:
        groups.setdefault(r["g"], []).append((r["k"], r["ordinal"], r["n"]))
    assert sum(map(len, groups.values())) == 5000 and None in groups
    for held in groups.values():
        held.sort()
        assert [h[1] for h in held] == list(range(len(held))) and {h[2] for h in held} == {len(held)}
    assert ordering.with_ordinal(rows.where("false"), ["k"]).count() == 0


def test_reserved_half_of_a_sample(spark):
    rows = spark.range(1000).withColumn("seen", F.col("id") >= 990)
    got = {r["id"] for r in ordering.weighted_sample(rows, 40, F.lit(1.0), "id", reserved=F.col("seen")).collect()}
    assert len(got) == 40 and set(range(990, 1000)) <= got
    few = {r["id"] for r in ordering.weighted_sample(rows, 6, F.lit(1.0), "id", reserved=F.col("seen")).collect()}
    assert len(few & set(range(990, 1000))) >= 3


def test_held_out_rows_and_annotated_ones(spark):
    rows = spark.range(50)
    got = {r["id"] for r in ordering.every_nth(rows, ["id"], 8, also=F.col("id").isin(3, 16)).collect()}
    assert got == set(range(0, 50, 8)) | {3}

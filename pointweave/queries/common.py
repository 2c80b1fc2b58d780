"""Shared bindings: tables and the shapes that operators expect."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Query(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


def collector() -> tuple[dict[str, Query], Callable]:
    """A dictionary and a decorator that files queries in it under their function's name."""
    found: dict[str, Query] = {}

    def query(sql: str | None = None):
        def file(f):
            found[f.__name__] = Query(f, sql)
            return f

        return file

    return found, query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str) -> Column:
    """A double rounded for comparison, without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as points: point_id, label and three leading components."""
    e = table(spark, sf_dir, "embeddings")
    axes = [F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate("xyz")]
    return e.select(F.col("vec_id").alias("point_id"), F.col("label"), *axes)


VECTORS = "(SELECT vec_id AS point_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)"


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as samples on pixels: frame, px, py, depth, point_id and alpha."""
    x = table(spark, sf_dir, "lineitem")
    return x.select(
        F.col("l_returnflag").alias("frame"),
        F.floor("l_quantity").alias("px"),
        F.round(F.col("l_discount") * 100).cast("long").alias("py"),
        F.col("l_extendedprice").alias("depth"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("point_id"),
        F.col("l_discount").alias("alpha"),
    )


CELLS = "(SELECT l_returnflag AS frame, floor(l_quantity)::BIGINT AS px, round(l_discount * 100)::BIGINT AS py, l_extendedprice AS depth, l_orderkey * 10 + l_linenumber AS point_id, l_discount AS alpha FROM lineitem)"


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as region supports: a set of frame (day), region (type), key and point (user)."""
    e = table(spark, sf_dir, "events")
    day = F.date_format("ts", "yyyy-MM-dd")
    return e.select(day.alias("frame"), F.col("event_type").alias("region"), F.concat_ws("/", day, "event_type").alias("key"), F.col("user_id").alias("point")).distinct()


SIGHTINGS = "(SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS frame, event_type AS region, strftime(ts, '%Y-%m-%d') || '/' || event_type AS key, user_id AS point FROM events)"


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region, nation, customer and supplier as one tree of objects (id, parent_id, label, level)."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    r = table(spark, sf_dir, "region").select(name("r", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_name").alias("label"), F.lit("scene").alias("level"))
    n = table(spark, sf_dir, "nation").select(name("n", "n_nationkey"), name("r", "n_regionkey"), "n_name", F.lit("object"))
    c = table(spark, sf_dir, "customer").select(name("c", "c_custkey"), name("n", "c_nationkey"), "c_name", F.lit("part"))
    s = table(spark, sf_dir, "supplier").select(name("s", "s_suppkey"), name("n", "s_nationkey"), "s_name", F.lit("part"))
    return r.union(n).union(c).union(s)


TREE = """(SELECT 'r' || r_regionkey AS id, NULL::VARCHAR AS parent_id, r_name AS label, 'scene' AS level FROM region
UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name, 'object' FROM nation
UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name, 'part' FROM customer
UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, s_name, 'part' FROM supplier)"""

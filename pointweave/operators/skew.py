"""Self-joins in which one key may hold a large part of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a key up to which its pairs are one cell.
BLOCK_ROWS = 2_000


def pair_cells(rows: DataFrame, by: Sequence[str], block: int = BLOCK_ROWS) -> DataFrame:
    """``rows``, each as often as its key needs, with ``cell`` (low, high, own): where pairs of one key of ``by`` meet.

    A key of few rows is one cell.  The rows of a larger one are dealt into blocks
    of about ``block`` by a hash, and every pair of blocks is a cell, so its pairs
    are a triangle of tasks of bounded size.  Join two aliases on ``by`` with
    ``meet``, and each pair meets once in either order.  Keys are counted first,
    before any row moves twice; those with a null in ``by`` meet nothing.
    """
    sizes = rows.groupBy(*by).agg(F.count("*").alias("__n")).where(F.col("__n") > block)
    counted = rows.join(sizes, list(by), "left")
    blocks = F.coalesce(F.ceil(F.col("__n") / block), F.lit(1))
    dealt = counted.withColumn("__b", blocks).withColumn("__own", F.when(F.col("__b") > 1, F.pmod(F.xxhash64(*rows.columns), F.col("__b"))).otherwise(0).cast("long"))
    spread = dealt.withColumn("__other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__b") - 1)))
    cell = F.struct(F.least("__own", "__other").alias("low"), F.greatest("__own", "__other").alias("high"), F.col("__own").alias("own"))
    return spread.select(*rows.columns, cell.alias("cell"))


def meet(by: Sequence[str], a: str = "a", b: str = "b") -> Column:
    """The join condition of two aliases of ``pair_cells``: one key, one cell, and of different blocks unless the cell is one block's own."""
    same = (F.col(f"{a}.cell.low") == F.col(f"{b}.cell.low")) & (F.col(f"{a}.cell.high") == F.col(f"{b}.cell.high"))
    for c in by:
        same = same & (F.col(f"{a}.{c}") == F.col(f"{b}.{c}"))
    return same & ((F.col(f"{a}.cell.low") == F.col(f"{a}.cell.high")) | (F.col(f"{a}.cell.own") != F.col(f"{b}.cell.own")))

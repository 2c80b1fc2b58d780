"""Row numbers, even samples and chunks over any number of rows.

A global row number in one window would pass every row through one task.  Here
rows are dealt into ranges of the order, sorted and numbered within their range
and written so; the numbers then move up by the counts of the ranges before.
Only those counts, one a range, meet in one place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import written

#: Bits of a row's number within its partition in monotonically_increasing_id.
PLACE_BITS = 33


def with_ordinal(rows: DataFrame, order: Sequence[str], by: Sequence[str] = (), name: str = "ordinal", total: str | None = None) -> DataFrame:
    """``rows`` with a 0-based position in ascending ``order`` within each group of ``by``; ``total`` names the group's size.

    ``order`` should tell rows of a group apart; rows that tie keep any order.
    The ranges are dealt once and written, so all that is counted and joined
    afterwards is one layout.
    """
    dealt = rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    laid = written(dealt.withColumn("__at", F.monotonically_increasing_id()), "ordinals")
    part, place = F.shiftright("__at", PLACE_BITS), F.col("__at").bitwiseAND((1 << PLACE_BITS) - 1)
    sizes = laid.groupBy(part.alias("__range")).agg(F.count("*").alias("__n"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"), F.sum("__n").over(Window.partitionBy()).alias("__all"))
    # A row a range: as many as the exchange has partitions.
    placed = laid.join(F.broadcast(bases), part == F.col("__range")).withColumn("__global", F.col("__base") + place)
    if not by:
        extra = [F.col("__all").alias(total)] if total else []
        return placed.select(*rows.columns, F.col("__global").alias(name), *extra)
    firsts = placed.groupBy(*by).agg(F.min("__global").alias("__first"), F.count("*").alias("__size"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    joined = placed.alias("a").join(firsts.alias("b"), same)
    extra = [F.col("b.__size").alias(total)] if total else []
    return joined.select(*[f"a.{c}" for c in rows.columns], (F.col("a.__global") - F.col("b.__first")).alias(name), *extra)


def evenly(ordinal: Column, total: Column, k: int, rule: str) -> Column:
    """Whether an ordinal is one of ``k`` even picks of ``total`` rows.

    Rules: ``truncate`` and ``nearest`` take i * step with a double step of
    (total - 1) / (k - 1), cut off or rounded half to even, the last pick forced
    to the end; ``floor`` takes floor(i * (total - 1) / (k - 1)), multiplied
    first; ``stride`` takes floor(i * total / k).  Of a group of k rows or fewer
    all are picked.  The picks around an ordinal are tested, not generated.
    """
    if k < 1:
        raise ValueError("k must be positive")
    last, n = (total - 1).cast("double"), total.cast("double")
    if rule == "stride":
        guess, pick = F.floor(ordinal * k / n), lambda i: F.floor(i * total / F.lit(float(k)))
    elif k == 1:
        return ordinal == 0
    else:
        step = last / (k - 1)
        guess = F.floor(ordinal / step)
        if rule == "floor":
            pick = lambda i: F.floor((i * (total - 1)).cast("double") / (k - 1))
        else:
            cut = F.rint if rule == "nearest" else F.floor
            pick = lambda i: F.when(i == k - 1, total - 1).otherwise(cut(i * step).cast("long"))
    tested = [(guess + d >= 0) & (guess + d < k) & (pick((guess + d).cast("long")) == ordinal) for d in (-1, 0, 1, 2)]
    hit = tested[0]
    for t in tested[1:]:
        hit = hit | t
    return (total <= k) | hit


def even_sample(rows: DataFrame, order: Sequence[str], k: int, rule: str = "truncate", by: Sequence[str] = ()) -> DataFrame:
    """The ``k`` evenly spaced rows of each group, with their ordinal."""
    numbered = with_ordinal(rows, order, by, total="__size")
    return numbered.where(evenly(F.col("ordinal"), F.col("__size"), k, rule)).drop("__size")


def exact_quantiles(rows: DataFrame, by: Sequence[str], value: str, shares: Sequence[float]) -> DataFrame:
    """(by, share, value): exact quantiles of each group, between two rows by linear interpolation; null values are left out.

    Values take their places in one sorted layout over all groups, and only the
    two rows beside each place are kept, so a group of any size costs no task its
    values.
    """
    placed = with_ordinal(rows.where(F.col(value).isNotNull()).select(*by, value), [value], by, total="__size")
    place = F.explode(F.array(*[F.struct(F.lit(float(s)).alias("share"), (F.lit(float(s)) * (F.col("__size") - 1)).alias("at")) for s in shares]))
    near = placed.withColumn("__p", place).where(F.abs(F.col("ordinal") - F.col("__p.at")) < 1)
    weight = 1 - F.abs(F.col("ordinal") - F.col("__p.at"))
    return near.groupBy(*by, F.col("__p.share").alias("share")).agg(F.sum(weight * F.col(value)).alias("value"))


def every_nth(rows: DataFrame, order: Sequence[str], n: int = 8, also: Column | None = None) -> DataFrame:
    """Rows 0, n, 2n, ... of the order, the held-out part of a split, and all rows that ``also`` names."""
    picked = F.col("ordinal") % n == 0
    return with_ordinal(rows, order).where(picked if also is None else picked | F.coalesce(also, F.lit(False))).drop("ordinal")


def chunk_manifest(rows: DataFrame, order: Sequence[str], size: int = 25_000) -> DataFrame:
    """(chunk, offset, count, first, last) of consecutive chunks; ``first`` and ``last`` are the order column's ends."""
    key = order[0]
    chunks = with_ordinal(rows, order).withColumn("chunk", F.floor(F.col("ordinal") / size))
    return chunks.groupBy("chunk").agg(F.min("ordinal").alias("offset"), F.count("*").alias("count"), F.min(key).alias("first"), F.max(key).alias("last"))


def contiguity_errors(chunks: DataFrame) -> DataFrame:
    """Chunks that do not begin where the one before ended; one row a chunk passes through the window."""
    before = F.lag(F.col("offset") + F.col("count"), 1, 0).over(Window.orderBy("chunk"))
    return chunks.withColumn("expected", before).where(F.col("offset") != F.col("expected"))


def front_to_back(rows: DataFrame, depth: str, index: str) -> DataFrame:
    """A total order by depth, then index; -0 and 0 tie, NaN and infinite depths are refused."""
    finite = F.col(depth).isNotNull() & ~F.isnan(depth) & (F.abs(depth) != float("inf"))
    checked = F.when(finite, F.col(depth) + F.lit(0.0)).otherwise(F.raise_error(F.lit("depths must be finite")))
    return rows.withColumn(depth, checked).orderBy(depth, index)


def top_per_group(rows: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group, with ``rank`` from 1; ranks beyond k are cut before the shuffle."""
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.where(F.col("rank") <= k)


def weighted_sample(rows: DataFrame, k: int, weight: Column, *keys: str, reserved: Column | None = None) -> DataFrame:
    """``k`` rows without replacement in proportion to weight: the least of -ln(u) / weight, u from a hash of ``keys``.

    Of rows that are ``reserved``, the first k // 2 of that order come before all
    others, so half the sample is theirs if there are as many.
    """
    u = (F.shiftrightunsigned(F.xxhash64(*keys), 12).cast("double") + 0.5) / float(1 << 52)
    drawn = rows.where(weight > 0).withColumn("__key", -F.log(u) / weight)
    if reserved is None:
        return drawn.orderBy("__key", *keys).limit(k).drop("__key")
    first = drawn.where(reserved).orderBy("__key", *keys).limit(k // 2).select(*keys, F.lit(True).alias("__first"))
    marked = drawn.join(F.broadcast(first), list(keys), "left")  # k // 2 rows at most
    return marked.orderBy(F.col("__first").asc_nulls_last(), "__key", *keys).limit(k).select(*rows.columns)

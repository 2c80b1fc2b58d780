"""Mixing sources to target weights by entropy balancing.

Rates r(d) >= 0 of documents minimise the sum of r log r - r + 1 under one token
constraint a source (the rates times the sizes sum to the source's target) and
0 <= r <= most.  The convex dual has one variable a source, and its solution is
an exponential tilt: r = min(most, exp(tilt * size / mean size)).  Safeguarded
Newton steps find the tilts of all sources at once; a step is one grouped sum
over the table of (source, size, documents), which holds all that the dual
depends on.

Rates become copies by rounding running sums of rates in descending order of
size, so a source's words miss its target by half its largest document at most;
correction rounds then move copies of the one size that lessens the miss most.

Sums of rates are exact decimals, so neither the tilts nor the copies depend on
the order of partial sums.

Skew: texts are read twice, first for their sizes and last to be placed; all
between works on sizes and counts, and no text is written.  A cell (source, size) of more than ROWS_A_SALT documents is dealt by salts of a
hash, as many as it needs; the few such cells alone have a table of salts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import storage

MOST = 3
WEIGHTS = (1, 2, 3)
NEWTON_ROUNDS = 60
CLOSE = 1e-10
CORRECTIONS = 6
ROWS_A_SALT = 1024
#: Sizes are ranked in blocks for running sums, so that no task orders a whole source.
BLOCK = 256
STEEPEST = 700.0

#: A word is a run of characters other than these.
SPACES = " \t\n\x0b\f\r"


def word_count(text: Column) -> Column:
    """Runs of characters other than blank and U+0009 to U+000D; null has none."""
    marks = F.regexp_replace(text, "[^\\x20\\x09-\\x0D]+", "w")
    return F.coalesce(F.length(F.translate(marks, SPACES, "")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``sources`` (source, source_size) with weight and target.

    Sources in code-point order, null last, take ``weights`` in turn.  The sizes'
    sum is shared by weight; a share stops at ``most`` times its source's size
    and the excess goes to the others by weight.  Ranked by size over weight, the
    first sources stop, and the first whose share of the rest fits ends it.
    One row a source in one task.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_room = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    upto, below = by_room.rowsBetween(Window.unboundedPreceding, -1), by_room.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    table = F.array(*[F.lit(w).cast("double") for w in weights])
    ranked = sources.withColumn("weight", F.get(table, (F.row_number().over(by_name) - 1) % len(weights)))
    ranked = ranked.withColumn("cap", most * F.col("source_size").cast("double")).withColumn("ratio", F.col("cap") / F.col("weight"))
    ranked = ranked.withColumn("rest", F.sum("source_size").over(every).cast("double") - F.coalesce(F.sum("cap").over(upto), F.lit(0.0)))
    ranked = ranked.withColumn("level", F.col("rest") / F.sum("weight").over(below))
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(every)["level"]
    return ranked.withColumn("share", level).select("source", "source_size", "weight", F.least("cap", F.col("weight") * F.col("share")).alias("target"))


def _exact(c: Column) -> Column:
    """A double as a decimal, for sums in any order."""
    return c.cast("decimal(38,9)")


def _rate(tilt: Column, x: Column, most: int) -> Column:
    return F.least(F.lit(float(most)), F.exp(F.least(F.lit(STEEPEST), F.greatest(F.lit(-STEEPEST), tilt * x))))


def tilts(counts: DataFrame, wanted: DataFrame, most: int = MOST) -> DataFrame:
    """(source, target, source_size, mean, tilt): Newton on the dual of every source, kept inside a shrinking bracket."""
    means = counts.where("size > 0").groupBy("source").agg((F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("mean"))
    state = wanted.join(means, wanted["source"].eqNullSafe(means["source"])).select(wanted["source"], "source_size", "target", "mean")
    # A target of ``most`` times the size needs the cap on all documents, whatever the tilt.
    full = F.col("target") >= most * F.col("source_size") * (1 - CLOSE)
    start = F.when(full, F.lit(float("inf"))).otherwise(F.log(F.col("target") / F.col("source_size")))
    state = state.withColumn("tilt", start).withColumn("low", F.lit(float("-inf"))).withColumn("high", F.lit(float("inf")))
    state = storage.materialise(state.withColumn("miss", F.when(full, 0.0).otherwise(1.0)), "tilts")
    sized = counts.where("size > 0").select(F.col("source").alias("s"), F.col("size").cast("double").alias("size"), "n")
    for _ in range(NEWTON_ROUNDS):
        x = F.col("size") / F.col("mean")
        open_ = state.where(F.col("miss") > CLOSE)
        joined = sized.join(open_, F.col("s").eqNullSafe(F.col("source")))
        rate = _rate(F.col("tilt"), x, most)
        slope = F.when(rate < most, F.col("n") * F.col("size") * x * rate).otherwise(0.0)
        sums = joined.groupBy("s").agg(F.sum(_exact(F.col("n") * F.col("size") * rate)).cast("double").alias("taken"), F.sum(_exact(slope)).cast("double").alias("slope"))
        moved = open_.join(sums, F.col("source").eqNullSafe(F.col("s")))
        over = F.col("taken") > F.col("target")
        moved = moved.withColumn("high", F.when(over, F.col("tilt")).otherwise(F.col("high"))).withColumn("low", F.when(over, F.col("low")).otherwise(F.col("tilt")))
        step = F.col("tilt") - (F.col("taken") - F.col("target")) / F.when(F.col("slope") > 0, F.col("slope"))
        middle = (
            F.when(F.col("low") == float("-inf"), F.col("high") - 1 - F.abs("high"))
            .when(F.col("high") == float("inf"), F.col("low") + 1 + F.abs("low"))
            .otherwise((F.col("low") + F.col("high")) / 2)
        )
        inside = (step > F.col("low")) & (step < F.col("high"))
        moved = moved.withColumn("miss", F.abs(F.col("taken") - F.col("target")) / F.col("target"))
        closed = (F.col("low") > float("-inf")) & (F.col("high") < float("inf")) & (F.col("high") - F.col("low") <= 1e-14 * F.abs("high"))
        done = (F.col("miss") <= CLOSE) | closed
        moved = moved.withColumn("next", F.when(done, F.col("tilt")).when(inside, step).otherwise(middle)).withColumn("miss", F.when(done, 0.0).otherwise(F.col("miss")))
        moved = moved.select("source", "source_size", "target", "mean", F.col("next").alias("tilt"), "low", "high", "miss")
        state = storage.materialise(moved.unionByName(state.where(F.col("miss") <= CLOSE)), "tilts")
        if state.where(F.col("miss") > CLOSE).isEmpty():
            break
    return state.select("source", "source_size", "target", "mean", "tilt")


def _rounded(rated: DataFrame, most: int) -> DataFrame:
    """``rated`` (source, size, n, rate) with ``copies``: how many the n documents get together.

    Copies are differences of rounded running sums.  A running sum over a source
    is the sum of its earlier blocks plus the running sum within the block.
    """
    blocked = rated.withColumn("block", -F.floor(F.col("size") / BLOCK)).withColumn("mass", _exact(F.col("n") * F.col("rate")))
    blocks = blocked.groupBy("source", "block").agg(F.sum("mass").alias("block_mass"))
    earlier = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = blocks.select(F.col("source").alias("s"), F.col("block").alias("b"), F.coalesce(F.sum("block_mass").over(earlier), F.lit(0).cast("decimal(38,9)")).alias("base"))
    inner = Window.partitionBy("source", "block").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, 0)
    summed = blocked.join(bases, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b"))).withColumn("upto", F.col("base") + F.sum("mass").over(inner))
    copies = F.round("upto") - F.round(F.col("upto") - F.col("mass"))
    bounded = F.greatest(F.lit(0), F.least(most * F.col("n"), copies.cast("long")))
    return summed.select("source", "size", "n", "rate", bounded.alias("copies"))


def _moves(cells: DataFrame, wanted: DataFrame, most: int) -> DataFrame:
    """(s, z, move): of each source the size whose copies, moved, leave the least of the difference between taken and target.

    Only a size below twice the difference lessens it; the move may go past the target.
    """
    taken = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"))
    gap = taken.join(wanted, taken["source"].eqNullSafe(wanted["source"])).select(taken["source"].alias("s"), F.round(F.col("target") - F.col("taken")).cast("long").alias("gap"))
    room = F.when(F.col("gap") > 0, most * F.col("n") - F.col("copies")).otherwise(F.col("copies"))
    near = cells.join(gap, F.col("source").eqNullSafe(F.col("s"))).where((F.col("size") > 0) & (F.col("size") < 2 * F.abs("gap")) & (room > 0))
    near = near.withColumn("move", F.least(room, F.greatest(F.lit(1), F.round(F.abs("gap") / F.col("size")).cast("long"))))
    left = F.abs(F.abs("gap") - F.col("move") * F.col("size"))
    best = near.groupBy("source").agg(F.min(F.struct(left.alias("left"), "size", "move", "gap")).alias("m"))
    better = best.where(F.col("m.left") < F.abs("m.gap"))
    return better.select(F.col("source").alias("s"), F.col("m.size").alias("z"), (F.signum("m.gap") * F.col("m.move")).cast("long").alias("move"))


def _corrected(cells: DataFrame, moves: DataFrame) -> DataFrame:
    moved = cells.join(moves, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")), "left")
    return moved.select("source", "size", "n", "rate", (F.col("copies") + F.coalesce("move", F.lit(0))).alias("copies"))


def _salt_quotas(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """(s, z, salt, more): how many documents of each salt of a large cell take one more copy.

    A cell's extra copies fall to its salts in proportion, by differences of floored running sums.
    """
    large = cells.where(F.col("n") > ROWS_A_SALT).select(F.col("source").alias("s"), F.col("size").alias("z"), "n", "copies")
    dealt = rows.select("source", "size", "h").join(large, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")))
    parts = dealt.groupBy("s", "z", "n", "copies", _salt(F.col("n")).alias("salt")).agg(F.count("*").alias("here"))
    upto = F.sum("here").over(Window.partitionBy("s", "z").orderBy("salt").rowsBetween(Window.unboundedPreceding, 0))
    extra = F.col("copies") % F.col("n")
    share = F.floor(upto * extra / F.col("n")) - F.floor((upto - F.col("here")) * extra / F.col("n"))
    return parts.select("s", "z", F.col("salt").alias("k"), share.alias("more"))


def _salt(n: Column) -> Column:
    return F.pmod("h", F.ceil(n / ROWS_A_SALT))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: Sequence[str] | None = None) -> DataFrame:
    """Every row of ``docs`` as struct ``row`` with source, size, source_size, target, rate, copies and taken.

    copies is how often the mix takes the row, ``most`` times at most.  Rows
    without words, null texts among them, have rate one and copy one; a null
    source is a source of its own, the last.  Among rows of one source and size,
    the order of a hash of the id and text says which take one more; it depends
    on the rows alone, so reruns agree.  Repeated rows count each.  The columns
    ``keep`` of ``docs``, all if not given, stay inside ``row``, so no name
    clashes; an empty table stays empty.
    """
    kept = docs.columns if keep is None else keep
    hashed = F.xxhash64(F.lit(id_col), F.col(id_col), F.col(text_col))
    rows = docs.select(F.struct(*kept).alias("row"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), hashed.alias("h"), F.col(id_col).alias("key"))
    sized = storage.materialise(rows.select("source", "size", "h"), "sizes-of-rows", compression="zstd")
    counts = storage.materialise(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "sizes")
    wanted = storage.materialise(targets(counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, most), "targets")
    solved = tilts(counts, wanted, most)

    known = solved.select(F.col("source").alias("s"), "mean", "tilt")
    rated = counts.join(known, F.col("source").eqNullSafe(F.col("s")), "left")
    rate = F.when(F.col("size") > 0, _rate(F.col("tilt"), F.col("size") / F.col("mean"), most)).otherwise(1.0)
    cells = storage.materialise(_rounded(rated.select("source", "size", "n", rate.alias("rate")), most), "copies")
    for _ in range(CORRECTIONS):
        moves = storage.materialise(_moves(cells, wanted, most), "moves")
        if moves.isEmpty():
            break
        cells = storage.materialise(_corrected(cells, moves), "copies")

    quotas = storage.materialise(_salt_quotas(sized, cells), "quotas")
    of_source = wanted.select(F.col("source").alias("s"), "source_size", "target")
    named = cells.join(of_source, F.col("source").eqNullSafe(F.col("s"))).select(F.col("source").alias("cell_source"), F.col("size").alias("cell_size"), "n", "rate", "copies", "source_size", "target")
    full = rows.join(named, F.col("source").eqNullSafe(F.col("cell_source")) & (F.col("size") == F.col("cell_size"))).withColumn("salt", _salt(F.col("n")))
    full = full.join(quotas, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & (F.col("salt") == F.col("k")), "left")
    place = F.row_number().over(Window.partitionBy("source", "size", "salt").orderBy("h", "key"))
    more = F.when(F.col("n") > ROWS_A_SALT, F.col("more")).otherwise(F.col("copies") % F.col("n"))
    copies = (F.floor(F.col("copies") / F.col("n")) + (place <= more).cast("int")).cast("long")
    placed = full.select("row", "source", "size", "source_size", "target", "rate", copies.alias("copies"))
    return placed.withColumn("taken", F.col("copies") * F.col("size"))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken."""
    return mix(docs, **options).where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")

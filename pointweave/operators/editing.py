"""Text commands as selections and reversible states of objects and points."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as words
from .graph import closure, descendants

ACTIONS = frozenset({"search", "focus", "hide", "show", "isolate", "delete", "undo", "priority"})
EVERYTHING = ("all", "全部", "所有", "场景", "scene")
UNDO_STEPS = 20
#: Actions that change nothing and so leave no history.
READING = frozenset({"search", "focus"})


@dataclass(frozen=True)
class Command:
    action: str
    query: str = ""
    object_ids: tuple[str, ...] = field(default=())
    priority: bool = True
    source: str = "rules"

    def __post_init__(self):
        if self.action not in ACTIONS:
            raise ValueError(f"unknown action {self.action!r}")
        if len(self.query) > 300 or len(self.object_ids) > 200 or not isinstance(self.priority, bool):
            raise ValueError("query, object_ids or priority out of bounds")
        if self.action != "undo" and not self.query.strip() and not self.object_ids:
            raise ValueError("a command needs a query or object ids")

    @classmethod
    def parse(cls, text: str) -> Command:
        """One request, read by the same columns as a table of them."""
        found = SparkSession.active().range(1).select(words.command(F.lit(str(text))).alias("c")).first()["c"]
        if found is None:
            raise ValueError("a request has 1 to 1000 characters")
        return cls(**found.asDict())


def terms(query: Column) -> Column:
    """The query's terms, split at commas and at 'and' or its Chinese form."""
    parts = F.split(F.lower(query), r"[,，、]|\band\b|\s+和\s+")
    return F.filter(F.transform(parts, lambda t: F.trim(t)), lambda t: F.length(t) > 0)


def matching(objects: DataFrame, command: Command) -> DataFrame:
    """(node): objects named by id, all, or those whose label, id or alias contains a term."""
    if command.object_ids:
        return objects.where(F.col("id").isin(list(command.object_ids))).select(F.col("id").alias("node"))
    if command.query.strip().lower() in EVERYTHING:
        return objects.select(F.col("id").alias("node"))
    names = F.concat(F.array(F.coalesce("label", F.lit("")), "id"), F.coalesce("aliases", F.array().cast("array<string>")))
    hit = F.exists(terms(F.lit(command.query)), lambda t: F.exists(names, lambda n: F.contains(F.lower(n), t)))
    return objects.where(hit).select(F.col("id").alias("node"))


def resolve(objects: DataFrame, command: Command) -> DataFrame:
    """(node): the matching objects and all their parts."""
    return descendants(matching(objects, command), tree(objects))


def search_with_ancestors(objects: DataFrame, query: str) -> DataFrame:
    """(node): objects whose label or alias contains the query, and what they are part of."""
    names = F.concat(F.array(F.coalesce("label", F.lit(""))), F.coalesce("aliases", F.array().cast("array<string>")))
    hits = objects.where(F.exists(names, lambda n: F.contains(F.lower(n), F.lit(query.strip().lower())))).select(F.col("id").alias("node"))
    above = closure(tree(objects)).join(hits, "node").select(F.col("ancestor").alias("node"))
    return hits.union(above).distinct()


def tree(objects: DataFrame) -> DataFrame:
    return objects.select(F.col("id").alias("child"), F.col("parent_id").alias("parent")).where("parent IS NOT NULL")


def apply_to_objects(objects: DataFrame, selected: DataFrame, command: Command) -> DataFrame:
    """Objects after a command; rows are never removed, deletion is a flag."""
    chosen = F.col("__sel").isNotNull()
    joined = objects.join(selected.select(F.col("node").alias("id"), F.lit(True).alias("__sel")), "id", "left")
    if command.action == "isolate":
        joined = joined.withColumn("visible", chosen | (F.col("level") == "scene"))
    elif command.action in ("hide", "delete"):
        joined = joined.withColumn("visible", F.when(chosen, False).otherwise(F.col("visible")))
        if command.action == "delete":
            joined = joined.withColumn("deleted", F.when(chosen, True).otherwise(F.col("deleted")))
    elif command.action == "show":
        joined = joined.withColumn("visible", F.when(chosen, True).otherwise(F.col("visible"))).withColumn("deleted", F.when(chosen, False).otherwise(F.col("deleted")))
    elif command.action == "priority":
        joined = joined.withColumn("priority", F.when(chosen, F.lit(command.priority)).otherwise(F.col("priority")))
    return joined.select(*objects.columns)


def apply_to_points(points: DataFrame, members: DataFrame, selected: DataFrame, command: Command) -> DataFrame:
    """Points (item, hidden, weight) after a command, by committed membership (item, node) alone."""
    hit = members.join(selected, "node", "left_semi").select("item").distinct().withColumn("__sel", F.lit(True))
    joined = points.join(hit, "item", "left")
    chosen = F.col("__sel").isNotNull()
    if command.action == "isolate":
        joined = joined.withColumn("hidden", ~chosen)
    elif command.action in ("hide", "delete", "show"):
        joined = joined.withColumn("hidden", F.when(chosen, F.lit(command.action != "show")).otherwise(F.col("hidden")))
    elif command.action == "priority":
        joined = joined.withColumn("weight", F.when(chosen, F.lit(2.0 if command.priority else 1.0)).otherwise(F.col("weight")))
    return joined.drop("__sel")


def visible_items(points: DataFrame, members: DataFrame, hidden: DataFrame, isolated: DataFrame | None = None, source: str = "all") -> DataFrame:
    """(item, visible): hidden if its own flag, its source, or any node it belongs to says so; isolation needs any member.

    ``members`` is closed over ancestors.  An item without members follows the
    node ``__unlabeled__``.
    """
    flags = members.join(hidden.select("node", F.lit(True).alias("__h")), "node", "left")
    if isolated is not None:
        flags = flags.join(isolated.select("node", F.lit(True).alias("__i")), "node", "left")
    else:
        flags = flags.withColumn("__i", F.lit(True))
    state = flags.groupBy("item").agg(F.count("__h").alias("__h"), F.count("__i").alias("__i"))
    loose = hidden.where("node = '__unlabeled__'").limit(1).count() > 0
    joined = points.join(state, "item", "left")
    unlabeled = F.col("__h").isNull()
    shown = ~F.col("hidden") & F.when(unlabeled, F.lit(not loose and isolated is None)).otherwise((F.col("__h") == 0) & (F.col("__i") > 0))
    if source != "all":
        shown = shown & (F.coalesce("source", F.lit("unknown")) == source)
    return joined.select("item", shown.alias("visible"))


def fold_log(log: DataFrame, steps: int = UNDO_STEPS) -> DataFrame:
    """Commands of a log (scene, seq, action, ...) that still hold: an undo takes back the latest not yet taken back.

    A scene's history keeps ``steps`` commands; what leaves it holds for good, and
    an undo of an empty history does nothing.  A scene's rows pass a task in
    order, which holds no more of them than its history, however long the log.
    """
    schema = log.schema

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scene, history = None, deque()
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                if row["scene"] != scene:
                    done += history
                    scene, history = row["scene"], deque()
                if row["action"] == "undo":
                    if history:
                        history.pop()
                elif row["action"] not in READING:
                    if len(history) == steps:
                        done.append(history.popleft())
                    history.append(row)
            yield pa.RecordBatch.from_pylist(done, batch.schema)
        if history:
            yield pa.RecordBatch.from_pylist(list(history), batch.schema)

    return log.repartition("scene").sortWithinPartitions("scene", "seq").mapInArrow(fold, schema)


def undo_stack(log: DataFrame, steps: int = UNDO_STEPS) -> DataFrame:
    """The latest ``steps`` entries of each scene's history."""
    w = Window.partitionBy("scene").orderBy(F.col("seq").desc())
    return log.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= steps).drop("__r")

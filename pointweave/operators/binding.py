"""Joins that only bind what is certain: unique keys, verified identities, audited differences."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sources of a point by lineage code.
SOURCE_CODES = {0: "unknown", 1: "observed", 2: "inferred"}


def unique_keys(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows whose key occurs once."""
    return rows.withColumn("__n", F.count("*").over(Window.partitionBy(*keys))).where("__n = 1").drop("__n")


def first_by(rows: DataFrame, by: Sequence[str], position: str) -> DataFrame:
    """The first row of each key, as an order-preserving distinct."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(position))).where("__r = 1").drop("__r")


def prefer(rows: DataFrame, by: Sequence[str], provenance: str, ranking: Sequence[str], position: str) -> DataFrame:
    """One row a key: of the provenance ranked first, then the first."""
    order = F.array_position(F.array(*[F.lit(x) for x in ranking]), F.col(provenance))
    best = F.row_number().over(Window.partitionBy(*by).orderBy(F.when(order == 0, len(ranking) + 1).otherwise(order), position))
    return rows.withColumn("__r", best).where("__r = 1").drop("__r")


def basename(path: Column) -> Column:
    """The part after the last slash or backslash, trailing ones aside."""
    return F.element_at(F.split(F.regexp_replace(path, r"[\\/]+$", ""), r"[\\/]"), -1)


def by_path_or_name(masks: DataFrame, cameras: DataFrame, ref: str = "ref", path: str = "path") -> DataFrame:
    """Masks with ``camera``: the one whose path equals the reference, else the only one of its base name; else null."""
    exact = unique_keys(cameras.select(F.col(path).alias("__path"), F.col("camera").alias("__exact")), "__path")
    named = unique_keys(cameras.select(basename(F.col(path)).alias("__name"), F.col("camera").alias("__named")), "__name")
    keyed = masks.withColumn("__base", basename(F.col(ref)))
    joined = keyed.join(exact, F.col(ref) == F.col("__path"), "left").join(named, F.col("__base") == F.col("__name"), "left")
    return joined.select(*masks.columns, F.coalesce("__exact", "__named").alias("camera"))


def to_one_image(references: DataFrame, images: DataFrame, ref: str = "ref", path: str = "path") -> DataFrame:
    """References with ``image``, null unless exactly one image answers; a reference with a folder must match in full."""
    plain = ~F.col(ref).rlike(r"[\\/]")
    named = unique_keys(images.select(basename(F.col(path)).alias("__name"), F.col(path).alias("__by_name")), "__name")
    exact = unique_keys(images.select(F.col(path).alias("__by_path")), "__by_path")
    joined = references.join(exact, F.col(ref) == F.col("__by_path"), "left").join(named, plain & (F.col(ref) == F.col("__name")), "left")
    return joined.select(*references.columns, F.coalesce("__by_path", "__by_name").alias("image"))


def bind_sidecar(preview: DataFrame, sidecar: DataFrame, identity: Mapping[str, object], expected: Mapping[str, object], key: str = "source_index") -> DataFrame:
    """Preview rows with the sidecar's columns and ``known``; rows that the sidecar lacks stay, as unknown.

    The identities (hash, count, class order) must agree before anything joins.
    """
    unlike = sorted(k for k in expected if identity.get(k) != expected[k])
    if unlike:
        raise ValueError(f"the sidecar belongs to another scene: {', '.join(unlike)} differ")
    return preview.join(sidecar.withColumn("known", F.lit(True)), key, "left").withColumn("known", F.coalesce("known", F.lit(False)))


def bind_total(preview: DataFrame, lineage: DataFrame, key: str = "source_index") -> tuple[DataFrame, DataFrame]:
    """(joined, missing): an inner join, and the preview rows that broke it; a caller accepts the first only if the second is empty."""
    return preview.join(lineage, key), preview.join(lineage, key, "left_anti")


def migrate_state(old: DataFrame, new: DataFrame, key: str = "source_index") -> DataFrame:
    """(key, outcome): carried, dropped (only old) or fresh (only new), over a full outer join on the verified key."""
    a, b = old.select(F.col(key).alias("o")), new.select(F.col(key).alias("n"))
    both = a.join(b, F.col("o") == F.col("n"), "full_outer")
    outcome = F.when(F.col("n").isNull(), "dropped").when(F.col("o").isNull(), "fresh").otherwise("carried")
    return both.select(F.coalesce("o", "n").alias(key), outcome.alias("outcome"))


def migrate_by_label(old: DataFrame, new: DataFrame, label: str = "label") -> DataFrame:
    """Old state for new categories whose label is unique on both sides."""
    return unique_keys(new, label).join(unique_keys(old, label), label)


def manifest_diff(declared: DataFrame, actual: DataFrame, key: str = "path", *values: str) -> DataFrame:
    """(key, problem) of every difference between two manifests: missing, undeclared or changed."""
    a = declared.select(F.col(key).alias("d"), *[F.col(v).alias(f"d_{v}") for v in values])
    b = actual.select(F.col(key).alias("a"), *[F.col(v).alias(f"a_{v}") for v in values])
    both = a.join(b, F.col("d") == F.col("a"), "full_outer")
    same = F.lit(True)
    for v in values:
        same = same & F.col(f"d_{v}").eqNullSafe(F.col(f"a_{v}"))
    problem = F.when(F.col("a").isNull(), "missing").when(F.col("d").isNull(), "undeclared").when(~same, "changed")
    return both.withColumn("problem", problem).where("problem IS NOT NULL").select(F.coalesce("d", "a").alias(key), "problem")


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one bag beyond those of the other, with the side they are on; empty if the bags are equal."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def split_overlap(split: DataFrame, *keys: str, part: str = "part") -> DataFrame:
    """(key, value, parts) of values that occur in more than one part of a split, for each key."""
    out = None
    for k in keys:
        shared = split.where(F.col(k).isNotNull()).groupBy(F.col(k).cast("string").alias("value")).agg(F.array_sort(F.collect_set(part)).alias("parts"))
        shared = shared.where(F.size("parts") > 1).select(F.lit(k).alias("key"), "value", F.array_join("parts", ",").alias("parts"))
        out = shared if out is None else out.unionByName(shared)
    return out


def select_views(images: DataFrame, allowed: DataFrame, held_out: DataFrame, key: str = "name") -> DataFrame:
    """(key, selected, reason) of every image: held out, not in the allow-list, or selected."""
    a, h = allowed.select(F.col(key), F.lit(True).alias("__a")).distinct(), held_out.select(F.col(key), F.lit(True).alias("__h")).distinct()
    joined = images.select(key).join(a, key, "left").join(h, key, "left")
    reason = F.when(F.col("__h"), "held_out").when(F.col("__a").isNull(), "not_allowed")
    return joined.select(key, reason.isNull().alias("selected"), F.coalesce(reason, F.lit("selected")).alias("reason"))


def approved_edges(approved: DataFrame, observed: DataFrame, *keys: str) -> DataFrame:
    """Approved edges with whether an observation backs them, and why not: unobserved, or observed under another relation."""
    full = observed.select(*keys, "relation", F.lit(True).alias("__full")).distinct()
    loose = observed.select(*keys, F.lit(True).alias("__loose")).distinct()
    joined = approved.join(full, [*keys, "relation"], "left").join(loose, list(keys), "left")
    reason = F.when(F.col("__full"), None).when(F.col("__loose"), "relation_differs").otherwise("unobserved")
    return joined.withColumn("accepted", F.coalesce("__full", F.lit(False))).withColumn("reason", reason).drop("__full", "__loose")


def replace_by_key(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Old rows whose key the new ones lack, and the new rows."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def any_key(records: DataFrame, wanted: DataFrame, *columns: str, value: str = "value") -> DataFrame:
    """Records of which any of the (array or plain) columns holds a wanted value, case aside."""
    keys = F.array(*[F.lit(None).cast("string")])
    for c in columns:
        array = records.schema[c].dataType.typeName() == "array"
        keys = F.concat(keys, F.coalesce(F.col(c).cast("array<string>"), F.array().cast("array<string>")) if array else F.array(F.col(c).cast("string")))
    exploded = records.withColumn("__key", F.explode(F.array_distinct(F.transform(F.filter(keys, lambda k: k.isNotNull()), F.lower))))
    hit = exploded.join(wanted.select(F.lower(value).alias("__key")).distinct(), "__key", "left_semi")
    return hit.drop("__key").distinct()


def uncovered(requested: DataFrame, matches: DataFrame, key: str = "label") -> DataFrame:
    """Requested keys that no match covers; a request is met when there are none."""
    return requested.select(key).distinct().join(matches.select(key), key, "left_anti")


def one_to_one(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Pairs whose two ends each occur in one distinct pair only."""
    return unique_keys(unique_keys(pairs.select(a, b).distinct(), a), b) if a == b else _both_unique(pairs.select(a, b).distinct(), a, b)


def _both_unique(pairs: DataFrame, a: str, b: str) -> DataFrame:
    counted = pairs.withColumns({"__a": F.count("*").over(Window.partitionBy(a)), "__b": F.count("*").over(Window.partitionBy(b))})
    return counted.where("__a = 1 AND __b = 1").drop("__a", "__b")


def paired_delta(before: DataFrame, after: DataFrame, keys: Sequence[str], *metrics: str) -> DataFrame:
    """(keys, metric deltas, matched): after minus before; keys of one side only stay with null deltas."""
    a = before.select(*keys, *[F.col(m).alias(f"__b_{m}") for m in metrics], F.lit(True).alias("__b"))
    b = after.select(*keys, *[F.col(m).alias(f"__a_{m}") for m in metrics], F.lit(True).alias("__a"))
    both = a.join(b, list(keys), "full_outer")
    deltas = [(F.col(f"__a_{m}") - F.col(f"__b_{m}")).alias(f"{m}_delta") for m in metrics]
    return both.select(*keys, *deltas, (F.col("__a").isNotNull() & F.col("__b").isNotNull()).alias("matched"))


def with_prior(current: DataFrame, prior: DataFrame, keys: Sequence[str], p: str = "p", missing: float = 0.05) -> DataFrame:
    """Current rows with the prior probability of their key, ``missing`` where there is none."""
    return current.join(prior.select(*keys, p), list(keys), "left").withColumn(p, F.coalesce(F.col(p), F.lit(missing)))


def backfill(rows: DataFrame, stored: DataFrame, key: str, *columns: str) -> DataFrame:
    """Rows with nulls of ``columns`` filled from the stored ones; ``changed`` says whether anything was."""
    held = stored.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    joined = rows.join(held, key, "left")
    changed = F.lit(False)
    for c in columns:
        changed = changed | (F.col(c).isNull() & F.col(f"__{c}").isNotNull())
    return joined.select(key, *[F.coalesce(c, f"__{c}").alias(c) for c in columns], changed.alias("changed"))


def registry(results: DataFrame, most: int = 100) -> DataFrame:
    """Valid results, the first of each id, at most ``most`` in their order (id, title, position, ...)."""
    valid = results.where("id IS NOT NULL AND length(trim(id)) > 0 AND title IS NOT NULL AND length(trim(title)) > 0")
    return first_by(valid, ["id"], "position").orderBy("position").limit(most)


def lineage_counts(lineage: DataFrame, code: str = "code") -> DataFrame:
    """(source, n) for every known source, none left out."""
    spark = lineage.sparkSession
    domain = spark.range(1).select(F.explode(F.create_map(*[x for k, v in SOURCE_CODES.items() for x in (F.lit(k), F.lit(v))])).alias("k", "source"))
    counts = lineage.groupBy(F.col(code).cast("int").alias("k")).agg(F.count("*").alias("n"))
    return domain.join(counts, "k", "left").select("source", F.coalesce("n", F.lit(0)).alias("n"))

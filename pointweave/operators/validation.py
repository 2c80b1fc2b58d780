"""Rule columns: every check names itself, and a table passes if no row breaks one."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The largest scene and its files.
MOST_POINTS = 3_000_000
MOST_PLY_BYTES = 1 << 30
MOST_JSON_BYTES = 256 << 20
MOST_JSONL_BYTES = 4 << 30
MOST_LINE_BYTES = 64 << 20
PREVIEW_BUDGETS = (100_000, 250_000, 500_000)
INFERRED_CONFIDENCE = 0.49


def finite_all(array: Column) -> Column:
    return F.forall(array, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def in_range(c: Column, low: float, high: float) -> Column:
    return c.isNotNull() & ~F.isnan(c) & c.between(low, high)


def scene_rules() -> dict[str, Column]:
    """Rules of a point row: position, scale, rotation, colour, opacity and harmonics."""
    vector = lambda name, n: (F.size(name) == n) & finite_all(F.col(name))
    return {
        "position": vector("position", 3),
        "scale": vector("scale", 3) & F.forall("scale", lambda x: x > 0),
        "rotation": vector("rotation", 4) & F.exists("rotation", lambda x: x != 0),
        "color": vector("color", 3) & F.forall("color", lambda x: x.between(0, 1)),
        "opacity": in_range(F.col("opacity"), 0, 1),
        "sh": F.col("sh").isNull() | ((F.size("sh") == 3 * (F.col("sh_degree") + 1) * (F.col("sh_degree") + 1)) & F.col("sh_degree").between(0, 3) & finite_all(F.col("sh"))),
    }


def mask_rules() -> dict[str, Column]:
    return {
        "label": F.length(F.trim("label")) > 0,
        "level": F.col("level").isin("object", "part", "scene"),
        "confidence": in_range(F.col("confidence"), 0, 1),
        "hash": F.col("source_image_sha256").isNull() | F.col("source_image_sha256").rlike("^[0-9a-f]{64}$"),
    }


def camera_rules() -> dict[str, Column]:
    return {
        "size": (F.col("width") > 0) & (F.col("height") > 0),
        "focal": in_range(F.col("fx"), 1e-12, 1e12) & in_range(F.col("fy"), 1e-12, 1e12),
        "matrix": (F.size("world_to_camera") == 4) & F.forall("world_to_camera", lambda r: (F.size(r) == 4) & finite_all(r)),
    }


def broken(rows: DataFrame, rules: Mapping[str, Column], *keys: str) -> DataFrame:
    """(keys, rule) for every rule that a row breaks; a rule of null is broken."""
    names = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])
    return rows.select(*keys, F.explode(F.array_compact(names)).alias("rule"))


def check(rows: DataFrame, rules: Mapping[str, Column], *keys: str) -> DataFrame:
    """``rows``, or an error that names the first broken rule."""
    first = broken(rows, rules, *keys).orderBy(*keys, "rule").first()
    if first is not None:
        raise ValueError(f"rule {first['rule']!r} is broken at {', '.join(f'{k}={first[k]}' for k in keys)}")
    return rows


def rule_report(rows: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """(rule, broken, rows) for every rule, in one pass over the rows."""
    counts = rows.agg(F.count("*").alias("rows"), *[F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in rules.items()])
    pairs = F.array(*[F.struct(F.lit(name).alias("rule"), F.col(name).alias("broken")) for name in rules])
    return counts.select("rows", F.explode(pairs).alias("x")).select("x.rule", "x.broken", "rows")


def clamp_provenance(confidence: Column, source: Column) -> Column:
    """A confidence within its source's bound: observed up to 1, anything else up to .49."""
    return F.least(confidence, F.when(source == "observed", 1.0).otherwise(INFERRED_CONFIDENCE))


def clamp_or(value: Column, default: float, low: float, high: float) -> Column:
    """A number within bounds, or the default if the value is not a finite number."""
    number = value.try_cast("double")
    ok = number.isNotNull() & ~F.isnan(number) & (F.abs(number) != float("inf"))
    return F.when(ok, F.least(F.greatest(number, F.lit(low)), F.lit(high))).otherwise(F.lit(default))


def within_budget(rows: Column, bytes_: Column) -> Column:
    """The first limit that a scene file exceeds, null if none."""
    return F.when(rows > MOST_POINTS, "points").when(bytes_ > MOST_PLY_BYTES, "bytes")


def classify_files(files: DataFrame, path: str, allowed_suffixes: tuple[str, ...], excluded_trees: tuple[str, ...]) -> DataFrame:
    """Files with ``included`` and ``reason``: the first rule that excludes one, else its suffix."""
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))
    tree = F.exists(F.array(*[F.lit(t) for t in excluded_trees]), lambda t: F.contains(F.concat(F.lit("/"), F.col(path)), F.concat(F.lit("/"), t, F.lit("/"))))
    unsafe = F.col(path).rlike(r"(^/|^[A-Za-z]:|(^|/)\.\.(/|$)|\\)")
    reason = F.when(unsafe, "unsafe_path").when(tree, "excluded_tree").when(~suffix.isin(*allowed_suffixes), "suffix")
    return files.withColumn("included", reason.isNull()).withColumn("reason", F.coalesce(reason, F.concat(F.lit("suffix:"), suffix)))


def secret_like(text: Column) -> Column:
    """Whether a text looks like it holds a credential."""
    return text.rlike(r"(?i)(api[_-]?key|secret|token|passw(or)?d)\s*[:=]\s*['\"]?[A-Za-z0-9_\-]{16,}") | text.rlike(r"-----BEGIN [A-Z ]*PRIVATE KEY-----")

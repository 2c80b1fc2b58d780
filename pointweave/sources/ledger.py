"""Projects reloaded against their stored hashes, and a ledger that takes each photo once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .evidence import FEWEST_PHOTOS, MOST_PHOTOS

#: Rows of a batch are in a partition of their own: reading earlier ones opens no file of the batch that is being written.
LEDGER = "path string, sha256 string, bytes bigint, status string, batch bigint"


def reload_problems(images: DataFrame, stored: DataFrame, fold_case: bool = False) -> DataFrame:
    """(project, name, problem) of projects that may not be reloaded; a project without rows is as it was stored.

    ``images`` (project, name, sha256, width, height) is the manifest, ``stored`` has
    the same columns of the files found, one row a file.  Problems of an image, the
    first that holds: ``name`` (null, or no base name), ``repeated``, ``missing``,
    ``changed`` (hash, a null one too), ``size``.  A project with fewer than two or over 300
    images has the problem ``count`` under a null name.  With ``fold_case`` names
    that differ in case alone are repeated, as a remote project requires.
    """
    identity = F.lower("name") if fold_case else F.col("name")
    counted = images.select("project", "name", "sha256", "width", "height", F.count("*").over(Window.partitionBy("project", identity)).alias("times"))
    found = stored.select("project", "name", F.lit(True).alias("found"), F.col("sha256").alias("have"), F.col("width").alias("w"), F.col("height").alias("h"))
    both = counted.join(found, ["project", "name"], "left")
    proper = F.coalesce((F.col("name") != "") & ~F.col("name").isin(".", "..") & ~F.contains("name", F.lit("/")), F.lit(False))
    same = F.coalesce(F.col("have") == F.col("sha256"), F.lit(False))
    problem = (
        F.when(~proper, "name")
        .when(F.col("times") > 1, "repeated")
        .when(F.col("found").isNull(), "missing")
        .when(~same, "changed")
        .when(~(F.col("w").eqNullSafe(F.col("width")) & F.col("h").eqNullSafe(F.col("height"))), "size")
    )
    rows = both.select("project", "name", problem.alias("problem")).where("problem IS NOT NULL").distinct()
    sizes = images.groupBy("project").agg(F.count("*").alias("n")).where(~F.col("n").between(FEWEST_PHOTOS, MOST_PHOTOS))
    return rows.unionByName(sizes.select("project", F.lit(None).cast("string").alias("name"), F.lit("count").alias("problem")))


def entries(spark: SparkSession, folder: str) -> DataFrame:
    """The ledger's rows: ``taken`` files and ``refused`` ones, whose path was taken with another hash; empty before the first batch."""
    try:
        return spark.read.schema(LEDGER).parquet(folder)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def taker(folder: str) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch`` that enters files (path, sha256, bytes) in the ledger in ``folder``.

    A path is taken once, with its first hash.  The same file again is ignored, in
    this batch or a later one; a path that comes with another hash is refused and
    entered as such.  Of several hashes of one path in a batch the least is taken.  A
    batch owns its part of the ledger and only reads those of earlier batches, so one
    that is run again after a failure leaves what it would have left at once.
    Rows without a path or hash are refused.
    """

    def take(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = entries(spark, folder).where(F.col("batch") < number)
        held = before.where("status = 'taken'").select("path", F.col("sha256").alias("held"))
        known = before.select("path", "sha256")
        files = batch.groupBy("path", "sha256").agg(F.max("bytes").cast("long").alias("bytes"))
        unknown = files.alias("f").join(known.alias("k"), F.col("f.path").eqNullSafe(F.col("k.path")) & F.col("f.sha256").eqNullSafe(F.col("k.sha256")), "left_anti")
        least = F.min("sha256").over(Window.partitionBy("path"))
        first = F.coalesce(F.col("sha256") == F.coalesce("held", least), F.lit(False)) & F.col("path").isNotNull()
        judged = unknown.join(held, "path", "left").withColumn("status", F.when(first, "taken").otherwise("refused"))
        judged.select("path", "sha256", "bytes", "status").write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return take

"""Writers that can run again: they replace the keys they write, and read label files only when those have changed."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_if_there(spark: SparkSession, path: str, fmt: str, schema, **options) -> DataFrame | None:
    """What lies below ``path``; None if nothing does."""
    try:
        return spark.read.format(fmt).options(**options).schema(schema).load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def replace_keys(rows: DataFrame, path: str, folder: str, keys: Sequence[str], fmt: str = "parquet", **options) -> None:
    """Write ``rows`` below ``path``, one folder per value of ``folder``, in place of earlier rows with the same ``keys``.

    Only folders that ``rows`` touch are written: their earlier rows with other keys are read and written again beside the new
    ones, and Spark swaps each folder for its new files when the job has ended, so a failed or repeated job leaves neither
    halves nor doubles. Folders of many rows are cut into several files. Rows without a key are equal to each other; repeated rows stay
    repeated. Two jobs must not write the same folders at the same time.
    """
    spark = rows.sparkSession
    there = read_if_there(spark, path, fmt, rows.schema, **options)
    out = rows
    if there is not None:
        touched = rows.select(F.col(folder).alias("_f")).distinct()
        new = rows.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).distinct()
        other = there.join(touched, F.col(folder).eqNullSafe(F.col("_f")), "left_semi")
        same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
        out = rows.unionByName(other.join(new, same, "left_anti"))
    out = out.hint("rebalance", folder)
    out.write.format(fmt).options(**options).option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(folder).save(path)


# --- label snapshots -----------------------------------------------------------------------------------------------------------


class LabelSnapshot:
    """Parsed labels of a folder of files, kept as Parquet and brought up to date file by file.

    ``data/gen=<n>`` holds the rows that update n parsed, ``files/gen=<n>`` the state of all files after it (name, fingerprint,
    and the update whose rows are theirs), and ``done/gen=<n>``, written last, says that the update is complete. Readers use the
    last complete one, so an update that failed half-way is not seen and its number is used again.
    """

    STATE = "path string, print string, born bigint"

    def __init__(self, spark: SparkSession, path: str, version: str = "1"):
        self.spark, self.path = spark, f"{path}/v{version}"

    def _last(self) -> int:
        done = read_if_there(self.spark, f"{self.path}/done", "parquet", "files bigint, gen bigint")
        return -1 if done is None else int(done.agg(F.coalesce(F.max("gen"), F.lit(-1))).first()[0])

    def _state(self, gen: int) -> DataFrame:
        return self.spark.read.schema(self.STATE).parquet(f"{self.path}/files/gen={gen}")

    def update(self, files: DataFrame, parse: Callable[[DataFrame], DataFrame]) -> dict[str, int]:
        """Parse what is new: ``files`` is the present listing (``path``, ``length``, and ``modified`` where known), ``parse`` turns rows of
        it into label rows with their ``path``. Returns the numbers of files added, changed, removed and kept.

        A file is known by its path, and has changed if its length or time has. Files that are listed twice count once.
        """
        when = F.col("modified").cast("string") if "modified" in files.columns else F.lit("")
        now = files.withColumn("print", F.sha2(F.concat_ws("|", F.col("length").cast("string"), F.coalesce(when, F.lit(""))), 256))
        now = now.groupBy("path").agg(F.max("print").alias("print"))
        gen = self._last()
        old = self._state(gen) if gen >= 0 else self.spark.createDataFrame([], self.STATE)
        old = old.select("path", F.col("print").alias("was"), "born")
        both = now.join(old, "path", "full")
        kind = F.when(F.col("was").isNull(), "added").when(F.col("print").isNull(), "removed").when(F.col("print") != F.col("was"), "changed").otherwise("kept")
        both = both.withColumn("kind", kind)
        counts = {"added": 0, "changed": 0, "removed": 0, "kept": 0} | {r["kind"]: r["count"] for r in both.groupBy("kind").count().collect()}
        if gen >= 0 and not counts["added"] + counts["changed"] + counts["removed"]:
            return counts
        nxt = gen + 1
        fresh = F.col("kind").isin("added", "changed")
        todo = files.join(both.filter(fresh).select("path"), "path", "left_semi").dropDuplicates(["path"])
        parse(todo).write.mode("overwrite").parquet(f"{self.path}/data/gen={nxt}")
        state = both.filter("kind <> 'removed'").select("path", "print", F.when(fresh, F.lit(nxt)).otherwise(F.col("born")).cast("bigint").alias("born"))
        state.write.mode("overwrite").parquet(f"{self.path}/files/gen={nxt}")
        total = counts["added"] + counts["changed"] + counts["kept"]
        self.spark.range(1).select(F.lit(total).cast("bigint").alias("files")).write.mode("overwrite").parquet(f"{self.path}/done/gen={nxt}")
        return counts

    def read(self) -> DataFrame:
        """The rows of all present files: those of the update that last parsed their file."""
        gen = self._last()
        if gen < 0:
            raise ValueError(f"no complete snapshot below {self.path}")
        live = self._state(gen).select(F.col("path").alias("_path"), "born")
        rows = self.spark.read.option("basePath", f"{self.path}/data").parquet(*[f"{self.path}/data/gen={g}" for g in self.generations(gen)])
        return rows.join(live, (F.col("path") == F.col("_path")) & (F.col("gen") == F.col("born")), "left_semi").drop("gen")

    def generations(self, gen: int | None = None) -> list[int]:
        """The updates whose rows are still in use; one number per update, so this is short."""
        gen = self._last() if gen is None else gen
        found = [r["born"] for r in self._state(gen).select("born").distinct().collect()]
        return sorted(found) or [gen]

"""Batches that can be stopped and taken up again: subjects are dealt into slices by a hash of their id, each slice is written and then committed, and a later run
does what isn't committed.

A slice's results count once its commit is there, so that a slice that was stopped halfway is written anew and no subject has two results.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from hedra.operators.score import Frozen, score_batch

COMMIT = "slice int, run string, state string, identity string, n bigint"


def _commits(spark: SparkSession, path: str) -> DataFrame:
    """The status table: a row for each end of a slice or of a run."""
    try:
        return spark.read.schema(COMMIT).parquet(f"{path}/status")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], COMMIT)


def _commit(spark: SparkSession, path: str, rows: list[tuple]) -> None:
    spark.createDataFrame(rows, COMMIT).coalesce(1).write.mode("append").parquet(f"{path}/status")


def committed(spark: SparkSession, path: str) -> dict[int, str]:
    """The run whose results of each slice count."""
    return {r["slice"]: r["run"] for r in _commits(spark, path).where("state = 'succeeded'").groupBy("slice").agg(F.min("run").alias("run")).collect()}  # a row a slice


def tag_of(path: str) -> str:
    """The tag of a batch's jobs, by which `stop` finds them."""
    return "batch-" + "".join(c if c.isalnum() else "-" for c in path)[-80:]


def stop(spark: SparkSession, path: str) -> None:
    """Interrupts the jobs of a running batch, from any thread; its run then ends with the state cancelled."""
    spark.sparkContext.cancelJobsWithTag(tag_of(path))


def run_batch(subjects: DataFrame, frozen: Frozen, path: str, key: str = "subject_id", slices: int = 16, cancelled: Callable[[int], bool] | None = None) -> str:
    """Scores what isn't committed yet, slice by slice, in a folder that all executors share; returns succeeded or cancelled.

    Subjects are dealt into the folder once, at its first run, so that a slice reads its own rows alone; later runs take them from there. cancelled: asked with the
    number of slices done before each. A folder belongs to one project, number of slices and key: another is refused. Subjects without an id go to one
    slice. The status table keeps every run's end.
    """
    spark, run = subjects.sparkSession, uuid.uuid4().hex
    identity = f"{frozen.reuse_key()}:{slices}:{key}"
    found = {r["identity"] for r in _commits(spark, path).select("identity").distinct().limit(2).collect()}
    if found - {identity}:
        raise ValueError("batch_identity_mismatch")
    if not found:
        dealt = subjects.withColumn("_slice", F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(slices)))
        dealt.write.mode("overwrite").partitionBy("_slice").parquet(f"{path}/subjects")
        _commit(spark, path, [(-1, run, "dealt", identity, None)])
    mine = spark.read.schema(StructType([*subjects.schema.fields, StructField("_slice", LongType())])).parquet(f"{path}/subjects")
    done, tag = committed(spark, path), tag_of(path)
    spark.sparkContext.addJobTag(tag)
    try:
        for k in range(slices):
            if k in done:
                continue
            if cancelled and cancelled(len(done)):
                _commit(spark, path, [(k, run, "cancelled", identity, None)])
                return "cancelled"
            out = f"{path}/results/{run}/slice={k}"
            try:
                score_batch(mine.where(F.col("_slice") == k).drop("_slice"), frozen, key).write.mode("overwrite").parquet(out)
            except Exception as e:
                if "cancel" not in str(e).lower():
                    _commit(spark, path, [(k, run, "failed", identity, None)])
                    raise
                spark.sparkContext.removeJobTag(tag)
                _commit(spark, path, [(k, run, "cancelled", identity, None)])
                return "cancelled"
            _commit(spark, path, [(k, run, "succeeded", identity, spark.read.parquet(out).count())])
            done[k] = run
    finally:
        spark.sparkContext.removeJobTag(tag)
    return "succeeded"


def results(spark: SparkSession, path: str) -> DataFrame:
    """What is committed, each subject once."""
    own = committed(spark, path)
    if not own:
        raise ValueError("batch_without_results")
    return spark.read.parquet(*[f"{path}/results/{run}/slice={k}" for k, run in sorted(own.items())])


def progress(spark: SparkSession, path: str) -> DataFrame:
    """state, slices and subjects of the status table."""
    return _commits(spark, path).groupBy("state").agg(F.count(F.lit(1)).alias("slices"), F.sum("n").alias("subjects"))

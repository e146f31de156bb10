"""Searches kept in a folder that all executors share, by a key of all that decides their result; the least recently used go."""

from __future__ import annotations

import json
import time
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hedra.operators.profile import canonical_state, dataset_hash, numeric_fingerprint
from hedra.operators.regress import CONST, Fit, solve
from hedra.operators.search import LOG, Search, Unit, _columns, cache_key, search_models

#: Searches that a folder keeps.
MOST = 32


def sample_fingerprint(df: DataFrame, key: str, columns: list[str]) -> str:
    """Identity of a sample: its row ids with schema and, of each column, number, sum, mean, deviation, first and last values. Two passes, which a caller that knows the sample
    by another name need not make."""
    facts = [r.asDict() for r in numeric_fingerprint(df, key, columns).orderBy("column").collect()]  # a row a column
    return dataset_hash(df, key, canonical_state(df.select(key, *columns)) + json.dumps(facts, sort_keys=True)).first()["sha256"]


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _uses(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("digest string, at double").parquet(f"{folder}/uses")


def _used(spark: SparkSession, folder: str, digest: str, most: int) -> list[str]:
    """Notes a use, and removes what has gone longest without one; returns what is kept, the latest first."""
    spark.createDataFrame([(digest, time.time())], "digest string, at double").coalesce(1).write.mode("append").parquet(f"{folder}/uses")
    last = [r["digest"] for r in _uses(spark, folder).groupBy("digest").agg(F.max("at").alias("at")).orderBy(F.desc("at"), "digest").collect()]  # `most` and what goes now
    for old in last[most:]:
        _delete(spark, f"{folder}/{old}")
    if len(last) > most:
        kept = [(r["digest"], r["at"]) for r in _uses(spark, folder).where(F.col("digest").isin(last[:most])).groupBy("digest").agg(F.max("at").alias("at")).collect()]
        fresh = f"{folder}/uses-{uuid.uuid4().hex}"
        spark.createDataFrame(kept, "digest string, at double").coalesce(1).write.parquet(fresh)
        _delete(spark, f"{folder}/uses")
        where = spark._jvm.org.apache.hadoop.fs.Path
        where(folder).getFileSystem(spark._jsc.hadoopConfiguration()).rename(where(fresh), where(f"{folder}/uses"))
    return last[:most]


def _chosen(candidate: str) -> tuple[dict[str, str], str]:
    """Variables with their transforms, and the target's kind, of a candidate's id."""
    *parts, kind, _ = candidate.split("|")
    return dict(p.rsplit(":", 1) for p in parts), kind.removeprefix("y:")


def cached_search(df: DataFrame, target: str, units: list[Unit], folder: str, fingerprint: str, most: int = MOST, objective: str = "rmse", scope: str = "population_model", **search) -> tuple[Search, bool]:
    """The search of `search_models` and whether it was in the folder: then no row of `df` is read. The key covers the fingerprint, target, units, objective and all options.

    Searches for a subject are made anew each time, as their records are the subject's. Two runs that miss at once both compute, and the later one's equal result stays."""
    spark = df.sparkSession
    if search.get("subject") is not None:
        return search_models(df, target, units, objective, **search), False
    digest = cache_key(fingerprint, units, {"target": target, "objective": objective, **{k: search[k] for k in sorted(search)}}, scope)
    at = f"{folder}/{digest}"
    hit = _exists(spark, f"{at}/state/_SUCCESS")
    if not hit:
        made = search_models(df, target, units, objective, **search)
        records = f"records-{uuid.uuid4().hex}"  # another name each time, so that who still reads an earlier one can
        made.records.write.parquet(f"{at}/{records}")
        r, n, names = made.triangle
        state = {"records": records, "audit": made.audit, "r": [float(v).hex() for v in r.ravel()], "n": n, "names": names}
        spark.createDataFrame([(json.dumps(state),)], "state string").coalesce(1).write.mode("overwrite").parquet(f"{at}/state")  # what is there last makes it whole
    _used(spark, folder, digest, most)
    state = json.loads(spark.read.parquet(f"{at}/state").first()["state"])
    names, n, by = state["names"], state["n"], {u.base: u for u in units}
    r = np.array([float.fromhex(v) for v in state["r"]]).reshape(len(names), len(names))

    def fit(candidate: str) -> Fit:
        c, kind = _chosen(candidate)
        return solve(r, n, names, [CONST, *_columns(by, c)], target if kind == "identity" else LOG + target)

    def features(candidate: str) -> list[tuple[str, str, str]]:
        c, _ = _chosen(candidate)
        return [(name, name if by[b].columns else b, "linear" if by[b].columns else c[b]) for b in sorted(c) for name in _columns(by, {b: c[b]})]

    audit = state["audit"] | {"targets": tuple(state["audit"]["targets"])}
    return Search(spark.read.parquet(f"{at}/{state['records']}"), audit, fit, features, (r, n, names)), hit

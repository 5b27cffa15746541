"""Versioned datasets, lineage and step logs as plain tables below one folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.session import cut_lineage

VERSIONS = "version int, label string, source_version int, path string, created_at timestamp"


class VersionStore:
    """Append-only versions with parent pointers. One writer at a time; any number of readers."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def versions(self) -> DataFrame:
        try:
            return self.spark.read.schema(VERSIONS).parquet(f"{self.root}/versions")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], VERSIONS)

    def save(self, df: DataFrame, label: str, source_version: int | None = None) -> int:
        version = (self.versions().agg(F.max("version")).first()[0] or 0) + 1
        path = f"{self.root}/data/{version}"
        df.write.parquet(path)
        row = self.spark.createDataFrame([(version, label, source_version, path)], "version int, label string, source_version int, path string")
        row.withColumn("created_at", F.current_timestamp()).write.mode("append").parquet(f"{self.root}/versions")
        return version

    def read(self, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/data/{version}")

    def latest(self, label: str | None = None) -> int | None:
        v = self.versions()
        return (v.where(F.col("label") == label) if label else v).agg(F.max("version")).first()[0]

    def available(self) -> dict[str, DataFrame]:
        """Label -> data of its latest version."""
        rows = self.versions().groupBy("label").agg(F.max("version").alias("version")).collect()
        return {r["label"]: self.read(r["version"]) for r in rows}


def latest_per_label(versions: DataFrame) -> DataFrame:
    return versions.groupBy("label").agg(F.max_by(F.struct("version", "source_version"), "version").alias("v")).select("label", "v.*")


def _jumps(versions: DataFrame) -> DataFrame:
    return versions.select("version", F.col("source_version").alias("jump"))


def _doublings(versions: DataFrame) -> int:
    """Rounds after which a jump is longer than any chain without a cycle."""
    return versions.count().bit_length()


def descendants(versions: DataFrame, roots: DataFrame) -> DataFrame:
    """Versions derived, directly or not, from the given ones (the closure that a purge drops).

    Pointer doubling: every version knows an ancestor 1, 2, 4, ... steps up and whether a root lies
    on the way, so depth costs a logarithm of rounds and shared ancestors are walked once.
    """
    named = roots.select(F.col("version").alias("root")).distinct()
    above = named.select(F.col("root").alias("parent"))
    state = _jumps(versions).join(named, F.col("version") == F.col("root"), "left").join(above, F.col("jump") == F.col("parent"), "left")
    state = state.select("version", "jump", (F.col("root").isNotNull() | F.col("parent").isNotNull()).alias("hit"))
    for _ in range(_doublings(versions)):
        state = cut_lineage(state)
        if not state.where("jump IS NOT NULL").limit(1).count():
            break
        above = state.select(F.col("version").alias("jump"), F.col("jump").alias("_jump"), F.col("hit").alias("_hit"))
        state = state.join(above, "jump", "left").select("version", F.col("_jump").alias("jump"), (F.col("hit") | F.coalesce("_hit", F.lit(False))).alias("hit"))
    return state.where("hit").select("version").union(named).distinct()


def purge(versions: DataFrame, roots: DataFrame) -> DataFrame:
    """Versions left after the given ones and everything derived from them are dropped."""
    return versions.join(descendants(versions, roots), "version", "left_anti")


def chain(versions: DataFrame, version: int) -> list[int] | None:
    """Versions from the root to ``version``; none when a parent is missing or the chain is a cycle.

    Ancestors at distance 0 to 2^k - 1 give those at 2^k to 2^(k+1) - 1 by one join with the jumps of
    length 2^k, so a chain of any depth takes a logarithm of rounds.
    """
    jumps = cut_lineage(_jumps(versions))
    found = jumps.where(F.col("version") == version).select("version", F.lit(0).cast("bigint").alias("depth"))
    rounds = _doublings(versions)
    for k in range(rounds):
        further = found.join(jumps.where("jump IS NOT NULL"), "version").select(F.col("jump").alias("version"), (F.col("depth") + (1 << k)).alias("depth"))
        longer = cut_lineage(found.unionByName(further))
        found, before = longer, found
        if longer.count() == before.count():
            break
        above = jumps.select(F.col("version").alias("jump"), F.col("jump").alias("_jump"))
        jumps = cut_lineage(jumps.join(above, "jump").select("version", F.col("_jump").alias("jump")))
    rows = found.join(_jumps(versions), "version", "left").orderBy(F.desc("depth")).collect()  # the answer itself, one row per link
    path = [r["version"] for r in rows]
    whole = versions.select("version").join(found.select("version"), "version", "left_semi").distinct().count() == len(path)
    if not path or rows[0]["jump"] is not None or not whole:
        return None
    return path


# ---- step log ------------------------------------------------------------------------------------------

STEP_LOG = "dataset string, step int, description string"


def append_step(log: DataFrame, dataset: str, description: str) -> DataFrame:
    """The log with one more step of ``dataset``; steps are numbered per dataset."""
    mine = log.where(F.col("dataset") == dataset)
    row = mine.agg((F.coalesce(F.max("step"), F.lit(0)) + 1).cast("int").alias("step")).select(
        F.lit(dataset).alias("dataset"), "step", F.lit(description).alias("description"))
    return log.unionByName(row)


def reset_steps(log: DataFrame, dataset: str) -> DataFrame:
    return log.where(F.col("dataset") != dataset)


def empty_log(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], T.StructType.fromDDL(STEP_LOG))

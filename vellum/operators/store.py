"""Keyed tables without row updates: upserts as anti-joins and unions, additive schemas, versioned writes."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def migrate(df: DataFrame, target: StructType) -> tuple[DataFrame, list[str]]:
    """df with the columns of target that it lacks (null), and their names; nothing the second time."""
    have = {c.lower() for c in df.columns}
    missing = [f for f in target if f.name.lower() not in have]
    return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing}) if missing else df, [f.name for f in missing]


def upsert_replace(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """new's rows win."""
    return old.join(new.select(*keys).distinct(), [*keys], "left_anti").unionByName(new, allowMissingColumns=True)


def upsert_ignore(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """old's rows win; new's only where the key is unknown."""
    return old.unionByName(new.join(old.select(*keys).distinct(), [*keys], "left_anti"), allowMissingColumns=True)


def replace_keys(old: DataFrame, new: DataFrame, processed: DataFrame, key: str) -> DataFrame:
    """All rows of the processed keys are replaced by new's, also where new has none."""
    return old.join(processed.select(key).distinct(), key, "left_anti").unionByName(new)


def stamp(works: DataFrame, processed: DataFrame, column: str, when: Column, key: str = "work_id") -> DataFrame:
    """column set to when for the processed keys."""
    done = processed.select(key).distinct().withColumn("__done", F.lit(True))
    return works.join(done, key, "left").withColumn(column, F.when(F.col("__done"), when).otherwise(F.col(column))).drop("__done")


def record_works(old: DataFrame, new: DataFrame, key: str = "work_id") -> DataFrame:
    """Insert; a known work changes its verdict columns only while it is a candidate. New pmcids fill in, identity stays."""
    verdict = ["status", "reject_reason", "study_type", "evidence_grade", "triage_confidence"]
    n = new.select(key, *[F.col(c).alias(f"n_{c}") for c in new.columns if c != key], F.lit(True).alias("__new"))
    both = old.withColumn("__old", F.lit(True)).join(n, key, "full_outer")
    open_ = F.col("__old").isNull() | (F.col("__new") & F.col("status").eqNullSafe("candidate"))

    def pick(c: str) -> Column:
        if c == key or f"n_{c}" not in both.columns:
            return F.col(c)
        if c in verdict:
            return F.when(open_, F.col(f"n_{c}")).otherwise(F.col(c)).alias(c)
        if c == "pmcid":
            return F.when(open_, F.coalesce(f"n_{c}", c)).otherwise(F.col(c)).alias(c)
        return F.when(F.col("__old").isNull(), F.col(f"n_{c}")).otherwise(F.col(c)).alias(c)

    return both.select(*[pick(c) for c in old.columns])


def apply_verdicts(works: DataFrame, verdicts: DataFrame, source: str, key: str = "work_id") -> DataFrame:
    """Judgments onto works: a publisher's study type stays and is credited to the publisher."""
    v = verdicts.select(key, F.col("relevance").alias("v_rel"), F.col("domain").alias("v_dom"), F.col("study_type").alias("v_type"), F.col("confidence").alias("v_conf"), F.lit(True).alias("__hit"))
    j = works.join(v, key, "left")
    hit = F.col("__hit").isNotNull()
    return j.withColumns(
        {
            "label_source": F.when(hit, F.when(F.col("study_type").isNull(), F.lit(source)).otherwise("publisher")).otherwise(F.col("label_source")),
            "label_confidence": F.when(hit, F.col("v_conf")).otherwise(F.col("label_confidence")),
            "relevance": F.when(hit, F.col("v_rel")).otherwise(F.col("relevance")),
            "domain": F.when(hit, F.col("v_dom")).otherwise(F.col("domain")),
            "study_type": F.when(hit, F.coalesce("study_type", "v_type")).otherwise(F.col("study_type")),
        }
    ).drop("v_rel", "v_dom", "v_type", "v_conf", "__hit")


def mark_retracted(works: DataFrame, checked: DataFrame, hits: DataFrame, now: Column, key: str = "work_id") -> DataFrame:
    """Status of hits becomes retracted; every checked work is stamped."""
    out = stamp(works, checked, "retraction_checked_at", now, key)
    h = hits.select(key).distinct().withColumn("__hit", F.lit(True))
    return out.join(h, key, "left").withColumn("status", F.when(F.col("__hit"), "retracted").otherwise(F.col("status"))).drop("__hit")


class Versioned:
    """A table as immutable version folders and a pointer file that names the current one.

    A writer adds a folder and swaps the pointer; readers of the old version aren't disturbed.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def current(self) -> str | None:
        if not self._fs.exists(self._path(f"{self.path}/CURRENT")):
            return None
        return self.spark.read.text(f"{self.path}/CURRENT").first()[0]

    def read(self) -> DataFrame:
        version = self.current()
        if version is None:
            raise FileNotFoundError(f"no version of {self.path}")
        return self.spark.read.parquet(f"{self.path}/{version}")

    def write(self, df: DataFrame) -> str:
        version = f"v-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{version}")
        out = self._fs.create(self._path(f"{self.path}/CURRENT.next"), True)
        out.write(bytearray(version.encode()))
        out.close()
        self._fs.delete(self._path(f"{self.path}/CURRENT"), False)
        self._fs.rename(self._path(f"{self.path}/CURRENT.next"), self._path(f"{self.path}/CURRENT"))
        return version

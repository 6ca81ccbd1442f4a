"""Stratified samples and splits, fixed by a seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(seed: int, key: str) -> Column:
    """A random order that any engine with MD5 repeats."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))


def allocation(sizes: DataFrame, stratum: str, n: int, floor: int) -> DataFrame:
    """stratum and take for sizes (a row for each stratum, with its size): a floor for all, the rest in proportion to what is left.

    Shares are rounded by largest remainder, then larger room, then name, in whole numbers; no stratum
    gives more than it has. The windows are over one row a stratum.
    """
    every = Window.partitionBy()
    df = sizes.withColumn("__base", F.least(F.col("size"), F.lit(floor))).withColumn("__room", F.col("size") - F.col("__base"))
    df = df.withColumn("__pool", F.sum("__room").over(every))
    df = df.withColumn("__rest", F.least(F.greatest(F.lit(n) - F.sum("__base").over(every), F.lit(0)), F.col("__pool")))
    df = df.withColumn("__whole", F.when(F.col("__pool") > 0, F.expr("__rest * __room div __pool")).otherwise(F.lit(0).cast("long")))
    df = df.withColumn("__left", F.col("__rest") * F.col("__room") - F.col("__whole") * F.col("__pool"))
    order = F.row_number().over(Window.orderBy(F.desc("__left"), F.desc("__room"), stratum))
    more = (order <= F.col("__rest") - F.sum("__whole").over(every)).cast("long")
    return df.select(stratum, (F.col("__base") + F.col("__whole") + more).alias("take"))


def stratified(df: DataFrame, stratum: str, key: str, n: int, floor: int = 20, seed: int = 7) -> DataFrame:
    """About n rows over all strata, numbered (pos) so that any prefix is spread over them too."""
    sizes = df.groupBy(stratum).agg(F.count("*").alias("size"))
    quota = allocation(sizes, stratum, n, floor).withColumnRenamed("take", "__take")  # one row a stratum
    w = Window.partitionBy(stratum).orderBy(draw(seed, key), key)
    picked = df.join(F.broadcast(quota), stratum).withColumn("__r", F.row_number().over(w)).filter("__r <= __take").drop("__r", "__take")
    return picked.withColumn("pos", F.row_number().over(Window.orderBy(draw(seed + 1, key), key)))  # at most n rows and the floors


def split(df: DataFrame, label: str, key: str, fraction: float = 0.2, seed: int = 7) -> DataFrame:
    """is_test marks a share of each class, rounded half to even."""
    w = Window.partitionBy(label)
    n = F.bround(F.count("*").over(w) * F.lit(fraction))
    return df.withColumn("is_test", F.row_number().over(w.orderBy(draw(seed, key), key)) <= n)

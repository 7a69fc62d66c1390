"""Generated problems of the published timings: simple, hard and interacted; rows are made where they are used."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sorbus.operators.absorb import Effect

SEED = 1234


def simple(spark: SparkSession, n: int = 10_000_000) -> tuple[DataFrame, list[Effect]]:
    """n rows on n / 100 and 100 levels, all drawn alike."""
    rows = spark.range(n).select(
        (F.rand(SEED) * (n // 100)).cast("int").alias("id1"), (F.rand(SEED + 1) * 100).cast("int").alias("id2"), F.rand(SEED + 2).alias("y")
    )
    return rows, [Effect("id1"), Effect("id2")]


def hard(spark: SparkSession, n: int = 800_000) -> tuple[DataFrame, list[Effect]]:
    """n rows on n / 2 workers and n / 16 firms; a worker's firms are within ten of an eighth of the worker's number."""
    workers, firms = n // 2, n // 16
    worker = (F.rand(SEED) * workers).cast("int")
    rows = spark.range(n).select(worker.alias("worker"), F.rand(SEED + 1).alias("step"), F.rand(SEED + 2).alias("x"), F.rand(SEED + 3).alias("y"))
    near = F.floor(F.col("worker") / 8) + F.floor(F.col("step") * 21) - 10
    return rows.withColumn("firm", F.greatest(F.lit(0), F.least(F.lit(firms - 1), near)).cast("int")).drop("step"), [Effect("worker"), Effect("firm")]


def interacted(spark: SparkSession, n: int = 800_000) -> tuple[DataFrame, list[Effect]]:
    """The rows of `hard` on workers, and on workers times a continuous column."""
    return hard(spark, n)[0], [Effect("worker"), Effect("worker", slope="x")]


#: Rows and groups of the published gather timings.
GATHERS = ((10_000_000, 100), (10_000_000, 100_000), (800_000, 400_000), (800_000, 50_000))


def gather_rows(spark: SparkSession, n: int, groups: int) -> DataFrame:
    return spark.range(n).select((F.rand(SEED) * groups).cast("int").alias("g"), F.rand(SEED + 1).alias("y"), F.rand(SEED + 2).alias("cache"))


def gather_hashed(rows: DataFrame) -> DataFrame:
    """Sums per group by hash aggregation, partial before the shuffle."""
    return rows.groupBy("g").agg(F.sum(F.col("y") * F.col("cache")).alias("sum"))


def gather_sorted(rows: DataFrame) -> DataFrame:
    """The same after rows are dealt and sorted by group."""
    return gather_hashed(rows.repartition("g").sortWithinPartitions("g"))

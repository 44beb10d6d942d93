"""Tables written once to the folder all executors share, to cut lineage and to fix rows."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.session import scratch

#: Spark's own setting that drops a query's shuffle files when it ends, not when the driver collects its garbage.
FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def kept(df: DataFrame, name: str) -> DataFrame:
    """`df`, written as Parquet below spark.checkpoint.dir and read again; the write's shuffle files go when it ends."""
    spark = df.sparkSession
    path, before = scratch(spark, name), spark.conf.get(FREE)
    spark.conf.set(FREE, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(FREE, before)
    return spark.read.schema(df.schema).parquet(path)


def literal_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table from a literal in the plan; unlike createDataFrame it needs no Python worker."""
    kind = "array<struct<" + ",".join(part.strip().replace(" ", ":", 1) for part in schema.split(";")) + ">>"
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), F.lit(kind))))

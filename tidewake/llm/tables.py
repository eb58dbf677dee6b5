"""Reading the test tables."""

from pyspark.sql import DataFrame, SparkSession

from tidewake.llm.workspace import bound_batches


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

"""Tables kept in the folder that all executors share, to cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where none is set, a temporary folder in local mode (tests), an error on a cluster."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tidewake-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Rows of an Arrow batch: texts are long, and a batch is held on both sides of the socket.
BATCH_ROWS = 256


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small in this session, unless they are smaller already."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


class Workspace:
    """A folder of intermediate Parquet tables for one run of one operator."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        bound_batches(spark)
        self.path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and return the stored table, whose plan starts at the files."""
        schema = df.schema
        df.write.mode("overwrite").parquet(self.at(name))
        return self.spark.read.schema(schema).parquet(self.at(name))

    def drop(self, name: str) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.at(name))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

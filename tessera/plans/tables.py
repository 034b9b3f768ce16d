"""Tables written once to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_written: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of this machine in local mode (tests), and an error on a cluster."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: executors have no folder in common")
        place = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, dropped when the driver's Python ends."""
    path = f"{shared_folder(spark)}/tessera-{name}-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


def write_once(df: DataFrame) -> DataFrame:
    """df written as Parquet and read back, which cuts its lineage; dropped when the driver's Python ends."""
    spark = df.sparkSession
    path = shared_path(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Rounds:
    """A table that grows by rounds: each is written to a folder of its own, and earlier ones are never written again."""

    def __init__(self, spark: SparkSession, schema: StructType, name: str = "rounds") -> None:
        self.spark, self.schema, self.path, self.n = spark, schema, shared_path(spark, name), 0

    def add(self, df: DataFrame) -> DataFrame:
        """Write the next round and return it as read back."""
        path = f"{self.path}/round={self.n}"
        df.select(*self.schema.names).write.parquet(path)
        self.n += 1
        return self.spark.read.schema(self.schema).parquet(path)

    def all(self) -> DataFrame:
        """The rows of every round."""
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/round={i}" for i in range(self.n)])


@atexit.register
def _drop_all() -> None:
    for path, spark in _written.items():
        try:
            if spark.sparkContext._jsc is not None:
                where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended; its folder goes with the cluster's clean-up
            continue

"""Session settings and lineage cutting for the analytics operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", name: str = "ripplemark", memory: str = "8g") -> SparkSession:
    """A session for one machine; a cluster brings its own settings."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir`` (a temporary one only where that is unset)."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="spark-checkpoint-", dir="/tmp"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


class Scratch:
    """Tables in the shared folder for the steps of a loop; they go when the block ends.

    Unlike a checkpoint, whose estimated size is that of its plan and multiplies with every join, a table has the size of
    its files: after a dozen rounds of joins the estimate alone has millions of digits and planning takes minutes.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.tables = spark, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}", 0

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def keep(self, df: DataFrame) -> DataFrame:
        """``df``, written and read again."""
        self.tables += 1
        df.write.parquet(path := f"{self.folder}/{self.tables}")
        return self.spark.read.schema(df.schema).parquet(path)

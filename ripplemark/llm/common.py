"""Small helpers that the text operators share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Only where that is unset (tests) a temporary one is set.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="spark-checkpoint-", dir="/tmp"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut, in the shared folder."""
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


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once for a row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def held_out(doc_id: str = "doc_id"):
    """True for the rows whose labels no model here may see: crc32 of the id as text, mod 4, is 2 (null ids: false)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def free(name: str, columns: list[str]) -> str:
    """``name``, with underscores before it until no column has it (in any case)."""
    taken = {c.lower() for c in columns}
    while any(c == name.lower() or c.startswith(name.lower()) for c in taken):
        name = f"_{name}"
    return name


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; a null counts as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def slices(batch: pa.RecordBatch, column: str, most_rows: int, most_bytes: int):
    """``batch`` in runs of at most ``most_rows`` rows and ``most_bytes`` bytes of text; a longer text is a run of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at = 0
    while at < batch.num_rows:
        fit = int(np.searchsorted(np.cumsum(sizes[at : at + most_rows], dtype=np.int64), most_bytes, "right"))
        yield batch.slice(at, max(1, fit))
        at += max(1, fit)


def map_texts(docs: DataFrame, columns: list[str], schema: str, rows, text: str = "text", slice_rows: int = 1500, slice_bytes: int = 8_000_000) -> DataFrame:
    """``rows(texts) -> dict of columns`` over whole texts, in slices of a batch, beside the ``columns`` passed through.

    One output row for each input row, in the same partition: no shuffle.  A slice is bounded in rows and in bytes.
    """
    names = [c for c in columns if c != text]
    kinds = {f.name: f.dataType.simpleString() for f in docs.select(*names).schema.fields}
    full = ", ".join([*(f"`{n}` {kinds[n]}" for n in names), schema])

    def run(batches):
        run_rows = rows()
        for batch in batches:
            for part in slices(batch, text, slice_rows, slice_bytes):  # bounds the memory of a worker
                out = run_rows(texts_of(part, text))
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), *(v if isinstance(v, pa.Array) else pa.array(v) for v in out.values())], names=[*names, *out])

    return docs.select(*names, text).mapInArrow(run, full)


#: A key with more than one row in so many is hot; there are fewer than this many of them, whatever the data.
HOT_SHARE = 4096


def join_facts(rows: DataFrame, facts: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """``rows`` left-joined with ``facts``, one row for each ``key``, whose column ``count`` is the key's number of rows.

    Keys that hold over ``total / HOT_SHARE`` of all ``total`` rows are fewer than ``HOT_SHARE``, so their facts are
    broadcast; the rows of these keys are dealt evenly, the others meet their facts in a shuffle.  ``rows`` may have no
    column ``_deal``.
    """
    names = [c for c in facts.columns if c != key]
    hot = facts.where(F.col(count) * HOT_SHARE > total).select(key, F.struct(*names).alias("_hot"))
    cold = facts.where(F.col(count) * HOT_SHARE <= total).select(key, F.struct(*names).alias("_cold"), F.lit(0).alias("_deal"))
    rows = rows.join(F.broadcast(hot), key, "left")
    deal = F.when(F.col("_hot").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(*[c for c in rows.columns if c != "_hot"]), F.lit(HOT_SHARE)).cast("int"))
    rows = rows.withColumn("_deal", deal).join(cold, [key, "_deal"], "left")
    return rows.withColumns({n: F.coalesce(F.col("_hot")[n], F.col("_cold")[n]) for n in names}).drop("_hot", "_cold", "_deal")


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit over the output."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))

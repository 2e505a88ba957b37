"""What the operators of this subpackage share: the scratch folder, folds, Arrow slices."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a task looks at together; one document may be longer.
SLICE_BYTES = 1 << 20
#: Rows that a task looks at together: short texts may be many to a slice.
SLICE_ROWS = 2048


def scratch(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a local session
    (one process, as in tests) gets a folder of its own and any other an error, since executors
    don't see each other's local folders."""
    conf = spark.sparkContext.getConf()
    where = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = getattr(spark, "_sluiceway_scratch", None) or tempfile.mkdtemp(prefix="spark-sluiceway-")
        spark._sluiceway_scratch = where
    return where.rstrip("/")


class Scratch:
    """Tables of one operator's run in the shared folder. Written tables end a lineage, so a
    lost executor costs no recomputation of what came before; they go once they are used up."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.where = spark, f"{scratch(spark)}/{label}-{uuid.uuid4().hex}"

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        """df, written and read back."""
        path = f"{self.where}/{name}"
        df.write.parquet(path)
        release(self.spark)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.where}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Shuffle files of finished levels go once the driver's JVM has dropped their plans."""
    spark.sparkContext._jvm.System.gc()


def one_text(own: DataFrame) -> DataFrame:
    """own (doc_id, text and more), where rows of one id that differ in their text are given the
    least of these texts. Looking for such ids moves ids and hashes only."""
    seen = F.xxhash64(F.coalesce("text", F.lit("")))
    several = own.filter("doc_id is not null").groupBy("doc_id").agg(F.min(seen).alias("lo"), F.max(seen).alias("hi")).filter("lo <> hi").select("doc_id")
    if several.isEmpty():
        return own
    least = own.join(several, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("_least"))
    return own.join(least, "doc_id", "left").withColumn("text", F.coalesce("_least", "text")).drop("_least").select(own.columns)


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(parts)


_held: dict[tuple, object] = {}


def held(key: tuple, build: Callable[[], object]) -> object:
    """What a Python worker keeps from one task to the next: one thing at a time."""
    if key not in _held:
        _held.clear()
        _held[key] = build()
    return _held[key]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES, rows: int = SLICE_ROWS, keep: bool = False) -> Iterator[pa.RecordBatch]:
    """The same rows in record batches of at most ``rows`` rows and ``limit`` text bytes (one
    row at least). Without ``keep``, what another operator held in this worker goes first."""
    import numpy as np

    if not keep:
        _held.clear()

    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch[text]), 0), dtype=np.int64))
        at = 0
        while at < batch.num_rows:
            done = size[at - 1] if at else 0
            upto = min(at + rows, max(at + 1, int(np.searchsorted(size, done + limit, side="right"))))
            yield batch.slice(at, upto - at)
            at = upto

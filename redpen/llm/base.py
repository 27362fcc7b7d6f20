"""What the operators of this subpackage share: reading tables, cutting lineage, size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when it has at most this many (narrow) rows; otherwise the join is shuffled.
BROADCAST_ROWS = 200_000
#: Texts are handed to numpy in pieces of about this many bytes, so that a task's memory does not follow the table.
PIECE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers get: rows here are whole texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); where it is unset, a new one if Spark is local, as in tests.

    On a cluster a machine's own folder would lose what other machines write, so that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="redpen-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/redpen-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends at files that outlive any executor."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file tree made by new_path() through Spark's own file systems."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it is proven small by counting; as it is, to be shuffled, if not.

    df should be cheap to count (a written table)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def column_bytes(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A string column as UTF-8 bytes; null is empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def pieces(batch: pa.RecordBatch, name: str, limit: int = PIECE_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) pieces of a batch of about `limit` bytes each; one longer text is a piece of its own."""
    texts, at, held, size = column_bytes(batch, name), 0, [], 0
    for i, t in enumerate(texts):
        if held and size + len(t) > limit:
            yield at, held
            at, held, size = i, [], 0
        held.append(t)
        size += len(t)
    if held:
        yield at, held

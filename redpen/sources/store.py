"""Folders that driver and executors share: tables that end a lineage, logs of batches, and publishing with a readback."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class PublishError(ValueError):
    """What was read back broke an invariant; nothing was published."""


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset, a new one if Spark is local, as in tests. Elsewhere that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="redpen-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/redpen-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read again."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _at(spark: SparkSession, path: str) -> tuple:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, fs = _at(spark, path)
    return bool(fs.exists(where))


def delete(spark: SparkSession, path: str) -> None:
    where, fs = _at(spark, path)
    fs.delete(where, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it isn't there."""
    where, fs = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def publish(rows: DataFrame, path: str, invariants: dict[str, Column | Callable[[DataFrame], DataFrame]], form: str = "parquet") -> DataFrame:
    """Write rows beside `path`, read them back, check every invariant over what was read, and only then move them there.

    An invariant is an aggregate over all rows that has to be true, or a function that gives the rows which break it. One that is
    false, null or has such rows deletes what was written and raises PublishError with the names of all that failed, of which
    `rows` (as many are read as were written) is one; a failure to write or read deletes it too. A path that is taken is an
    error and stays as it is. Readers never see part of the files: the move is a rename. Returns the published table."""
    spark = rows.sparkSession
    if exists(spark, path):
        raise PublishError(f"{path} is taken")
    aside = f"{path.rstrip('/')}.aside-{uuid.uuid4().hex}"
    where, fs = _at(spark, aside)
    try:
        counted, watch = F.count(F.lit(1)).alias("rows"), Observation()
        rows.observe(watch, counted).write.format(form).save(aside)
        back = spark.read.schema(rows.schema).format(form).load(aside)
        sums = {n: c for n, c in invariants.items() if isinstance(c, Column)}
        found = back.agg(counted, *[F.coalesce(c, F.lit(False)).alias(f"ok{k}") for k, c in enumerate(sums.values())]).first()
        failed = [n for k, n in enumerate(sums) if not found[f"ok{k}"]] + [n for n, f in invariants.items() if n not in sums and f(back).limit(1).count()]
        if found["rows"] != watch.get["rows"]:
            failed.append("rows")
        if failed:
            raise PublishError(f"{', '.join(failed)} not met")
        if not fs.rename(where, _at(spark, path)[0]):
            raise PublishError(f"{path} can't be written")
    except BaseException:
        fs.delete(where, True)
        raise
    return spark.read.schema(rows.schema).format(form).load(path)


class BatchLog:
    """A log of micro-batches that holds each batch once, however often it is written.

    A batch has a folder of its own, named by its number, which a repeated batch overwrites; the marker that Spark's writers leave
    last says that it is whole. So a run that is killed while it writes, or before Spark notes the batch as done, and is resumed
    from its checkpoint leaves every row once. Batch numbers are those of one checkpoint: a log belongs to one stream."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, form: str = "json"):
        self.spark, self.folder, self.schema, self.form = spark, folder.rstrip("/"), schema, form

    def __call__(self, rows: DataFrame, batch: int) -> None:
        rows.write.format(self.form).mode("overwrite").save(f"{self.folder}/batch={batch}")

    def read(self) -> DataFrame:
        """Rows of all whole batches, with their batch number."""
        whole = [f"{self.folder}/{n}" for n in names(self.spark, self.folder) if n.startswith("batch=") and exists(self.spark, f"{self.folder}/{n}/_SUCCESS")]
        if not whole:
            return self.spark.createDataFrame([], self.schema).withColumn("batch", F.lit(0).cast("long"))
        return self.spark.read.schema(f"{self.schema}, batch long").option("basePath", self.folder).format(self.form).load(whole)


def drained(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", idle: bool = True) -> None:
    """Run a stream into a sink until what is there now has been read; a checkpoint that exists is resumed.

    idle: whether batches without rows follow as long as state asks for them. Timers of event time need them; state that lives by
    the clock asks for ever, so it has to do without."""
    conf, key = stream.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(key)
    conf.set(key, str(idle).lower())
    try:
        run = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    finally:
        conf.set(key, before)
    run.awaitTermination()

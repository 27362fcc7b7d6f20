"""Tables and the paragraph view that most operators start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def paragraphs(docs: DataFrame, *carry: str) -> DataFrame:
    """(doc_id, *carry, para_idx, text): the lines of each text. Null texts have none."""
    return docs.select("doc_id", *carry, F.posexplode(F.split("text", "\n", -1)).alias("para_idx", "text")).withColumn("para_idx", F.col("para_idx").cast("long"))


def with_offsets(paras: DataFrame, gap: int = 2) -> DataFrame:
    """position: where each paragraph begins if they are joined by `gap` characters."""
    before = Window.partitionBy("doc_id").orderBy("para_idx").rowsBetween(Window.unboundedPreceding, -1)
    return paras.withColumn("length", F.length("text").cast("long")).withColumn("position", F.coalesce(F.sum(F.col("length") + gap).over(before), F.lit(0)).cast("long"))


def listing_page(keys: DataFrame, key: str, prefix: str, size: int, after: str = "") -> DataFrame:
    """One page of a listing by keyset: (key, is_truncated, next_token) of keys with the prefix after a token; the next token is the page's
    last key if there are more. The windows see at most size + 1 rows."""
    rows = keys.filter(F.col(key).startswith(prefix) & (F.col(key) > after)).select(F.col(key).alias("key")).distinct().orderBy("key").limit(size + 1)
    page = Window.orderBy("key").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    more = F.count("*").over(page) > size
    numbered = rows.select("key", F.row_number().over(Window.orderBy("key")).alias("n"), more.alias("is_truncated"), F.when(more, F.nth_value("key", size).over(page)).alias("next_token"))
    return numbered.filter(F.col("n") <= size).select("key", "is_truncated", "next_token")

"""Reading inputs and writing results."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X

PAGES = T.StructType(
    [T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType())]
)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages with the schema given, so that no file is opened to infer it."""
    return spark.read.schema(PAGES).parquet(path)


def stream_pages(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(PAGES)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def read_bucketed_pages(spark: SparkSession, table: str) -> DataFrame:
    """Pages of a table bucketed by page_id: pass co_located=True to the page jobs, which then shuffle
    nothing at all."""
    return spark.table(table)


def write_bucketed_pages(pages: DataFrame, table: str, buckets: int) -> None:
    """One shuffle, paid once, for a page table that is converted more than once."""
    (
        pages.repartition(buckets, "page_id")
        .write.mode("overwrite")
        .bucketBy(buckets, "page_id")
        .sortBy("page_id")
        .saveAsTable(table)
    )


def last_nonblank_capture(captures: DataFrame, *keys: str) -> DataFrame:
    """Several captures per key -> the last one that is not blank (S2). Keys without one disappear.
    Partial maxima on the map side leave one row per key and task, however hot the key."""
    names = keys or ("url",)
    return captures.where(X.not_blank(F.col("html"))).groupBy(*names).agg(F.max_by("html", "capture_no").alias("html"))


def read_requests(requests: DataFrame) -> DataFrame:
    """Request values are cleaned: missing becomes '', tags are stripped, blanks trimmed (S3)."""
    return requests.withColumns({c: X.clean_value(F.col(c)) for c in ("accept", "uri")})


def write_results(corpus: DataFrame, path: str, mode: str = "errorifexists", compact: bool = False) -> None:
    """Good and failed pages in one pass: the split is by directory, so nothing is computed twice and
    nothing has to be kept (S5, S6).

    With compact, rows are rebalanced by directory first: few, even files, and a language that holds
    most of the pages is split over many tasks. That costs a shuffle of the Markdown.
    """
    if compact:
        corpus = corpus.hint("rebalance", F.col("status"), F.col("language"))
    corpus.write.mode(mode).partitionBy("status", "language").parquet(path)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Finished pages; other directories are pruned."""
    return spark.read.parquet(path).where(F.col("status") == "ok")


def read_quarantine(spark: SparkSession, path: str) -> DataFrame:
    return quarantine(spark.read.parquet(path))


def quarantine(corpus: DataFrame) -> DataFrame:
    """Pages that gave nothing, with the reason."""
    return corpus.where(F.col("status") != "ok").drop("markdown")


def current_facts(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """The newest finished version of post facts under root/v=N, as write_facts(facts, f"{root}/v={n}") makes them. A
    version that is still being written, or was lost, has no mark and is passed over."""
    number = max(folder_numbers(spark, root, "v", "_SUCCESS"), default=None)
    if number is None:
        raise ValueError(f"no version of the facts in {root}")
    return spark.read.schema(schema).parquet(f"{root}/v={number}")


def folder_numbers(spark: SparkSession, folder: str, name: str, mark: str | None = None) -> Iterator[int]:
    """N of each folder name=N in `folder`, or of those that hold a file `mark`; through the session's own file system."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    path = hadoop.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(path):
        for status in fs.listStatus(path):
            found = re.fullmatch(rf"{name}=(\d+)", status.getPath().getName())
            if found and (mark is None or fs.exists(hadoop.Path(status.getPath(), mark))):
                yield int(found.group(1))


def write_facts(facts: DataFrame, path: str) -> DataFrame:
    """The post facts written once, for streams that join them in every batch."""
    facts.write.mode("errorifexists").parquet(path)
    return facts.sparkSession.read.schema(facts.schema).parquet(path)

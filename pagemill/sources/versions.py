"""The corpus as versions over hash buckets: a refresh writes the buckets it changes, a manifest says where each one is.

root/data/v=N/bucket=B holds bucket B as version N wrote it, root/manifest/v=N one row for each bucket of version N:
the version that wrote it, or none where it is empty. A version exists once its manifest is finished, and its data is
finished before; a lost job leaves a folder that the next attempt at the same number overwrites. Old versions stay
readable as long as their folders are kept. One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import folder_numbers

CORPUS_SCHEMA = "cache_key string, page_id long, markdown string, stored_at timestamp, ttl_s int, status string, language string"
MANIFEST_SCHEMA = "bucket int, written int"
#: For a store of some 100 TB take as many as make a bucket a few hundred MB; a manifest row is all that each costs.
BUCKETS = 16


def current_version(spark: SparkSession, root: str) -> int:
    """Number of the newest finished version, 0 when there is none."""
    return max(folder_numbers(spark, f"{root}/manifest", "v", "_SUCCESS"), default=0)


def manifest(spark: SparkSession, root: str, version: int | None = None) -> dict[int, int | None]:
    """For each bucket of a version the version that wrote it; as many rows as there are buckets."""
    number = version or current_version(spark, root)
    return {r.bucket: r.written for r in spark.read.schema(MANIFEST_SCHEMA).parquet(f"{root}/manifest/v={number}").collect()}


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def read_version(spark: SparkSession, root: str, version: int | None = None, only: set[int] | None = None) -> DataFrame:
    """A version, the current one by default, or some buckets of it; without entries it reads as an empty corpus."""
    where = [f"{root}/data/v={v}/bucket={b}" for b, v in manifest(spark, root, version).items() if v and (only is None or b in only)]
    return spark.read.schema(CORPUS_SCHEMA).parquet(*where) if where else spark.createDataFrame([], CORPUS_SCHEMA)


def _write(spark: SparkSession, rows: DataFrame, root: str, touched: set[int], before: dict[int, int | None]) -> int:
    number = current_version(spark, root) + 1
    buckets = len(before)
    columns = [f.split()[0] for f in CORPUS_SCHEMA.split(", ")]
    here = rows.select(*columns, bucket_of(F.col("cache_key"), buckets).alias("bucket"))
    # one exchange by bucket; Spark splits the large ones into files of even size and puts small ones together
    here.hint("rebalance", F.col("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/data/v={number}")
    filled = set(folder_numbers(spark, f"{root}/data/v={number}", "bucket"))
    if filled - touched:
        raise ValueError("rows outside the buckets that were to be written")
    after = [(b, (number if b in filled else None) if b in touched else v) for b, v in before.items()]
    spark.createDataFrame(after, MANIFEST_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{root}/manifest/v={number}")
    return number


def write_version(spark: SparkSession, corpus: DataFrame, root: str, buckets: int | None = None) -> int:
    """Writes a whole store as the next version, in as many buckets as the store has, or `buckets` for a new one."""
    if current_version(spark, root):
        before = manifest(spark, root)
        if buckets not in (None, len(before)):
            raise ValueError(f"the store has {len(before)} buckets")
    else:
        before = dict.fromkeys(range(buckets or BUCKETS))
    return _write(spark, corpus, root, set(before), before)


def buckets_of(keys: DataFrame, buckets: int) -> set[int]:
    """The buckets that hold the keys in `keys` (cache_key)."""
    return {r.b for r in keys.select(bucket_of(F.col("cache_key"), buckets).alias("b")).distinct().collect()}


def replace_buckets(spark: SparkSession, root: str, rows: DataFrame, touched: set[int]) -> int:
    """Writes `rows` as the whole content of the buckets `touched` of the next version; the others stay where they are,
    as files that are not written again. Rows of other buckets are refused. Without a touched bucket no version is made."""
    if not touched:
        return current_version(spark, root)
    return _write(spark, rows, root, touched, manifest(spark, root))

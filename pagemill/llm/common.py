"""Helpers shared by the operators of this package."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these; the same set that bytes.split() knows as white space.
SPACES = r"[\x20\x09-\x0D]+"
#: Rows of an Arrow batch that a Python task holds at once are cut again at so many bytes of text.
BATCH_BYTES = 8 << 20


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; one of our own only where none is named."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and written to the checkpoint folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once; what a lambda takes from outside is computed for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def row_key(doc_id: Column, text: Column) -> Column:
    """Tells rows with the same doc_id apart by their text; rows equal in both are one document."""
    return F.struct(doc_id.alias("doc_id"), F.xxhash64(text).alias("text_hash"))


def parallelism(spark: SparkSession) -> int:
    """Partitions for an explicit exchange. It only says how finely work is dealt out; results don't depend on it."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pieces(batches: Iterable[pa.RecordBatch], size_of: str) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about BATCH_BYTES of the named string or binary column, one row at least."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(size_of))
        lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        begin, total = 0, 0
        for i, n in enumerate(lengths):
            if i > begin and total + n > BATCH_BYTES:
                yield batch.slice(begin, i - begin)
                begin, total = i, 0
            total += int(n)
        if begin < batch.num_rows:
            yield batch.slice(begin)


def map_batches(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(work, schema)

"""Helpers of the operators: memory of workers, folds, bounded samples, small sides of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern import shared
from lectern.shared import bound_batches, give_back, lean  # noqa: F401

#: Rows of a few numbers or words that are broadcast at most.
SMALL_ROWS = 1_000_000


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """df for a broadcast join if it has at most `rows` rows, else as it is, for a join by shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def materialize(df: DataFrame, name: str, blobs: bool = False) -> DataFrame:
    """A table written to the shared folder and read back, with Arrow batches of this session bounded beforehand."""
    bound_batches(df.sparkSession)
    return shared.materialize(df, name, blobs)


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(modulus))


def labelled_sample(labels: DataFrame, label: str, modulus: int, held: int, limit: int) -> DataFrame:
    """(doc_id, y) of at most `limit` labelled documents outside the held-out fold, chosen by a hash of the id.

    Null ids and labels are left out; of several labels of one id the largest counts. The result has at most `limit`
    rows of 16 bytes, which is what makes it safe to broadcast.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).dropna()
    rows = rows.filter(fold(F.col("doc_id"), modulus) != held).groupBy("doc_id").agg(F.max("y").alias("y"))
    return rows.orderBy(F.xxhash64(F.lit(17), "doc_id"), "doc_id").limit(limit)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def size_of(docs: DataFrame, column: str = "text") -> tuple[int, int]:
    """Rows and bytes of a text column."""
    row = docs.select(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(column)), F.lit(0)).alias("b")).first()
    return int(row["n"]), int(row["b"])


def slices(batch, column: str, limit: int):
    """Row ranges of an Arrow batch with at most `limit` bytes of text each; one longer text stands alone."""
    import numpy as np

    from lectern.llm.textcore import buffers

    n = batch.num_rows
    if not n:
        return
    _, offsets = buffers(batch.column(column))
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield batch.slice(lo, min(hi, n) - lo)
        lo = min(hi, n)

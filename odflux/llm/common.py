"""What several operators share: columns of words, tables in the shared folder, Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from odflux.session import materialize, scratch_path  # noqa: F401

#: White space of all word rules: space and \t \n \v \f \r.
WHITE = " \t\n\x0b\x0c\r"
WHITE_RUN = r"[\x20\x09-\x0D]+"
NON_WHITE = r"[^\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def count_words(text) -> F.Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(NON_WHITE + "+")), F.lit(0)).cast("long")


def row_bytes(column: pa.ChunkedArray | pa.Array) -> Iterator[memoryview]:
    """The UTF-8 bytes of each string (null: none), without making Python strings."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    for chunk in chunks:
        if pa.types.is_large_string(chunk.type) or pa.types.is_large_binary(chunk.type):
            width = np.int64
        else:
            width = np.int32
        _, offsets, data = chunk.buffers()
        if len(chunk) == 0:
            continue
        at = np.frombuffer(offsets, width)[chunk.offset : chunk.offset + len(chunk) + 1].tolist()
        whole = memoryview(data) if data is not None else memoryview(b"")
        valid = chunk.is_valid().to_pylist() if chunk.null_count else None
        for i in range(len(chunk)):
            yield whole[at[i] : at[i + 1]] if valid is None or valid[i] else whole[:0]


def binary_array(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())


def batch_of(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def with_rank(rows: DataFrame, group: list[str], order: list[str], out: str, weight: str | None = None) -> DataFrame:
    """Adds a gapless rank from 0 inside each group (or the running sum of ``weight`` before the
    row), without bringing a group to one task: rows are ranked inside slices of the group, and
    slices get offsets from their sizes. Rows that are equal in ``order`` may change places."""
    spark = rows.sparkSession
    n = partitions(spark)
    amount = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    cut = rows.withColumn("_slice", F.pmod(F.xxhash64(*order), F.lit(n)))
    sizes = cut.groupBy(*group, "_slice").agg(F.sum(amount).alias("_sum"))
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *[F.col(c).alias(f"_o_{c}") for c in group], F.col("_slice").alias("_o_slice"),
        F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"),
    )
    inside = Window.partitionBy(*group, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = cut.withColumn("_local", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    same = F.col("_slice") == F.col("_o_slice")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_o_{c}"))
    return local.join(offsets, same).withColumn(out, F.col("_local") + F.col("_offset")).drop(
        "_slice", "_local", "_offset", "_o_slice", *[f"_o_{c}" for c in group]
    )

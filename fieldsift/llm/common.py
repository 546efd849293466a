"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fieldsift.sources.tables import as_table, drop_table, shared_dir, shuffled  # noqa: F401  shared with the corridor operators


def tokenizer_path(name: str) -> str:
    """The public vocabulary file of that name; every operator takes another path as a parameter."""
    return public_tokenizers.path(name)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def blocks(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int, max_rows: int) -> Iterator[pa.Table]:
    """Regroups Arrow batches into blocks of bounded rows and text bytes (one longer text makes its own block)."""
    import pyarrow.compute as pc

    held: list[pa.RecordBatch] = []
    rows = size = 0
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = 0
        for i, n in enumerate(lengths):
            if rows and (rows >= max_rows or size + n > max_bytes):
                if i > start:
                    held.append(batch.slice(start, i - start))
                yield pa.Table.from_batches(held)
                held, rows, size, start = [], 0, 0, i
            rows, size = rows + 1, size + n
        if len(lengths) > start:
            held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def block_ids() -> Iterator[int]:
    """Ids that are unique in a job and the same when a task runs again."""
    base = TaskContext.get().partitionId() << 32
    while True:
        yield base
        base += 1


def whole_row(df: DataFrame, columns: list[str] | None = None) -> Column:
    """The named columns (all of them) as the struct "row", whatever they are called."""
    return F.struct(*(F.col("`" + c.replace("`", "``") + "`").alias(c) for c in columns or df.columns)).alias("row")


def with_fields(ddl: str, source: DataFrame, names: list[str]) -> StructType:
    """The schema of ddl and source's columns of these names, of any type."""
    out = StructType.fromDDL(ddl)
    for name in names:
        out = out.add(source.schema[name])
    return out


def texts(docs: DataFrame) -> DataFrame:
    """doc_id long and text string, null texts as empty ones."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

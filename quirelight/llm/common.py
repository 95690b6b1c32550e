"""What the operators of this package share: column helpers; staged tables from the library."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import delete, release, shared_dir, stage

__all__ = ["LOWER", "UPPER", "delete", "lower_ascii", "release", "require", "shared_dir", "slices", "stage", "table", "text_or_empty", "unless_large"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII takes the faster built-in, with the same result."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Arrow batches a few rows at a time: texts may be long, and as Python objects they take
    more room than in Arrow. Batches without rows are left out."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def unless_large(keys: DataFrame, rows: int = 1 << 19) -> DataFrame:
    """A written table of a few numbers a row, to be broadcast if it has at most so many rows
    (some 20 MB). Beyond that the join is left to the planner, which shuffles both sides."""
    return F.broadcast(keys) if keys.count() <= rows else keys


def require(df: DataFrame, *names: str) -> None:
    missing = [x for x in names if x not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")

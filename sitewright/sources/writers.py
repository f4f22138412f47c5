"""Sinks. Parquet is canonical; text forms exist for exchange."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import format_general
from ..operators.ranking import best_row


def write_delimited(df: DataFrame, path: str, *, sep: str = "\t", digits: int = 10, mode: str = "overwrite") -> None:
    """Headed text with floats in printf general form."""
    floats = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}
    rendered = df.select(*[format_general(c, digits).alias(c) if c in floats else F.col(c) for c in df.columns])
    rendered.write.mode(mode).csv(path, sep=sep, header=True)


def write_summary(df: DataFrame, path: str, *, mode: str = "overwrite") -> None:
    """Nested summary rows as JSON lines; a summary is a handful of rows, so one file holds them. They are gathered by a
    shuffle, which leaves the work before it as parallel as it was."""
    df.repartition(1).write.mode(mode).json(path)


def append_results(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def append_checkpoint(df: DataFrame, path: str, *, stamp: str = "scored_at") -> None:
    """Append with the write time; ``read_checkpoint`` resolves repeated keys."""
    df.withColumn(stamp, F.current_timestamp()).write.mode("append").parquet(path)


def keep_last(df: DataFrame, keys: Sequence[str], *, stamp: str = "scored_at", ties: Sequence[Column] = ()) -> DataFrame:
    """Newest row of each key."""
    return best_row(df, keys, [-F.unix_micros(stamp) if dict(df.dtypes)[stamp].startswith("timestamp") else -F.col(stamp), *ties])


def write_chunks(df: DataFrame, path: str, chunk: str) -> None:
    """Partitioned checkpoint: rewriting replaces only the chunks present in ``df``."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(chunk).parquet(path)


def labelled_matrix(df: DataFrame, row: str, column: str, value: str, columns: Sequence) -> DataFrame:
    """Matrix with a label column and one column per listed level; the first value of a cell is kept, cells
    without one are NULL."""
    return df.groupBy(row).pivot(column, list(columns)).agg(F.first(value))

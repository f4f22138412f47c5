"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_folder

#: Texts are worked on in slices of about so many characters, so a task's memory does not follow its Arrow batch.
SLICE_CHARS = 4_000_000


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a DataFrame once to the folder that all executors share and read it back: several users then share one
    computation, and a lost executor loses nothing."""
    spark = df.sparkSession
    folder = fresh_folder(spark, name)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def text_slices(column, limit: int = SLICE_CHARS) -> Iterator[tuple[int, int, list[str]]]:
    """The slices of an Arrow column of texts with their bounds; only one is held as Python strings at a time."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    begin, size = 0, 0
    for i, own in enumerate([*sizes, None]):
        if i > begin and (own is None or size + own > limit):
            yield begin, i, [text or "" for text in column.slice(begin, i - begin).to_pylist()]
            begin, size = i, 0
        size += own or 0


def texts_of(batch, name: str = "text") -> list[str]:
    """The texts of an Arrow batch, empty where they are null."""
    return [text or "" for text in batch.column(name).to_pylist()]


def fold(id_column: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id falls into fold 1, so it is never held out as fold 0."""
    column = F.col(id_column) if isinstance(id_column, str) else id_column
    return F.coalesce(F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(folds)), F.lit(1)).cast("int")


def keyed_rank(id_column: str, seed: int) -> Column:
    """A repeatable pseudo-random order of rows that depends on their id alone."""
    return F.xxhash64(F.lit(seed), F.col(id_column))


def text_column_udf(make, returns):
    """An Arrow column function over whole texts. ``make()`` runs once per task and gives a function from a list of
    texts to an Arrow array; texts reach it in slices. It is marked non-deterministic, so that a filter on its result
    is not evaluated a second time below it."""
    import pyarrow as pa
    from pyspark.sql.functions import arrow_udf

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        apply = make()
        for batch in batches:
            parts = [apply(texts) for _, _, texts in text_slices(batch)]
            yield pa.concat_arrays(parts) if parts else apply([])

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return arrow_udf(run, returns).asNondeterministic()


def fresh_name(df: DataFrame, name: str) -> str:
    """A column name that the DataFrame does not have (names differ by more than case)."""
    taken = {column.lower() for column in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name

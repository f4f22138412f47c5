"""Sum-of-squares online packing of token sequences into fixed windows."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import text_slices
from .tokens import encoder

PIECES = T.StructType(
    [
        T.StructField("start", T.LongType(), False),
        T.StructField("length", T.LongType(), False),
        T.StructField("ids", T.BinaryType(), False),
        T.StructField("doc_tokens", T.LongType(), False),
        T.StructField("sequence_id", T.LongType(), False),
        T.StructField("offset", T.LongType(), False),
    ]
)
#: A task numbers its sequences from its partition's number times this.
SEQUENCES_PER_TASK = 1 << 36


class LevelPacker:
    """Places pieces into open windows by the sum-of-squares rule.

    ``counts[h]`` is the number of open windows filled to level h. A piece of s tokens goes to the level h that makes
    the sum of squared counts after the placement smallest (h = 0 opens a window; a window that becomes full leaves the
    array). Ties go to the fullest level. Pieces are (document, start, ids as bytes, tokens of the document)."""

    def __init__(self, window: int, open_limit: int):
        self.window, self.open_limit = window, open_limit
        self.counts = np.zeros(window + 1, np.int64)
        self.levels: dict[int, deque] = {}
        self.open = 0

    def place(self, piece: tuple, size: int) -> list[tuple] | None:
        """Place a piece shorter than the window; gives the window's pieces if it is full now."""
        window, counts = self.window, self.counts
        before, after = counts[: window - size + 1], counts[size:]
        change = 2 * (after - before) + 2
        change[-1] -= 2 * counts[window] + 1  # a full window is not counted
        change[0] = 2 * counts[size] + 1
        allowed = before > 0
        allowed[0] = True
        levels = np.flatnonzero(allowed)
        level = int(levels[len(levels) - 1 - np.argmin(change[levels][::-1])])
        if level:
            pieces = self.levels[level].popleft()
            counts[level] -= 1
            self.open -= 1
        else:
            pieces = []
        pieces.append(piece)
        if level + size == window:
            return pieces
        counts[level + size] += 1
        self.levels.setdefault(level + size, deque()).append(pieces)
        self.open += 1
        return None

    def close(self) -> Iterator[list[tuple]]:
        """Empty the level array: pieces of the least filled windows are cut into the gaps of the fullest, until one
        window at most is left with a gap."""
        left = deque((level, pieces) for level in sorted(self.levels, reverse=True) for pieces in self.levels[level])
        self.counts[:] = 0
        self.levels, self.open = {}, 0
        while left:
            level, pieces = left.popleft()
            while level < self.window and left:
                other_level, other = left.pop()
                doc, start, ids, total = other.pop()
                size = len(ids) // 4
                take = min(size, self.window - level)
                pieces.append((doc, start + size - take, ids[4 * (size - take) :], total))
                level, other_level = level + take, other_level - take
                if take < size:
                    other.append((doc, start, ids[: 4 * (size - take)], total))
                if other:
                    left.append((other_level, other))
            yield pieces


def pack_sequences(
    docs: DataFrame,
    window: int = 2048,
    end_id: int = 1,
    vocabulary: str | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
    open_limit: int = 4096,
) -> DataFrame:
    """One row per piece of a document: the id column, ``start`` (its document's ids before it), ``length``, ``ids``
    (little-endian unsigned 32-bit), ``doc_tokens``, ``sequence_id`` and ``offset`` within the sequence.

    Each input split is packed by the task that reads it, with its own level array, so nothing is shuffled and a lost
    task is repeated alone. Whole windows of a long document are sequences of their own; its rest is placed by the
    sum-of-squares rule. When a task ends, or holds ``open_limit`` open windows, the open ones are filled from one
    another, so a task leaves one sequence with a gap (and one per ``open_limit`` windows).

    A null or empty text is its end id alone; a null id stays null; repeated rows are separate documents; an empty table
    gives no rows; further columns are not read."""

    def run(batches):
        codes, packer = encoder(vocabulary), LevelPacker(window, open_limit)
        number = TaskContext.get().partitionId() * SEQUENCES_PER_TASK
        end = np.array([end_id], "<u4").tobytes()
        rows: list[tuple] = []

        def emit(pieces):
            nonlocal number
            at = 0
            for doc, start, ids, total in pieces:
                size = len(ids) // 4
                rows.append((doc, start, size, ids, total, number, at))
                at += size
            number += 1

        def flush():
            columns = list(zip(*rows)) if rows else [[] for _ in schema]
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        schema = None
        for batch in batches:
            schema = schema or pa.schema([pa.field(id_column, batch.schema.field(0).type), *arrow_fields()])
            names = batch.column(0).to_pylist()
            for a, b, texts in text_slices(batch.column(1)):
                for doc, ids in zip(names[a:b], codes.encode(texts)):
                    ids += end
                    total = len(ids) // 4
                    whole = total - total % window
                    for start in range(0, whole, window):
                        emit([(doc, start, ids[4 * start : 4 * (start + window)], total)])
                    if whole < total:
                        full = packer.place((doc, whole, ids[4 * whole :], total), total - whole)
                        if full:
                            emit(full)
                        elif packer.open >= packer.open_limit:
                            for pieces in packer.close():
                                emit(pieces)
                yield flush()
        for pieces in packer.close():
            emit(pieces)
        if rows:
            yield flush()

    spark_schema = T.StructType([T.StructField(id_column, docs.schema[id_column].dataType), *PIECES.fields])
    return docs.select(id_column, text_column).mapInArrow(run, spark_schema)


def arrow_fields() -> list[pa.Field]:
    return [
        pa.field("start", pa.int64()),
        pa.field("length", pa.int64()),
        pa.field("ids", pa.binary()),
        pa.field("doc_tokens", pa.int64()),
        pa.field("sequence_id", pa.int64()),
        pa.field("offset", pa.int64()),
    ]


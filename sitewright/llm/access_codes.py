"""Directly addressable codes: token ids as chunk levels with continuation bitmaps and rank directories."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import fresh_folder
from .common import text_slices
from .tokens import encoder

#: Bits of a chunk, and bits of a continuation bitmap covered by one entry of its rank directory.
CHUNK_BITS = 8
RANK_BITS = 512
POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)


class Segment:
    """A run of ids: per level the chunks (one byte each), the continuation bitmap and the rank directory.

    Level 0 has a chunk for every id, its lowest eight bits. A set bit says that the id goes on in the next level, at
    the place given by the number of set bits before it; the directory holds that number for every 512th bit."""

    def __init__(self, levels: list[tuple[bytes, bytes, bytes]]):
        self.chunks = [np.frombuffer(c, np.uint8) for c, _, _ in levels]
        self.bits = [np.frombuffer(b, np.uint8) for _, b, _ in levels]
        self.ranks = [np.frombuffer(r, "<u4") for _, _, r in levels]

    @staticmethod
    def encode(ids: np.ndarray) -> list[tuple[bytes, bytes, bytes]]:
        levels, rest = [], ids.astype(np.uint32)
        while True:
            more = rest >> CHUNK_BITS
            goes_on = more > 0
            bits = np.packbits(goes_on, bitorder="little")
            blocks = np.add.reduceat(POPCOUNT[bits].astype(np.uint32), np.arange(0, len(bits), RANK_BITS // 8)) if len(bits) else []
            ranks = np.concatenate([[0], np.cumsum(blocks)[:-1]]).astype("<u4") if len(bits) else np.zeros(0, "<u4")
            levels.append(((rest & 255).astype(np.uint8).tobytes(), bits.tobytes(), ranks.tobytes()))
            if not goes_on.any():
                return levels
            rest = more[goes_on]

    def rank(self, level: int, at: np.ndarray) -> np.ndarray:
        """Set bits before each place: the directory's entry, whole bytes after it, and bits of the last byte."""
        block, byte = at // RANK_BITS, at // 8
        out = self.ranks[level][block].astype(np.int64)
        first = block * (RANK_BITS // 8)
        bits = self.bits[level]
        for k in range(RANK_BITS // 8 - 1):
            here = first + k
            inside = here < byte
            if not inside.any():
                break
            out += np.where(inside, POPCOUNT[bits[np.minimum(here, len(bits) - 1)]], 0)
        return out + POPCOUNT[bits[byte] & ((1 << (at % 8)) - 1).astype(np.uint8)]

    def access(self, places) -> np.ndarray:
        """The ids at the given places, each reached through the rank directories without decoding its neighbours."""
        at = np.asarray(places, np.int64)
        out, live = np.zeros(len(at), np.uint32), np.arange(len(at))
        for level in range(len(self.chunks)):
            out[live] |= self.chunks[level][at].astype(np.uint32) << np.uint32(CHUNK_BITS * level)
            goes_on = (self.bits[level][at // 8] >> (at % 8).astype(np.uint8)) & 1 == 1
            at, live = at[goes_on], live[goes_on]
            if not len(at):
                break
            at = self.rank(level, at)
        return out

    def decode(self) -> np.ndarray:
        """All ids in order."""
        out = np.zeros(len(self.chunks[0]), np.uint32)
        live = np.arange(len(out))
        for level, chunks in enumerate(self.chunks):
            out[live] |= chunks.astype(np.uint32) << np.uint32(CHUNK_BITS * level)
            live = live[np.unpackbits(self.bits[level], count=len(chunks), bitorder="little") == 1]
        return out


LEVEL = T.ArrayType(
    T.StructType([T.StructField(n, T.BinaryType(), False) for n in ("chunks", "continues", "ranks")]), False
)


def write_codes(
    docs: DataFrame,
    folder: str,
    end_id: int = 2,
    vocabulary: str | None = None,
    segment_tokens: int = 1 << 18,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> str:
    """Encode all documents in ascending id order and write segment files to ``folder``, through Spark's own writer, so
    any store that Spark writes to will do. A file row is a segment: ``part`` and ``segment`` (their order is the order
    of the ids), ``first`` (ids of the part before it), ``n_tokens``, ``index`` (documents in order with their number of tokens) and ``levels``.

    Rows are ranged by id before they are encoded, so equal ids (and null ids, which come first) are neighbours; a
    document never straddles segments. Null or empty text: the end id alone. Ties are ordered by text."""

    def run(batches):
        codes, part = encoder(vocabulary), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        number, first, names, sizes, held, total, kind = 0, 0, [], [], [], 0, None

        def segment():
            nonlocal number, first, names, sizes, held, total
            levels = Segment.encode(np.frombuffer(b"".join(held), "<u4"))
            index = pa.StructArray.from_arrays([pa.array(names, kind), pa.array(sizes, pa.int64())], names=["id", "n_tokens"])
            row = pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()),
                    pa.array([number], pa.int32()),
                    pa.array([first], pa.int64()),
                    pa.array([total], pa.int64()),
                    pa.ListArray.from_arrays(pa.array([0, len(index)], pa.int32()), index),
                    pa.array(
                        [[dict(zip(("chunks", "continues", "ranks"), level)) for level in levels]],
                        pa.list_(pa.struct([(n, pa.binary()) for n in ("chunks", "continues", "ranks")])),
                    ),
                ],
                names=["part", "segment", "first", "n_tokens", "index", "levels"],
            )
            number, first, names, sizes, held, total = number + 1, first + total, [], [], [], 0
            return row

        for batch in batches:
            kind = kind or batch.schema.field(0).type
            ids = batch.column(0).to_pylist()
            for a, b, texts in text_slices(batch.column(1)):
                for name, code in zip(ids[a:b], codes.encode(texts)):
                    names.append(name)
                    sizes.append(len(code) // 4 + 1)
                    held.append(code + end)
                    total += sizes[-1]
                    if total >= segment_tokens:
                        yield segment()
        if names:
            yield segment()

    index = T.ArrayType(T.StructType([T.StructField("id", docs.schema[id_column].dataType), T.StructField("n_tokens", T.LongType(), False)]), False)
    schema = T.StructType(
        [
            T.StructField("part", T.IntegerType(), False),
            T.StructField("segment", T.IntegerType(), False),
            T.StructField("first", T.LongType(), False),
            T.StructField("n_tokens", T.LongType(), False),
            T.StructField("index", index, False),
            T.StructField("levels", LEVEL, False),
        ]
    )
    ordered = docs.select(id_column, text_column).repartitionByRange(id_column).sortWithinPartitions(id_column, text_column)
    ordered.mapInArrow(run, schema).write.parquet(folder)
    return folder


def read_codes(segments: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """One row per document of written segments: its id, ``start`` (ids of all documents before it), ``n_tokens`` and
    ``ids`` (little-endian unsigned 32-bit), decoded from the levels; one place of every document is read by random access
    as well and compared."""
    kind = segments.schema["index"].dataType.elementType["id"].dataType

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                index = batch.column("index")[i].values
                segment = Segment([(x["chunks"], x["continues"], x["ranks"]) for x in batch.column("levels")[i].as_py()])
                ids, sizes = segment.decode().astype("<u4"), index.field("n_tokens").to_numpy()
                ends = np.cumsum(sizes)
                starts = ends - sizes
                # one place of every document is also reached by itself
                places = starts + (starts * 7919 + 13) % sizes
                if (segment.access(places) != ids[places]).any():
                    raise ValueError("a token reached through the rank directories differs from the decoded one")
                offsets = pa.py_buffer(np.concatenate([[0], 4 * ends]).astype(np.int32))
                columns = [
                    index.field("id"),
                    pa.array(starts + batch.column("base")[i].as_py(), pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.Array.from_buffers(pa.binary(), len(index), [None, offsets, pa.py_buffer(ids)]),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[id_column, "start", "n_tokens", "ids"])

    schema = T.StructType(
        [
            T.StructField(id_column, kind),
            T.StructField("start", T.LongType(), False),
            T.StructField("n_tokens", T.LongType(), False),
            T.StructField("ids", T.BinaryType(), False),
        ]
    )
    # what precedes a part is summed over parts, of which there are as many as shuffle partitions, so the side that is
    # broadcast does not grow with the input
    parts = segments.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    parts = parts.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))
    based = segments.join(F.broadcast(parts), "part")
    return based.select((F.col("before") + F.col("first")).alias("base"), "index", "levels").mapInArrow(run, schema)


def encode_codes(docs: DataFrame, **options) -> DataFrame:
    """Write all documents as segment files to a new folder in the shared one and read them back."""
    spark = docs.sparkSession
    folder = write_codes(docs, fresh_folder(spark, "codes"), **options)
    return read_codes(spark.read.parquet(folder), options.get("id_column", "doc_id"))



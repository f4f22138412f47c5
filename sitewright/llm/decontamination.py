"""Benchmark passages in documents, found by one Aho-Corasick automaton over normalised windows of words."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh_name, text_slices

#: ASCII signs other than digits and small letters part words; A-Z are lowered first.
WORD_BYTES = b"0123456789abcdefghijklmnopqrstuvwxyz"
#: A byte table that lowers A-Z and turns every separating sign into a blank; bytes of other characters stay.
NORMAL = bytes(
    code + 32 if 65 <= code <= 90 else code if code > 127 or code in WORD_BYTES else 32 for code in range(256)
)
#: Bytes of items that one automaton is built over (about 80 times that in a worker); more are dealt to further automata.
SHARD_BYTES = 4_000_000


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(NORMAL).split()


def windows_of(words: list[bytes], width: int) -> list[list[bytes]]:
    """All runs of ``width`` words, or one shorter run of all of them; none without words."""
    return [words[a : a + width] for a in range(max(1, len(words) - width + 1))] if words else []


class Matcher:
    """The automaton over a shard of items, and their windows.

    Its patterns are every second half window of an item (words between blanks, in UTF-8 bytes shown as Latin-1
    characters), so its size follows the items' text, not ten times that: a window holds at least one such half whole, and
    where one occurs the windows around it are looked up. Items of one short window are patterns as a whole."""

    def __init__(self, items: list[tuple[str | None, str]], width: int):
        import ahocorasick

        self.width, self.half, self.halves = width, max(1, width // 2), False
        owners: dict[bytes, set[str]] = {}
        patterns: dict[bytes, tuple[int, bool]] = {}
        for item, text in items:
            words = words_of(text)
            for window in windows_of(words, width):
                named = owners.setdefault(b" ".join(window), set())
                if item is not None:
                    named.add(item)
            if 0 < len(words) < width:
                patterns[b" ".join(words)] = (len(words), True)  # as a half window of another item it is found as well
            for a in range(0, len(words) - self.half + 1 if len(words) >= width else 0, self.half):
                block = b" ".join(words[a : a + self.half])
                patterns.setdefault(block, (self.half, False))
                self.halves = True
        self.windows = {window: tuple(named) for window, named in owners.items()}
        self.automaton = ahocorasick.Automaton()
        for pattern, (size, whole) in patterns.items():
            self.automaton.add_word(f" {pattern.decode('latin-1')} ", (size, whole))
        self.automaton.make_automaton()
        self.empty = not patterns

    def scan(self, words: list[bytes], line: str) -> list[tuple[int, int, tuple[str, ...]]]:
        """Occurrences of windows in a normalised text: first word, number of words and the items."""
        found = [] if self.empty else list(self.automaton.iter(line))
        if not found:
            return []
        blanks = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
        stops = np.searchsorted(blanks, [end for end, _ in found]).tolist()
        places = set()
        for stop, (_, (size, whole)) in zip(stops, found):
            at = stop - size
            if whole:
                places.add((at, size))
            if self.halves and size == self.half:
                places.update((a, self.width) for a in range(max(0, at - self.half + 1), at + 1))
        known = ((a, n, self.windows.get(b" ".join(words[a : a + n]))) for a, n in sorted(places) if a + n <= len(words))
        return [(a, n, items) for a, n, items in known if items is not None]


#: The automaton that this worker process built last, under the token of its shard.
_LAST: dict[str, Matcher] = {}


def matcher_of(shard: Broadcast) -> Matcher:
    token, items, width = shard.value
    if token not in _LAST:
        _LAST.clear()
        _LAST[token] = Matcher(items, width)
    return _LAST[token]


def item_shards(items: DataFrame, width: int, id_column: str, text_column: str, shard_bytes: int) -> list[Broadcast]:
    """The items in broadcasts of about ``shard_bytes`` bytes of text each."""
    spark = items.sparkSession
    rows = items.select(F.col(id_column).cast("string").alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text")).distinct()
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    held = []
    for k in range(shards):
        part = rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(shards)) == k).collect()
        held.append(spark.sparkContext.broadcast((uuid.uuid4().hex, [(r.id, r.text) for r in part], width)))
    return held


def find_contamination(
    docs: DataFrame,
    items: DataFrame,
    width: int = 10,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_id_column: str = "item_id",
    item_text_column: str = "text",
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """One row per row of ``docs``: the id, ``n_words``, ``n_hit`` (words inside an occurrence of an item's window of
    ``width`` words), ``items`` (ids, as strings in ascending order, of the items whose windows occur), ``spans``
    (maximal runs of hit words as code-point offsets ``start`` and ``end`` of the original text, end exclusive) and
    ``contaminated``.

    Words are lower-cased (A-Z) runs of characters other than ASCII signs. Items of fewer than ``width`` words are one
    window; items without words match nothing. Items reach the workers by broadcast: one automaton up to ``shard_bytes``
    bytes of items; larger sets are dealt over several, of which a task holds one at a time, and the hits of all are
    joined. Texts are only scanned: nothing is shuffled, and memory follows one slice of texts.

    Null or empty texts have no words and no hits. Repeated rows give a row each; items that repeat an id or a text count
    once, and items without an id hit words but are not listed. An empty table gives no rows, without items nothing is
    hit. Other columns are not read, whatever their names."""
    held = item_shards(items, width, item_id_column, item_text_column, shard_bytes)
    id_type = docs.schema[id_column].dataType
    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    fields = [
        ("id", id_type),
        ("n_words", T.LongType()),
        ("n_hit", T.LongType()),
        ("items", T.ArrayType(T.StringType())),
        ("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
        ("contaminated", T.BooleanType()),
    ]
    schema = T.StructType([T.StructField(*f) for f in fields])

    def run(batches):
        kinds = None
        for batch in batches:
            for a, b, texts in text_slices(batch.column("text")):
                rows = scan_texts(texts, held)
                if kinds is None:
                    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                    kinds = [pa.int64(), pa.int64(), pa.list_(pa.string()), spans, pa.bool_()]
                columns = [pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), *columns], names=schema.names)

    found = source.mapInArrow(run, schema)
    taken = fresh_name(found.drop("id"), id_column)  # an id column may be called like one of the results
    return found.withColumnRenamed("id", taken)


def scan_texts(texts: list[str], held: list[Broadcast]) -> list[tuple]:
    """Per text its ``n_words``, ``n_hit``, ``items``, ``spans`` and ``contaminated``."""
    hits: list[list] = [[] for _ in texts]
    counts = []
    for shard in held:
        matcher = matcher_of(shard)
        counts = []
        for text, own in zip(texts, hits):
            words = words_of(text)
            counts.append(len(words))
            if words:
                own += matcher.scan(words, (b" %s " % b" ".join(words)).decode("latin-1"))
    return [_row(*row) for row in zip(texts, counts, hits)]


def _row(text: str, n_words: int, found: list[tuple[int, int, tuple[str, ...]]]) -> tuple:
    if not found:
        return n_words, 0, [], [], False
    edges = np.zeros(n_words + 1, np.int64)
    for a, n, _ in found:
        edges[a] += 1
        edges[a + n] -= 1
    hit = np.cumsum(edges[:-1]) > 0
    starts, stops = word_offsets(text)
    turns = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    spans = [{"start": int(starts[a]), "end": int(stops[b - 1])} for a, b in zip(turns[::2], turns[1::2])]
    return n_words, int(hit.sum()), sorted({item for _, _, items in found for item in items}), spans, True


def word_offsets(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code-point offsets at which the words of the original text start and end."""
    data = np.frombuffer(text.encode("utf-8", "replace").translate(NORMAL), np.uint8)
    inside = np.concatenate([[False], data != 32, [False]]).astype(np.int8)
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # code points that begin before a byte
    change = np.diff(inside)
    return points[np.flatnonzero(change == 1)], points[np.flatnonzero(change == -1)]

"""Phrase collocations: frequent n-grams by mergeable Misra-Gries summaries, counted exactly in a second pass."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chosen_path import GOLDEN, mixed
from .common import staged

#: Signs that end a piece, and blanks that part words within one.
PIECE_ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
KIND = np.array([2 if c in PIECE_ENDS else 1 if c in BLANKS else 0 for c in range(256)], np.uint8)
#: Bytes of texts that are parted at once, and distinct n-grams that a task holds before it hands them on.
SLICE_BYTES, HELD = 500_000, 1_000_000
#: Odd bases of the two word hashes, with their inverses modulo 2^64.
BASES = tuple((np.uint64(b), np.uint64(pow(b, -1, 2**64))) for b in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Words:
    """The words of a run of texts: their bytes parted by single blanks, where each starts, its piece and its group."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, groups: np.ndarray):
        """``data`` holds texts that each end in a piece's end; ``bounds`` are their ends, ``groups`` their group codes."""
        kind = KIND[data]
        inside = kind == 0
        change = np.flatnonzero(np.diff(np.concatenate([[False], inside]).view(np.int8)))
        begins, ends = change[::2], change[1::2]
        keep = inside.copy()
        keep[1:] |= inside[:-1]
        self.bytes = np.where(inside, LOWER[data], np.uint8(32))[keep]
        self.sizes = ends - begins
        self.starts = np.cumsum(self.sizes + 1) - self.sizes - 1
        self.pieces = np.searchsorted(np.flatnonzero(kind == 2), begins)
        self.texts = np.searchsorted(bounds, begins, side="right")
        self.groups = groups[self.texts]

    def hashes(self, which: int) -> np.ndarray:
        """A 64-bit hash of each word, from sums over prefixes of all bytes."""
        base, inverse = BASES[which]
        sums = np.zeros(len(self.bytes) + 1, np.uint64)
        np.cumsum((self.bytes + np.uint64(1)) * powers(base, len(self.bytes)), out=sums[1:])
        own = sums[self.starts + self.sizes] - sums[self.starts]
        return mixed(own * powers(inverse, len(self.bytes) + 1)[self.starts] + self.sizes.astype(np.uint64))

    def grams(self, size: int) -> np.ndarray:
        """Places of the words at which an n-gram of this size begins within a piece."""
        n = len(self.starts) - size + 1
        return np.flatnonzero(self.pieces[:n] == self.pieces[size - 1 :]) if n > 0 else np.zeros(0, np.int64)

    def codes(self, hashes: np.ndarray, size: int, places: np.ndarray) -> np.ndarray:
        factors = mixed(np.arange(1, size + 1, dtype=np.uint64) * GOLDEN + np.uint64(size)) | np.uint64(1)
        total = self.groups[places].copy()
        for k in range(size):
            total += hashes[places + k] * factors[k]
        return mixed(total)

    def phrases(self, places: np.ndarray, size: int) -> pa.Array:
        """The n-grams at these places as strings, their words parted by single blanks."""
        begins = self.starts[places]
        lengths = self.starts[places + size - 1] + self.sizes[places + size - 1] - begins
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        taken = self.bytes[np.arange(offsets[-1]) + np.repeat(begins - offsets[:-1], lengths)]
        return pa.StringArray.from_buffers(len(places), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(taken))


def words_of(batch: pa.RecordBatch) -> Iterator[tuple[Words, list]]:
    """The words of a batch of (group, text) in runs of texts, with the groups' names by text."""
    wide = pa.large_string()
    groups, texts = batch.column("group"), pc.fill_null(batch.column("text"), "")
    named = groups.dictionary_encode()
    names = named.dictionary.to_pylist()
    seeds = np.array([hash_of(name) for name in names], np.uint64)
    owner = named.indices.to_numpy()
    sizes = pc.binary_length(texts).to_numpy().astype(np.int64) + 1
    run, a = np.cumsum(sizes), 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(run, run[a] - sizes[a] + SLICE_BYTES, side="right")))
        # every text ends a piece
        ended = pc.binary_join_element_wise(texts.slice(a, b - a).cast(wide), pa.scalar("", wide), pa.scalar("\n", wide))
        data = np.frombuffer(ended.buffers()[2], np.uint8)[: run[b - 1] - run[a] + sizes[a]]
        words = Words(data, np.cumsum(sizes[a:b]), seeds[owner[a:b]])
        if len(words.starts):
            yield words, [names[k] for k in owner[a:b]]
        a = b


def hash_of(name: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(name)


def cells_of(codes: np.ndarray, parts: int) -> np.ndarray:
    """The hash partition of each code in the upper 32 bits, the code within it in the lower ones."""
    high, low = codes >> np.uint64(32), codes & np.uint64(0xFFFFFFFF)
    return ((high * np.uint64(parts)) >> np.uint64(32)) << np.uint64(32) | low


def summed(cells: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(cells, kind="stable")
    cells = cells[order]
    firsts = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]])) if len(cells) else np.zeros(0, np.int64)
    return cells[firsts], np.add.reduceat(counts[order], firsts) if len(cells) else counts


class MisraGries:
    """A mergeable summary of at most ``capacity`` counters. ``lost`` is what any true count may exceed its counter by;
    lost * (capacity + 1) never exceeds the mass that was added."""

    def __init__(self, capacity: int):
        self.capacity, self.lost = capacity, 0
        self.codes, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def merge(self, codes: np.ndarray, counts: np.ndarray) -> None:
        self.codes, self.counts = summed(np.concatenate([self.codes, codes]), np.concatenate([self.counts, counts]))
        if len(self.codes) > self.capacity:
            least = int(np.partition(self.counts, -self.capacity - 1)[-self.capacity - 1])
            kept = self.counts > least
            self.codes, self.counts, self.lost = self.codes[kept], self.counts[kept] - least, self.lost + least

    def survivors(self, threshold: int) -> np.ndarray:
        return self.codes[self.counts + self.lost >= threshold]


def frequent_filter(source: DataFrame, max_words: int, threshold: int, counters: int, filter_bits: int):
    """A broadcast bit table in which every n-gram with ``threshold`` occurrences or more in its group has its bit set,
    and the number of hash partitions that its places go by.

    Tasks add up the n-grams of their texts and hand on, for each hash partition, a summary. The summaries of a partition
    are merged into one of a capacity above mass / threshold, so what it loses stays below the threshold and all frequent
    n-grams survive. The number of partitions follows the bytes of text, so a partition has about ``counters`` counters
    at any size of input. The table has up to ``filter_bits`` bits; a fuller one lets more n-grams through to the exact
    count, which drops them."""
    spark = source.sparkSession
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # a byte of text starts at most half a word, and a word at most ``max_words`` n-grams
    parts = max(1, -(-size * max_words // (2 * threshold * counters)))

    def collect(batches):
        held, entries = [], 0
        for batch in batches:
            for words, _ in words_of(batch):
                hashes = words.hashes(0)
                cells = [cells_of(words.codes(hashes, m, words.grams(m)), parts) for m in range(1, max_words + 1)]
                held.append(np.unique(np.concatenate(cells), return_counts=True))
                entries += len(held[-1][0])
                if entries > HELD:
                    held = [summed(*(np.concatenate(x) for x in zip(*held)))]
                    entries = len(held[0][0])
                    if entries > HELD // 2:
                        yield handed_on(*held[0])
                        held, entries = [], 0
        if held:
            yield handed_on(*summed(*(np.concatenate(x) for x in zip(*held))))

    local = source.mapInArrow(collect, "part int, mass long, codes binary, counts binary")
    by_part = Window.partitionBy("part")
    # the mass of a partition is known before its first summary is merged
    whole = local.withColumn("whole", F.sum("mass").over(by_part))

    def merge(batches):
        current, summary = None, None
        for batch in batches:
            for part, codes, counts, mass in zip(*(batch.column(c).to_pylist() for c in ("part", "codes", "counts", "whole"))):
                if part != current:
                    if summary is not None:
                        yield kept(current, summary)
                    current, summary = part, MisraGries(mass // threshold + 1)
                summary.merge(np.frombuffer(codes, np.uint32).astype(np.uint64), np.frombuffer(counts, np.uint32).astype(np.int64))
        if summary is not None:
            yield kept(current, summary)

    def kept(part, summary):
        codes = summary.survivors(threshold)
        fields = [pa.array([part], pa.int32()), pa.array([len(codes)], pa.int64()), pa.array([codes.astype(np.uint32).tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(fields, names=["part", "n", "codes"])

    survivors = staged(whole.mapInArrow(merge, "part int, n long, codes binary"), "survivors")
    n = survivors.agg(F.sum("n")).first()[0] or 0
    bits = min(filter_bits, max(64, 16 * n))
    each = max(1, bits // (8 * parts))  # bytes of a partition

    def table(batches):
        for batch in batches:
            rows = []
            for codes in batch.column("codes").to_pylist():
                at = np.frombuffer(codes, np.uint32).astype(np.uint64) * np.uint64(8 * each) >> np.uint64(32)
                own = np.zeros(8 * each, np.uint8)
                own[at] = 1
                rows.append(np.packbits(own, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("part"), pa.array(rows, pa.binary())], names=["part", "bits"])

    whole_table = bytearray(parts * each)  # at most filter_bits / 8 bytes, or one byte a partition
    for row in survivors.select("part", "codes").mapInArrow(table, "part int, bits binary").toLocalIterator():
        whole_table[row.part * each : (row.part + 1) * each] = row.bits
    return spark.sparkContext.broadcast(bytes(whole_table)), parts


def handed_on(cells: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """The summaries of a task, a row for each hash partition; their codes are sorted."""
    owner = (cells >> np.uint64(32)).astype(np.int64)
    firsts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    masses = np.add.reduceat(counts, firsts)
    # a larger count is as good as this one: it is frequent
    codes, counts = (cells & np.uint64(0xFFFFFFFF)).astype(np.uint32), np.minimum(counts, 2**31).astype(np.uint32)
    ends = [*firsts[1:].tolist(), len(cells)]
    cut = [(codes[a:b].tobytes(), counts[a:b].tobytes()) for a, b in zip(firsts.tolist(), ends)]
    columns = [pa.array(owner[firsts], pa.int32()), pa.array(masses, pa.int64()), *(pa.array(list(x), pa.binary()) for x in zip(*cut))]
    return pa.RecordBatch.from_arrays(columns, names=["part", "mass", "codes", "counts"])


def exact_counts(source: DataFrame, max_words: int, threshold: int, table, parts: int) -> DataFrame:
    """``group``, ``phrase``, ``size`` and ``f`` of every n-gram with ``threshold`` occurrences or more, and a row of
    size 0 for each group with the number of its words."""

    def count(batches):
        bits = np.frombuffer(table.value, np.uint8)
        each = np.uint64(8 * len(bits) // parts)
        for batch in batches:
            for words, names in words_of(batch):
                hashes, others = words.hashes(0), None
                texts, n = np.unique(words.texts, return_counts=True)
                yield counted([names[t] for t in texts], pa.nulls(len(texts), pa.string()), 0, n)
                for m in range(1, max_words + 1):
                    places = words.grams(m)
                    codes = words.codes(hashes, m, places)
                    cells = cells_of(codes, parts)
                    at = (cells >> np.uint64(32)) * each + ((cells & np.uint64(0xFFFFFFFF)) * each >> np.uint64(32))
                    found = np.flatnonzero(bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1)
                    if not len(found):
                        continue
                    places, codes = places[found], codes[found]
                    others = words.hashes(1) if others is None else others
                    firsts, n = told_apart(codes, words.codes(others, m, places))
                    own = places[firsts]
                    yield counted([names[t] for t in words.texts[own]], words.phrases(own, m), m, n)

    rows = source.mapInArrow(count, "group string, phrase string, size int, n long")
    return rows.groupBy("group", "phrase", "size").agg(F.sum("n").alias("f")).filter((F.col("size") == 0) | (F.col("f") >= threshold))


def told_apart(codes: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of one n-gram of each kind, and how many there are; kinds differ in one of two 64-bit hashes."""
    order = np.argsort(codes, kind="stable")
    same = codes[order][1:] == codes[order][:-1]
    if np.any(same & (others[order][1:] != others[order][:-1])):
        order = np.lexsort((others, codes))
        same = (codes[order][1:] == codes[order][:-1]) & (others[order][1:] == others[order][:-1])
    firsts = np.flatnonzero(np.concatenate([[True], ~same]))
    return order[firsts], np.diff(np.concatenate([firsts, [len(codes)]]))


def counted(groups: list, phrases: pa.Array, size: int, n: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(groups, pa.string()), phrases, pa.array(np.full(len(groups), size), pa.int32()), pa.array(n, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["group", "phrase", "size", "n"])


def collocations(
    docs: DataFrame,
    max_words: int = 3,
    threshold: int = 10,
    top: int = 2000,
    share: int = 50,
    missing: str = "und",
    group_column: str = "lang",
    text_column: str = "text",
    counters: int = 1_000_000,
    filter_bits: int = 2**29,
) -> DataFrame:
    """The ``top`` collocations of each group: the group, ``rank`` (from 1), ``phrase``, ``a`` (occurrences), ``l`` and
    ``r`` (those of the two parts at the weakest cut), ``n`` (words of the group) and ``score``, that is
    floor(1000000 a a / (l r)) at the cut where it is lowest, ties to the first.

    Texts are lower-cased (A-Z) and parted into pieces at punctuation and line ends, pieces into words at blanks and tabs.
    Phrases of 2 to ``max_words`` words with ``threshold`` occurrences or more are candidates; one whose words lie
    within a longer candidate goes if the longer one has ``share`` percent of its occurrences or more. Order: score and
    ``a`` descending, then the phrase's bytes.

    Counts are exact: the summaries only tell which n-grams the second pass need not count. Parts that begin or end a
    ten-thousandth of all phrases are looked up by broadcast (there are at most that many), so no task gets them all.

    Null groups are ``missing``, together with groups of that name; null or empty texts have no words; repeated rows
    count again. An empty table, or one without candidates, gives no rows. Other columns are not read."""
    source = docs.select(F.coalesce(F.col(group_column).cast("string"), F.lit(missing)).alias("group"), F.col(text_column).alias("text"))
    table, parts = frequent_filter(source, max_words, threshold, counters, filter_bits)
    counts = staged(exact_counts(source, max_words, threshold, table, parts), "phrases")
    totals = counts.filter("size = 0").select("group", F.col("f").alias("n"))
    frequent = counts.filter("size > 0").drop("n")
    phrases = frequent.filter("size > 1").withColumn("words", F.split("phrase", " ", -1))

    cuts = phrases.select("group", "phrase", F.col("f").alias("a"), "words", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.withColumns({"left": _joined("words", F.lit(1), F.col("k")), "right": _joined("words", F.col("k") + 1, F.size("words") - F.col("k"))})
    mass = totals.agg(F.sum("n")).first()[0] or 0
    known = frequent.filter(F.col("size") < max_words).select("group", "phrase", "f")
    cuts = _with_count(_with_count(cuts.drop("words"), known, mass, "left", "l"), known, mass, "right", "r")
    whole = T.DecimalType(38, 0)
    a, l, r = (F.col(c).cast(T.DecimalType(19, 0)).cast(whole) for c in ("a", "l", "r"))
    cuts = cuts.withColumn("score", F.call_function("div", a * a * F.lit(1_000_000).cast(whole), l * r).cast("long"))
    scored = cuts.groupBy("group", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("low"))

    longer = phrases.filter("size > 2").select(
        "group", F.col("f").alias("longer"), "words", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("m")
    )
    longer = longer.withColumn("at", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("m") + 1)))
    inside = longer.groupBy("group", _joined("words", F.col("at"), F.col("m")).alias("phrase")).agg(F.max("longer").alias("longer"))
    kept = scored.join(inside, ["group", "phrase"], "left").filter(
        F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * share)
    )
    order = Window.partitionBy("group").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    kept = kept.select("group", "phrase", "a", "low.l", "low.r", "low.score").withColumn("rank", F.row_number().over(order).cast("long"))
    best = kept.filter(F.col("rank") <= top).join(totals, "group")
    return best.select(F.col("group").alias(group_column), "rank", "phrase", "a", "l", "r", "n", "score")


def _joined(words: str, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def _with_count(rows: DataFrame, known: DataFrame, mass: int, key: str, name: str) -> DataFrame:
    """``rows`` with the count of the phrase in ``key``. Phrases with a ten-thousandth of all occurrences of their size,
    which are ten thousand a size at most, come by broadcast; the others meet in a join that none of them can dominate."""
    common = F.broadcast(known.filter(F.col("f") * 10_000 >= mass).withColumnsRenamed({"phrase": key, "f": "_common"}))
    rare = known.filter(F.col("f") * 10_000 < mass).withColumnsRenamed({"phrase": "_key", "f": "_rare"})
    rows = rows.join(common, ["group", key], "left")
    # what is found goes by its own phrase, which is no key: two blanks never meet in one
    rows = rows.withColumn("_key", F.when(F.col("_common").isNull(), F.col(key)).otherwise(F.concat(F.lit("  "), F.col("phrase"))))
    return rows.join(rare, ["group", "_key"], "left").withColumn(name, F.coalesce("_common", "_rare")).drop("_key", "_common", "_rare")

"""Position weight matrices: from counts to log odds, scanning both strands, disruption by edits, families."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StructField, StructType

from ..functions.expressions import col
from ..functions.intervals import overlap_fraction
from ..functions.sequences import reverse_complement
from .intervals import overlap_join
from .ranking import best_row

# Matrix-name prefixes and the family each one stands for, first match wins.
FAMILY_PREFIXES = (
    ("C/EBP/bZIP", "CEBP"),
    ("AP-1/bZIP", "JUN FOS ATF CREB MAF BACH NFE2 BATF HLF DBP TEF NFIL3"),
    ("FOX/forkhead", "FOX"),
    ("HNF4/nuclear receptor", "HNF4"),
    ("nuclear receptor", "NR1 NR2 NR3 RXR PPAR RARA RARB RARG"),
    ("homeobox", "MEIS HOX BARHL BARX LHX OTX VAX BSX PAX NANOG EMX NKX RAX GSX RHOXF HMX DLX MSX PITX PRRX PROP PHOX SIX"),
    ("bHLH", "ARNT HIF MXI MAX CLOCK TFAP4 TFE USF MYC MLX NPAS MNT"),
    ("KLF/SP", "KLF SP"),
    ("ETS", "ETS ELF ELK ERG FLI GABP SPI"),
    ("GATA", "GATA"),
    ("RFX", "RFX"),
    ("zinc finger", "ZNF ZKSCAN ZBTB PATZ HIC BNC"),
    ("NFI", "NFIA NFIB NFIC NFIX"),
    ("T-box", "TBX"),
    ("RUNX", "RUNX"),
    ("SOX/HMG", "SOX SRY TCF7 LEF1"),
    ("SMAD", "SMAD"),
)

def classify_by_prefix(name: str | Column, rules: Sequence[tuple[str, str]] = FAMILY_PREFIXES) -> Column:
    """Class of the first rule with a matching prefix (case ignored), else the name itself."""
    upper = F.upper(col(name))
    result = col(name)
    for family, prefixes in reversed(list(rules)):
        result = F.when(upper.rlike("^(" + "|".join(prefixes.split()) + ")"), F.lit(family)).otherwise(result)
    return result


def log_odds(counts: DataFrame, *, matrix: str, offset: str, base: str, count: str, pseudocount: float = 0.5) -> DataFrame:
    """Long (matrix, offset, base, log_odds) table against a uniform background from a long count table."""
    padded = counts.select(matrix, offset, base, (F.col(count).cast("double") + pseudocount).alias("_c"))
    totals = padded.groupBy(matrix, offset).agg(F.sum("_c").alias("_t"))
    return padded.join(totals, [matrix, offset]).select(
        matrix, offset, base, F.log2(F.col("_c") / F.col("_t") / 0.25).alias("log_odds")
    )


def pack_matrices(weights: DataFrame, *, matrix: str, offset: str, base: str) -> DataFrame:
    """One row per matrix: weights in (offset, base) order, its length and its lowest and highest score."""
    extremes = weights.groupBy(matrix, offset).agg(F.min("log_odds").alias("_lo"), F.max("log_odds").alias("_hi"))
    score_range = extremes.groupBy(matrix).agg(F.sum("_lo").alias("lowest"), F.sum("_hi").alias("highest"))
    # a matrix has 4 x length entries
    packed = weights.groupBy(matrix).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(offset, base, "log_odds"))), lambda x: x["log_odds"]).alias("weights")
    )
    return packed.join(score_range, matrix).withColumn("length", (F.size("weights") / 4).cast("int"))


LETTER_CODES = np.full(256, 4, dtype=np.int64)
LETTER_CODES[np.frombuffer(b"ACGT", dtype=np.uint8)] = np.arange(4)
PAIRED = np.array([3, 2, 1, 0, 4])
#: So many bases are scanned at a time: the arrays over them take some 20 MB.
SCANNED_BASES = 1 << 18


def _encoded(sequences: list[str], gap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Base codes of all sequences in a row with ``gap`` foreign codes after each; every place's sequence and offset."""
    sizes = np.array([len(s) + gap for s in sequences])
    joined = "".join(s + "." * gap for s in sequences)
    codes = LETTER_CODES[np.frombuffer(joined.encode("latin-1", "replace"), dtype=np.uint8)]
    row = np.repeat(np.arange(len(sequences)), sizes)
    return codes, row, np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _scan(codes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and reverse score of one matrix at every place of the encoded sequences."""
    length = len(weights) // 4
    n = max(len(codes) - length + 1, 0)
    table = np.column_stack([np.asarray(weights, dtype=float).reshape(length, 4), np.full(length, -np.inf)])
    paired = PAIRED[codes]
    forward, reverse = np.zeros(n), np.zeros(n)
    for k in range(length):
        # both strands add matrix positions in the same order, so a palindrome ties exactly
        forward += table[k][codes[k : k + n]]
        reverse += table[k][paired[length - 1 - k : length - 1 - k + n]]
    return forward, reverse


def scan_matrices(
    tiles: DataFrame,
    matrices: DataFrame,
    *,
    sequence: str,
    tile: int,
    tile_start: str = "tile_start",
    min_fraction: float | None = None,
    libraries: int = 1,
) -> DataFrame:
    """Best strand ('+' on ties) and score of every matrix at every offset of tiled sequences.

    Tiles carry a halo of at least the longest matrix minus one; each start belongs to one tile. The matrices are packed
    into ``libraries`` rows (by a hash) that meet every tile, so a tile is sent and encoded once per library and
    all matrices of it run over the tiles of a batch together; choose more libraries when one outweighs a tile.
    With ``min_fraction`` offsets below that share of the matrix's score range are dropped inside the scan."""
    span = F.greatest(F.col("highest") - F.col("lowest"), F.lit(1e-9))
    floor = F.lit(float("-inf")) if min_fraction is None else F.col("lowest") + F.lit(min_fraction) * span - F.lit(1e-9)
    described = [c for c in matrices.columns if c != "weights"]
    entry = F.struct(*described, F.col("weights").alias("_w"), floor.alias("_f"))
    part = F.pmod(F.xxhash64(*described), F.lit(libraries))
    library = matrices.groupBy(part.alias("_part")).agg(F.collect_list(entry).alias("_library"))
    # at most ``libraries`` rows on this side
    ready = tiles.withColumnRenamed(sequence, "_s").join(F.broadcast(library), F.lit(True))
    kept = [c for c in tiles.columns if c != sequence]
    keep = [*kept, *described]
    found = [StructField("_o", IntegerType()), StructField("_p", BooleanType()), StructField("score", DoubleType())]
    schema = StructType([*(tiles.schema[c] for c in kept), *(matrices.schema[c] for c in described), *found])

    arrow = to_arrow_schema(schema)
    types = [f.type for f in arrow]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, lengths = batch.column("_part").to_numpy(), pc.coalesce(pc.utf8_length(batch.column("_s")), 0).to_numpy()
            for p in np.unique(parts):
                places = np.flatnonzero(parts == p)
                entries = batch.column("_library")[int(places[0])].as_py()
                gap = max(len(e["_w"]) for e in entries) // 4
                # a bounded number of bases at a time, however many tiles a batch has
                shares = (np.cumsum(lengths[places] + gap) - 1) // SCANNED_BASES
                for own in np.split(places, np.flatnonzero(np.diff(shares)) + 1):
                    sequences = [s or "" for s in batch.column("_s").take(pa.array(own)).to_pylist()]
                    codes, row, offset = _encoded(sequences, gap)
                    room = np.array([len(s) for s in sequences])[row] - offset
                    for e in entries:
                        forward, reverse = _scan(codes, e["_w"])
                        n, length = len(forward), len(e["_w"]) // 4
                        best = np.maximum(forward, reverse)
                        hit = np.flatnonzero((best >= e["_f"]) & (offset[:n] < tile) & (room[:n] >= length))
                        taken = pa.array(own[row[hit]])
                        values = [batch.column(c).take(taken) for c in kept]
                        values += [pa.array([e[c]] * len(hit), t) for c, t in zip(described, types[len(kept) :])]
                        values += [pa.array(offset[hit].astype("int32")), pa.array(forward[hit] >= reverse[hit]), pa.array(best[hit])]
                        yield pa.RecordBatch.from_arrays(values, schema=arrow)

    out = ready.select(*kept, "_s", "_part", "_library").mapInArrow(scan, schema).select(
        *keep,
        (F.col(tile_start) + F.col("_o")).alias("start"),
        F.when(F.col("_p"), "+").otherwise("-").alias("strand"),
        "score",
        ((F.col("score") - F.col("lowest")) / span).alias("score_fraction"),
    ).drop(tile_start)
    if min_fraction is not None:
        out = out.where(F.col("score_fraction") >= min_fraction)
    return out.withColumn("end", F.col("start") + F.col("length") - 1)


def score_oriented(df: DataFrame, weights: DataFrame, keys: Sequence[str], *, matrix: str, offset: str, base: str, motif: str, name: str) -> DataFrame:
    """Score of one oriented motif string per row, NULL without letters. A motif with a non-canonical base scores
    -infinity. Rows stay where they are: each looks its letters up in its matrix, and the matrices are broadcast."""
    place = F.concat_ws(":", F.col(offset).cast("int"), F.col(base))
    packed = weights.groupBy(matrix).agg(F.map_from_entries(F.collect_list(F.struct(place, F.col("log_odds").cast("double")))).alias("_w"))
    letters = F.filter(F.split(F.col(motif), ""), lambda c: c != "")
    found = F.transform(letters, lambda c, i: F.coalesce(F.col("_w")[F.concat_ws(":", i, c)], F.lit(float("-inf"))))
    total = F.aggregate(found, F.lit(0.0), lambda a, x: a + x)
    scored = df.join(F.broadcast(packed), matrix, "left").withColumn(name, F.when(F.length(motif) > 0, total))
    return scored.select(*df.columns, name)


def motif_disruption(
    hits: DataFrame,
    windows: DataFrame,
    weights: DataFrame,
    by: Sequence[str],
    *,
    matrix: str,
    offset: str,
    base: str,
    family: str,
    native: str,
    edited: str,
    origin: str | Column,
    min_fraction: float,
    bin_width: int,
) -> DataFrame:
    """Product of native score fraction, fraction lost by the edits and overlap fraction, for every hit that
    touches a window. ``hits`` carry the native and edited sequences starting at ``origin``; they and the windows meet in
    bins of ``bin_width``, which should be about as long as they are."""
    by = list(by)
    o = origin if isinstance(origin, Column) else F.col(origin)
    piece = F.substring(F.col(edited), (F.col("start") - o + 1).cast("int"), F.col("length"))
    oriented = F.when(F.col("strand") == "-", reverse_complement(piece)).otherwise(piece)
    # a hit takes its own bases along, not the sequences
    keyed = hits.withColumn("_edited", oriented).drop(native, edited)
    near = overlap_join(
        keyed, windows, by, start="start", end="end", other_start="window_start", other_end="window_end", bin_width=bin_width, levels=0
    )
    keys = [*by, "window", "start", "strand"]
    scored = score_oriented(near, weights, keys, matrix=matrix, offset=offset, base=base, motif="_edited", name="_edited_score")
    span = F.greatest(F.col("highest") - F.col("lowest"), F.lit(1e-9))
    lost = F.greatest(F.lit(0.0), F.col("score_fraction") - (F.col("_edited_score") - F.col("lowest")) / span)
    share = overlap_fraction("start", "end", "window_start", "window_end")
    return (
        scored.where(F.col("score_fraction") >= min_fraction)
        .withColumn("score_loss", lost)
        .withColumn("overlap_fraction", share)
        .withColumn("disruption", F.col("score_fraction") * F.col("score_loss") * F.col("overlap_fraction"))
        .withColumn("family", classify_by_prefix(family))
        .drop("_edited", "_edited_score")
    )


def best_per_window_family(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Strongest disruption per (window, family)."""
    return best_row(df, [*by, "window", "family"], [-F.col("disruption"), *order])

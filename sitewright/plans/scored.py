"""Scoring queries: content-addressed batches, resumption, streaming arrival and the coarse-to-fine scan."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequences as sq
from ..operators import design as ds
from ..operators import joins as jn
from ..operators import scoring as sc
from ..session import fresh_folder, staged
from ..streaming.incremental_scan import start_scan
from .designs import NUC_SQL, nucleotides
from .registry import query, rounded, table

SCORED_SQL = """
SELECT doc_id, length(seq)::BIGINT AS n_bases, round((length(seq) - length(regexp_replace(seq, '[GC]', '', 'g'))) / length(seq)::DOUBLE, 6) AS signal FROM nuc WHERE length(seq) > 0
"""


def regions_of(spark, sf_dir):
    return nucleotides(spark, sf_dir).where(F.length("seq") > 0)


@query("batch_scoring", f"WITH {NUC_SQL} {SCORED_SQL}")
def batch_scoring(spark, sf_dir):
    """Score each distinct sequence once and expand to all documents that share it."""
    regions, store = regions_of(spark, sf_dir), fresh_folder(spark, "scores")
    designs = sc.native_states(regions, ["doc_id"], sequence="seq")
    sc.score_pending(spark, designs, regions, ["doc_id"], store, sc.composition_scorer, sequence="seq")
    return rounded(sc.with_scores(spark, designs, store).select("doc_id", "n_bases", "signal"))


@query("resumed_scoring", f"WITH {NUC_SQL}, s AS ({SCORED_SQL}) SELECT s.*, 1::BIGINT AS n_stored FROM s")
def resumed_scoring(spark, sf_dir):
    """A first run stops after half of the documents; the second scores only what the store lacks."""
    regions, store = regions_of(spark, sf_dir), fresh_folder(spark, "scores")
    designs = sc.native_states(regions, ["doc_id"], sequence="seq")
    for part in (designs.where("doc_id % 2 = 0"), designs):
        sc.score_pending(spark, part, regions, ["doc_id"], store, sc.composition_scorer, sequence="seq")
    stored = sc.read_store(spark, store, sc.SIGNAL).groupBy("key").agg(F.count(F.lit(1)).alias("n_stored"))
    expanded = sc.with_scores(spark, designs, store).join(stored, "key")
    return rounded(expanded.select("doc_id", "n_bases", "signal", "n_stored"))


@query(
    "streamed_scoring",
    f"WITH {NUC_SQL}, s AS (SELECT DISTINCT sha256(seq) AS sequence_sha256, length(seq)::BIGINT AS n_bases FROM nuc WHERE length(seq) > 0) SELECT sequence_sha256, n_bases, 1::BIGINT AS n_stored FROM s",
)
def streamed_scoring(spark, sf_dir):
    """Design files arrive in two waves; both runs drain what is new into one store."""
    root = fresh_folder(spark, "stream")
    arrivals, store, checkpoint = f"{root}/designs", f"{root}/scores", f"{root}/checkpoint"
    regions = regions_of(spark, sf_dir)
    designs = sc.native_states(regions, ["doc_id"], sequence="seq")
    for wave in (designs.where("doc_id % 2 = 0"), designs):
        wave.write.mode("append").parquet(arrivals)
        start_scan(
            spark, arrivals, regions, store, checkpoint, sc.composition_scorer, by=["doc_id"], sequence="seq"
        ).awaitTermination()
    stored = sc.read_store(spark, store, sc.SIGNAL).withColumnRenamed("key", "sequence_sha256")
    return stored.groupBy("sequence_sha256", "n_bases").agg(F.count(F.lit(1)).alias("n_stored"))


def failing_once(scorer):
    """A scorer whose every first call on a batch fails, as a remote one may."""
    seen = set()

    def score(frame):
        if frame["key"].iloc[0] not in seen:
            seen.add(frame["key"].iloc[0])
            raise ConnectionError("the scorer is not there yet")
        return scorer(frame)

    return score


@query(
    "scoring_call_counts",
    f"""WITH {NUC_SQL} SELECT count(DISTINCT seq) AS units, true AS calls_hold_units, count(DISTINCT seq) > 0 AS every_call_retried FROM nuc WHERE length(seq) > 0""",
)
def scoring_call_counts(spark, sf_dir):
    """Units, calls and retries of a scan whose every call fails once. How many calls a scan takes follows its partitions,
    so what must hold of them is given: each has up to 16 units, and each was retried once."""
    regions, store = regions_of(spark, sf_dir), fresh_folder(spark, "scores")
    designs = sc.native_states(regions, ["doc_id"], sequence="seq")
    scorer = failing_once(sc.composition_scorer)
    sc.score_pending(spark, designs, regions, ["doc_id"], store, scorer, sequence="seq", batch_size=16)
    counts = sc.scoring_counters(sc.read_store(spark, store, sc.SIGNAL))
    within = (F.col("units") >= F.col("calls")) & (F.col("units") <= 16 * F.col("calls"))
    retried = (F.col("calls") > 0) & (F.col("retries") == F.col("calls")) & (F.col("requests") == 2 * F.col("calls"))
    return counts.select("units", within.alias("calls_hold_units"), retried.alias("every_call_retried"))


WEIGHTS = {"A": 1.0, "C": 2.0, "G": 4.0, "T": 9.0}
TILE, WIDTH, STEP, PICKS = 200, 16, 8, 3


def weight_sql(text: str, weights=WEIGHTS, scale: float = 1.0) -> str:
    """The closed-form scorer in SQL: the sum of a weight per base."""
    return " + ".join(f"{scale * w}::DOUBLE * (length({text}) - length(replace({text}, '{base}', '')))" for base, w in weights.items())


WINDOW_SQL = f"""
w AS (SELECT *, ({weight_sql("translate(p, 'ACGT', 'TGCA')")}) - ({weight_sql("p")}) AS v FROM (
  SELECT doc_id, s AS ws, substr(seq, s + 1, {WIDTH}) AS p, substr(seq, s // {TILE} * {TILE} + 1, {TILE + WIDTH - 1}) AS tile
  FROM (SELECT doc_id, seq, unnest(range(0, length(seq) - {WIDTH - 1}, {STEP})) AS s FROM nuc WHERE length(seq) >= {WIDTH}))),
rw AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY abs(v) DESC, ws) AS r FROM w),
g AS (
  SELECT doc_id, r, ws, [ws] AS kept, true AS took FROM rw WHERE r = 1
  UNION ALL
  SELECT n.doc_id, n.r, n.ws, CASE WHEN len(g.kept) < {PICKS} AND len(list_filter(g.kept, lambda t: abs(t - n.ws) <= {WIDTH - 1})) = 0 THEN list_append(g.kept, n.ws) ELSE g.kept END,
         len(g.kept) < {PICKS} AND len(list_filter(g.kept, lambda t: abs(t - n.ws) <= {WIDTH - 1})) = 0
  FROM g JOIN rw n ON n.doc_id = g.doc_id AND n.r = g.r + 1 WHERE len(g.kept) < {PICKS}),
picked AS (SELECT rw.doc_id, rw.ws, v, p, {weight_sql("tile")} AS native_signal FROM g JOIN rw USING (doc_id, ws) WHERE took)
"""


@query(
    "coarse_to_fine_scan",
    f"""
WITH RECURSIVE {NUC_SQL}, {WINDOW_SQL},
fine AS (SELECT doc_id, ws, v, native_signal, ws + i AS position, ({weight_sql("alt")}) - ({weight_sql("ref")}) AS effect
  FROM (SELECT *, substr(p, i + 1, 1) AS ref FROM (SELECT *, unnest(range(0, {WIDTH})) AS i FROM picked)), (VALUES ('A'), ('C'), ('G'), ('T')) x(alt) WHERE alt <> ref)
SELECT doc_id, count(*) AS n_candidates, sum(position)::BIGINT AS position_sum, count(DISTINCT ws) AS n_windows, sum(abs(v)) AS contrast_sum,
       sum(native_signal + effect) AS signal_sum, sum(effect) AS effect_sum, max(abs(effect)) AS largest_effect,
       count(*) FILTER (WHERE sign(effect) = sign(v)) AS n_same_sign
FROM fine GROUP BY 1
""",
)
def coarse_to_fine_scan(spark, sf_dir):
    """Windows of all texts are scored through a store, those with the largest contrast are scanned base by base."""
    tiles = ds.tile_sequences(nucleotides(spark, sf_dir), sequence="seq", tile=TILE, halo=WIDTH - 1)
    fine = sc.coarse_to_fine(
        spark, tiles, fresh_folder(spark, "scores"), sc.weight_scorer(WEIGHTS), by=["doc_id"], tile="tile_start",
        sequence="seq", width=WIDTH, step=STEP, limit=PICKS, owned=F.col("window_start") < TILE,
    )
    same = F.signum("effect") == F.signum("window_contrast")
    return fine.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_candidates"),
        F.sum("position").alias("position_sum"),
        F.count_distinct("window_start").alias("n_windows"),
        (F.sum(F.abs("window_contrast"))).alias("contrast_sum"),
        F.sum("signal").alias("signal_sum"),
        F.sum("effect").alias("effect_sum"),
        F.max(F.abs("effect")).alias("largest_effect"),
        F.count(F.when(same, 1)).alias("n_same_sign"),
    )


#: Tracks of the closed-form track scorer, with their base weights.
TRACKS = {
    sc.Track("rna_plus", "+", "RNA"): WEIGHTS,
    sc.Track("rna_minus", "-", "RNA"): {"A": 9.0, "C": 4.0, "G": 2.0, "T": 1.0},
    sc.Track("access", ".", "ATAC"): {"A": 1.0, "C": 3.0, "G": 3.0, "T": 2.0},
    sc.Track("access_plus", "+", "ATAC"): {"A": 5.0, "C": 1.0, "G": 2.0, "T": 2.0},
}
GENES = (sc.Gene("gene_a", "+", 88, 104), sc.Gene("gene_b", "-", 96, 112), sc.Gene("gene_c", ".", 100, 104))
REGIMES = {"all_folds": 1.0, "held_out": 0.5}
PLACE = 100


def base_tracks(scale: float):
    """A track scorer: at every position the tracks' weights of its base, times ``scale``."""
    import numpy as np

    table = np.zeros((256, len(TRACKS)))
    for k, weights in enumerate(TRACKS.values()):
        for base, weight in weights.items():
            table[ord(base), k] = scale * weight

    def score(sequences):
        texts = list(sequences)
        stops = np.cumsum([len(s) for s in texts])
        whole = table.take(np.frombuffer("".join(texts).encode(), np.uint8), axis=0)
        return [whole[stop - len(s) : stop] for s, stop in zip(texts, stops)]

    return score


def tracks_sql() -> str:
    """Per gene and compatible track the window's mean in both states."""
    rows = []
    for track, weights in TRACKS.items():
        for gene in GENES:
            if gene.strand in "+-" and track.strand not in (gene.strand, "."):
                continue
            for regime, scale in REGIMES.items():
                part, length = f"substr(seq, {gene.start + 1}, {gene.stop - gene.start})", f"(least({gene.stop}, length(seq)) - {gene.start})"
                ref = f"({weight_sql(part, weights, scale)}) / {length}"
                inside = f"CASE WHEN {PLACE} >= {gene.start} AND {PLACE} < {gene.stop} THEN 1.0 ELSE 0.0 END"
                change = f"{inside} * (({weight_sql('alt', weights, scale)}) - ({weight_sql('ref', weights, scale)})) / {length}"
                rows.append(
                    f"SELECT doc_id, tile, '{regime}' AS regime, '{track.modality}' AS modality, '{gene.name}' AS gene, '{track.name}' AS track, "
                    f"{ref} AS ref_value, {change} AS effect FROM variant"
                )
    return " UNION ALL ".join(rows)


@query(
    "scored_track_extraction",
    f"""
WITH {NUC_SQL},
tiles AS (SELECT doc_id, s // {TILE} AS tile, substr(seq, s + 1, {TILE}) AS seq FROM (SELECT doc_id, seq, unnest(range(0, length(seq), {TILE})) AS s FROM nuc WHERE length(seq) > 0)),
variant AS (SELECT *, substr(seq, {PLACE} + 1, 1) AS ref, translate(substr(seq, {PLACE} + 1, 1), 'ACGT', 'TGCA') AS alt FROM tiles WHERE length(seq) > {PLACE}),
tracks AS ({tracks_sql()}),
effects AS (SELECT doc_id, tile, regime, modality, gene, avg(ref_value) AS ref_value, avg(effect) AS effect, count(*) AS n_tracks FROM tracks GROUP BY ALL)
SELECT doc_id, regime, modality, gene, count(*) AS n_variants, sum(n_tracks)::BIGINT AS n_tracks, round(sum(ref_value), 6) AS ref_sum,
       round(sum(effect), 6) AS effect_sum, round(max(abs(effect)), 6) AS largest_effect FROM effects GROUP BY ALL
""",
)
def scored_track_extraction(spark, sf_dir):
    """A variant in the middle of every tile of every text, its two states scored under two regimes, and the effects on
    the genes of the tile over strand-compatible tracks."""
    # read for the variants, their states and both regimes: texts are folded once
    tiles = staged(ds.tile_sequences(nucleotides(spark, sf_dir), sequence="seq", tile=TILE), "tiles", compression="zstd")
    placed = tiles.where(F.length("seq") > PLACE)
    base = sq.base_at("seq", PLACE)
    variants = placed.select(
        "doc_id", "tile_start", F.concat_ws(":", "doc_id", "tile_start").alias("variant"),
        F.lit(PLACE).alias("offset0"), base.alias("ref"), sq.complement(base).alias("alt"),
    )
    effects = sc.variant_effects(
        spark, variants, tiles, fresh_folder(spark, "scores"), {name: base_tracks(scale) for name, scale in REGIMES.items()},
        by=["doc_id", "tile_start"], variant="variant", sequence="seq", tracks=list(TRACKS), genes=GENES, together=["doc_id"],
    )
    return effects.groupBy("doc_id", "regime", "modality", "gene").agg(
        F.count(F.lit(1)).alias("n_variants"),
        F.sum("n_tracks").alias("n_tracks"),
        F.round(F.sum("ref_value"), 6).alias("ref_sum"),
        F.round(F.sum("effect"), 6).alias("effect_sum"),
        F.round(F.max(F.abs("effect")), 6).alias("largest_effect"),
    )


@query(
    "baseline_subtracted_scores",
    """
WITH m AS (SELECT l_suppkey, l_linenumber, avg(round(l_extendedprice * 100)::BIGINT) AS v FROM lineitem GROUP BY 1, 2), b AS (SELECT l_suppkey, v AS base FROM m WHERE l_linenumber = 1)
SELECT l_suppkey, l_linenumber, round(v - base, 4) AS combined_minus_anchor FROM m LEFT JOIN b USING (l_suppkey) WHERE l_linenumber > 1
""",
)
def baseline_subtracted_scores(spark, sf_dir):
    from .registry import cents

    means = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_linenumber", cents("l_extendedprice").alias("c")).groupBy("l_suppkey", "l_linenumber").agg(F.avg("c").alias("v"))
    based = jn.attach_baseline(means, ["l_suppkey"], is_baseline=F.col("l_linenumber") == 1, value="v", name="base")
    return based.where("l_linenumber > 1").select("l_suppkey", "l_linenumber", F.round(F.col("v") - F.col("base"), 4).alias("combined_minus_anchor"))

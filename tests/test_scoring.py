import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sitewright.functions import sequences as sq
from sitewright.operators import design as ds
from sitewright.operators import scoring as sc
from sitewright.streaming.incremental_scan import start_scan

WEIGHTS = {"A": 1.0, "C": 2.0, "G": 4.0, "T": 9.0}
OTHER = str.maketrans("ACGT", "TGCA")


def weight(text):
    return sum(WEIGHTS.get(base, 0.0) for base in text)


def counting(scorer, path):
    """A scorer that leaves a line per row it was asked for."""

    def score(frame):
        with open(path, "a") as out:
            out.write("".join(f"{key}\n" for key in frame["key"]))
        return scorer(frame)

    return score


def asked(path):
    return open(path).read().split() if path.exists() else []


@pytest.fixture
def regions(spark):
    rng = np.random.default_rng(3)
    rows = [(d, t, "".join(rng.choice(list("ACGT"), n))) for d, t, n in [(1, 0, 55), (1, 40, 48), (2, 0, 30), (3, 0, 9), (4, 0, 0)]]
    return spark.createDataFrame([*rows, (5, 0, None), (6, 0, rows[0][2])], "doc int, tile int, seq string")


def test_edits_are_carried_out_from_the_last(spark):
    rows = [("ACGTACGT", [(1, 3, "T"), (4, 4, "GGG"), (6, 8, "")]), ("ACGT", []), (None, [])]
    df = spark.createDataFrame(rows, f"s string, e {sc.EDITS}")
    assert [r[0] for r in df.select(sq.apply_edits("s", "e")).collect()] == ["ATTGGGAC", "ACGT", None]


def test_edits_that_change_nothing_have_the_native_key(spark):
    df = spark.createDataFrame([("h", 2, "A", "A"), ("h", 2, "A", "C")], "h string, at int, new string, old string")
    keys = [r[0] for r in df.select(sc.state_key("h", sc.one_edit("at", F.col("at") + 1, "new", "old"))).collect()]
    assert keys[0] == "h" and keys[1] != "h"


def test_store_scores_each_state_once(spark, regions, tmp_path):
    store, log = str(tmp_path / "store"), tmp_path / "asked"
    designs = sc.native_states(regions.where("seq IS NOT NULL"), ["doc", "tile"], sequence="seq")
    scorer = counting(sc.weight_scorer(WEIGHTS), log)
    for part in (designs.where("doc < 2"), designs, designs):
        sc.score_pending(spark, part, regions, ["doc", "tile"], store, scorer, sequence="seq", batch_size=2)
    found = {(r.doc, r.tile): r.signal for r in sc.with_scores(spark, designs, store).collect()}
    assert found == {(r.doc, r.tile): weight(r.seq) for r in regions.where("seq IS NOT NULL").collect()}
    assert len(asked(log)) == len(set(asked(log))) == 5  # regions 1 and 6 are one sequence


def test_micro_batch_reads_only_its_shards(spark, tmp_path):
    store = str(tmp_path / "store")
    rows = [(f"{i:x}{i}", 1.0, 3, "c", 1) for i in range(16)]
    sc.append_store(spark.createDataFrame(rows, f"key string, {sc.SIGNAL}, {sc.CALLS}"), store)
    batch = spark.createDataFrame([("30", 1, []), ("aX", 2, [])], f"key string, doc int, edits {sc.EDITS}")
    todo = sc.pending_states(spark, batch, ["doc"], store, sc.SIGNAL, prune=True)
    assert [r.key for r in todo.collect()] == ["30", "aX"]  # "33" and "a10" are stored, these are not
    kept = sc.read_store(spark, store, sc.SIGNAL, ["3", "a"])
    assert {f.rsplit("shard=", 1)[1][0] for f in kept.inputFiles()} >= {"3", "a"}
    plan = todo._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "shard" in plan.split("PartitionFilters: [", 1)[1].split("]", 1)[0]
    assert kept.count() == 2


def test_counters_count_committed_calls(spark, regions, tmp_path):
    store, tries = str(tmp_path / "store"), tmp_path / "tries"
    states = spark.range(100).select(F.sha2(F.col("id").cast("string"), 256).alias("key"), F.lit("ACGT").alias("sequence"), "id")

    def flaky(frame):
        # fails twice on the batch that holds id 7, once on that with id 50
        held = set(frame["id"])
        done = open(tries).read().split() if os.path.exists(tries) else []
        for name, times in ((7, 2), (50, 1)):
            if name in held and done.count(str(name)) < times:
                with open(tries, "a") as out:
                    out.write(f"{name}\n")
                raise ConnectionError
        return sc.composition_scorer(frame)

    scored = sc.score_batches(states.repartition(3, "id"), flaky, outputs=sc.SIGNAL, batch_size=10, attempts=4, extra=["id"])
    sc.append_store(scored, store)
    counts = sc.scoring_counters(sc.read_store(spark, store, sc.SIGNAL)).first()
    sizes = [r["count"] for r in states.repartition(3, "id").groupBy(F.spark_partition_id()).count().collect()]
    calls = sum(-(-n // 10) for n in sizes)
    assert (counts.units, counts.calls, counts.retries, counts.requests) == (100, calls, 3, calls + 3)


def test_counters_are_right_when_a_task_is_repeated(spark, tmp_path):
    states = spark.range(20).select(F.col("id").cast("string").alias("key"), F.lit("ACGT").alias("sequence"))
    scored = sc.score_batches(states.coalesce(1), sc.composition_scorer, outputs=sc.SIGNAL, batch_size=8)
    assert scored.count() == 20  # one run is thrown away
    sc.append_store(scored, str(tmp_path / "store"))
    counts = sc.scoring_counters(sc.read_store(spark, str(tmp_path / "store"), sc.SIGNAL)).first()
    assert tuple(counts) == (20, 3, 3, 0)


def test_scorer_that_keeps_failing_fails_the_job(spark):
    def broken(frame):
        raise ConnectionError("no scorer")

    states = spark.createDataFrame([("k", "ACGT")], "key string, sequence string")
    with pytest.raises(Exception, match="no scorer"):
        sc.score_batches(states, broken, outputs=sc.SIGNAL, attempts=2).collect()


def test_counters_of_an_empty_store(spark, tmp_path):
    empty = sc.read_store(spark, str(tmp_path / "none"), sc.SIGNAL)
    assert tuple(sc.scoring_counters(empty).first()) == (0, 0, 0, 0)


def brute_scan(rows, width, step, limit):
    out = []
    for doc in sorted({d for d, _, _ in rows}):
        windows = []
        for d, tile, seq in rows:
            if d != doc or not seq:
                continue
            for s in range(0, min(40, len(seq) - width + 1), step):
                part = seq[s : s + width]
                windows.append((-abs(weight(part.translate(OTHER)) - weight(part)), tile + s, tile, seq, part))
        kept = []
        for contrast, start, tile, seq, part in sorted(windows, key=lambda w: w[:2]):
            if len(kept) < limit and all(abs(start - k) >= width for k in kept):
                kept.append(start)
                out += [
                    (doc, start, start + i, ref, alt, weight(seq), weight(seq) - WEIGHTS[ref] + WEIGHTS[alt])
                    for i, ref in enumerate(part)
                    for alt in "ACGT"
                    if alt != ref
                ]
    return sorted(out)


def test_coarse_to_fine_scan(spark, regions, tmp_path):
    log, width, step = tmp_path / "asked", 6, 3
    tiles = regions.where("doc < 6")

    def scan(scorer, store):
        found = sc.coarse_to_fine(
            spark, tiles, store, scorer, by=["doc"], tile="tile", sequence="seq", width=width, step=step, limit=2,
            owned=F.col("window_start") < 40,
        )
        return sorted((r.doc, r.window_start, r.position, r.ref, r.alt, r.native_signal, r.signal) for r in found.collect())

    expected = brute_scan([tuple(r) for r in tiles.collect()], width, step, 2)
    scorer = counting(sc.weight_scorer(WEIGHTS), log)
    assert scan(scorer, str(tmp_path / "store")) == expected
    first = len(asked(log))
    assert scan(scorer, str(tmp_path / "store")) == expected
    assert len(asked(log)) == first  # a repeated scan scores nothing

    # a scan that stopped between its rounds goes on from the first round's scores
    coarse = sc.window_states(tiles, ["doc", "tile"], sequence="seq", width=width, step=step).where("window_start < 40")
    coarse = coarse.select("doc", "tile", "key", "edits").unionByName(sc.native_states(tiles.where("seq IS NOT NULL"), ["doc", "tile"], sequence="seq"))
    other = str(tmp_path / "other")
    sc.score_pending(spark, coarse, tiles, ["doc", "tile"], other, scorer, sequence="seq")
    rounds = len(asked(log))
    assert scan(scorer, other) == expected
    assert len(asked(log)) - rounds == first - (rounds - first) > 0


TRACKS = [sc.Track("p", "+", "RNA"), sc.Track("m", "-", "RNA"), sc.Track("u", ".", "ATAC")]
GENES = [sc.Gene("a", "+", 2, 6), sc.Gene("b", "-", 0, 99), sc.Gene("c", ".", 4, 5)]


def tracks_by(scale):
    def score(sequences):
        return [np.array([[scale * (ord(c) * (k + 1) + i) for k in range(3)] for i, c in enumerate(s)], float) for s in sequences]

    return score


track_scorer = tracks_by(1)


def test_variant_effects(spark, tmp_path):
    regions = spark.createDataFrame([(1, "ACGTACGT"), (2, "TTTTTTTT")], "region int, seq string")
    variants = spark.createDataFrame([(1, "v1", 4, "A", "G"), (2, "v2", 0, "T", "C"), (2, "v3", 0, "T", "T")], "region int, variant string, offset0 int, ref string, alt string")
    found = sc.variant_effects(
        spark, variants, regions, str(tmp_path / "stores"), {"x": track_scorer, "y": tracks_by(2)},
        by=["region"], variant="variant", sequence="seq", tracks=TRACKS, genes=GENES,
    )
    got = {(r.variant, r.regime, r.modality, r.gene): (r.ref_value, r.alt_value, r.n_tracks, r.effect) for r in found.collect()}
    expected = {}
    for name, ref, alt in (("v1", "ACGTACGT", "ACGTGCGT"), ("v2", "TTTTTTTT", "CTTTTTTT"), ("v3", "TTTTTTTT", "TTTTTTTT")):
        for regime, scale in (("x", 1), ("y", 2)):
            for gene in GENES:
                for modality in ("RNA", "ATAC"):
                    used = [k for k, t in enumerate(TRACKS) if t.modality == modality and (gene.strand == "." or t.strand in (gene.strand, "."))]
                    if used:
                        means = [np.mean([scale * track_scorer([s])[0][gene.start : gene.stop, k].mean() for k in used]) for s in (ref, alt)]
                        expected[name, regime, modality, gene.name] = (means[0], means[1], len(used), means[1] - means[0])
    assert got.keys() == expected.keys()
    for key in expected:
        assert got[key] == pytest.approx(expected[key])


def test_variant_with_another_reference_base_fails(spark, tmp_path):
    regions = spark.createDataFrame([(1, "ACGT")], "region int, seq string")
    variants = spark.createDataFrame([(1, "v", 0, "G", "T")], "region int, variant string, offset0 int, ref string, alt string")
    with pytest.raises(Exception, match="reference base differs"):
        sc.variant_effects(
            spark, variants, regions, str(tmp_path / "s"), {"x": track_scorer}, by=["region"], variant="variant",
            sequence="seq", tracks=TRACKS, genes=GENES,
        ).collect()


def test_track_arrays_of_another_width_are_refused():
    score = sc.reduced_tracks(lambda s: [np.zeros((3, 2))], TRACKS, GENES)
    with pytest.raises(ValueError, match="3 tracks"):
        score(pd.DataFrame({"sequence": ["AAA"]}))


def test_streamed_waves_score_each_state_once(spark, regions, tmp_path):
    log = tmp_path / "asked"
    arrivals, store, checkpoint = (str(tmp_path / n) for n in ("designs", "store", "checkpoint"))
    tiles = regions.where("seq IS NOT NULL")
    designs = sc.window_states(tiles, ["doc", "tile"], sequence="seq", width=6, step=6).select("doc", "tile", "key", "edits")
    for wave in (designs.where("doc = 1"), designs, designs):
        wave.write.mode("append").parquet(arrivals)
        start_scan(
            spark, arrivals, tiles, store, checkpoint, counting(sc.weight_scorer(WEIGHTS), log), by=["doc", "tile"], sequence="seq"
        ).awaitTermination()
    scored = {r.key: r.signal for r in sc.read_store(spark, store, sc.SIGNAL).collect()}
    edited = designs.join(tiles, ["doc", "tile"]).select("key", sq.apply_edits("seq", "edits").alias("s"))
    assert scored == {r.key: weight(r.s) for r in edited.collect()}
    assert len(asked(log)) == len(set(asked(log))) == len(scored)


def test_exhaustive_candidates(spark):
    df = spark.createDataFrame([("chr1", "AG")], "chrom string, seq string")
    found = {r.variant_key for r in sc.exhaustive_candidates(df, sequence="seq", chrom="chrom", start_position=7).collect()}
    assert found == {f"chr1:{p}:{r}>{a}" for p, r in ((7, "A"), (8, "G")) for a in "ACGT" if a != r}


def test_window_states_of_tiles(spark):
    df = spark.createDataFrame([(1, "ACGTACGTAC")], "doc int, seq string")
    tiles = ds.tile_sequences(df, sequence="seq", tile=4, halo=2)
    states = sc.window_states(tiles, ["doc", "tile_start"], sequence="seq", width=3, step=2)
    edited = states.join(tiles, ["doc", "tile_start"]).select("tile_start", "window_start", sq.apply_edits("seq", "edits").alias("s"))
    assert {tuple(r) for r in edited.collect()} == {(0, 0, "TGCTAC"), (0, 2, "ACCATC"), (4, 0, "TGCTAC"), (4, 2, "ACCATC")}


def test_stores_are_not_broadcast(spark, tmp_path):
    regions = spark.createDataFrame([(1, "ACGT"), (2, "TTTT")], "doc int, seq string")
    designs, store = sc.native_states(regions, ["doc"], sequence="seq"), str(tmp_path / "store")
    sc.score_pending(spark, designs, regions, ["doc"], store, sc.composition_scorer, sequence="seq")
    states = designs.withColumn("region_hash", F.col("key"))
    for found in (
        sc.pending_states(spark, designs, ["doc"], store, sc.SIGNAL), sc.with_scores(spark, designs, store), sc.contrast_to_native(spark, states, store),
    ):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_track_stores_hold_values_without_names_and_belong_to_their_genes(spark, tmp_path):
    regions = spark.createDataFrame([(1, "ACGTACGT"), (2, "TTTTTTTT")], "region int, seq string")
    variants = spark.createDataFrame([(1, "v1", 4, "A", "G"), (2, "v2", 0, "T", "C")], "region int, variant string, offset0 int, ref string, alt string")

    def run(genes, tracker=track_scorer):
        found = sc.variant_effects(
            spark, variants, regions, str(tmp_path / "stores"), {"x": tracker}, by=["region"], variant="variant", sequence="seq", tracks=TRACKS, genes=genes,
        )
        return {(r.variant, r.gene, r.modality): r for r in found.collect()}

    first = run(GENES)
    stores = list((tmp_path / "stores").iterdir())
    values = spark.read.parquet(str(stores[0])).schema["tracks"].dataType.simpleString()
    assert len(stores) == 1 and values == "array<double>"
    assert run(GENES, None) == first  # all states are stored: no scorer is asked
    moved = [sc.Gene("moved", ".", 0, 8)]
    assert {k[1] for k in run(moved)} == {"moved"}
    part_missing = run([sc.Gene("n", ".", 1, 3)], lambda s: [np.where(np.arange(len(TRACKS)) == 0, np.nan, a) for a in track_scorer(s)])
    of = [k for k, t in enumerate(TRACKS) if t.modality == TRACKS[0].modality and k]
    for name, ref in (("v1", "ACGTACGT"), ("v2", "TTTTTTTT")):
        row = part_missing[name, "n", TRACKS[0].modality]
        expected = np.mean([track_scorer([ref])[0][1:3, k].mean() for k in of]) if of else None
        assert row.ref_value == (pytest.approx(expected) if of else None) and row.n_tracks == len(of) + 1


def test_appended_shards_are_more_tasks_than_folders(spark, tmp_path):
    rows = [(f"{i:02x}" + "0" * 62, 1.0, 1, "c", 1) for i in range(256)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # 256 rows would be one task
    try:
        sc.append_store(spark.createDataFrame(rows, f"key string, {sc.SIGNAL}, {sc.CALLS}").repartition(4), str(tmp_path / "s"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    found = sc.read_store(spark, str(tmp_path / "s"), sc.SIGNAL)
    assert found.count() == 256 and len(found.inputFiles()) > 16


def test_states_of_a_region_are_made_after_the_shuffle(spark, regions, tmp_path):
    store, tiles = str(tmp_path / "store"), regions.where("doc < 6")
    scan = dict(by=["doc"], tile="tile", sequence="seq", width=6, step=3, limit=2, owned=F.col("window_start") < 40)
    found = sc.coarse_to_fine(spark, tiles, store, sc.weight_scorer(WEIGHTS), **scan)
    plan = found._jdf.queryExecution().executedPlan().toString()
    # parents come first: substitutions are made of rows that met their region's scores
    assert 0 < plan.index("Generate posexplode") < plan.index("SortMergeJoin") < plan.index("Exchange")
    # all states of a region have its digits, and a region's scores are one row
    keys = [r.key for r in sc.read_store(spark, store, sc.SIGNAL).select("key").collect()]
    hashes = {r[0] for r in tiles.where("seq IS NOT NULL").select(sq.content_hash("seq")).collect()}
    assert len(keys) == len(set(keys)) and {k[: sc.REGION_DIGITS] for k in keys} == {h[: sc.REGION_DIGITS] for h in hashes}
    lists = sc._by_region(spark, store, sc.SIGNAL, "signal").collect()
    assert len(lists) == len(hashes) and sum(len(r._ids) for r in lists) == sum(len(r._values) for r in lists) == len(keys)


def test_scan_leaves_out_what_has_no_score(spark, regions, tmp_path):
    tiles = regions.where("doc IN (1, 2)")

    def scan(rows, store, scorer=sc.weight_scorer(WEIGHTS)):
        found = sc.coarse_to_fine(spark, rows, store, scorer, by=["doc"], tile="tile", sequence="seq", width=6, step=6, limit=1)
        return sorted((r.doc, r.window_start, r.position, r.alt, r.signal, r.effect) for r in found.collect())

    once = scan(tiles, str(tmp_path / "a"))
    assert len(once) == 2 * 18 and scan(tiles.unionByName(tiles), str(tmp_path / "b")) == once  # one candidate is enough

    def without_native(frame):
        scored = sc.weight_scorer(WEIGHTS)(frame)
        return scored.assign(signal=scored["signal"].where(frame["key"].str.len() < 64))

    assert scan(tiles, str(tmp_path / "c"), without_native) == []


def test_windows_without_bases_are_the_native_state(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, "NNNNNNACGTAC"), (2, 0, "acgtNNNNNNNN")], "doc int, tile int, seq string")
    log = tmp_path / "asked"
    found = sc.coarse_to_fine(
        spark, rows, str(tmp_path / "s"), counting(sc.weight_scorer(WEIGHTS), log), by=["doc"], tile="tile", sequence="seq", width=6, step=6, limit=2
    ).collect()
    assert len(asked(log)) == len(set(asked(log)))
    of = {(r.doc, r.window_start): set() for r in found}
    for r in found:
        of[r.doc, r.window_start].add((r.position, r.ref, r.alt))
    assert {k: len(v) for k, v in of.items()} == {(1, 6): 18, (2, 0): 12}  # lower-case bases are bases


def test_states_that_a_store_has_no_value_for_stay_without_one(spark, tmp_path):
    store = str(tmp_path / "store")
    h = "ab" * 32
    rows = [(h, 1.5, 3, "c", 1), (h[:32] + "f" * 16, None, 3, "c", 1), (h[:32] + "0" * 15 + "1", 4.0, 3, "c", 1)]
    sc.append_store(spark.createDataFrame(rows, f"key string, {sc.SIGNAL}, {sc.CALLS}"), store)
    states = spark.createDataFrame([(r[0], h) for r in rows] + [(h[:32] + "e" * 16, h)], "key string, region_hash string")
    got = {r.key: (r.signal, r.native_signal, r.contrast) for r in sc.contrast_to_native(spark, states, store).collect()}
    assert got == {rows[0][0]: (1.5, 1.5, 0.0), rows[1][0]: (None, 1.5, None), rows[2][0]: (4.0, 1.5, 2.5), h[:32] + "e" * 16: (None, 1.5, None)}


def test_variants_meet_scores_by_region_and_new_ones_are_scored_alone(spark, tmp_path):
    log, stores = tmp_path / "asked", str(tmp_path / "stores")
    regions = spark.createDataFrame([(1, "ACGTACGT"), (2, "ACGTACGT"), (3, "TTTTTTTT"), (4, "CCCC")], "region int, seq string")
    gene = [sc.Gene("g", ".", 0, 8)]

    def tracker(sequences):
        with open(log, "a") as out:
            out.write("".join(f"{s}\n" for s in sequences))
        return track_scorer(sequences)

    def run(rows):
        variants = spark.createDataFrame(rows, "region int, variant string, offset0 int, ref string, alt string")
        return sc.variant_effects(
            spark, variants, regions, stores, {"x": tracker}, by=["region"], variant="variant", sequence="seq", tracks=TRACKS, genes=gene,
        )

    def value(text):
        return np.mean([track_scorer([text])[0][:, k].mean() for k in range(2)])

    first = [(1, "a", 4, "A", "G"), (2, "b", 4, "A", "G"), (2, "b", 4, "A", "G"), (1, "c", 0, "A", None)]
    found = run(first)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_region" in plan and "hashpartitioning(key" not in plan and "Broadcast" not in plan
    got = {r.variant: (r.ref_value, r.alt_value) for r in found.where("modality = 'RNA'").collect()}
    ref, alt = value("ACGTACGT"), value("ACGTGCGT")
    assert got == {"a": (ref, alt), "b": (ref, alt), "c": (ref, None)}
    assert sorted(asked(log)) == ["ACGTACGT", "ACGTGCGT"]  # two regions of one content
    more = run([*first, (1, "d", 0, "A", "C"), (3, "e", 7, "T", "T")])
    got = {r.variant: (r.ref_value, r.alt_value) for r in more.where("modality = 'RNA'").collect()}
    same = value("TTTTTTTT")
    assert got == {"a": (ref, alt), "b": (ref, alt), "c": (ref, None), "d": (ref, value("CCGTACGT")), "e": (same, same)}
    assert sorted(asked(log)[2:]) == ["CCGTACGT", "TTTTTTTT"]
    keys = [r.key for r in sc.read_store(spark, f"{stores}/{os.listdir(stores)[0]}", sc.TRACK_VALUES).collect()]
    assert len(keys) == 4 and len({k[: sc.REGION_DIGITS] for k in keys}) == 2


def test_effects_that_come_together_are_grouped_without_another_shuffle(spark, tmp_path):
    regions = spark.createDataFrame([(i % 3, i, "ACGTACGT") for i in range(9)], "doc int, tile int, seq string")
    variants = regions.select("doc", "tile", F.concat_ws(":", "doc", "tile").alias("variant"), F.lit(4).alias("offset0"), F.lit("A").alias("ref"), F.lit("G").alias("alt"))

    def run(together):
        effects = sc.variant_effects(
            spark, variants, regions, str(tmp_path / "stores"), {"x": track_scorer}, by=["doc", "tile"], variant="variant", sequence="seq", tracks=TRACKS, genes=GENES, together=together,
        )
        grouped = effects.groupBy("doc", "gene", "modality").agg(F.count(F.lit(1)).alias("n"), F.sum("effect").alias("effect"))
        return grouped._jdf.queryExecution().executedPlan().toString().count("Exchange"), sorted(tuple(r) for r in grouped.collect())

    (more, spread), (fewer, near) = run(None), run(["doc"])
    assert spread == near and len(near) == 3 * 6 and {r[3] for r in near} == {3} and fewer == more - 1


def test_one_edit_is_keyed_and_carried_out_as_several_are(spark):
    import hashlib

    rows = [("ACGTACGT", [(1, 3, "T")]), ("ACGTACGT", [(0, 0, "GG")]), ("ACGTACGT", [(7, 8, "")]), ("ACGTACGT", [(1, 3, "T"), (4, 4, "GGG")]), ("ACGT", []), ("ACGT", None)]
    df = spark.createDataFrame(rows, f"s string, e {sc.EDITS}")
    got = [tuple(r) for r in df.select(sq.apply_edits("s", "e"), sc.state_key(F.lit("h"), "e")).collect()]

    def told(edits):
        return hashlib.sha256("|".join(["h", *(f"{a}:{b}:{t}" for a, b, t in edits)]).encode()).hexdigest()

    texts = ["ATTACGT", "GGACGTACGT", "ACGTACG", "ATTGGGACGT", "ACGT", None]
    assert got == [*((text, told(e)) for text, (_, e) in zip(texts[:4], rows)), ("ACGT", "h"), (None, None)]


def test_scan_of_letters_whose_capitals_are_longer_finds_its_own_scores(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, "acgt\u00dfACGTACGTTTGA")], "doc int, tile int, seq string")
    found = sc.coarse_to_fine(spark, rows, str(tmp_path / "s"), sc.weight_scorer(WEIGHTS), by=["doc"], tile="tile", sequence="seq", width=4, step=2, limit=3).collect()
    assert len(found) > 18 and all(r.signal is not None for r in found)


def test_rows_written_where_they_were_scored_are_not_sorted_and_settings_stay(spark, tmp_path):
    name, rows = "spark.sql.maxConcurrentOutputFileWriters", [(f"{i:02x}" + "0" * 46, 1.0, 1, "c", 1) for i in range(255, -1, -1)]
    scored = spark.createDataFrame(rows, f"key string, {sc.SIGNAL}, {sc.CALLS}").coalesce(1)
    before = spark.conf.get(name)
    for prefix in (1, 2):  # 256 folders are too many to be open at a time: those rows are sorted
        sc.append_store(scored, str(tmp_path / f"p{prefix}"), prefix, gathered=False)
        found = sc.read_store(spark, str(tmp_path / f"p{prefix}"), sc.SIGNAL)
        assert sorted(r.key for r in found.collect()) == sorted(r[0] for r in rows) and len(found.inputFiles()) == 16**prefix
        assert spark.conf.get(name) == before
    one = spark.read.parquet(*[f for f in sc.read_store(spark, str(tmp_path / "p1"), sc.SIGNAL).inputFiles() if "shard=a" in f])
    assert [r.key[:2] for r in one.collect()] == [f"a{c}" for c in "fedcba9876543210"]

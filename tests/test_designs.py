import random

import pytest
from pyspark.sql import functions as F

from sitewright.functions import sequences as sq
from sitewright.operators import design as ds
from sitewright.operators import motifs as mt
from sitewright.sources import readers

RNG = random.Random(9)
DNA = "".join(RNG.choice("ACGT") for _ in range(400))


@pytest.fixture(scope="module")
def one(spark):
    return spark.createDataFrame([(1, DNA, 200)], "id int, seq string, a int")


def differences(x, y):
    return [i for i, (p, q) in enumerate(zip(x, y, strict=True)) if p != q]


def test_component_pairs_differ_at_the_anchor_only(one):
    components = [("native", "control", []), ("motif", "m", [(-1, 8)]), ("arms", "arm", [(-60, -2), (9, 60)])]
    rows = ds.component_design(one, sequence="seq", anchor="a", components=components, seeds=[1, 2], alleles={"REF": "G", "ALT": "T"}).collect()
    states = {(r.component, r.seed, r.allele): r for r in rows}
    assert len(states) == 12
    for c in ("native", "motif", "arms"):
        for s in (1, 2):
            assert differences(states[c, s, "REF"].edited, states[c, s, "ALT"].edited) == [200]
            outside = [i for i in differences(states[c, s, "ALT"].edited, DNA) if i != 200]
            assert (outside == []) == (c == "native") and len(outside) == states[c, s, "ALT"].n_changed
    moved = states["arms", 1, "REF"].edited
    for low, high in ((140, 199), (209, 261)):
        assert sorted(moved[low:high]) == sorted(DNA[low:high]) and moved[low:high] != DNA[low:high]
    assert states["arms", 1, "REF"].edited != states["arms", 2, "REF"].edited


def test_recovery_keeps_the_motif_and_restores_by_extent(one):
    rows = ds.recovery_design(
        one, sequence="seq", anchor="a", half=100, seeds=[4], upstream_extents=[0, 10, 100], downstream_extents=[0, 100], protect_from=-1, protect_to=8, alleles={"ALT": "T"}
    ).collect()
    states = {(r.condition, r.extent): r.edited for r in rows}
    native = DNA[:200] + "T" + DNA[201:]
    assert states["native", -1] == native
    for s in states.values():
        assert s[199:209] == native[199:209] and len(s) == 400
    assert states["upstream_recovery", 10][190:199] == DNA[190:199]
    assert states["upstream_recovery", 100][:209] == native[:209]
    assert states["downstream_recovery", 100][209:] == DNA[209:]


def test_boundary_conditions_are_complementary(one):
    rows = ds.boundary_design(one, sequence="seq", anchor="a", half=50, seeds=[1], upstream=(20, 20), downstream=(15, 15), alleles={"REF": DNA[200]}).collect()
    states = {r.condition: r.edited for r in rows}
    assert states["outside_scramble"][180:216] == DNA[180:216]
    assert states["inside_scramble"][:180] + states["inside_scramble"][216:] == DNA[:180] + DNA[216:]
    assert states["outside_scramble"][:180] != DNA[:180]


def test_a_shuffle_that_must_differ(spark):
    texts = ["AAAAAA", "AAAC", "CA", "GATTACA", "A", "ANNA", ""]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    rows = df.select("s", *[ds.shuffled(F.col("s"), F.lit(k), must_differ=True).alias(f"x{k}") for k in range(6)]).collect()
    for row in rows:
        for drawn in row[1:]:
            if len(set(row.s.replace("N", ""))) < 2:
                assert drawn is None  # no other order: the row stays, without a state
            else:
                assert drawn != row.s and sorted(drawn) == sorted(row.s)


def test_wrong_deletion_and_wrong_anchor_base_fail(spark, one):
    bad = one.withColumn("op", F.lit("deletion")).withColumn("ev", F.lit("NNN"))
    with pytest.raises(Exception, match="deleted bases differ"):
        ds.apply_event(bad, sequence="seq", boundary="a", operation="op", event="ev", length=390).collect()
    other = "A" if DNA[200] != "A" else "C"
    with pytest.raises(Exception, match="unexpected base at the anchor"):
        ds.donor_fragments(one, sequence="seq", anchor="a", upstream=5, downstream=5, native_base=other, other_base="T", seed=1).collect()


def test_region_without_tiles_fails(spark, one):
    tiles = ds.tile_sequences(one.select("id", "seq"), sequence="seq", tile=64).withColumnRenamed("seq", "sequence")
    regions = spark.createDataFrame([(1, 350, 450)], "id int, s bigint, e bigint")
    with pytest.raises(Exception, match="not covered"):
        ds.regions_from_tiles(regions, tiles, ["id"], region_id="id", start0="s", end0="e", tile=64).collect()


def test_occurrences_overlap(spark):
    df = spark.createDataFrame([("ATATAT",), ("A",), ("",)], "s string")
    assert [r.o for r in df.select(sq.occurrences("s", "ATAT").alias("o")).collect()] == [[0, 2], [], []]


def test_matrix_text_and_scan(spark):
    text = ">M1 CEBPX\nA  [ 9 0 0 ]\nC  [ 0 9 0 ]\nG  [ 0 0 9 ]\nT  [ 0 0 0 ]\n"
    broken = ">M2 incomplete\nA [ 1 ]\nC [ 1 ]\n"
    counts = readers.matrix_records(spark.createDataFrame([(text,), (broken,)], "value string"))
    assert {r.matrix_id for r in counts.collect()} == {"M1"} and {r.name for r in counts.collect()} == {"CEBPX"}
    weights = mt.log_odds(counts, matrix="matrix_id", offset="offset", base="base", count="count")
    packed = mt.pack_matrices(weights, matrix="matrix_id", offset="offset", base="base")
    tiles = ds.tile_sequences(spark.createDataFrame([(7, "TTACGTTNACG")], "id int, seq string"), sequence="seq", tile=4, halo=2)
    hits = mt.scan_matrices(tiles, packed, sequence="seq", tile=4, min_fraction=0.99).collect()
    # ACG forward at 2 and 8; its reverse complement CGT at 3
    assert sorted((r.start, r.strand) for r in hits) == [(2, "+"), (3, "-"), (8, "+")]
    everything = mt.scan_matrices(tiles, packed, sequence="seq", tile=4).collect()
    assert len(everything) == 9 and sum(r.score == float("-inf") for r in everything) == 3


def test_families_by_first_matching_prefix(spark):
    df = spark.createDataFrame([("CEBPB",), ("Foxa2",), ("NR1H4",), ("HNF4A",), ("SPI1",), ("ZNF5",), ("XYZ",)], "n string")
    got = [r.f for r in df.select(mt.classify_by_prefix("n").alias("f")).collect()]
    assert got == ["C/EBP/bZIP", "FOX/forkhead", "nuclear receptor", "HNF4/nuclear receptor", "KLF/SP", "zinc finger", "XYZ"]


def test_a_component_without_another_order_has_no_state(spark):
    from sitewright.operators import scoring as sc
    from sitewright.plans.designs import keyed_states

    rows = [(1, "h1", 0, 8, "ACGTTTTT", 1), (2, "h2", 0, 8, "ACGTACGA", 1)]
    df = spark.createDataFrame(rows, "id int, region_hash string, at int, stop int, seq string, a int")
    states = ds.component_design(
        df, sequence="seq", anchor="a", components=[("arm", "arm", [(3, 6)])], seeds=[3], alleles={"REF": "G"}, region=["id"]
    )
    found = {r.id: (r.edited, r.state_key) for r in keyed_states(states).collect()}
    assert found[1] == (None, None)
    assert found[2][0] is not None and found[2][1] not in (None, "h2")
    text = F.lit(None).cast("string")
    assert spark.range(1).select(sc.state_key(F.lit("h"), sc.one_edit(F.lit(0), F.lit(1), text, F.lit("A")))).first()[0] is None


def test_motifs_are_scored_where_they_are(spark):
    weights = spark.createDataFrame([("m", k, b, float(10 * k + i)) for k in range(2) for i, b in enumerate("ACGT")], "m string, o int, b string, log_odds double")
    rows = [(1, "m", "AC"), (1, "m", "AC"), (2, "m", "TT"), (3, "m", "AN"), (4, "m", ""), (5, "m", None), (6, "other", "AC")]
    df = spark.createDataFrame(rows, "i int, m string, s string")
    found = mt.score_oriented(df, weights, ["i"], matrix="m", offset="o", base="b", motif="s", name="v").collect()
    low = float("-inf")
    assert sorted((r.i, r.v) for r in found if r.v is not None) == [(1, 11.0), (1, 11.0), (2, 16.0), (3, low), (6, low)]
    assert sorted(r.i for r in found if r.v is None) == [4, 5]


def test_scan_passes_tiles_without_a_sequence(spark):
    counts = spark.createDataFrame([("m", k, b, 9 if b == "ACG"[k] else 0) for k in range(3) for b in "ACGT"], "matrix_id string, offset int, base string, count int")
    packed = mt.pack_matrices(mt.log_odds(counts, matrix="matrix_id", offset="offset", base="base", count="count"), matrix="matrix_id", offset="offset", base="base")
    # more bases than are scanned at a time
    tiles = spark.createDataFrame([(0, 0, None), *((i, 0, "TACGT" + "T" * 995) for i in range(1, 600))], "id int, tile_start int, seq string")
    hits = mt.scan_matrices(tiles.repartition(1), packed, sequence="seq", tile=1000, min_fraction=0.99).collect()
    assert sorted((r.id, r.start, r.strand) for r in hits if r.strand == "+") == [(i, 1, "+") for i in range(1, 600)]


def test_whole_texts_are_shuffled_as_pieces_are(spark):
    rows = [(1, DNA), (2, "ACNNGT-TTé"), (3, ""), (None, "ACGTTGCA"), (5, None), (6, "A")]
    df = spark.createDataFrame(rows, "i int, s string")
    keys = (F.lit("20"), F.col("i"))
    for r in df.select(ds.shuffled(F.col("s"), *keys).alias("a"), ds.shuffled_texts(F.col("s"), *keys).alias("b")).collect():
        assert r.a == r.b


def test_occurrences_are_not_looked_up_at_every_place(spark):
    texts = ["ATATATATGATAT", "ATAT", "TAT", "", None, "é\U0001f600ATATATxATAT\nATAT", "x.+x.+x"]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    for pattern in ("ATAT", ".+x"):
        found = df.select("s", sq.occurrences("s", pattern).alias("o"))
        assert "sequence(" not in found._jdf.queryExecution().optimizedPlan().toString()
        for r in found.collect():
            assert r.o == [i for i in range(len(r.s or "")) if r.s[i:].startswith(pattern)]


def test_canonical_count(spark):
    df = spark.createDataFrame([("ACGTN-acgé",), ("",), (None,)], "s string")
    counted = df.select(sq.canonical_count("s").alias("n"))
    assert "regexp" not in counted._jdf.queryExecution().optimizedPlan().toString()
    assert [r.n for r in counted.collect()] == [4, 0, None]


def test_profiles_and_controls_are_dealt_by_their_rows(spark, monkeypatch):
    from sitewright.operators import catalog, contacts
    from sitewright.plans import contact_maps

    small = "/root/testdata/sf0.001"
    whole = sorted(contact_maps.matched_controls(spark, small).collect())
    monkeypatch.setattr(contacts, "PROFILE_ROWS_PER_TASK", 60)
    monkeypatch.setattr(catalog, "PROFILE_ROWS_PER_TASK", 60)
    profile = contact_maps.day_profile(spark, small)
    assert profile.rdd.getNumPartitions() >= 10  # the session shuffles to 4
    assert len(whole) > 0 and sorted(contact_maps.matched_controls(spark, small).collect()) == whole

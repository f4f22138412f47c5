"""Sequence and perturbation-design queries. Document texts, folded onto A, C, G, T, are the sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequences as sq
from ..operators import catalog as ct
from ..operators import design as ds
from ..operators import intervals as op
from ..operators import scoring as sc
from .registry import query, rounded, table

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FOLDED = "".join("ACGT"[i % 4] for i in range(26))

def nuc_sql(room: int | str = 1) -> str:
    """Folded texts, and those with the ``room`` (bases, or an expression over doc_id) that a design needs."""
    return f"""
nuc AS (SELECT doc_id, translate(regexp_replace(text, '[^A-Za-z]', '', 'g'), '{LETTERS + LETTERS.lower()}', '{FOLDED + FOLDED}') AS seq FROM documents),
long AS (SELECT doc_id, seq, length(seq) AS n, length(seq) // 2 AS a FROM nuc WHERE length(seq) >= {room})
"""


NUC_SQL = nuc_sql()


def nucleotides(spark, sf_dir):
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    # a generator row: filters on seq stay above it instead of repeating the folding per condition
    return texts.select("doc_id", F.explode(F.array(sq.as_nucleotides("text"))).alias("seq"))


def long_sequences(spark, sf_dir, room: int | str = 1):
    """Sequences with room for a design around their middle base ``a`` (0-based)."""
    n = F.length("seq")
    return nucleotides(spark, sf_dir).where(n >= F.expr(str(room))).withColumn("n", n).withColumn("a", F.floor(n / 2).cast("int"))


def middle_windows(spark, sf_dir, room, left: int, right: int):
    """The bases around the middle one as a region's window: a design cuts, shuffles and edits those alone, and its states
    are edits of the whole sequence."""
    whole = long_sequences(spark, sf_dir, room).withColumn("region_hash", sq.content_hash("seq"))
    return whole.select(
        "doc_id", "region_hash", (F.col("a") - left).alias("at"), (F.col("a") + right + 1).alias("stop"), F.lit(left).alias("a"),
        F.substring(F.col("seq"), F.col("a") - left + 1, F.lit(left + right + 1)).alias("seq"),
    )


def middle_sql(left: int, right: int) -> str:
    """The same in SQL, as a table ``mid``."""
    return f"""mid AS (SELECT doc_id, sha256(s) AS h, a0 - {left} AS first0, a0 + {right + 1} AS stop0, {left} AS a, substr(s, a0 - {left - 1}, {left + right + 1}) AS seq
  FROM (SELECT doc_id, seq AS s, a AS a0 FROM long))"""


def keyed_states(states):
    """States with the key of the whole sequence under the window's edit."""
    return states.withColumn("state_key", sc.state_key("region_hash", sc.one_edit("at", "stop", "edited", "seq")))


def key_sql(edited: str) -> str:
    return f"CASE WHEN {edited} = seq THEN h WHEN {edited} IS NOT NULL THEN sha256(h || '|' || first0 || ':' || stop0 || ':' || {edited}) END"


def designed(name: str, sql: str, *, room: int | str, may_fail: str | None = None):
    """Register a design query that answers for every text: one without the ``room`` that this design needs, or (where
    ``may_fail`` names the column that is missing then) one whose state cannot be built, comes out with the reason in
    ``design_status``."""
    status = f"CASE WHEN {may_fail} IS NULL THEN 'no other order' ELSE 'designed' END" if may_fail else "'designed'"
    full = f"""
SELECT *, {status} AS design_status FROM ({sql})
UNION ALL BY NAME SELECT doc_id, 'too short' AS design_status FROM (WITH {nuc_sql(room)} SELECT doc_id FROM nuc WHERE coalesce(length(seq), 0) < {room})
"""

    def register(fn):
        @query(name, full)
        def every_text(spark, sf_dir):
            states = fn(spark, sf_dir)
            made = F.lit("designed")
            if may_fail:
                made = F.when(F.col(may_fail).isNull(), "no other order").otherwise(made)
            short = nucleotides(spark, sf_dir).where(F.coalesce(F.length("seq"), F.lit(0)) < F.expr(str(room)))
            short = short.select("doc_id", F.lit("too short").alias("design_status"))
            return states.withColumn("design_status", made).unionByName(short, allowMissingColumns=True)

        return fn

    return register


def sql_shuffle(text: str, *key: str) -> str:
    digest = "md5(concat_ws(':', " + ", ".join(key) + ", i))"
    return (
        f"array_to_string(list_transform(list_sort(list_transform(range(length({text})), lambda i: "
        f"{{'k': {digest}, 'i': i, 'c': substr({text}, i + 1, 1)}})), lambda x: x.c), '')"
    )


@query(
    "substitutions",
    f"""
WITH {NUC_SQL},
b AS (SELECT doc_id, unnest(string_split(seq, '')) AS ref, unnest(range(1, length(seq) + 1)) AS position FROM nuc WHERE length(seq) > 0)
SELECT doc_id, count(*) AS n, sum(position)::BIGINT AS position_sum, count(*) FILTER (WHERE alt = 'A') AS n_alt_a, count(*) FILTER (WHERE ref = 'C' AND alt = 'T') AS n_c_to_t
FROM b, (VALUES ('A'), ('C'), ('G'), ('T')) v(alt) WHERE alt <> ref GROUP BY 1
""",
)
def substitutions(spark, sf_dir):
    states = ds.substitutions(nucleotides(spark, sf_dir), sequence="seq")
    return states.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("position").cast("bigint")).alias("position_sum"),
        F.count(F.when(F.col("alt") == "A", 1)).alias("n_alt_a"),
        F.count(F.when((F.col("ref") == "C") & (F.col("alt") == "T"), 1)).alias("n_c_to_t"),
    )


@designed(
    "deletion_grid",
    f"""
WITH {nuc_sql(9)}
SELECT doc_id, u::INTEGER AS upstream, d::INTEGER AS downstream, sha256(substr(substr(seq, 1, a - u) || substr(seq, a + d + 1), 1, n - 8)) AS sequence_sha256
FROM long, range(0, 5) x(u), range(0, 5) y(d)
""",
    room=9,
)
def deletion_grid(spark, sf_dir):
    base = long_sequences(spark, sf_dir, 9).withColumn("keep", F.col("n") - 8)
    grid = ds.deletion_grid(base, sequence="seq", cut="a", upstream=4, downstream=4, length="keep")
    return grid.select("doc_id", "upstream", "downstream", "sequence_sha256")


@designed(
    "repair_event_states",
    f"""
WITH {nuc_sql(17)}
SELECT doc_id, 'deletion' AS operation, sha256(substr(substr(seq, 1, a) || substr(seq, a + 6), 1, n - 16)) AS sequence_sha256 FROM long
UNION ALL SELECT doc_id, 'insertion', sha256(substr(substr(seq, 1, a) || 'GATTA' || substr(seq, a + 1), 1, n - 16)) FROM long
""",
    room=17,
)
def repair_event_states(spark, sf_dir):
    base = long_sequences(spark, sf_dir, 17).withColumn("keep", F.col("n") - 16)
    events = F.array(
        F.struct(F.lit("deletion").alias("operation"), F.substring(F.col("seq"), F.col("a") + 1, F.lit(5)).alias("event")),
        F.struct(F.lit("insertion").alias("operation"), F.lit("GATTA").alias("event")),
    )
    listed = base.withColumn("_e", F.explode(events)).select("*", "_e.*").drop("_e")
    states = ds.apply_event(listed, sequence="seq", boundary="a", operation="operation", event="event", length="keep")
    return states.select("doc_id", "operation", "sequence_sha256")


@query(
    "complement_windows",
    f"""
WITH {NUC_SQL},
w AS (SELECT doc_id, s, translate(substr(seq, s + 1, 10), 'ACGT', 'TGCA') AS r FROM (SELECT doc_id, seq, unnest(range(0, length(seq) - 9, 5)) AS s FROM nuc WHERE length(seq) >= 10))
SELECT doc_id, count(*) AS n_windows, sum(s + 9)::BIGINT AS end_sum, sum(length(r))::BIGINT AS n_changed, sum(length(r) - length(replace(r, 'A', '')))::BIGINT AS n_a FROM w GROUP BY 1
""",
)
def complement_windows(spark, sf_dir):
    # tiles keep every row short; a window belongs to the tile it starts in
    tiles = ds.tile_sequences(nucleotides(spark, sf_dir), sequence="seq", tile=1000, halo=9)
    windows = ds.complement_windows(tiles, sequence="seq", width=10, step=5).where("window_start < 1000")
    return windows.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_windows"),
        F.sum((F.col("tile_start") + F.col("window_end")).cast("bigint")).alias("end_sum"),
        F.sum(F.col("n_changed").cast("bigint")).alias("n_changed"),
        F.sum((F.length("replacement") - F.length(F.replace("replacement", F.lit("A"), F.lit("")))).cast("bigint")).alias("n_a"),
    )


@query(
    "composition_shuffle",
    f"""
WITH {NUC_SQL}
SELECT doc_id, sha256({sql_shuffle('seq', "'20'", 'doc_id')}) AS shuffled_sha256 FROM nuc WHERE length(seq) > 0
""",
)
def composition_shuffle(spark, sf_dir):
    base = nucleotides(spark, sf_dir).where(F.length("seq") > 0)
    return base.select("doc_id", sq.content_hash(ds.shuffled_texts(F.col("seq"), F.lit("20"), F.col("doc_id"))).alias("shuffled_sha256"))


HALF = 40
BOUNDARY_SQL = f"""
{middle_sql(HALF, HALF)},
seeded AS (SELECT mid.*, seed FROM mid, (VALUES (1), (2)) s(seed)),
arms AS (SELECT *, substr(seq, 1, {HALF}) AS l, substr(seq, a + 2, {HALF}) AS r FROM seeded),
tpl AS (SELECT *, {sql_shuffle('l', 'seed', "'left'", 'doc_id')} || substr(seq, a + 1, 1) || {sql_shuffle('r', 'seed', "'right'", 'doc_id')} AS t FROM arms),
grid AS (SELECT *, substr(CASE WHEN cond = 'outside_scramble' THEN t ELSE seq END, 1, a - u) || substr(CASE WHEN cond = 'outside_scramble' THEN seq ELSE t END, a - u + 1, u + d + 1)
                || substr(CASE WHEN cond = 'outside_scramble' THEN t ELSE seq END, a + d + 2) AS bg
         FROM tpl, range(10, 12) x(u), range(6, 8) y(d), (VALUES ('outside_scramble'), ('inside_scramble')) c(cond)),
st AS (SELECT *, substr(bg, 1, a) || base || substr(bg, a + 2) AS edited FROM grid, (VALUES ('REF', 'G'), ('ALT', 'T')) v(allele, base))
"""


@designed(
    "boundary_design",
    f"""
WITH {nuc_sql(2 * HALF + 1)}, {BOUNDARY_SQL}
SELECT doc_id, seed, u::INTEGER AS upstream, d::INTEGER AS downstream, cond AS condition, allele, {key_sql('edited')} AS state_key FROM st
""",
    room=2 * HALF + 1,
)
def boundary_design(spark, sf_dir):
    states = ds.boundary_design(
        middle_windows(spark, sf_dir, 2 * HALF + 1, HALF, HALF), sequence="seq", anchor="a", half=HALF, seeds=[1, 2], upstream=(10, 11),
        downstream=(6, 7), alleles={"REF": "G", "ALT": "T"}, region=["doc_id"],
    )
    return keyed_states(states).select("doc_id", "seed", "upstream", "downstream", "condition", "allele", "state_key")


@designed(
    "recovery_design",
    f"""
WITH {nuc_sql(2 * HALF + 1)}, {middle_sql(HALF, HALF)},
seeded AS (SELECT mid.*, seed FROM mid, (VALUES (5), (6)) s(seed)),
arms AS (SELECT *, substr(seq, 1, {HALF} - 1) AS l, substr(seq, a + 10, {HALF} - 8) AS r FROM seeded),
tpl AS (SELECT *, {sql_shuffle('l', 'seed', "'left'", 'doc_id')} || substr(seq, a, 10) || {sql_shuffle('r', 'seed', "'right'", 'doc_id')} AS t FROM arms),
lv AS (SELECT * FROM (VALUES ('native', 'none', -1), ('motif_only', 'shared', 0), ('upstream_recovery', 'upstream', 2), ('upstream_recovery', 'upstream', 20), ('downstream_recovery', 'downstream', 10), ('downstream_recovery', 'downstream', 30)) v(condition, arm, extent)),
bg AS (SELECT *, CASE condition WHEN 'native' THEN seq WHEN 'motif_only' THEN t
         WHEN 'upstream_recovery' THEN substr(t, 1, a - extent) || substr(seq, a - extent + 1, extent - 1) || substr(t, a)
         ELSE substr(t, 1, a + 9) || substr(seq, a + 10, extent - 8) || substr(t, a + extent + 2) END AS bg FROM tpl, lv),
st AS (SELECT *, substr(bg, 1, a) || base || substr(bg, a + 2) AS edited FROM bg, (VALUES ('REF', 'G'), ('ALT', 'T')) v(allele, base))
SELECT doc_id, seed, condition, arm, extent, allele, {key_sql('edited')} AS state_key FROM st
""",
    room=2 * HALF + 1,
)
def recovery_design(spark, sf_dir):
    states = ds.recovery_design(
        middle_windows(spark, sf_dir, 2 * HALF + 1, HALF, HALF), sequence="seq", anchor="a", half=HALF, seeds=[5, 6],
        upstream_extents=[0, 2, 20], downstream_extents=[0, 10, 30], protect_from=-1, protect_to=8, alleles={"REF": "G", "ALT": "T"},
        region=["doc_id"],
    )
    return keyed_states(states).select("doc_id", "seed", "condition", "arm", "extent", "allele", "state_key")


COMPONENTS = [("native", "control", []), ("hotspot", "hotspot", [(-30, -19)]), ("motif", "positive_control", [(-1, 8)]), ("both_arms", "arm", [(-25, -2), (9, 25)])]


def _differing(text: str, *key: str) -> str:
    """A keyed order that differs: turned by one letter if the draw repeats the text, NULL for a single letter."""
    drawn = sql_shuffle(text, *key)
    turned = f"substr({drawn}, 2) || substr({drawn}, 1, 1)"
    return f"CASE WHEN {drawn} <> {text} THEN {drawn} WHEN {turned} <> {text} THEN {turned} END"


@designed(
    "component_design",
    f"""
WITH {nuc_sql(60)}, {middle_sql(30, 25)},
cut AS (SELECT *, substr(seq, 1, 12) AS hot, substr(seq, 6, 24) AS up, substr(seq, 40, 17) AS down FROM mid),
s AS (SELECT *, {_differing('hot', "'3'", "'hotspot'", "'0'", 'doc_id')} AS hs, {_differing('up', "'3'", "'both_arms'", "'0'", 'doc_id')} AS us, {_differing('down', "'3'", "'both_arms'", "'1'", 'doc_id')} AS dns FROM cut),
bg AS (
  SELECT *, 'native' AS component, seq AS bg FROM s
  UNION ALL SELECT *, 'hotspot', hs || substr(seq, 13) FROM s
  UNION ALL SELECT *, 'both_arms', substr(seq, 1, 5) || us || substr(seq, 30, 10) || dns FROM s),
st AS (SELECT *, substr(bg, 1, a) || base || substr(bg, a + 2) AS edited FROM bg, (VALUES ('REF', 'G'), ('ALT', 'T')) v(allele, base))
SELECT doc_id, component, allele, {key_sql('edited')} AS state_key FROM st
""",
    room=60,
    may_fail="state_key",
)
def component_design(spark, sf_dir):
    states = ds.component_design(
        middle_windows(spark, sf_dir, 60, 30, 25), sequence="seq", anchor="a", components=[c for c in COMPONENTS if c[0] != "motif"], seeds=[3],
        alleles={"REF": "G", "ALT": "T"}, region=["doc_id"],
    )
    return keyed_states(states).select("doc_id", "component", "allele", "state_key")


@designed(
    "motif_component_states",
    f"""
WITH {nuc_sql(17)},
m AS (SELECT *, substr(seq, a, 1) || substr(seq, a + 2, 8) AS piece FROM long),
s AS (SELECT *, piece = repeat(substr(piece, 1, 1), 9) AS plain FROM m)
SELECT doc_id, allele, CASE WHEN NOT plain THEN length(seq)::INTEGER END AS n_bases, CASE WHEN NOT plain THEN substr(seq, 1, a - 1) END AS before,
       CASE WHEN NOT plain THEN CASE allele WHEN 'REF' THEN 'G' ELSE 'T' END END AS anchor_base, CASE WHEN NOT plain THEN substr(seq, a + 10) END AS after,
       CASE WHEN NOT plain THEN array_to_string(list_sort(string_split(piece, '')), '') END AS composition, NOT plain AS changed
FROM s, (VALUES ('REF'), ('ALT')) v(allele)
""",
    room=17,
)
def motif_component_states(spark, sf_dir):
    """Scramble around a protected anchor: everything outside and the composition inside must be kept."""
    a = F.col("a")
    states = ds.component_design(
        long_sequences(spark, sf_dir, 17), sequence="seq", anchor="a", components=[c for c in COMPONENTS if c[0] == "motif"], seeds=[3],
        alleles={"REF": "G", "ALT": "T"}, region=["doc_id"],
    )
    inside = F.concat(F.substring(F.col("edited"), a, F.lit(1)), F.substring(F.col("edited"), a + 2, F.lit(8)))
    letters = F.filter(F.split(inside, ""), lambda c: c != "")
    return states.select(
        "doc_id",
        "allele",
        F.length("edited").alias("n_bases"),
        F.substring(F.col("edited"), F.lit(1), a - 1).alias("before"),
        sq.base_at("edited", a).alias("anchor_base"),
        F.substring(F.col("edited"), a + 10, F.length("edited")).alias("after"),
        F.array_join(F.array_sort(letters), "").alias("composition"),
        (F.coalesce("n_changed", F.lit(0)) > 0).alias("changed"),
    )


#: Donors go before the start site on the plus strand, after it on the minus strand.
DONOR_TRANSFER_ROOM = "CASE WHEN doc_id % 2 = 0 THEN 49 ELSE 117 END"


@designed(
    "donor_transfer",
    f"""
WITH {nuc_sql(DONOR_TRANSFER_ROOM)},
g AS (SELECT doc_id, n, a, CASE WHEN doc_id % 2 = 0 THEN '+' ELSE '-' END AS strand, substr(seq, 1, a) || 'G' || substr(seq, a + 2) AS seq FROM long),
f AS (SELECT *, substr(seq, a - 10 + 1, 17) AS nat, substr(seq, a - 10 + 1, 10) || 'T' || substr(seq, a + 2, 6) AS oth FROM g),
sc AS (SELECT *, substr(oth, 1, 10) || substr(oth, 12) AS movable FROM f),
dn AS (SELECT doc_id, seq, n, a, strand, 'native' AS donor_group, nat AS donor FROM f UNION ALL SELECT doc_id, seq, n, a, strand, 'other', oth FROM f),
p AS (SELECT *, CASE WHEN strand = '-' THEN 60 + dist + 1 ELSE 60 - dist - 17 END AS s1 FROM dn, (VALUES (10), (40)) v(dist))
SELECT doc_id, donor_group, dist AS distance, s1::INTEGER AS placement_start, sha256(substr(seq, 1, s1 - 1) || donor || substr(seq, s1 + 17)) AS sequence_sha256 FROM p
""",
    room=DONOR_TRANSFER_ROOM,
)
def donor_transfer(spark, sf_dir):
    """Native and other-allele donors moved upstream of a start site at position 60 of the same sequence."""
    base = long_sequences(spark, sf_dir, DONOR_TRANSFER_ROOM).withColumn("seq", sq.set_base("seq", F.col("a"), "G"))
    donors = ds.donor_fragments(base, sequence="seq", anchor="a", upstream=10, downstream=6, native_base="G", other_base="T", seed=9, region=["doc_id"])
    joined = donors.where("donor_group <> 'scrambled'").join(base.select("doc_id", "seq"), "doc_id")
    sited = joined.withColumn("strand", F.when(F.col("doc_id") % 2 == 0, "+").otherwise("-")).withColumn("tss", F.lit(60))
    placed = ds.place_upstream(sited, sequence="seq", tss="tss", strand="strand", origin0=F.lit(0), donor="donor", distances=[10, 40])
    return placed.select("doc_id", "donor_group", "distance", "placement_start", "sequence_sha256")


@designed(
    "scrambled_donors",
    f"""
WITH {nuc_sql(20)},
f AS (SELECT doc_id, substr(seq, a - 9, 10) || 'T' || substr(seq, a + 2, 6) AS oth FROM long),
z AS (SELECT doc_id, list_transform(list_sort(list_transform(list_filter(range(17), lambda i: i <> 10), lambda i: {{'k': md5(concat_ws(':', '9', doc_id, i)), 'i': i, 'c': substr(oth, i + 1, 1)}})), lambda x: x.c) AS m FROM f)
SELECT doc_id, array_to_string(m[1:10], '') || 'T' || array_to_string(m[11:16], '') AS donor FROM z
""",
    room=20,
)
def scrambled_donors(spark, sf_dir):
    base = long_sequences(spark, sf_dir, 20).withColumn("seq", sq.set_base("seq", F.col("a"), "G"))
    donors = ds.donor_fragments(base, sequence="seq", anchor="a", upstream=10, downstream=6, native_base="G", other_base="T", seed=9, region=["doc_id"])
    return donors.where("donor_group = 'scrambled'").select("doc_id", "donor")


@designed(
    "site_states",
    f"""
WITH {nuc_sql(129)},
sites AS (SELECT doc_id, seq, role, off FROM long, (VALUES ('high_contact', 20), ('low_contact_1', 70), ('low_contact_2', 120)) v(role, off))
SELECT doc_id, 'native_shared' AS role, 'native' AS construct, sha256(seq) AS sequence_sha256 FROM long
UNION ALL
SELECT doc_id, role, construct, sha256(substr(seq, 1, off) || donor || substr(seq, off + length(donor) + 1)) FROM sites, (VALUES ('major', 'ACGTGACGT'), ('minor', 'ACGTTACGT')) d(construct, donor)
""",
    room=129,
)
def site_states(spark, sf_dir):
    roles = F.array(*[F.struct(F.lit(r).alias("role"), F.lit(o).cast("bigint").alias("off")) for r, o in (("high_contact", 20), ("low_contact_1", 70), ("low_contact_2", 120))])
    sites = long_sequences(spark, sf_dir, 129).withColumn("_r", F.explode(roles)).select("doc_id", "seq", F.lit(1000).alias("start0"), "_r.role", (F.col("_r.off") + 1000).alias("slot"))
    states = ds.site_states(sites, ["doc_id"], sequence="seq", origin0="start0", role="role", replacement_start="slot", donors={"major": "ACGTGACGT", "minor": "ACGTTACGT"})
    return states.select("doc_id", "role", "construct", "sequence_sha256")


#: The event lies on one side of the middle base.
SPANNING_DELETION_ROOM = "CASE WHEN doc_id % 2 = 0 THEN 17 ELSE 22 END"


@designed(
    "spanning_deletion",
    f"""
WITH {nuc_sql(SPANNING_DELETION_ROOM)},
e AS (SELECT doc_id, seq, a AS anchor, CASE WHEN doc_id % 2 = 0 THEN a + 6 ELSE a - 9 END AS ds FROM long),
w AS (SELECT *, least(anchor, ds - 1) AS lo, greatest(anchor, ds + 3) AS hi FROM e)
SELECT doc_id, lo AS position, substr(seq, lo, hi - lo + 1) AS ref, substr(seq, lo, ds - lo) || substr(seq, ds + 4, hi - ds - 3) AS alt FROM w
""",
    room=SPANNING_DELETION_ROOM,
)
def spanning_deletion(spark, sf_dir):
    base = long_sequences(spark, sf_dir, SPANNING_DELETION_ROOM).withColumn("anchor", F.col("a").cast("bigint"))
    base = base.withColumn("ds", F.when(F.col("doc_id") % 2 == 0, F.col("anchor") + 6).otherwise(F.col("anchor") - 9)).withColumn("de", F.col("ds") + 3)
    out = ds.spanning_deletion(base, sequence="seq", origin=1, anchor="anchor", deletion_start="ds", deletion_end="de")
    return out.select("doc_id", "position", "ref", "alt")


@designed(
    "combined_edits",
    f"""
WITH {nuc_sql(12)},
p AS (SELECT doc_id, unnest(range(a - 5, a + 7)) AS position, seq, a FROM long),
c AS (SELECT doc_id, position, CASE WHEN position % 3 = 0 THEN translate(substr(seq, position, 1), 'ACGT', 'TGCA') END AS alt, substr(seq, position, 1) AS ref FROM p)
SELECT doc_id, string_agg(coalesce(alt, ref), '' ORDER BY position) AS edited, string_agg(position::VARCHAR || '>' || alt, ';' ORDER BY position) FILTER (WHERE alt IS NOT NULL) AS edits
FROM c GROUP BY 1
""",
    room=12,
)
def combined_edits(spark, sf_dir):
    base = long_sequences(spark, sf_dir, 12)
    a = F.col("a").cast("bigint")
    windows = base.select("doc_id", (a - 5).alias("s"), (a + 6).alias("e"), F.substring(F.col("seq"), F.col("a") - 5, F.lit(12)).alias("piece"))
    choices = base.select("doc_id", F.explode(F.sequence(a - 8, a + 9)).alias("position"), "seq").where("position % 3 = 0")
    chosen = choices.select("doc_id", "position", sq.complement(F.substring(F.col("seq"), F.col("position").cast("int"), F.lit(1))).alias("alt"))
    return ds.combined_edits(windows, chosen, ["doc_id"], start="s", end="e", sequence="piece", origin="s").select("doc_id", "edited", "edits")


#: What the facts about a junction are called here: the first rule that holds.
FATES = [
    ("downstream = 0 AND size(hits) > 0", "pattern_kept"),
    ("size(crossing) > 0", "pattern_across"),
    ("anchor_index IS NOT NULL", "anchor_left"),
    ("true", "anchor_lost"),
]
GROUPS = [("downstream = 0", "downstream_whole"), ("size(crossing) > 0", "rejoined"), ("true", "broken")]
JUNCTION_ROOM = 53
AUDIT_SQL = """
ev AS (SELECT doc_id, seq, a AS cut, a + 2 AS anchor, u, d, a - u + 1 AS es, a + d AS ee, substr(seq, 1, a - u) || substr(seq, a + d + 1) AS edited FROM long, range(1, 6) x(u), range(0, 3) y(d)),
lo AS (SELECT *, cut - 19 AS w0, substr(edited, (cut - 19)::INTEGER, 40) AS local FROM ev),
hh AS (SELECT *, es - w0 AS ji, list_filter(range(0, 38), lambda i: substr(local, i + 1, 3) = 'TAC') AS h FROM lo),
cr AS (SELECT *, list_filter(h, lambda x: x < ji AND ji <= x + 2) AS c, CASE WHEN anchor BETWEEN es AND ee THEN NULL WHEN anchor < es THEN anchor - w0 ELSE anchor - w0 - (ee - es + 1) END AS ai FROM hh),
st AS (SELECT *, CASE WHEN d = 0 AND len(h) > 0 THEN 'pattern_kept' WHEN len(c) > 0 THEN 'pattern_across' WHEN ai IS NOT NULL THEN 'anchor_left' ELSE 'anchor_lost' END AS fate,
              CASE WHEN d = 0 THEN 'downstream_whole' WHEN len(c) > 0 THEN 'rejoined' ELSE 'broken' END AS junction_group FROM cr)
"""


@designed(
    "junction_audit",
    f"""
WITH {nuc_sql(JUNCTION_ROOM)}, {AUDIT_SQL}
SELECT doc_id, u::INTEGER AS upstream, d::INTEGER AS downstream, es::BIGINT AS event_start, ee::BIGINT AS event_end, greatest(0, least(ee, cut + 4) - greatest(es, cut - 2) + 1)::BIGINT AS motif_overlap,
       local AS local_sequence, array_to_string(h, ';') AS hits, array_to_string(c, ';') AS crossing_hits, ji::BIGINT AS junction_index, ai::BIGINT AS anchor_index, fate, junction_group
FROM st
""",
    room=JUNCTION_ROOM,
)
def junction_audit(spark, sf_dir):
    base = long_sequences(spark, sf_dir, JUNCTION_ROOM)
    # the bases that any of the deletions can bring to the junction; positions in them are 1-based
    near = base.select("doc_id", F.col("a").cast("bigint").alias("a"), F.substring(F.col("seq"), F.col("a") - 19, F.lit(48)).alias("seq"))
    grid = near.withColumn("upstream", F.explode(F.sequence(F.lit(1), F.lit(5)))).withColumn("downstream", F.explode(F.sequence(F.lit(0), F.lit(2))))
    placed = grid.withColumns({name: F.lit(20 + at).cast("bigint") for name, at in (("cut", 0), ("anchor", 2), ("m0", -2), ("m1", 4))})
    facts = ds.junction_facts(
        placed, sequence="seq", cut="cut", upstream="upstream", downstream="downstream", anchor="anchor", pattern="TAC", features={"motif": ("m0", "m1")}
    )
    out = ds.labelled(ds.labelled(facts, "fate", FATES), "junction_group", GROUPS)
    moved = F.col("a") - 20
    return out.select(
        "doc_id", "upstream", "downstream", (F.col("event_start") + moved).alias("event_start"), (F.col("event_end") + moved).alias("event_end"),
        F.col("motif_overlap").cast("bigint").alias("motif_overlap"), "local_sequence", F.array_join(F.col("hits").cast("array<string>"), ";").alias("hits"),
        F.array_join(F.col("crossing").cast("array<string>"), ";").alias("crossing_hits"), "junction_index", "anchor_index", "fate", "junction_group",
    )


@query(
    "junction_group_summary",
    f"""
WITH {nuc_sql(JUNCTION_ROOM)}, {AUDIT_SQL},
g AS (SELECT junction_group, (len(h))::DOUBLE AS v FROM st UNION ALL SELECT 'too short', NULL FROM nuc WHERE coalesce(length(seq), 0) < {JUNCTION_ROOM})
SELECT junction_group, count(*) AS n_designs, round(quantile_cont(v, 0.5), 6) AS median, round(avg(v), 6) AS mean, min(v) AS min, max(v) AS max FROM g GROUP BY 1
""",
)
def junction_group_summary(spark, sf_dir):
    """Hits per group of junctions; texts without room are a group without values."""
    from ..operators.aggregates import group_summary

    audit = junction_audit(spark, sf_dir).withColumn("v", F.when(F.col("hits") == "", 0.0).otherwise(F.size(F.split("hits", ";")).cast("double")))
    out = group_summary(audit, ["junction_group"], "v").select("junction_group", F.col("n").alias("n_designs"), "median", "mean", "min", "max")
    short = nucleotides(spark, sf_dir).where(F.coalesce(F.length("seq"), F.lit(0)) < JUNCTION_ROOM)
    none = short.agg(F.count(F.lit(1)).alias("n_designs")).where("n_designs > 0").select(F.lit("too short").alias("junction_group"), "n_designs")
    return rounded(out.unionByName(none, allowMissingColumns=True))


@designed(
    "reference_allele_report",
    f"""
WITH {nuc_sql(1)},
r AS (SELECT doc_id, substr(seq, a + 1, 1) AS b, substr('ACGT', (doc_id % 4 + 1)::INTEGER, 1) AS x, substr('ACGT', ((doc_id + 1 + doc_id % 3) % 4 + 1)::INTEGER, 1) AS y FROM long)
SELECT doc_id, b AS reference_base, CASE WHEN b = x THEN x WHEN b = y THEN y END AS ref, CASE WHEN b = x THEN y WHEN b = y THEN x END AS alt, b = x OR b = y AS reference_ok FROM r
""",
    room=1,
)
def reference_allele_report(spark, sf_dir):
    from .variants import pick_base

    k = F.col("doc_id")
    rows = long_sequences(spark, sf_dir, 1).withColumn("x", pick_base(k)).withColumn("y", pick_base(k + 1 + k % 3))
    return ds.reference_allele_report(rows, sequence="seq", index0="a", candidates=["x", "y"]).select("doc_id", "reference_base", "ref", "alt", "reference_ok")


@designed(
    "region_fetch",
    f"""
WITH {nuc_sql(1)} SELECT doc_id, n // 4 AS s, n - n // 4 AS e, sha256(substr(seq, n // 4 + 1, n - n // 4 - n // 4)) AS region_sha256 FROM long
""",
    room=1,
)
def region_fetch(spark, sf_dir):
    base = long_sequences(spark, sf_dir, 1)
    tiles = ds.tile_sequences(base.select("doc_id", "seq"), sequence="seq", tile=256).withColumnRenamed("seq", "sequence")
    regions = base.select("doc_id", F.floor(F.col("n") / 4).alias("s"), (F.col("n") - F.floor(F.col("n") / 4)).alias("e"))
    got = ds.regions_from_tiles(regions, tiles, ["doc_id"], region_id="doc_id", start0="s", end0="e", tile=256)
    return got.select("doc_id", "s", "e", sq.content_hash("sequence").alias("region_sha256"))


@query(
    "sequence_composition",
    f"""
WITH {NUC_SQL}
SELECT doc_id, length(seq)::BIGINT AS n_bases, round((length(seq) - length(regexp_replace(seq, '[GC]', '', 'g'))) / length(seq)::DOUBLE, 6) AS gc,
       round((length(seq) - length(replace(seq, 'CG', ''))) / 2.0 / greatest(1, length(seq) - 1), 6) AS cpg,
       sha256(reverse(translate(seq, 'ACGT', 'TGCA'))) AS reverse_sha256,
       round((length(regexp_replace(text, '[ACGT]', '', 'g'))) / length(text)::DOUBLE, 6) AS ambiguous
FROM nuc JOIN documents USING (doc_id) WHERE length(seq) > 0
""",
)
def sequence_composition(spark, sf_dir):
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = texts.withColumn("seq", F.explode(F.array(sq.as_nucleotides("text")))).where(F.length("seq") > 0)
    return rounded(
        rows.select(
            "doc_id",
            F.length("seq").cast("bigint").alias("n_bases"),
            sq.gc_fraction("seq").alias("gc"),
            sq.cpg_density("seq").alias("cpg"),
            sq.content_hash(sq.reverse_complement("seq")).alias("reverse_sha256"),
            sq.ambiguous_fraction("text").alias("ambiguous"),
        )
    )


@query(
    "pattern_occurrences",
    f"""
WITH {NUC_SQL},
p AS (SELECT doc_id, unnest(range(0, length(seq) - 3)) AS i, seq FROM nuc WHERE length(seq) >= 4)
SELECT doc_id, count(*) AS n_hits, min(i)::BIGINT AS first_hit, max(i)::BIGINT AS last_hit, sum(i)::BIGINT AS hit_sum FROM p WHERE substr(seq, i + 1, 4) = 'ATAT' GROUP BY 1
""",
)
def pattern_occurrences(spark, sf_dir):
    tiles = ds.tile_sequences(nucleotides(spark, sf_dir), sequence="seq", tile=500, halo=3)
    hits = tiles.select("doc_id", "tile_start", F.explode(sq.occurrences("seq", "ATAT")).alias("o")).where("o < 500")
    at = (F.col("tile_start") + F.col("o")).cast("bigint")
    return hits.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_hits"), F.min(at).alias("first_hit"), F.max(at).alias("last_hit"), F.sum(at).alias("hit_sum"))


@query(
    "packed_keys",
    """
SELECT page_id, split_part(split_part(url, '://', 2), '/', 1) AS host, regexp_replace(regexp_replace(url, '[^A-Za-z0-9_.-]+', '_', 'g'), '^_+|_+$', '', 'g') AS safe_id,
       regexp_extract(url, 'page=([0-9]+)', 1) AS page_number FROM pages
""",
)
def packed_keys(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id",
        sq.packed_field(sq.packed_field("url", "://", 1), "/", 0).alias("host"),
        sq.safe_identifier("url").alias("safe_id"),
        F.regexp_extract("url", "page=([0-9]+)", 1).alias("page_number"),
    )


@designed(
    "site_composition",
    f"""
WITH {nuc_sql(26)},
c AS (SELECT doc_id, seq, n, unnest(range(25, n, 50)) AS center FROM long),
w AS (SELECT *, CASE WHEN center - 30 >= 0 AND center + 30 <= n AND center % 100 = 25 THEN substr(seq, center - 29, 60) END AS x FROM c),
f AS (SELECT doc_id, center, substr(x, 25 + 1, 10) AS slot, substr(x, 1, 25) || substr(x, 36, 25) AS fl FROM w)
SELECT doc_id, center, round((10 - length(regexp_replace(slot, '[GC]', '', 'g'))) / 10.0, 6) AS slot_gc, round((50 - length(regexp_replace(fl, '[GC]', '', 'g'))) / 50.0, 6) AS flank_gc,
       round((50 - length(replace(fl, 'CG', ''))) / 2.0 / 49, 6) AS flank_cpg FROM f
""",
    room=26,
)
def site_composition(spark, sf_dir):
    base = long_sequences(spark, sf_dir, 26)
    tiles = ds.tile_sequences(base.select("doc_id", "seq"), sequence="seq", tile=256).withColumnRenamed("seq", "sequence")
    sites = base.select("doc_id", "n", F.explode(F.sequence(F.lit(25).cast("bigint"), F.col("n").cast("bigint") - 1, F.lit(50).cast("bigint"))).alias("center"))
    out = ct.site_composition(
        sites, tiles, ["doc_id"], center="center", eligible=F.col("center") % 100 == 25, context=60, slot=10, length="n", tile=256
    )
    return rounded(out.select("doc_id", "center", "slot_gc", "flank_gc", "flank_cpg"))


@query(
    "promoter_catalogue",
    """
WITH g AS (SELECT p_partkey, p_brand AS chrom, (p_partkey * 977) % 100000 AS s, (p_partkey * 977) % 100000 + p_size * 100 AS e, CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand,
                  'G' || p_partkey::VARCHAR || '.' || (p_size % 9)::VARCHAR AS gene_id, p_name FROM part),
t AS (SELECT *, CASE WHEN strand = '+' THEN s ELSE e - 1 END AS tss0 FROM g)
SELECT chrom, gene_id, tss0, 'G' || p_partkey::VARCHAR || '__' || p_name || '__tss' || (tss0 + 1)::VARCHAR AS promoter_id, greatest(tss0 - 5000, 0) AS promoter_start0, least(tss0 + 5000, 102000) AS promoter_end0,
       row_number() OVER (PARTITION BY chrom ORDER BY tss0, gene_id, p_name) - 1 AS promoter_index FROM t
""",
)
def promoter_catalogue(spark, sf_dir):
    out = ct.promoter_catalogue(
        gene_table(spark, sf_dir), chrom="chrom", start="s", end="e", strand="strand", gene_id="gene_id", gene_name="p_name", half_width=5000, chrom_length=F.lit(102000)
    )
    return out.select(
        "chrom", "gene_id", "tss0", "promoter_id", F.col("promoter_start0").cast("bigint").alias("promoter_start0"), F.col("promoter_end0").cast("bigint").alias("promoter_end0"), "promoter_index"
    )


def gene_table(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("chrom"), ((k * 977) % 100000).alias("s"), ((k * 977) % 100000 + F.col("p_size") * 100).alias("e"),
        F.when(k % 2 == 0, "+").otherwise("-").alias("strand"),
        F.concat(F.lit("G"), k.cast("string"), F.lit("."), (F.col("p_size") % 9).cast("string")).alias("gene_id"), "p_name",
    )


TRANSCRIPT_SQL = """
t AS (SELECT l_partkey AS gene, CASE WHEN l_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand, l_suppkey * 10 AS s, l_suppkey * 10 + l_linenumber * 5 AS e, CASE WHEN l_returnflag = 'A' THEN 'protein_coding' ELSE 'other' END AS kind,
             l_orderkey AS transcript FROM lineitem)
"""


def transcript_table(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("gene"), F.when(F.col("l_partkey") % 2 == 0, "+").otherwise("-").alias("strand"), (F.col("l_suppkey") * 10).alias("s"),
        (F.col("l_suppkey") * 10 + F.col("l_linenumber") * 5).alias("e"), F.when(F.col("l_returnflag") == "A", "protein_coding").otherwise("other").alias("kind"),
        F.col("l_orderkey").alias("transcript"),
    )


@query(
    "representative_transcript",
    f"""
WITH {TRANSCRIPT_SQL}
SELECT gene, transcript, kind, CASE WHEN strand = '+' THEN s ELSE e END AS candidate_tss FROM (
  SELECT *, row_number() OVER (PARTITION BY gene ORDER BY kind <> 'protein_coding', s, e, transcript) AS rn FROM t) WHERE rn = 1
""",
)
def representative_transcript(spark, sf_dir):
    out = ct.representative_transcript(
        transcript_table(spark, sf_dir), ["gene"], start="s", end="e", strand="strand", kind="kind", preferred="protein_coding", tie=["transcript"]
    )
    return out.select("gene", "transcript", "kind", "candidate_tss")


@query(
    "consensus_tss",
    f"""
WITH {TRANSCRIPT_SQL},
u AS (SELECT gene, CASE WHEN strand = '+' THEN s ELSE e END AS tss, kind FROM t),
p AS (SELECT gene, bool_or(kind = 'protein_coding') AS has FROM u GROUP BY 1),
c AS (SELECT u.gene, u.tss, p.has AS from_preferred, count(*) AS support FROM u JOIN p USING (gene) WHERE NOT p.has OR u.kind = 'protein_coding' GROUP BY 1, 2, 3)
SELECT gene, tss, support, from_preferred FROM (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY support DESC, tss) AS rn FROM c) WHERE rn = 1
""",
)
def consensus_tss(spark, sf_dir):
    return ct.consensus_tss(transcript_table(spark, sf_dir), ["gene"], start="s", end="e", strand="strand", kind="kind", preferred="protein_coding")


@query(
    "bounds_split",
    """
WITH g AS (SELECT p_partkey, (p_partkey * 977) % 100000 AS s FROM part)
SELECT p_partkey, CASE WHEN s - 8000 < 0 THEN 'window starts before the sequence' WHEN s + 8000 > 96000 THEN 'window ends after the sequence' END AS skip_reason FROM g
""",
)
def bounds_split(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", ((F.col("p_partkey") * 977) % 100000).alias("s"))
    return ct.split_by_bounds(rows, start0=F.col("s") - 8000, end0=F.col("s") + 8000, length=F.lit(96000)).select("p_partkey", "skip_reason")


@query(
    "merged_set_of_windows",
    """
WITH g AS (SELECT p_brand AS chrom, (p_partkey * 977) % 100000 AS s FROM part), w AS (SELECT chrom, greatest(s - 300, 0) AS s, s + 300 AS e FROM g),
f AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY chrom ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS o FROM w),
i AS (SELECT *, sum(o) OVER (PARTITION BY chrom ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM f)
SELECT chrom, min(s) AS start, max(e) AS "end", count(*) AS n_merged FROM i GROUP BY chrom, k
""",
)
def merged_set_of_windows(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("chrom"), ((F.col("p_partkey") * 977) % 100000).alias("s"))
    windows = rows.select("chrom", F.greatest(F.col("s") - 300, F.lit(0)).alias("a"), (F.col("s") + 300).alias("b"))
    return op.merge_intervals(windows, ["chrom"], "a", "b", tile=4096)

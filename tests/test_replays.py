"""Published summary statistics reproduced from their published inputs."""

import math

import pytest
from pyspark.sql import functions as F

from sitewright.operators import association as asn
from sitewright.operators import intervals as op
from sitewright.operators import joins as jn

# Correlation and pair count per element and assay.
ELEMENTS = [
    ("e1", "DNASE", 885, 0.47383454114923224), ("e1", "ATAC", 885, 0.4765381857403055), ("e2", "DNASE", 1790, 0.04542004436744993),
    ("e3", "DNASE", 949, 0.33611215065542727), ("e3", "ATAC", 949, 0.35155821446128593), ("e4", "DNASE", 1369, 0.17206899380083873),
    ("e5", "DNASE", 1376, 0.6323839414272215), ("e5", "ATAC", 1376, 0.630794541029482), ("e6", "DNASE", 1784, 0.689441013292506),
    ("e6", "ATAC", 1784, 0.62639098815896),
]
POOLED = {
    "ATAC": (4, 0.5313265961832118, 0.3957346508726986, 0.6442479268174567, 0.030442666633124393, 113.54191766436647, 97.35780400603406, 1.896617251190778e-24),
    "DNASE": (6, 0.4186408547040226, 0.16589829515768836, 0.6197751606321213, 0.12042998009220787, 810.1705684493782, 99.38284600864115, 7.294357184301982e-173),
}


def test_random_effects_pooling(spark):
    df = spark.createDataFrame(ELEMENTS, "element string, modality string, n bigint, rho double")
    for r in asn.random_effects(df, ["modality"], r="rho", n="n").collect():
        want = POOLED[r.modality]
        got = (r.k, r.pooled, r.pooled_low, r.pooled_high, r.tau2, r.q, r.i2_percent, r.q_p)
        assert got == pytest.approx(want, rel=1e-9)


def test_fisher_interval(spark):
    from sitewright.functions.expressions import fisher_bound

    df = spark.createDataFrame([(0.47383454114923224, 885), (0.689441013292506, 1784)], "r double, n bigint")
    got = [r.h for r in df.select("n", fisher_bound("r", "n", 1).alias("h")).orderBy("n").collect()]
    assert got == pytest.approx([0.5233920001536209, 0.713036053173136], rel=1e-12)


def test_loss_against_the_intact_baseline(spark):
    rows = [
        ("intact", "a", 0.051347648355177834), ("intact", "b", 0.06303837998036711), ("w1", "a", 0.05085724757160732),
        ("w1", "b", 0.05654734724951488), ("w3", "a", 0.05183937971896155),
    ]
    df = spark.createDataFrame(rows, "construct string, gene string, v double")
    out = jn.attach_baseline(df, ["gene"], is_baseline=F.col("construct") == "intact", value="v", name="intact_v", tolerance=1e-9)
    got = {(r.construct, r.gene): r.intact_v - r.v for r in out.collect()}
    assert got[("w1", "a")] == pytest.approx(0.000490400783570516, abs=1e-15)
    assert got[("w1", "b")] == pytest.approx(0.006491032730852234, abs=1e-15)
    assert got[("w3", "a")] == pytest.approx(-0.0004917313637837137, abs=1e-15)


def test_hotspot_windows_keep_their_distance(spark):
    """A noisy signal: picks are at least five apart, clear of the protected motif and equal a plain greedy walk."""
    signal = {p: abs(math.sin(p * 0.37) * math.cos(p * 0.11)) for p in range(-250, 251)}
    df = spark.createDataFrame([("g", p, v) for p, v in signal.items()], "gene string, p int, v double")
    windows = op.sliding_windows(df, ["gene"], position="p", value="v", width=12, protected=(-1, 8), tile=64)
    order = [-F.col("mean_value"), -F.col("peak_value"), F.col("start")]
    got = sorted(r.start for r in op.greedy_non_overlapping(windows, ["gene"], start="start", width=12, margin=5, limit=6, order=order).collect())
    candidates = []
    for s in range(-250, 240):
        e = s + 11
        if s <= 8 and e >= -1:
            continue
        x = [signal[p] for p in range(s, e + 1)]
        candidates.append((-sum(x) / 12, -max(x), s))
    kept = []
    for _, _, s in sorted(candidates):
        if all(abs(s - t) > 16 for t in kept):
            kept.append(s)
        if len(kept) == 6:
            break
    assert got == sorted(kept)
    assert windows.count() == len(candidates)


def test_chi_square_tail_small_cases(spark):
    rows = [(3.841458820694124, 1), (5.991464547107979, 2), (11.070497693516351, 5), (0.0, 3)]
    tails = [r[0] for r in spark.createDataFrame(rows, "q double, df int").select(asn.chi2_tail("q", "df")).collect()]
    assert tails == pytest.approx([0.05, 0.05, 0.05, 1.0], rel=1e-9)

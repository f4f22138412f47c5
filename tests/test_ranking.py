import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sitewright.operators import ranking as rk


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds most rows; ties are common; some values are missing."""
    rng = random.Random(3)
    rows = [("hot", float(rng.randrange(400)), i) for i in range(3000)]
    rows += [("cold", float(rng.randrange(20)), 10_000 + i) for i in range(60)]
    rows += [("one", 5.0, 20_000), ("none", None, 20_001)]
    return spark.createDataFrame(rows, "g string, v double, id bigint"), pd.DataFrame(rows, columns=["g", "v", "id"])


@pytest.mark.parametrize("every", [2, 4096])
def test_value_ranks_do_not_depend_on_the_split(skewed, every):
    df, pdf = skewed
    got = {(r.g, r.v): (r.n, r.n_less, r.n_total) for r in rk.value_ranks(df, ["g"], "v", split_every=every).collect()}
    want = {}
    for g, part in pdf.dropna().groupby("g"):
        for v in part.v.unique():
            want[(g, v)] = (int((part.v == v).sum()), int((part.v < v).sum()), len(part))
    assert got == want


def test_hot_groups_are_really_split(skewed):
    df, _ = skewed
    distinct = df.where("v IS NOT NULL").groupBy("g", "v").count()
    cells = rk.with_cells(distinct, ["g"], "v", split_every=2).where("g = 'hot'").select("_cell").distinct().count()
    assert cells > 50


@pytest.mark.parametrize("every", [2, 4096])
@pytest.mark.parametrize("by", [["g"], []])
def test_row_positions_are_dense_and_ordered(skewed, every, by):
    df, pdf = skewed
    rows = rk.row_positions(df.where("v IS NOT NULL"), by, [-F.col("v"), F.col("id")], split_every=every).collect()
    got = {r.id: r.position for r in rows}
    ordered = pdf.dropna().sort_values(["v", "id"], ascending=[False, True])
    groups = ordered.groupby("g") if by else [("", ordered)]
    want = {i: k + 1 for _, part in groups for k, i in enumerate(part.id)}
    assert got == want


@pytest.mark.parametrize("every", [2, 4096])
def test_quantiles_and_moments_match_numpy(skewed, every):
    df, pdf = skewed
    probs = {"q10": 0.1, "median": 0.5, "q90": 0.9}
    for r in rk.distribution(df, ["g"], "v", probs, threshold=10.0, split_every=every).collect():
        x = pdf[pdf.g == r.g].v.dropna()
        assert r.n == len(x)
        assert r.mean == pytest.approx(x.mean())
        assert (r.sd is None) if len(x) == 1 else r.sd == pytest.approx(x.std(ddof=1))
        assert [r.q10, r.median, r.q90] == pytest.approx(list(np.quantile(x, [0.1, 0.5, 0.9])))
        assert r.fraction_at_least == pytest.approx((x >= 10).mean())


def test_average_percentile_and_descending_min_rank(skewed):
    df, pdf = skewed
    columns = {"pct": rk.average_percentile(), "top": rk.min_rank_descending()}
    rows = rk.attach_ranks(df.where("g = 'cold'"), ["g"], "v", columns).orderBy("id").collect()
    part = pdf[pdf.g == "cold"].sort_values("id")
    assert [r.pct for r in rows] == pytest.approx(list(part.v.rank(method="average", pct=True)))
    assert [r.top for r in rows] == list(part.v.rank(method="min", ascending=False).astype(int))


def test_cohorts_split_small_and_overlapping_groups(spark):
    df = spark.createDataFrame([(i,) for i in range(7)], "x int")
    got = {}
    for r in rk.cohorts(df, [], [F.col("x")], 3).collect():
        got.setdefault(r.cohort, set()).add(r.x)
    assert got == {"bottom": {0, 1, 2}, "middle": {2, 3, 4}, "top": {4, 5, 6}}


def test_force_member_takes_the_last_place(spark):
    df = spark.createDataFrame([("a", 5), ("b", 4), ("c", 3), ("must", 1)], "k string, s int")
    rows = rk.force_member(df, [], [F.desc("s"), F.col("k")], 2, F.col("k") == "must").orderBy("rank").collect()
    assert [r.k for r in rows] == ["must", "a"]


def test_cells_count_the_cuts_below(spark):
    """Cuts reach the rows without sending each group to one task, and bisection counts as comparing with all does."""
    rows = spark.createDataFrame([(g, (7 * i) % 1009 / 3) for g in ("a", "b", None) for i in range(1500)] + [("a", None)], "g string, v double")
    celled = rk.with_cells(rows, ["g"], "v", split_every=2)
    joins = [line for line in celled._jdf.queryExecution().sparkPlan().toString().splitlines() if "Join" in line]
    assert len(joins) == 1 and "BroadcastHashJoin" in joins[0]
    cuts = {r.g: r._cuts for r in rk._cut_points(rows, ["g"], "v", 2).collect()}
    assert all(200 < len(set(c)) == len(c) <= rk.SPLIT_POINTS for c in cuts.values()) and len(cuts) == 3
    for r in celled.collect():
        assert r._cell == (0 if r.v is None else sum(c < r.v for c in cuts[r.g]))


def test_spread_join_keeps_rows_and_parts_groups(spark):
    rows = spark.createDataFrame([("a", i) for i in range(200)] + [(None, 1), ("z", 2)], "g string, i int")
    totals = spark.createDataFrame([("a", 10), (None, 20)], "g string, t int")
    joined = rk.join_spread(rows, totals, ["g"], F.col("i"), "left")
    assert "_part" in joined._jdf.queryExecution().optimizedPlan().toString()
    found = sorted(((r.g, r.i, r.t) for r in joined.collect()), key=str)
    assert found == sorted([("a", i, 10) for i in range(200)] + [(None, 1, 20), ("z", 2, None)], key=str)

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitewright.operators import replicates as rp

SCHEMA = "g string, c int, a double, b double, hit boolean"


def rows_of(seed, n=400):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        g = ["u", "v", None][rng.integers(3)]
        a = float(rng.integers(0, 12)) if rng.random() > 0.05 else None
        b = float(np.round((a or 0) + rng.normal(0, 4), 1)) if rng.random() > 0.05 else float("nan")
        out.append((g, int(rng.integers(0, 15)), a, b, bool(rng.random() < 0.4)))
    return [*out, ("one", 1, 1.0, 2.0, False), ("one", 2, 2.0, 3.0, False)]


def mid_ranks(v):
    v = np.asarray(v)
    return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])


def spearman(x, y):
    if len(set(x)) < 2 or len(set(y)) < 2:
        return np.nan
    return np.corrcoef(mid_ranks(x), mid_ranks(y))[0, 1]


def areas(v, y):
    v, y = np.asarray(v), np.asarray(y)
    p, n = y.sum(), (~y).sum()
    if not p:
        return np.nan, np.nan
    pr = sum((y & (v == t)).sum() * (y & (v >= t)).sum() / (v >= t).sum() for t in set(v)) / p
    roc = sum((v[~y] < t).sum() + 0.5 * (v[~y] == t).sum() for t in v[y]) / (p * n) if n else np.nan
    return roc, pr


def draws_of(spark, rows, by, replicates, seed):
    clusters = spark.createDataFrame(rows, SCHEMA).select(*by, "c").distinct()
    found = rp.multiplicities(clusters, by, cluster="c", replicates=replicates, seed=seed).collect()
    return {tuple(r[k] for k in by) + (r.c,): np.frombuffer(r._m, np.uint8) for r in found}


def interval(values):
    values = np.array(values)[np.isfinite(values)]
    return (None, None) if not len(values) else tuple(np.quantile(values, [0.025, 0.975]))


def same(got, want):
    want = [None if w is None or (isinstance(w, float) and np.isnan(w)) else w for w in want]
    assert [g is None for g in got] == [w is None for w in want]
    assert [g for g in got if g is not None] == pytest.approx([w for w in want if w is not None])


def test_multiplicities_add_up_to_the_clusters(spark):
    rows = rows_of(1)
    found = draws_of(spark, rows, ["g"], 20, 3)
    for g in {r[0] for r in rows}:
        own = np.array([m for key, m in found.items() if key[0] == g])
        assert (own.sum(axis=0) == len(own)).all() and (own[:, -1] == 1).all()


@pytest.mark.parametrize("by, split_every", [(["g"], 4096), (["g"], 3), ([], 2)])
def test_bootstrap_spearman_brute_force(spark, by, split_every):
    rows, replicates = rows_of(2), 25
    complete = [r for r in rows if r[2] is not None and np.isfinite(r[3])]
    found = rp.bootstrap_spearman(
        spark.createDataFrame(rows, SCHEMA), by, "a", "b", cluster="c", replicates=replicates, seed=4, split_every=split_every
    )
    draws = draws_of(spark, complete, by, replicates, 4)
    got = {tuple(r[k] for k in by): (r.n, r.spearman, r.ci_low, r.ci_high) for r in found.collect()}
    groups = {(r[0],) if by else () for r in complete}
    assert got.keys() == groups
    for group in groups:
        own = [r for r in complete if not by or (r[0],) == group]
        rho = []
        for k in range(replicates):
            drawn = [r for r in own for _ in range(draws[(*group, r[1])][k])]
            rho.append(spearman([r[2] for r in drawn], [r[3] for r in drawn]))
        same(got[group], [len(own), spearman([r[2] for r in own], [r[3] for r in own]), *interval(rho)])


@pytest.mark.parametrize("split_every", [4096, 3])
def test_ranking_quality_bootstrap_brute_force(spark, split_every):
    rows, replicates = rows_of(5), 12
    used = [r for r in rows if r[2] is not None and np.isfinite(r[3])]
    found = rp.ranking_quality_bootstrap(
        spark.createDataFrame(rows, SCHEMA), ["g"], scores=["a", "b"], positive=F.col("hit"), cluster="c", replicates=replicates,
        seed=6, split_every=split_every,
    )
    draws = draws_of(spark, used, ["g"], replicates, 6)
    got = {(r.g, r.score): tuple(r)[2:] for r in found.collect()}
    assert got.keys() == {(r[0], s) for r in used for s in ("a", "b")}
    for g in {r[0] for r in used}:
        own = [r for r in used if r[0] == g]
        drawn = [[r for r in own for _ in range(draws[(g, r[1])][k])] for k in range(replicates)]
        every = {s: [areas([r[i] for r in d], [r[4] for r in d]) for d in [*drawn, own]] for i, s in ((2, "a"), (3, "b"))}
        for score in ("a", "b"):
            want = [len(own), sum(r[4] for r in own)]
            for kind in (0, 1):
                values = [x[kind] for x in every[score]]
                want += [values[-1], *interval(values[:-1])]
            for kind in (0, 1):
                apart = [x[kind] - y[kind] for x, y in zip(every[score], every["a"])]
                want += [apart[-1], *interval(apart[:-1])] if score == "b" else [None] * 3
            same(got[g, score], want)


def test_bootstraps_of_an_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert rp.bootstrap_spearman(empty, ["g"], "a", "b", cluster="c", replicates=5, seed=1).collect() == []
    found = rp.ranking_quality_bootstrap(empty, ["g"], scores=["a"], positive=F.col("hit"), cluster="c", replicates=5, seed=1)
    assert found.collect() == []


def test_bootstrap_plans_few_scans(spark):
    rows = spark.createDataFrame(rows_of(7), SCHEMA)
    found = rp.bootstrap_spearman(rows, ["g"], "a", "b", cluster="c", replicates=5, seed=1)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= 10


def test_draws_are_dealt_over_tasks(spark, monkeypatch):
    from sitewright.operators import resampling as rs

    clusters = spark.createDataFrame([("a", f"c{i:02}") for i in range(40)] + [(None, "d")], "g string, c string")

    def draws():
        return rs.cluster_draws(clusters, ["g"], cluster="c", replicates=25, seed=3)

    whole = sorted(map(str, draws().collect()))
    monkeypatch.setattr(rs, "DRAWS_PER_TASK", 100)
    assert "_slot#" in (plan := draws()._jdf.queryExecution().executedPlan().toString()) and plan.count(", 11), REPARTITION_BY_NUM") >= 2
    assert sorted(map(str, draws().collect())) == whole
    assert sum(r._times for r in draws().collect()) == 41 * 25


def test_quantile_bins_part_their_groups(spark):
    from sitewright.operators import resampling as rs

    rows = spark.createDataFrame([(g, i) for g in ("a", None) for i in range(20)], "g string, v int")
    binned = rs.quantile_bins(rows, ["g"], "v", 4)
    assert "_part" in binned._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.quantile_bin for r in binned.collect()) == sorted(2 * [1, 2, 3, 4] * 5)


def test_rows_of_frequent_values_are_added_up_before_they_meet(spark):
    n, m = 400, bytes([2, 0, 1])
    shared = spark.createDataFrame([(None if i % 2 else "g", float(i % 4 // 2), i, 1, bytearray(m)) for i in range(n)], "g string, v double, p bigint, t bigint, _m binary")
    rare = spark.createDataFrame([("g", 100.0 + i, 1, 1, bytearray(m)) for i in range(9)], shared.schema)
    found = rp._gathered(shared.unionByName(rare).coalesce(1), ["g", "v"], ["p", "t"]).collect()
    assert len(found) == 4 + 9 and sum(r._added is None for r in found) == 9
    for r in found:
        if r._added is not None:
            p = sum(i for i in range(n) if (None if i % 2 else "g") == r.g and float(i % 4 // 2) == r.v)
            assert np.frombuffer(bytes(r._added)).tolist() == [2 * p, 0, p, 2 * 100, 0, 100]


def test_cells_are_not_interpreted_row_by_row(spark):
    from sitewright.operators.ranking import with_cells

    rows = spark.range(3000).selectExpr("id % 3 AS g", "id AS v")
    celled = with_cells(rows, ["g"], "v", split_every=8)
    plan = celled._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(array" not in plan and "lambdafunction" not in plan.split("_cell", 1)[1].split("Join")[0]
    got = celled.groupBy("g", "_cell").agg({"v": "min", "*": "count"}).orderBy("g", "_cell").collect()
    for g in range(3):
        of = [r for r in got if r.g == g]
        assert [r._cell for r in of] == list(range(len(of))) and len(of) > 50
        assert [r["min(v)"] for r in of] == sorted(r["min(v)"] for r in of)


def test_quantile_bins_are_not_interpreted_row_by_row(spark):
    from sitewright.operators import resampling as rs

    rows = spark.createDataFrame([("a", float(i)) for i in range(20)] + [("a", None), (None, 1.0), (None, 1.0)], "g string, v double")
    binned = rs.quantile_bins(rows, ["g"], "v", 4)
    assert "filter(_edges" not in binned._jdf.queryExecution().optimizedPlan().toString()
    edges = np.quantile(np.arange(20), [0, 0.25, 0.5, 0.75, 1])
    found = {(r.g, r.v): r.quantile_bin for r in binned.collect()}
    assert found == {**{("a", float(i)): max(1, int((edges < i).sum())) for i in range(20)}, ("a", None): None, (None, 1.0): None}

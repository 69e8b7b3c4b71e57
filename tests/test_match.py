import numpy as np
import pandas as pd
import pytest

from upshot.operators import match as M


def _brute(t, c, cal, rule="closest"):
    """Pairs by plain loops. ``closest``: all pairs within the caliper by (distance, treated score, control score, ids), each
    accepted if both are free. ``score_order``: treated by (score, id), each with its nearest free control."""
    pairs, used_t, used_c = [], set(), set()
    if rule == "closest":
        every = sorted((abs(cs - ts), ts, cs, tid, cid) for tid, ts in t.items() for cid, cs in c.items())
    else:
        every = [p for ts, tid in sorted((ts, tid) for tid, ts in t.items())
                 for p in sorted((abs(cs - ts), ts, cs, tid, cid) for cid, cs in c.items())]
    for d, _, _, tid, cid in every:
        if (cal is None or d <= cal) and tid not in used_t and cid not in used_c:
            pairs.append((tid, cid))
            used_t.add(tid)
            used_c.add(cid)
    return sorted(pairs)


def _run(spark, t, c, cal, kind="long", **kw):
    rows = [(k, 1, v) for k, v in t.items()] + [(k, 0, v) for k, v in c.items()]
    df = spark.createDataFrame(rows, f"id {kind}, arm int, s double")
    out = M.match_nearest(df, "id", "arm", "s", caliper=cal, **kw).collect()
    return sorted((r.treatment_id, r.control_id) for r in out), out


@pytest.mark.parametrize("rule", ["closest", "score_order"])
@pytest.mark.parametrize("n_c", [80, 40])           # spare controls / too few
def test_random_against_brute_force(spark, rule, n_c):
    rng = np.random.default_rng(11)
    grid = 1 / 256                         # exact distances, many ties
    t = {i: float(rng.integers(0, 256)) * grid for i in range(60)}
    c = {100 + i: float(rng.integers(0, 256)) * grid for i in range(n_c)}
    for cal, bucket in ((0.05, 12), (0.05, 10_000), (None, 12)):        # many buckets and passes / one
        got, rows = _run(spark, t, c, cal, bucket=bucket, rule=rule)
        assert got == _brute(t, c, cal, rule)
        used = [r.control_id for r in rows]
        assert len(used) == len(set(used))
        assert cal is None or all(r.distance <= cal for r in rows)


def _units(t, c):
    """Blocks of equal score and arm, and the ids of each."""
    cells = {}
    for arm, side in ((1, t), (0, c)):
        for i, s in side.items():
            cells.setdefault((s, arm), []).append(i)
    order = sorted(cells)
    return [[s, arm, len(cells[s, arm])] for s, arm in order], [sorted(cells[k]) for k in order]


def _ids_of(ranges, t_ids, c_ids):
    used_t, used_c, out = {}, {}, []
    for i, j, n, _ in ranges:
        a, b = used_t.get(i, 0), used_c.get(j, 0)
        out += zip(t_ids[i][a:a + n], c_ids[j][b:b + n], strict=True)
        used_t[i], used_c[j] = a + n, b + n
    return sorted(out)


def test_one_bucket_of_both_rules_on_400_random_cases():
    rng = np.random.default_rng(5)
    for case in range(400):
        n, span = int(rng.integers(1, 30)), int(rng.choice([2, 4, 30, 10_000]))
        t = {f"T{i:02}": float(rng.integers(0, span)) / 64 for i in range(n)}
        c = {f"C{i:02}": float(rng.integers(0, span)) / 64 for i in range(int(rng.integers(1, 30)))}
        cal = [None, 0.0, 1 / 64, 0.5][case % 4]
        blocks, ids = _units(t, c)
        assert _ids_of(M._settle(blocks, cal, (None,) * 4), ids, ids) == _brute(t, c, cal)
        tb, cb = ([[s, k] for s, a, k in blocks if a == arm] for arm in (1, 0))
        ti, ci = ([x for x, (_, a, _) in zip(ids, blocks) if a == arm] for arm in (1, 0))
        pairs, more = M._serve(tb, cb, cal, None, None)
        assert not more and _ids_of(pairs, ti, ci) == _brute(t, c, cal, "score_order")


def test_common_scores_a_step_apart(spark):
    n = 30_000
    df = spark.range(2 * n).selectExpr("id", "cast(id % 2 as int) arm", "0.5 + (id % 2) * 0.01 s")
    for rule in ("closest", "score_order"):
        out = M.match_nearest(df, "id", "arm", "s", caliper=0.1, bucket=100, rule=rule)
        assert out.selectExpr("count(*)", "max(round) <= 3", "bool_and(treatment_id = control_id + 1)").first()[:] == (n, True, True)


def test_strata_and_a_grid_of_calipers_in_one_run(spark):
    rng = np.random.default_rng(3)
    rows = [(i, int(i % 3 == 0), float(rng.integers(0, 64)) / 64, ["a", "b", None][i % 7 % 3]) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, arm int, s double, g string")
    grid = df.crossJoin(spark.createDataFrame([(0.0,), (1 / 64,), (0.1,)], "cal double"))
    for rule in ("closest", "score_order"):
        got = M.match_nearest(grid, "id", "arm", "s", caliper="cal", by=["g", "cal"], bucket=20, rule=rule).collect()
        for g in ("a", "b", None):
            for cal in (0.0, 1 / 64, 0.1):
                t, c = ({i: s for i, a, s, h in rows if a == arm and h == g} for arm in (1, 0))
                assert sorted((r.treatment_id, r.control_id) for r in got if r.g == g and r.cal == cal) == _brute(t, c, cal, rule)


def test_string_ids_and_far_arms(spark):
    t = {f"CUST{i:03d}": 0.25 + i / 1024 for i in range(20)}
    c = {f"ACC{i:03d}": 0.75 + i / 512 for i in range(15)}   # all controls above all treated: one chain
    got, _ = _run(spark, t, c, None, kind="string", bucket=8)
    assert got == _brute(t, c, None) and len(got) == 15


def test_many_equal_scores_take_few_passes(spark):
    n = 5000
    df = spark.createDataFrame([(i, i % 2, 0.5) for i in range(2 * n)], "id long, arm int, s double")
    out = M.match_nearest(df, "id", "arm", "s", caliper=0.1).collect()
    assert len(out) == n and max(r["round"] for r in out) == 1
    assert sorted((r.treatment_id, r.control_id) for r in out) == [(2 * i + 1, 2 * i) for i in range(n)]


def test_contention_ties_and_caliper_edge(spark):
    # 3 treated compete for 1 control; equal distance goes to the lower id
    got, _ = _run(spark, {1: 0.5, 2: 0.25, 3: 0.75}, {10: 0.5}, 0.25)
    assert got == [(1, 10)]
    got, _ = _run(spark, {1: 0.5}, {10: 0.25, 11: 0.75}, 0.25)      # tie between two controls
    assert got == [(1, 10)]
    got, _ = _run(spark, {1: 0.5}, {10: 0.75}, 0.25)                 # distance equal to the caliper
    assert got == [(1, 10)]
    got, _ = _run(spark, {1: 0.5}, {10: 0.875}, 0.25)                # out of range
    assert got == []


def test_empty_arm_and_equal_scores(spark):
    got, _ = _run(spark, {1: 0.5, 2: 0.5}, {}, 0.1)
    assert got == []
    got, _ = _run(spark, {1: 0.5, 2: 0.5}, {10: 0.5, 11: 0.5, 12: 0.5}, 0.1)
    assert got == [(1, 10), (2, 11)]


def test_maximal_and_report(spark):
    rng = np.random.default_rng(4)
    t = {i: float(x) for i, x in enumerate(rng.uniform(0, 1, 30))}
    c = {100 + i: float(x) for i, x in enumerate(rng.uniform(0, 1, 20))}
    got, rows = _run(spark, t, c, 0.05)
    mt = {a for a, _ in got}
    mc = {b for _, b in got}
    for a, s in t.items():
        if a in mt:
            continue
        assert all(abs(s - v) > 0.05 for b, v in c.items() if b not in mc)
    units = spark.createDataFrame([(k, 1, v) for k, v in t.items()] + [(k, 0, v) for k, v in c.items()],
                                  "id long, arm int, s double")
    pairs = spark.createDataFrame(pd.DataFrame([r.asDict() for r in rows])) if rows else None
    rep = M.match_report(pairs, units, "arm").first()
    assert rep.matched == len(got) and abs(rep.match_rate - len(got) / 30) < 1e-12


def test_propensity_gradient_is_zero(spark):
    """The first level is dropped, and the penalised log-likelihood of the fit is stationary."""
    rng = np.random.default_rng(8)
    n = 400
    x = rng.normal(size=n)
    arm = (rng.uniform(size=n) < 1 / (1 + np.exp(-2 * x))).astype(int)
    seg = rng.choice(["a", "b", "c"], n)
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "arm": arm, "x": x, "seg": seg}))
    s = M.propensity_scores(df, "arm", ["x"], ["seg"], tol=1e-12).toPandas().sort_values("id")
    design = np.column_stack([x, seg == "b", seg == "c"]).astype(float)
    design = (design - design.mean(axis=0)) / design.std(axis=0)
    p = s.propensity_score.to_numpy()
    logit = np.log(p / (1 - p))
    beta, *_ = np.linalg.lstsq(np.column_stack([np.ones(n), design]), logit, rcond=None)
    assert np.allclose(np.column_stack([np.ones(n), design]) @ beta, logit, atol=1e-6)   # these columns and no others
    gradient = design.T @ (p - arm) + beta[1:]                                           # C = 1
    assert np.abs(gradient).max() < 1e-3 and abs((p - arm).sum()) < 1e-3


def test_gbt_propensity_small(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=200)
    arm = (x + rng.normal(scale=0.5, size=200) > 0).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(200), "arm": arm, "x": x,
                                             "seg": rng.choice(["a", "b"], 200)}))
    scored, auc = M.gbt_propensity(df, "arm", ["x"], ["seg"], trees=5, depth=2, folds=2)
    assert scored.count() == 200 and 0.7 < auc <= 1.0


def test_rounds_of_score_order_broadcast_nothing(spark, monkeypatch):
    """The driver builds no table for the joins of the rounds, however many there are."""
    plans, cut = [], M.cut_lineage

    def kept(df, *a):
        out = cut(df, *a)
        plans.append(df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0])
        return out

    monkeypatch.setattr(M, "cut_lineage", kept)
    t, c = {i: i / 64 for i in range(40)}, {100 + i: i / 128 for i in range(60)}
    got, _ = _run(spark, t, c, 0.3, bucket=8, rule="score_order")
    assert got == _brute(t, c, 0.3, "score_order")
    assert len(plans) > 8 and sum(p.count("BroadcastHashJoin") for p in plans) <= 2  # of the blocks, before the rounds


def test_a_long_shortage_takes_few_rounds_of_score_order(spark, monkeypatch):
    """Each round leaves its jobs in the driver: a shortage that runs through 24,000 scores is served in as many rounds as large buckets."""
    cuts, cut = [], M.cut_lineage
    monkeypatch.setattr(M, "cut_lineage", lambda df, *a: cuts.append(df) or cut(df, *a))
    rng = np.random.default_rng(2)
    s = np.sort(rng.uniform(0.2, 0.8, 24_000))
    arm = (rng.uniform(size=len(s)) < 0.35 + 0.6 * (s - 0.2)).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(len(s)), "arm": arm, "s": s}))
    ids = [np.flatnonzero(arm == k).tolist() for k in (1, 0)]
    pairs, _ = M._serve(*[[[float(s[i]), 1] for i in x] for x in ids], 0.1, None, None)
    want = sorted((ids[0][t], ids[1][c]) for t, c, _, _ in pairs)
    for bucket, rounds in ((None, 1), (8_000, 3)):        # as many as buckets, at most
        cuts.clear()
        got = M.match_nearest(df, "id", "arm", "s", caliper=0.1, bucket=bucket, rule="score_order").collect()
        assert sorted((r.treatment_id, r.control_id) for r in got) == want
        assert max(r["round"] for r in got) <= rounds and len(cuts) <= 4 + 2 * rounds


def test_large_buckets_keep_ranges_of_many_units_and_cells_apart(spark):
    """Blocks of more than a range's units, in two cells with a caliper each, over several buckets."""
    n = M.RANGE + 2_345
    df = spark.range(3 * n).selectExpr("id", "cast(id % 3 = 0 as int) arm", "0.25 + (id % 3) / 16 s").crossJoin(
        spark.createDataFrame([("a", 0.0625), ("b", 0.03125)], "g string, cal double"))
    for bucket in (1, 2, None):
        out = M.match_nearest(df, "id", "arm", "s", caliper="cal", by=["g"], bucket=bucket, rule="score_order")
        assert out.selectExpr("count(*)", "min(g)", "max(g)", "bool_and(control_id = treatment_id + 1)").first()[:] == (n, "a", "a", True)

import numpy as np
import pytest
from pyspark.sql import functions as F

import helpers as H
from voxmill.operators import compare
from voxmill.operators import evaluate as E
from voxmill.operators import matching as G
from voxmill.params import Scoring


def _table(spark, gt, pred):
    volumes = {1: gt}
    both = E.align(
        H.voxel_table(spark, volumes, "label"), H.voxel_table(spark, {1: pred}, "label")
    )
    return E.contingency(both, H.catalog(spark, volumes))


def test_scoring_against_itself_is_perfect(spark):
    gt = H.components(np.random.default_rng(1).random((8, 8, 8)) < 0.2)
    row = E.threshold_metrics(_table(spark, gt, gt), Scoring(1, False, (0.5,))).first()
    assert (row.precision, row.recall, row.f1, row.overseg_ratio_pred_eval_gt) == (1.0, 1.0, 1.0, 1.0)
    assert row.tp == gt.max() and row.fp == row.fn == 0


def test_tie_between_valid_and_border_stays_evaluable(spark):
    gt = np.zeros((5, 5, 8), int)
    gt[2, 2, 1:4] = 1
    gt[2, 2, 5:8] = 2
    pred = np.zeros_like(gt)
    pred[2, 2, 3] = pred[2, 2, 5] = 7
    pred[4, 4, 4] = 8
    pred[2, 2, 6:8] = 9
    table = _table(spark, gt, pred)
    gts = E.true_instances(table, Scoring(1, True, (0.5,)))
    got = {r.pred_id: r.evaluable for r in E.judged_predictions(table, gts).collect()}
    assert got == {7: True, 8: True, 9: False}


def test_no_valid_truth(spark):
    gt = np.zeros((4, 4, 4), int)
    gt[0, 0, :2] = 1
    pred = np.zeros_like(gt)
    pred[0, 0, :2] = 5
    pred[3, 3, 3] = 6
    scoring = Scoring(1, True, (0.5,))
    table = _table(spark, gt, pred)
    rows = {r.pred_id: r.status for r in E.best_per_prediction(table, scoring).collect()}
    assert rows == {5: "no_valid_gt", 6: "background_or_unmatched"}
    assert E.best_per_true(table, scoring).count() == 0
    row = E.threshold_metrics(table, scoring).first()
    assert (row.gt_valid, row.pred_eval, row.tp, row.recall, row.f1) == (0, 1, 0, 0.0, 0.0)


def test_nothing_predicted(spark):
    gt = np.zeros((4, 4, 4), int)
    gt[1, 1, 1] = 1
    row = E.threshold_metrics(_table(spark, gt, np.zeros_like(gt)), Scoring(1, False, (0.5,))).first()
    assert (row.gt_valid, row.pred_total, row.fn, row.precision) == (1, 0, 1, 0.0)


def test_thresholds_must_be_positive(spark):
    gt = np.ones((2, 2, 2), int)
    with pytest.raises(ValueError):
        E.threshold_metrics(_table(spark, gt, gt), Scoring(1, False, (0.0,)))


def _random_problem(rng, vol):
    n, m = rng.integers(1, 6, 2)
    gain = np.where(rng.random((n, m)) < 0.6, np.round(rng.random((n, m)), 3), 0.0)
    return gain, [(vol, g + 1, p + 1, float(gain[g, p])) for g in range(n) for p in range(m) if gain[g, p] > 0]


def _best_pairs(pairs):
    """The heaviest set of disjoint pairs, by trying all."""
    best = (0, ())
    def go(k, used, weight, chosen):
        nonlocal best
        if k == len(pairs):
            best = max(best, (weight, tuple(chosen)))
            return
        _, g, p, iou = pairs[k]
        go(k + 1, used, weight, chosen)
        if ("g", g) not in used and ("p", p) not in used:
            go(k + 1, used | {("g", g), ("p", p)}, weight + G.pair_weight(g, p, iou), [*chosen, (g, p)])
    go(0, frozenset(), 0, [])
    return set(best[1])


def test_matching_is_the_one_optimum(spark):
    """Also where optima tie, or differ by less than doubles of a sum can tell."""
    rng = np.random.default_rng(4)
    problems = [_random_problem(rng, vol)[1] for vol in range(40)]
    problems = [p for p in problems if len(p) <= 14]
    for near in (0.3, 0.3 + 1e-11, 0.3 + 1e-15):
        problems.append([(0, 1, 1, 0.3), (0, 1, 2, near), (0, 2, 1, 0.3), (0, 2, 2, 0.3)])
    problems.append([(0, g, p, 0.25) for g in range(3) for p in range(3)])
    problems.append([(0, 1, 1, 2.0**-70)])
    rows = [(vol, g, p, iou) for vol, own in enumerate(problems) for _, g, p, iou in own]
    table = spark.createDataFrame(rows, "vol_id int, gt_id int, pred_id int, iou double")
    chosen = G.optimal_matching(table).collect()
    for vol, own in enumerate(problems):
        assert {(r.gt_id, r.pred_id) for r in chosen if r.vol_id == vol} == _best_pairs(own)
    with pytest.raises(ValueError, match="knot"):
        G.optimal_matching(table, knot_pairs=3)


def test_a_large_knot_is_solved():
    """A chain of ten thousand pairs, each alternative to its neighbours."""
    n = 5000
    links = [[(r, 10 + r % 3), *([(r + 1, 11)] if r + 1 < n else [])] for r in range(n)]
    taken = G.assign(links, n)
    assert (taken >= 0).all() and len(set(taken.tolist())) == n


def test_best_pair_may_leave_the_optimum(spark):
    pairs = [(1, 1, 1, 0.51), (1, 1, 2, 0.4), (1, 2, 1, 0.4)]
    table = spark.createDataFrame(pairs, "vol_id int, gt_id int, pred_id int, iou double")
    chosen = G.optimal_matching(table).collect()
    assert sorted((r.gt_id, r.pred_id) for r in chosen) == [(1, 2), (2, 1)]


def test_assign_small_matrices():
    rng = np.random.default_rng(9)
    for _ in range(300):
        gain, _ = _random_problem(rng, 0)
        links = [[(c, int(round(w * 1000))) for c, w in enumerate(row) if w > 0] for row in gain]
        taken = G.assign(links, gain.shape[1])
        used = taken[taken >= 0]
        assert len(set(used)) == len(used)
        assert np.isclose(sum(gain[r, c] for r, c in enumerate(taken) if c >= 0), H.best_total(gain))


def test_statistics_of_small_groups(spark):
    rows = [("a", "c1", "m1", 5, 5, 0.5, 0.25, 0.75, 1, 2, 1.0), ("b", "c1", "m1", 5, 5, 1.0, 0.75, 0.25, 3, 4, 2.0),
            ("b", "c1", "m2", 5, 5, 0.1, 0.2, 0.3, 5, 6, 0.5)]
    table = spark.createDataFrame(rows, ", ".join(f"{c} {t}" for c, t in zip(compare.DETAIL, (
        "string string string int int double double double int int double").split())))
    stats = compare.statistics(table, ("m1", "m2", "m3"))
    got = {(r.group, r.method, r.metric): r for r in stats.collect()}
    assert {g for g, *_ in got} == {"ALL", "a", "b"} and ("a", "m2", "f1050") not in got
    assert got["a", "m1", "f1050"].std == 0.0
    assert np.isclose(got["ALL", "m1", "precision050"].std, np.std([0.5, 1.0], ddof=1))
    assert got["ALL", "m1", "total_fp"].mean == 4 and got["ALL", "m1", "total_fp"].median is None
    text = {(r.group, r.method, r.metric): r for r in compare.formatted(stats).collect()}
    assert text["ALL", "m1", "total_fn"].mean == "6" and text["ALL", "m1", "total_fn"].std == ""
    assert text["ALL", "m1", "f1050"].median == "0.500000"

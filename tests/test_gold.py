from datetime import date

import pytest
from pyspark.sql import functions as F

from quarterdeck.operators import folds, forecasts as fc, peers, portfolios as pf
from quarterdeck.plans import gold
from quarterdeck.session import save_stage

QUARTERS = [(date(2024, 3, 31), date(2024, 5, 15)), (date(2024, 6, 30), date(2024, 8, 15)), (date(2024, 9, 30), date(2024, 11, 15)),
            (date(2024, 12, 31), date(2025, 2, 15)), (date(2025, 3, 31), date(2025, 5, 15))]
PANEL = {
    "A": [{"1": .7, "2": .3}, {"1": .6, "2": .4}, {"1": .5, "2": .3, "3": .2}, {"1": .45, "3": .35, "2": .2}, {"1": .4, "3": .4, "2": .2}],
    "B": [{"3": .8, "2": .2}, {"3": .7, "2": .3}, {"3": .6, "2": .4}, {"3": .55, "2": .45}, {"3": .5, "2": .5}],
}
SCHEMA = "cik string, report_period date, filing_date date, security_key string, cusip string, issuer_name string, weight double, rank long, value_usd long"


def build(spark, snaps, cap):
    facts = pf.portfolio_facts(snaps)
    quarters = save_stage(pf.manager_quarters(facts, pf.turnover(snaps)), "q")
    stats = save_stage(peers.peer_statistics(snaps, facts, peers.quarter_cutoffs(quarters)), "s")
    ranked = save_stage(peers.ranked_peers(stats, pf.first_seen(snaps)), "r")
    held = save_stage(peers.held_with_peers(snaps, quarters, ranked), "h")
    negatives = peers.peer_negatives(held, quarters, ranked, cap)
    return quarters, stats, save_stage(gold.build_examples(held, negatives, pf.security_history(snaps)), "g")


@pytest.fixture(scope="module")
def panel(spark):
    rows = []
    for cik, history in PANEL.items():
        for (period, filed), held in zip(QUARTERS, history):
            filed = filed if cik == "A" else filed.replace(day=10)
            for rank, (key, weight) in enumerate(sorted(held.items(), key=lambda kv: -kv[1]), 1):
                rows.append((cik, period, filed, key, key * 9, f"ISSUER {key}", weight, rank, int(weight * 1e6)))
    return build(spark, save_stage(spark.createDataFrame(rows, SCHEMA), "panel"), 2)


def test_panel_examples(panel):
    quarters, _, examples = panel
    assert pf.eligibility_counts(quarters).first().eligible_manager_quarters == 8
    row = examples.filter("cik = 'A' and feature_report_period = date'2024-06-30' and security_key = '3'").first()
    assert row.target_report_period == date(2024, 9, 30) and row.target_action == "new" and row.target_is_new == 1
    assert row.target_weight == pytest.approx(.2) and row.current_rank == 3 and row.holding_history_quarters == 0
    assert row.quarters_since_last_held == -1 and row.peer_owner_count == 1
    first = examples.filter("cik = 'A' and feature_report_period = date'2024-03-31' and security_key = '1'").first()
    assert first.previous_rank == 1 and first.manager_turnover == 0
    found = folds.expanding_folds(examples, 2, 1).orderBy("evaluation_target_quarter").collect()
    assert [f.role for f in found] == ["validation", "test"]
    assert max(found[0].train_target_quarters) < found[0].evaluation_target_quarter
    assert folds.audit_examples(examples).count() == 0
    coverage = gold.coverage_summary(gold.coverage_by_manager_quarter(examples, quarters)).filter("target_report_period is null").first()
    assert coverage.target_candidate_coverage > .8 and coverage.mean_target_weight_mass_coverage > .8


def test_peers_match_brute_force(spark):
    """Late filers, gaps and early amendments against a literal reading."""
    import random
    rng, rows = random.Random(3), []
    for m in range(12):
        for period, filed in QUARTERS:
            if rng.random() < .2:
                continue
            available = date.fromordinal(filed.toordinal() + rng.choice([-30, 0, 3, 60, 120, 200]))
            keys = rng.sample("abcdefgh", 4)
            rows += [(f"m{m}", period, available, k, k, k, .25, i + 1, 1) for i, k in enumerate(keys)]
    quarters, stats, examples = build(spark, save_stage(spark.createDataFrame(rows, SCHEMA), "random"), 3)
    available = {(r[0], r[1]): r[2] for r in rows}
    held = {}
    for r in rows:
        held.setdefault((r[0], r[1]), set()).add(r[3])
    want = {}
    for q in quarters.filter("status = 'eligible'").collect():
        t, c, owners = q.report_period, q.available_at, {}
        for m in {k[0] for k in held}:
            periods = [p for (mm, p) in held if mm == m and p <= t and available[m, p] <= c]
            for key in held[m, max(periods)] if periods else ():
                owners[key] = owners.get(key, 0) + 1
        want.update({(t, c, k): n for k, n in owners.items()})
        free = sorted((k for k in owners if k not in held[q.cik, t]), key=lambda k: (-owners[k], k))[:3]
        mine = examples.filter((F.col("cik") == q.cik) & (F.col("feature_report_period") == t)).collect()
        assert {e.security_key for e in mine} == held[q.cik, t] | set(free)
    assert {(r.t, r.cutoff, r.security_key): r.peer_owner_count for r in stats.collect()} == want


def test_audit_finds_planted_faults(spark):
    good = ("e1", "A", date(2024, 3, 31), date(2024, 5, 15), date(2024, 6, 30), date(2024, 8, 15), date(2024, 3, 31), date(2024, 5, 10))
    bad = ("e2", "A", date(2024, 3, 31), date(2024, 5, 15), date(2024, 9, 30), date(2024, 5, 15), date(2024, 6, 30), date(2024, 5, 10))
    schema = ("example_id string, cik string, feature_report_period date, feature_available_at date, target_report_period date, target_available_at date,"
              " security_first_seen_period date, security_first_seen_available_at date")
    rows = spark.createDataFrame([good, good, bad], schema)
    assert {(r.code, r.example_id) for r in folds.audit_examples(rows).collect()} == {
        ("duplicate_example", "e1"), ("invalid_target_horizon", "e2"), ("target_available_too_early", "e2"), ("future_candidate", "e2")}
    split = spark.createDataFrame([("f", date(2024, 6, 30))], "fold_id string, evaluation_target_quarter date")
    members = spark.createDataFrame([("f", "train", "e1"), ("f", "evaluation", "e1"), ("f", "train", "x"), ("f", "evaluation", "y"), ("f", "evaluation", "e2")],
                                    "fold_id string, side string, example_id string")
    assert {r.code for r in folds.audit_split(rows, members, split).collect()} == {
        "split_example_overlap", "split_manager_quarter_overlap", "unknown_train_example", "train_boundary_violation",
        "unknown_evaluation_example", "evaluation_boundary_violation"}


def test_quarter_fold_audit(spark):
    rows = spark.createDataFrame([("e1", "A", date(2024, 3, 31), date(2024, 6, 30)), ("e2", "A", date(2024, 3, 31), date(2024, 9, 30))],
                                 "example_id string, cik string, feature_report_period date, target_report_period date")
    def split(train):
        return spark.createDataFrame([("f", date(2024, 9, 30), train)], "fold_id string, evaluation_target_quarter date, train_target_quarters array<date>")
    assert {r.code for r in folds.audit_quarter_folds(rows, split([date(2024, 6, 30)])).collect()} == {"split_manager_quarter_overlap"}
    assert {r.code for r in folds.audit_quarter_folds(rows.filter("example_id = 'e2'"), split([date(2024, 9, 30)])).collect()} == {
        "split_example_overlap", "train_boundary_violation"}
    assert folds.audit_quarter_folds(rows.filter("example_id = 'e2'"), split([date(2024, 6, 30)])).count() == 0


def test_metric_vectors(spark):
    def metrics(truth, score):
        rows = [("m", date(2024, 6, 30), "A", f"k{i}", 1.0, float(t), float(s), 0, 0, 0, 0) for i, (t, s) in enumerate(zip(truth, score))]
        return fc.manager_quarter_metrics(spark.createDataFrame(
            rows, "model string, target_report_period date, cik string, security_key string, current_weight double, target_weight double, predicted_weight double,"
                  " target_is_new int, target_is_exit int, predicted_is_new int, predicted_is_exit int")).first()
    perfect, reverse, flat = metrics([3, 2, 0], [3, 2, 0]), metrics([3, 2, 0], [0, 2, 3]), metrics([1, 1], [1, 2])
    assert perfect.ndcg_at_10 == pytest.approx(1) and perfect.recall_at_10 == 1 and perfect.rank_correlation == pytest.approx(1)
    assert reverse.ndcg_at_10 < 1 and reverse.rank_correlation == pytest.approx(-1) and flat.rank_correlation == 0


def test_smallest_good_cap(spark):
    reports = spark.createDataFrame([(0, .790), (100, .7931), (500, .7935)], "negative_candidate_limit long, mean_target_weight_mass_coverage double")
    assert gold.smallest_good_cap(reports).first().selected_negative_candidate_limit == 100
    assert gold.smallest_good_cap(reports, 1.0).first().selected_negative_candidate_limit == 0


def test_ridge_equals_closed_form(spark):
    import numpy as np
    from quarterdeck.plans import learning as ml
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, len(fc.FEATURES)))
    y = x @ rng.normal(size=x.shape[1]) * .01 + rng.normal(size=200) * .001 + .5
    df = spark.createDataFrame([(*map(float, row), float(t)) for row, t in zip(x, y)], ", ".join(f"{c} double" for c in (*fc.FEATURES, "target_weight")))
    got = np.sort([r.ridge for r in ml.fit_ridge(df)(df).collect()])
    z = (x - x.mean(0)) / x.std(0)
    beta = np.linalg.solve(z.T @ z + np.eye(z.shape[1]), z.T @ (y - y.mean()))
    assert np.allclose(got, np.sort(z @ beta + y.mean()), atol=1e-6)


def test_locked_test_fold(spark):
    from quarterdeck.plans import learning as ml
    with pytest.raises(ValueError):
        next(ml.walk_forward(None, None, include_test=True))


def test_candidates_by_manager_need_one_exchange_of_the_rows(spark):
    from quarterdeck.queries.tables import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    fresh = t.build_gold()
    wide = gold.build_examples(t.held(), t.negatives(), pf.security_history(t.snapshots()))
    assert fresh.columns == wide.columns
    assert fresh.exceptAll(wide).isEmpty() and wide.exceptAll(fresh).isEmpty()
    stored = t.gold()
    assert stored.exceptAll(wide).isEmpty() and stored.columns == wide.columns
    ranked = fc.predicted_ranks(fc.prediction_rows(fresh, fc.simple_forecasts()))
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line or "Exchange rangepartitioning" in line]
    assert len(dealt) == 1 and "hashpartitioning(cik" in dealt[0]


def test_ranks_beyond_the_broadcast_limit_give_the_same_candidates(spark, monkeypatch):
    from quarterdeck.queries.tables import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    sent = save_stage(t.build_gold(), "sent")
    monkeypatch.setattr(peers, "BROADCAST_RANKS", 0)
    shuffled = t.build_gold()
    assert sent.exceptAll(shuffled).isEmpty() and shuffled.exceptAll(sent).isEmpty()

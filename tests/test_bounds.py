"""Recommendations by bounds against all pairs; candidate caps in one pass against a build per cap."""

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from quarterdeck.functions.sectors import UNKNOWN_SECTOR
from quarterdeck.operators import clients as cl, peers, portfolios as pf
from quarterdeck.plans import gold
from quarterdeck.session import save_stage

ALERT = ("alert_id string, cusip string, issuer_name string, sector string, score int, severity string, abs_weight_delta double, "
         "current_weight double, change_share_of_turnover double")
HELD = "client_id string, client_name string, strategy string, cusip string, issuer_name string, sector string, weight double"
PRECEDENT = ("alert_id string, place int, p_accession string, p_previous string, p_issuer string, p_cusip string, sector string, "
             "p_abs_weight_delta double, p_value_delta long, p_rule_score int, p_weak_label int, similarity double")
SECTORS = ["Technology", "Energy", "Healthcare", UNKNOWN_SECTOR]


def tables(spark, seed, alerts, clients, dense):
    rng = random.Random(seed)
    cusips = [f"C{i:03d}" for i in range(12 if dense else 90)]
    home = {c: rng.choice(SECTORS) for c in cusips}
    some = lambda: rng.choice([None, 0.0, 0.0004, 0.01, 0.1, rng.random(), rng.random() ** 3])
    listed = []
    for i in range(alerts):
        cusip = rng.choice(cusips)
        # some CUSIPs are named in ways that fall into several sectors
        sector = rng.choice([home[cusip]] * 4 + [None, rng.choice(SECTORS)])
        listed.append((f"a{i:04d}", cusip, "X", sector, rng.choice([40, 60, 78, 78, 86, 100]), "review", some(), some(), some()))
    held = []
    for i in range(clients):
        own = rng.sample(cusips, rng.randint(1, 9))
        weights = [rng.choice([0.0, rng.random()]) for _ in own]
        total = sum(weights) or 1.0
        held += [(f"k{i:03d}", f"K{i}", "s", c, f"I{c}", home[c], w / total) for c, w in zip(own, weights)]
    found = [(f"a{i:04d}", 1, "p", "q", "X", "C", "Energy", .1, 5, 60, 1, .9) for i in range(0, alerts, 3)]
    return (spark.createDataFrame(listed, ALERT), spark.createDataFrame(held, HELD), spark.createDataFrame(found, PRECEDENT))


@pytest.mark.parametrize("seed,alerts,clients,dense,limit", [(1, 400, 25, True, 20), (2, 300, 25, False, 3), (3, 15, 10, False, 20)])
def test_leading_impacts_hold_the_best(spark, seed, alerts, clients, dense, limit):
    listed, held, found = (save_stage(d, "bounds") for d in tables(spark, seed, alerts, clients, dense))
    every, few = cl.client_impacts(listed, held), save_stage(cl.leading_impacts(listed, held, limit), "leading")
    assert sorted(every.columns) == sorted(few.columns)
    columns = ["client_id", "alert_id", "impact_score", "impact_label", "direct_weight", "sector_weight", "sector", "cusip"]
    assert few.select(*columns).exceptAll(every.select(*columns)).count() == 0
    best = [cl.top_recommendations(cl.recommendations(i, held, found), limit).select(
        *columns, "place", "relevance_score", F.round("content_similarity", 9).alias("similarity")) for i in (every, few)]
    a, b = (sorted(map(tuple, d.collect()), key=str) for d in best)
    assert a == b and a
    if alerts > 100:
        assert few.count() < every.count()


def test_leading_impacts_of_empty_tables(spark):
    listed, held, _ = tables(spark, 4, 5, 3, True)
    assert cl.leading_impacts(listed.limit(0), held).count() == 0
    assert cl.leading_impacts(listed, held.limit(0)).count() == 0


def test_caps_in_one_pass_match_a_build_for_each(spark):
    rng, rows = random.Random(8), []
    periods = [date(2023, 12, 31), date(2024, 3, 31), date(2024, 6, 30), date(2024, 9, 30)]
    for m in range(9):
        for period in periods:
            if rng.random() < .1:
                continue
            filed = date(period.year + (period.month == 12), period.month % 12 + 2, rng.randint(1, 25))
            keys = rng.sample(range(20), rng.randint(1, 8))
            rows += [(f"m{m}", period, filed, f"s{k}", f"s{k}", f"S{k}", 1 / len(keys), r, 100) for r, k in enumerate(keys, 1)]
    snaps = save_stage(spark.createDataFrame(rows, "cik string, report_period date, filing_date date, security_key string, cusip string, issuer_name string, weight double, rank long, value_usd long"), "snaps")
    facts = pf.portfolio_facts(snaps)
    quarters = save_stage(pf.manager_quarters(facts, pf.turnover(snaps)), "q")
    ranked = save_stage(peers.ranked_peers(peers.peer_statistics(snaps, facts, peers.quarter_cutoffs(quarters)), pf.first_seen(snaps)), "r")
    held = save_stage(peers.held_with_peers(snaps, quarters, ranked), "h")
    caps = [0, 1, 3, 6, 50]
    one = {r[0]: r[1] for r in gold.coverage_by_cap(peers.target_positions(snaps, held, quarters, ranked), quarters, caps).collect()}
    for cap in caps:
        examples = gold.build_examples(held, peers.peer_negatives(held, quarters, ranked, cap), pf.security_history(snaps))
        mean = gold.coverage_by_manager_quarter(examples, quarters).agg(F.avg("target_weight_mass_coverage")).first()[0]
        assert one[cap] == pytest.approx(mean)
    assert len(set(one.values())) > 3


def test_impacts_are_summed_by_kind_of_alert_without_their_pairs(spark):
    from quarterdeck.operators import clients as cl

    alerts = spark.createDataFrame(
        [(f"a{i}", cusip, "issuer", sector, score, "low") for i, (cusip, sector, score) in enumerate(
            [("C1", "Energy", 90), ("C1", "Energy", 90), ("C1", "Energy", 20), ("C2", "Unknown", 75), ("C1", None, 75), ("C3", "Energy", 75), ("C9", "Unknown", 5)])],
        "alert_id string, cusip string, issuer_name string, sector string, score long, severity string")
    holdings = spark.createDataFrame(
        [("1", "one", "s", "C1", "i", "Energy", .75), ("1", "one", "s", "C2", "i", "Unknown", .25), ("2", "two", "s", "C1", "i", "Technology", 1.0),
         ("3", "three", "s", "C3", "i", "Energy", 0.0), ("3", "three", "s", "C4", "i", "Energy", 1.0), ("4", "four", "s", "C2", "i", "Unknown", 1.0)],
        "client_id string, client_name string, strategy string, cusip string, issuer_name string, sector string, weight double")
    pairs = cl.client_impacts(alerts, holdings).groupBy("alert_id").agg(
        F.count(F.lit(1)).alias("clients"), *[F.sum((F.col("impact_label") == n).cast("long")).alias(n) for n in ("high", "medium")],
        F.sum("impact_score").alias("total_impact"), F.sum("direct_weight").alias("direct_weight"), F.sum("sector_weight").alias("sector_weight"))
    summed = cl.impact_summary(alerts, holdings)
    assert summed.columns == pairs.columns
    assert sorted(map(tuple, summed.collect())) == sorted(map(tuple, pairs.collect()))
    plan = summed._jdf.queryExecution().executedPlan().toString()
    assert "client_id" not in plan  # the alerts meet sums, not clients

"""Mixing to target weights with soft domain membership.

A multinomial logistic classifier over hashed words, fitted on a bounded sample of the
labelled table (about ``TRAIN_ROWS`` labelled rows drawn by a hash), gives every
document a posterior over the domains ``high`` (good quality), ``low`` and ``toxic``. Nonnegative
rates r are then fitted so that the expected tokens of each domain, sum of
r * tokens * posterior, match target weights times the tokens of the corpus: projected
gradient least squares, started at rate 1. The gradient is preconditioned by the K x K
token-weighted Gram matrix of the posteriors of the rows with a positive rate and, should
such a step ever lose ground, by that of all rows, with which a step of one descends. An
iteration is one aggregate over a narrow saved table that returns K numbers; nothing else
reaches the driver. The rates are saved every ``CHAIN`` steps, which bounds the plans.

Only DataFrame and ML-pipeline operations run on the executors.

Defined results: null and empty texts have no tokens and the posterior of a text without
words; a label row counts once per id, the worst label winning; labels without a document
or with both marks null are ignored. With labels of one domain only, every document is of
it; with none, the posterior is the target and all rates are 1. Unreachable targets give
the least-squares rates. Repeated rows are rows of their own with equal rates. An empty
table gives no rows. Posteriors and rates are rounded to ``DECIMALS`` digits.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from ..session import save_stage
from .common import set_aside, small_side

DOMAINS = ("high", "low", "toxic")
TARGETS = {"high": 0.85, "low": 0.11, "toxic": 0.04}
WORD_BUCKETS, TRAIN_ROWS, FIT_STEPS = 1 << 15, 8000, 20
STEPS, CHAIN, CLOSE = 32, 8, 1e-6
DECIMALS = 6


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")


def _hashing() -> HashingTF:
    return HashingTF(inputCol="_w", outputCol="_x", numFeatures=WORD_BUCKETS, binary=True)


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    domain = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).when(F.coalesce("quality", "toxic").isNotNull(), 0)
    truth = labels.select("doc_id", domain.cast("double").alias("_y")).filter("doc_id is not null and _y is not null").groupBy("doc_id").agg(F.max("_y").alias("_y"))
    share = min(1.0, TRAIN_ROWS / max(1, truth.count()))
    drawn = save_stage(truth.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000)), "mixing-labels")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(small_side(drawn, 16), "doc_id")
    return rows.select(_words(F.col("text")).alias("_w"), "_y")


def classified(docs: DataFrame, labels: DataFrame, targets: dict[str, float]) -> DataFrame:
    """``docs`` with n_tokens and one posterior column per domain, which replace columns of the same names (as rate does)."""
    sample = save_stage(_hashing().transform(_labelled(docs, labels)).select("_x", "_y"), "mixing-sample")
    seen = [r["_y"] for r in sample.select("_y").distinct().collect()]
    names = [f"p_{name}" for name in DOMAINS]
    rows, carried = set_aside(docs.drop(*names, "n_tokens", "rate"), "doc_id", "text")
    rows = rows.withColumn("_w", _words(F.col("text")))
    rows = rows.withColumn("n_tokens", F.size("_w").cast("long"))
    if len(seen) < 2:
        constant = [float(k == seen[0]) if seen else targets[name] for k, name in enumerate(DOMAINS)]
        return rows.select(*carried, "n_tokens", *[F.lit(float(p)).alias(name) for name, p in zip(names, constant)])
    fit = LogisticRegression(featuresCol="_x", labelCol="_y", probabilityCol="_p", predictionCol="_g", rawPredictionCol="_r", family="multinomial",
                             maxIter=FIT_STEPS, regParam=0.002, standardization=False)
    model = fit.fit(sample)
    told = model.transform(_hashing().transform(rows)).withColumn("_p", vector_to_array("_p"))
    # classes above the largest label of the sample don't exist for the model
    posteriors = [F.coalesce(F.round(F.get("_p", F.lit(k)), DECIMALS), F.lit(0.0)).alias(name) for k, name in enumerate(names)]
    return told.select(*carried, "n_tokens", *posteriors)


def _step(rate: Column, v: np.ndarray) -> Column:
    move = reduce(lambda a, b: a + b, (F.col(f"p_{name}") * float(x) for name, x in zip(DOMAINS, v)))
    return F.greatest(F.lit(0.0), rate + move)


def fitted_rates(rows: DataFrame, targets: dict[str, float]) -> list[np.ndarray]:
    """The steps of the projected gradient, each a K-vector; rates follow from posteriors and steps."""
    names = [f"p_{name}" for name in DOMAINS]
    n = F.col("n_tokens")
    pairs = [(a, b) for a in names for b in names]

    def gram(row) -> np.ndarray:
        return np.linalg.pinv(np.array([[row[f"{a}|{b}"] for b in names] for a in names]) / total)

    whole = rows.agg(F.sum("n_tokens").alias("n"), *[F.sum(n * F.col(a) * F.col(b)).alias(f"{a}|{b}") for a, b in pairs]).first()
    total = float(whole["n"] or 0)
    if not total:
        return []
    safe = gram(whole)
    weights = np.array([targets[name] for name in DOMAINS], dtype=float)
    want, steps, before, sure = weights / weights.sum(), [], np.inf, False
    state, since = save_stage(rows.select("n_tokens", *names, F.lit(1.0).alias("rate")), "mixing-rates"), []
    for _ in range(STEPS):
        rated = state.select("n_tokens", *names, reduce(_step, since, F.col("rate")).alias("rate"))
        live = F.when(F.col("rate") > 0, n).otherwise(0)
        got = rated.agg(*[F.sum(n * F.col("rate") * F.col(a)).alias(a) for a in names],
                        *[F.sum(live * F.col(a) * F.col(b)).alias(f"{a}|{b}") for a, b in pairs]).first()
        miss = want - np.array([got[a] for a in names]) / total
        error = float(miss @ safe @ miss)
        sure = sure or error > before  # a step on the live rows went too far: only sure steps from here
        before = error
        step = (safe if sure else gram(got)) @ miss
        if np.abs(miss).max() < CLOSE or np.abs(step).max() < CLOSE:
            break
        steps.append(step)
        since.append(step)
        if len(since) == CHAIN:
            state, since = save_stage(rated.withColumn("rate", _step(F.col("rate"), step)), "mixing-rates"), []
    return steps


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, keep: tuple[str, ...] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all, if not given), n_tokens, posteriors and rate of every row."""
    rows = classified(docs, labels, targets)
    if keep is not None:
        rows = rows.select(*keep, "n_tokens", *[f"p_{name}" for name in DOMAINS])
    rows = save_stage(rows, "mixing-posteriors")
    out = rows.withColumn("rate", F.lit(1.0))
    for at, step in enumerate(fitted_rates(rows, targets)):
        out = out.withColumn("rate", _step(F.col("rate"), step))
    return out.withColumn("rate", F.round("rate", DECIMALS))


def drawn(mixed: DataFrame, columns: list[Column]) -> DataFrame:
    """Whole copies of each row: the floor of its rate, and one more with the probability of the rest, by a hash of the row."""
    chance = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    copies = F.floor(F.col("rate") + chance).cast("int")
    return mixed.withColumn("_copy", F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies)))).select(*columns)

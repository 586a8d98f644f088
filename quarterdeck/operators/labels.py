"""Review queue, label metrics, calibration and time folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.keys import event_id
from ..functions.measures import share_of
from .ranking import rank_within

TOP_FRACTION = 0.1


def review_queue(rows: DataFrame, limit: int = 300) -> DataFrame:
    """Positives and negatives in turn by weak label, highest score first (a list of ``limit`` rows).

    Each class needs at most ``limit`` rows, so only those are numbered.
    """
    if limit < 1:
        raise ValueError("limit must be positive")
    order = [F.desc("rule_score"), F.col("current_accession_number"), F.col("holding_key")]

    def best(label: int) -> DataFrame:
        top = rows.filter(F.col("weak_label") == label).orderBy(*order).limit(limit)
        return top.withColumn("turn", F.row_number().over(Window.partitionBy("weak_label").orderBy(*order)))

    queue = best(1).unionByName(best(0)).orderBy("turn", F.desc("weak_label")).limit(limit)
    position = F.row_number().over(Window.orderBy("turn", F.desc("weak_label"))).cast("long")
    blank = [F.lit("").alias(c) for c in ("manual_label", "review_reason", "reviewer_id", "reviewed_at")]
    return queue.select(
        position.alias("position"), event_id("current_accession_number", "holding_key").alias("event_id"),
        *[c for c in rows.columns], *blank,
    )


SCORE_BUCKETS = 1000


def _score_bands(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds bucket, part and prefix: bands of falling scores whose number does not follow the rows.

    A bucket is cut at its most frequent score; the rows of that score are spread by the
    first characters of their event id.
    """
    bucketed = rows.withColumn("bucket", -F.floor(F.col("score") * SCORE_BUCKETS).cast("int"))
    per_score = bucketed.groupBy(*keys, "bucket", "score").agg(F.count(F.lit(1)).alias("n"))
    common = per_score.groupBy(*keys, "bucket").agg(F.max_by("score", F.struct("n", "score")).alias("common"))
    common = common.withColumnsRenamed({c: f"of_{c}" for c in (*keys, "bucket")})
    together = F.lit(True)
    for c in (*keys, "bucket"):
        together = together & F.col(c).eqNullSafe(F.col(f"of_{c}"))
    part = F.when(F.col("score") > F.col("common"), 0).when(F.col("score") == F.col("common"), 1).otherwise(2)
    return bucketed.join(common, together).select(*bucketed.columns, part.alias("part")).withColumn(
        "prefix", F.when(F.col("part") == 1, F.substring("event_id", 1, 2)).otherwise(""))


def binary_metrics(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Confusion counts and scores of each slice.

    ``rows`` needs event_id, label, prediction (0/1) and score in 0..1; equal scores are
    ordered by event id. Hand in a saved stage.
    """
    keys = list(keys)
    if not keys:
        rows, keys = rows.withColumn("slice", F.lit("all")), ["slice"]

    def count(condition: Column) -> Column:
        return F.sum(condition.cast("long"))

    y, p = F.col("label"), F.col("prediction")
    counts = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sample_count"), count((y == 1) & (p == 1)).alias("true_positive"),
        count((y == 0) & (p == 0)).alias("true_negative"), count((y == 0) & (p == 1)).alias("false_positive"),
        count((y == 1) & (p == 0)).alias("false_negative"),
        F.avg((F.col("score") - y) * (F.col("score") - y)).alias("brier_score"),
    )
    banded = _score_bands(rows.select(*keys, "event_id", "label", "score"), keys)
    # average precision: position among all and among positives, by score
    ranked = rank_within(
        banded, keys, [F.desc("score"), F.col("event_id")], [F.col("bucket"), F.col("part"), F.col("prefix")],
        "position", running={"hits": F.col("label").cast("long")},
    )
    precision = ranked.filter("label = 1").groupBy(*keys).agg(F.avg(F.col("hits") / F.col("position")).alias("pr_auc"))
    # precision at the top: labels of 1 first among equal scores
    placed = rank_within(
        banded, keys, [F.desc("score"), F.desc("label"), F.col("event_id")],
        [F.col("bucket"), F.col("part"), F.when(F.col("part") == 1, -F.col("label")).otherwise(0), F.col("prefix")],
        "position", totals={"n": F.lit(1)},
    )
    wanted = F.greatest(F.lit(1).cast("double"), F.bround(F.col("n") * F.lit(TOP_FRACTION)))
    top = placed.withColumn("wanted", wanted).groupBy(*keys).agg(
        (F.sum(F.when((F.col("label") == 1) & (F.col("position") <= F.col("wanted")), 1).otherwise(0)) / F.max("wanted"))
        .alias("precision_at_top_10_percent"))
    joined = counts.join(precision, keys, "left").join(top, keys)
    tp, fp, fn = (F.col(f"{c}") for c in ("true_positive", "false_positive", "false_negative"))
    scored = joined.withColumns({
        "accuracy": share_of(tp + F.col("true_negative"), "sample_count"),
        "precision": share_of(tp, tp + fp), "recall": share_of(tp, tp + fn), "pr_auc": F.coalesce("pr_auc", F.lit(0.0)),
    })
    return scored.withColumn("f1", share_of(F.col("precision") * F.col("recall") * 2, F.col("precision") + F.col("recall")))


def average_precision(scored: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Sum over falling scores of the recall gained times the precision there; equal scores are one threshold.

    From counts per distinct score of each group. ``scored`` needs label and score in 0..1; hand in a saved stage.
    """
    values = scored.groupBy(*keys, "score").agg(F.count(F.lit(1)).alias("copies"), F.sum("label").alias("positives")).withColumn("all", F.lit(1))
    ranked = rank_within(
        values, ["all", *keys], [F.desc("score")], [-F.floor(F.col("score") * SCORE_BUCKETS).cast("int")], "place",
        totals={"of_all": F.col("positives")}, running={"seen": F.col("copies"), "hits": F.col("positives")},
    )
    gained = F.sum(F.col("positives") * F.col("hits") / F.col("seen"))
    return ranked.groupBy(*keys).agg(F.coalesce(F.try_divide(gained, F.max("of_all")), F.lit(0.0)).alias("average_precision"))


def event_type() -> Column:
    return (
        F.when(F.col("is_new_position"), "new_position").when(F.col("is_exited_position"), "exited_position")
        .when(F.col("weight_delta") > 0, "increased_position").otherwise("decreased_position")
    )


def with_stored_predictions(labelled: DataFrame, predictions: DataFrame) -> DataFrame:
    """Labelled rows with a stored model prediction (inner), by filing and holding key."""
    stored = predictions.select("current_accession_number", "holding_key", "predicted_label", "probability")
    return labelled.join(stored, ["current_accession_number", "holding_key"])


def prediction_coverage(labelled: DataFrame, predictions: DataFrame) -> DataFrame:
    stored = predictions.select("current_accession_number", "holding_key", F.lit(1).alias("stored")).distinct()
    joined = labelled.join(stored, ["current_accession_number", "holding_key"], "left")
    return joined.agg(
        F.count(F.lit(1)).alias("labelled_events"), F.count("stored").alias("matched_events"),
        share_of(F.count("stored"), F.count(F.lit(1))).alias("coverage"))


def quantiles(rows: DataFrame, value: str, fractions: Sequence[float]) -> DataFrame:
    """Exact linear quantiles as one array, from counts per distinct value; equal values are one row."""
    values = rows.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("x")).agg(F.count(F.lit(1)).alias("copies")).withColumn("all", F.lit(1))
    ranked = rank_within(
        values, ["all"], [F.col("x")], [F.floor(F.col("x") * SCORE_BUCKETS).cast("int")], "place",
        totals={"n": F.col("copies")}, running={"until": F.col("copies")},
    )
    spots = ranked.select("x", "copies", "until", "n", F.posexplode(F.array(*[F.lit(f) for f in fractions])).alias("i", "f")).withColumn(
        "at", F.col("f") * (F.col("n") - 1) + 1)
    share = F.col("at") - F.floor("at")

    def covers(position: Column) -> Column:
        return (position > F.col("until") - F.col("copies")) & (position <= F.col("until"))

    weight = F.when(covers(F.floor("at")), 1 - share).otherwise(0.0) + F.when(covers(F.floor("at") + 1), share).otherwise(0.0)
    near = spots.filter(covers(F.floor("at")) | covers(F.floor("at") + 1)).withColumn("weight", weight)
    edge = F.sum(F.col("x") * F.col("weight"))
    edges = near.groupBy("i").agg(edge.alias("edge"))
    return edges.agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "edge"))), lambda e: e["edge"]).alias("edges"))


def calibration_curve(rows: DataFrame, bins: int = 5) -> DataFrame:
    """Mean score against observed frequency in quantile bins; empty bins are left out."""
    inner = quantiles(rows, "score", [i / bins for i in range(1, bins)]).scalar()
    placed = rows.withColumn("edges", inner).withColumn(
        "bin", F.size(F.filter("edges", lambda e: e < F.col("score"))).cast("long"))
    return placed.groupBy("bin").agg(F.avg("score").alias("predicted_probability"), F.avg("label").alias("observed_frequency"))


def time_folds(rows: DataFrame, fold_count: int = 3) -> DataFrame:
    """Fold of each filing: sorted accessions in nearly equal blocks, larger blocks first."""
    if fold_count < 2:
        raise ValueError("fold_count must be at least 2")
    filings = rows.select("current_accession_number").distinct().withColumn("all", F.lit(1))
    ranked = rank_within(
        filings, ["all"], [F.col("current_accession_number")], [F.substring("current_accession_number", 1, 10)], "position",
        totals={"n": F.lit(1)},
    )
    folds = F.least("n", F.lit(fold_count))
    size, larger = F.floor(F.col("n") / folds), F.col("n") % folds
    place = F.col("position") - 1
    border = larger * (size + 1)
    fold = F.when(place < border, F.floor(place / (size + 1))).otherwise(larger + F.floor((place - border) / size))
    return ranked.select("current_accession_number", fold.cast("int").alias("fold"))


def latest_model(runs: DataFrame) -> DataFrame:
    """Runs of the newest comparison group (or the newest single run), best first."""
    newest = runs.agg(F.max_by(F.struct("comparison_group_id", "run_id"), "run_id").alias("last"))
    last = newest.select("last.comparison_group_id").scalar()
    run = newest.select("last.run_id").scalar()
    same = F.when(last.isNotNull() & (last != ""), F.col("comparison_group_id") == last).otherwise(F.col("run_id") == run)
    return runs.filter(same).orderBy(F.desc("is_best_model"), F.desc("run_id"))


def alerts_with_predictions(alerts: DataFrame, runs: DataFrame, predictions: DataFrame) -> DataFrame:
    """Alerts with the prediction of the latest best run, when there is one."""
    best = latest_model(runs).select("run_id").limit(1)
    stored = predictions.join(best, "run_id", "left_semi").select("current_accession_number", "holding_key", "probability", "predicted_label")
    return alerts.join(stored, ["current_accession_number", "holding_key"], "left")

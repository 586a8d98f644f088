"""As-of peer statistics and peer candidates.

For a feature quarter ``t`` and cut-off ``c`` every manager counts with its latest
report of a period <= t that was available by c. A report is therefore active for
the cut-offs from its own availability until a later period (<= t) becomes
available. Instead of joining holdings to every cut-off, each holding adds one
event where its report becomes active and one where it stops; events are summed
per (t, security, cut-off) before any shuffle, and running sums restore the
statistics at every cut-off. The shuffled volume follows the holdings, not
holdings times cut-offs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.measures import octave
from .portfolios import ELIGIBLE
from .ranking import rank_within

#: Weights closer than this many decimals count as equal when candidates are ordered,
#: so the order does not depend on how sums were grouped.
ORDER_DECIMALS = 10


def quarter_cutoffs(quarters: DataFrame) -> DataFrame:
    """Sorted distinct cut-offs per feature quarter; rows and lengths follow the calendar."""
    return quarters.filter(F.col("status") == ELIGIBLE).groupBy(F.col("report_period").alias("t")).agg(
        F.sort_array(F.collect_set("available_at")).alias("cutoffs")
    )


def active_reports(facts: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Per report and quarter t: the half-open range of cut-off positions it is active for."""
    last_t = cutoffs.agg(F.max("t")).scalar()
    reports = F.sort_array(F.collect_list(F.struct(F.col("report_period").alias("p"), F.col("available_at").alias("a"))))
    # one entry per quarter and manager; few bytes, but much work a row, so they are dealt by a fixed number of partitions
    spread = int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    per_manager = facts.select("cik", "report_period", "available_at").repartition(spread, "cik").groupBy("cik").agg(reports.alias("reports"))
    each = per_manager.select("cik", "reports", F.posexplode("reports").alias("i", "own")).select(
        "cik", "reports", F.col("own.p").alias("p"), F.col("own.a").alias("a"),
        F.get("reports", F.col("i") + 1).alias("next"),
    )
    months = F.sequence(F.trunc("p", "month"), F.trunc(last_t, "month"), F.expr("interval 3 month"))
    each = each.filter(F.col("p") <= last_t).withColumn("month", F.explode(months)).withColumn(
        "t", F.last_day("month")).join(cutoffs, "t")
    # a report followed by one that was available before t's first cut-off can not be active
    alive = each.filter(
        F.col("next").isNull() | (F.col("t") < F.col("next.p")) | (F.get("cutoffs", F.lit(0)) < F.col("next.a"))
    )
    ends = F.array_min(F.transform(
        F.filter("reports", lambda r: (r["p"] > F.col("p")) & (r["p"] <= F.col("t"))), lambda r: r["a"]
    ))
    ranged = alive.withColumn("ends", ends).select(
        "cik", F.col("p").alias("report_period"), "t",
        F.size(F.filter("cutoffs", lambda c: c < F.col("a"))).alias("start"),
        F.coalesce(
            F.when(F.col("ends").isNotNull(), F.size(F.filter("cutoffs", lambda c: c < F.col("ends")))), F.size("cutoffs")
        ).alias("stop"),
        F.size("cutoffs").alias("n"),
    )
    return ranged.filter(F.col("start") < F.col("stop"))


def peer_statistics(snaps: DataFrame, facts: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Owners and summed weight of every security at every (t, cut-off)."""
    held = snaps.select("cik", "report_period", "security_key", "weight").join(
        active_reports(facts, cutoffs), ["cik", "report_period"]
    )
    begin = F.struct(F.col("start").alias("at"), F.lit(1).cast("long").alias("d"), F.col("weight").alias("dw"))
    end = F.struct(F.col("stop").alias("at"), F.lit(-1).cast("long").alias("d"), (-F.col("weight")).alias("dw"))
    events = held.select(
        "t", "security_key",
        F.explode(F.when(F.col("stop") < F.col("n"), F.array(begin, end)).otherwise(F.array(begin))).alias("e"),
    ).groupBy("t", "security_key", F.col("e.at").alias("at")).agg(F.sum("e.d").alias("d"), F.sum("e.dw").alias("dw"))
    # at most one row per cut-off of the quarter in each group
    along = Window.partitionBy("t", "security_key").orderBy("at")
    steps = events.select(
        "t", "security_key", "at", F.lead("at").over(along).alias("until"),
        F.sum("d").over(along).alias("owners"), F.sum("dw").over(along).alias("weight"),
    ).filter(F.col("owners") > 0)
    placed = steps.join(cutoffs, "t")
    span = F.sequence(F.col("at"), F.coalesce("until", F.size("cutoffs")) - 1)
    return placed.select("t", "cutoffs", "security_key", "owners", "weight", F.explode(span).alias("k")).select(
        "t", F.get("cutoffs", F.col("k")).alias("cutoff"), "security_key",
        F.col("owners").alias("peer_owner_count"), F.round("weight", ORDER_DECIMALS).alias("peer_aggregate_weight"),
    )


def security_counts(listed: DataFrame, facts: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Number of securities that any manager holds at every (t, cut-off): the length of the list of :func:`ranked_peers`.

    The events of :func:`peer_statistics` without weights. A security counts from the event that brings its
    first owner to the one that takes its last, so changes of the number are summed per (t, cut-off).
    """
    held = listed.select("cik", "report_period", "securities").join(active_reports(facts, cutoffs), ["cik", "report_period"])
    begin, end = (F.struct(F.col(at).alias("at"), F.lit(d).cast("long").alias("d")) for at, d in (("start", 1), ("stop", -1)))
    ends = F.when(F.col("stop") < F.col("n"), F.array(begin, end)).otherwise(F.array(begin))
    events = held.select("t", ends.alias("ends"), F.explode("securities").alias("security_key")).select(
        "t", "security_key", F.explode("ends").alias("e")).groupBy("t", "security_key", F.col("e.at").alias("at")).agg(F.sum("e.d").alias("d"))
    # at most one row per cut-off of the quarter in each group
    along = Window.partitionBy("t", "security_key").orderBy("at")
    owners = F.sum("d").over(along)
    changed = events.select("t", "at", owners.alias("now"), (owners - F.col("d")).alias("before")).select(
        "t", "at", ((F.col("now") > 0).cast("long") - (F.col("before") > 0).cast("long")).alias("d"))
    steps = changed.groupBy("t", "at").agg(F.sum("d").alias("d"))
    calendar = Window.partitionBy("t").orderBy("at")  # a row per cut-off of the quarter
    numbers = steps.select("t", "at", F.sum("d").over(calendar).alias("securities"), F.lead("at").over(calendar).alias("until"))
    span = F.sequence(F.col("at"), F.coalesce("until", F.size("cutoffs")) - 1)
    return numbers.join(cutoffs, "t").select("t", "cutoffs", "securities", F.explode(span).alias("k")).select(
        "t", F.get("cutoffs", F.col("k")).alias("cutoff"), "securities")


def candidate_counts(listed: DataFrame, quarters: DataFrame, limit: int) -> DataFrame:
    """Eligible manager-quarters with the number of rows that :func:`candidates_by_manager` forms for them.

    A manager is its own peer, so its h holdings are among the n securities of its cut-off's list, and
    of the n - h others it takes the first ``limit``.
    """
    numbers = security_counts(listed, quarters, quarter_cutoffs(quarters)).withColumnRenamed("t", "report_period")
    return _eligible(quarters).join(numbers, ["report_period", "cutoff"]).select(
        "cik", "report_period", "target_report_period",
        (F.col("holdings") + F.least(F.lit(limit).cast("long"), F.col("securities") - F.col("holdings"))).alias("candidates"))


def ranked_peers(stats: DataFrame, seen: DataFrame) -> DataFrame:
    """Securities of each (t, cut-off) by owners, weight, key, with their first observation.

    Hand in a saved stage. Attaching the first observation here, once per security and
    cut-off, spares joining it to every candidate.
    """
    order = [
        F.desc("peer_owner_count"), F.desc(F.round("peer_aggregate_weight", ORDER_DECIMALS)), F.col("security_key")
    ]
    ranked = rank_within(stats, ["t", "cutoff"], order, [-octave("peer_owner_count")], "peer_rank")
    return ranked.withColumnRenamed("t", "report_period").join(seen, "security_key")


def _eligible(quarters: DataFrame) -> DataFrame:
    return quarters.filter(F.col("status") == ELIGIBLE).drop("status").withColumnRenamed("available_at", "cutoff")


def held_with_peers(snaps: DataFrame, quarters: DataFrame, ranked: DataFrame) -> DataFrame:
    """Holdings of eligible manager-quarters with manager facts, peer statistics and position.

    A manager is its own peer, so every holding finds its statistics.
    """
    held = snaps.select("cik", "report_period", "security_key").join(_eligible(quarters), ["cik", "report_period"])
    return held.join(ranked, ["report_period", "cutoff", "security_key"])


def peer_negatives(held: DataFrame, quarters: DataFrame, ranked: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` best ranked securities a manager does not hold, per eligible manager-quarter.

    A manager with h holdings finds them among the first limit + h positions. Its held
    positions are left out of that sequence and the rest joined on (t, cut-off,
    position), so nothing but the result is produced, and a cut-off shared by many
    managers is spread over the positions.
    """
    # positions are integers, at most one per listed security
    taken = held.groupBy("cik", "report_period").agg(F.collect_list("peer_rank").alias("taken"))
    free = F.slice(
        F.array_except(
            F.sequence(F.lit(1).cast("long"), F.col("holdings") + F.lit(limit)),
            F.coalesce("taken", F.array().cast("array<bigint>")),
        ),
        1, limit,
    )
    # few rows become many: spread them by a fixed number of partitions before unnesting
    spread = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    managers = _eligible(quarters).join(taken, ["cik", "report_period"], "left").repartition(spread, "cik", "report_period")
    wanted = managers.withColumn("peer_rank", F.explode(free))
    return wanted.drop("taken").join(ranked, ["report_period", "cutoff", "peer_rank"])


#: ranks that are sent to every task as a table; beyond, Spark shuffles the rows to them
BROADCAST_RANKS = 1_000_000
#: holdings of a partition of managers
MANAGER_ROWS = 50_000


def candidates_by_manager(snaps: DataFrame, quarters: DataFrame, ranked: DataFrame, limit: int) -> DataFrame:
    """Held and negative candidates of eligible manager-quarters with facts, peer statistics and the manager's history of the security.

    The rows of :func:`held_with_peers`, :func:`peer_negatives` and ``portfolios.security_history``, from one
    exchange: holdings and facts are dealt by manager while they are narrow. Candidates are unnested in
    place and meet the ranks, which follow cut-offs and securities and not managers, as a broadcast table.
    The result stays dealt by ``cik``. Hand in saved stages.
    """
    facts = _eligible(quarters)
    told = [c for c in facts.columns if c not in ("cik", "report_period")]
    own = F.struct("security_key", F.col("weight").alias("w"), F.col("rank").alias("r"), F.col("issuer_name").alias("issuer"))
    parts = max(int(snaps.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + snaps.count() // MANAGER_ROWS)
    dealt = snaps.select("cik", "report_period", own.alias("own")).unionByName(
        facts.select("cik", "report_period", F.struct(*told).alias("facts")), allowMissingColumns=True).repartition(parts, "cik")
    ranks = ranked.select(F.struct("report_period", "cutoff").alias("at"), F.col("security_key").alias("listed"), "peer_rank",
                          F.struct("peer_owner_count", "peer_aggregate_weight").alias("stats"))
    if ranks.count() <= BROADCAST_RANKS:
        ranks = F.broadcast(ranks)

    # one manager-quarter, as large as its portfolio
    portfolio = Window.partitionBy("cik", "report_period")
    rows = dealt.withColumn("facts", F.max("facts").over(portfolio)).withColumn(
        "at", F.when(F.col("facts").isNotNull(), F.struct("report_period", F.col("facts.cutoff").alias("cutoff"))))
    known = rows.filter(F.col("own").isNotNull()).join(
        ranks.withColumnRenamed("at", "__at"), (F.col("at") == F.col("__at")) & (F.col("own.security_key") == F.col("listed")), "left").drop("__at", "listed")
    entry = F.struct("own", "peer_rank", "stats")
    nested = known.groupBy("cik", "report_period").agg(F.collect_list(entry).alias("held"), F.first("facts").alias("facts"), F.first("at").alias("at"))
    taken = F.transform("held", lambda h: h["peer_rank"])
    free = F.slice(F.array_except(F.sequence(F.lit(1).cast("long"), F.col("facts.holdings") + F.lit(limit)), taken), 1, limit)
    none = F.col("held")[0]
    listed = F.transform(F.coalesce(free, F.array().cast("array<bigint>")), lambda r: F.struct(
        F.when(F.lit(False), none["own"]).alias("own"), r.alias("peer_rank"), F.when(F.lit(False), none["stats"]).alias("stats")))
    each = nested.select("cik", "report_period", "facts", "at", F.explode(F.concat("held", listed)).alias("e")).select(
        "cik", "report_period", "facts", "at", "e.own", F.col("e.stats").alias("own_stats"),
        F.when(F.col("e.own").isNull(), F.col("e.peer_rank")).alias("free_rank"))
    met = each.join(ranks.withColumnsRenamed({"at": "__at", "peer_rank": "__rank"}), (F.col("at") == F.col("__at")) & (F.col("free_rank") == F.col("__rank")), "left")
    met = met.filter(F.col("own").isNotNull() | F.col("listed").isNotNull()).select(
        "cik", "report_period", "facts", "own", F.coalesce("own.security_key", "listed").alias("security_key"), F.coalesce("own_stats", "stats").alias("stats"))
    # a security in one manager's quarters: once held and once a candidate in each at most
    past = F.when(F.col("own").isNotNull(), F.struct("report_period", F.struct("own.w", "own.r", "own.issuer")))
    asked = F.when(F.col("facts").isNotNull(), F.struct("report_period", "facts", "stats"))
    grouped = met.groupBy("cik", "security_key").agg(F.map_from_entries(F.collect_list(past)).alias("quarters"), F.collect_list(asked).alias("asked"))
    return grouped.select("cik", "security_key", "quarters", F.explode("asked").alias("a")).select(
        "cik", "security_key", "quarters", "a.report_period", "a.facts.*", "a.stats.*")


def target_positions(snaps: DataFrame, held: DataFrame, quarters: DataFrame, ranked: DataFrame) -> DataFrame:
    """Where each next-quarter holding stands in its manager's candidate list, without building the list.

    Position 0 is a security the manager already holds. Any other is the p-th negative when
    its peer rank less the manager's held ranks before it is p, so a cap of c covers exactly
    the positions up to c. Securities no peer held at the cut-off are in no list and left out.
    """
    targets = snaps.select("cik", F.col("report_period").alias("target_report_period"), "security_key", "weight").join(
        _eligible(quarters).select("cik", "report_period", "target_report_period", "cutoff"), ["cik", "target_report_period"])
    placed = targets.join(ranked.select("report_period", "cutoff", "security_key", "peer_rank"), ["report_period", "cutoff", "security_key"])
    rows = placed.select("cik", "report_period", "peer_rank", F.col("weight").alias("target_weight"), F.lit(0).alias("held")).unionByName(
        held.select("cik", "report_period", "peer_rank", F.lit(None).cast("double").alias("target_weight"), F.lit(1).alias("held")))
    # one manager's two portfolios; a held security and its target share their rank
    by_rank = Window.partitionBy("cik", "report_period").orderBy("peer_rank")
    before = F.coalesce(F.sum("held").over(by_rank.rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.sum("held").over(by_rank.rangeBetween(Window.unboundedPreceding, Window.currentRow)) > before
    return rows.withColumn("position", F.when(own, 0).otherwise(F.col("peer_rank") - before).cast("long")).filter("held = 0").drop("held", "peer_rank")

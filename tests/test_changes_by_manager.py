"""Changes from one exchange of the positions, scored in place and not stored twice."""

from pyspark.sql import functions as F

from quarterdeck.operators import changes as ch, validation
from quarterdeck.queries import changes as queries, labels
from quarterdeck.queries.tables import Tables
from quarterdeck.session import Workspace
from quarterdeck.sources import driver_tables as given

SOURCE = "/root/testdata/sf0.001"


def _same(a, b):
    a, b = a.select(*sorted(a.columns)), b.select(*sorted(b.columns))
    assert a.columns == b.columns and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_changes_by_manager_are_those_of_the_join(spark):
    t = Tables(spark, SOURCE)
    _same(queries.deltas(t).drop("moved"), ch.position_deltas(queries.pairs(t), queries.positions(t)))
    _same(queries.features(t), ch.change_features(queries.deltas(t).drop("moved"), given.SECTOR_TABLE))
    scored = queries.assessed(t)
    _same(queries.training(t), ch.training_rows(scored.drop("score", "severity", "should_alert", "reasons"), scored))


def test_positions_by_whole_filings_are_those_by_bands(spark):
    lines = queries.lines_in_thousands(Tables(spark, SOURCE)).localCheckpoint()
    _same(ch.filing_positions(lines, whole=True), ch.filing_positions(lines))


def test_changes_are_stored_once(spark):
    t = Tables(spark, SOURCE)
    t.workspace.forget()
    queries.newest_alerts(t)
    labels.label_metrics_by_event(t)
    labels.review_queue(t)
    stored = {key[3] for key in Workspace._paths if key[1] == SOURCE}
    assert "compared" in stored and not stored & {"deltas", "assessed", "training_rows", "reviewed", "latest_lines"}


def test_repeated_event_ids_are_reported_and_no_other(spark):
    columns = {c: F.lit("x") for c in (*validation.EVENT_COLUMNS, *validation.REVIEW_COLUMNS) if c not in ("event_id", "manual_label")}
    ids = spark.createDataFrame([("a",), ("b",), (" a ",), ("",), ("c",)], "event_id string")
    found = validation.label_problems(ids.withColumns({**columns, "manual_label": F.lit("1")}))
    assert sorted(tuple(r) for r in found.collect()) == [
        ("", "event_id is required"), (" a ", "duplicate event_id"), ("a", "duplicate event_id")]

"""The planted audit reads narrow examples and joins its sides once; a single pass does not store gold."""

import datetime

from quarterdeck.operators import folds
from quarterdeck.queries import gold
from quarterdeck.queries.tables import Tables

DAY = datetime.date


def test_sides_are_joined_once_and_keep_ids_of_findings_only(spark, monkeypatch):
    examples = spark.createDataFrame([("a", "1", DAY(2000, 3, 31), DAY(2000, 6, 30)), ("b", "1", DAY(2000, 3, 31), DAY(2000, 6, 30)), ("c", "2", DAY(2000, 6, 30), DAY(2000, 9, 30))],
                                     "example_id string, cik string, feature_report_period date, target_report_period date")
    members = spark.createDataFrame([("f", "train", "a"), ("f", "evaluation", "b"), ("f", "evaluation", "c"), ("f", "train", "x")], "fold_id string, side string, example_id string")
    split = spark.createDataFrame([("f", DAY(2000, 9, 30))], "fold_id string, evaluation_target_quarter date")
    kept, plain = {}, folds.save_stage

    def seen(df, label):
        kept[label] = plain(df, label)
        return kept[label]

    monkeypatch.setattr(folds, "save_stage", seen)
    found = {(r["code"], r["example_id"]) for r in folds.audit_split(examples, members, split).collect()}
    assert found == {("unknown_train_example", "x"), ("evaluation_boundary_violation", "b"), ("split_manager_quarter_overlap", None)}
    assert sorted(r[0] or "" for r in kept["sides"].select("example_id").collect()) == ["", "", "b", "x"]


def _refused(self):
    raise AssertionError("gold is not needed")


def test_planted_faults_read_the_audited_columns(spark, monkeypatch):
    rows = [(f"{k:x}{n}", str(n), DAY(2000, 6, 30), DAY(2000, 8, 1), DAY(2000, 9, 30), DAY(2000, 11, 1), DAY(1999, 3, 31), DAY(1999, 5, 1)) for k in range(16) for n in range(2)]
    examples = spark.createDataFrame(rows, "example_id string, cik string, feature_report_period date, feature_available_at date, target_report_period date, target_available_at date,"
                                           " security_first_seen_period date, security_first_seen_available_at date")
    monkeypatch.setattr(Tables, "audited", lambda self: examples)
    monkeypatch.setattr(Tables, "gold", _refused)
    told = {r["code"]: r["issues"] for r in gold.planted_faults(Tables(spark, "unread")).collect()}
    assert told["duplicate_example"] == told["invalid_target_horizon"] == told["future_candidate"] == told["unknown_train_example"] == 2


def test_history_of_one_pass_is_not_stored(spark, monkeypatch):
    examples = spark.createDataFrame([("1", "s", DAY(2000, 6, 30), 3, 0)], "cik string, security_key string, feature_report_period date, holding_history_quarters long, quarters_since_last_held long")
    monkeypatch.setattr(Tables, "build_unnamed", lambda self: examples)
    monkeypatch.setattr(Tables, "gold", _refused)
    t = Tables(spark, "unread")
    monkeypatch.setattr(t.workspace, "kept", lambda label: None)
    assert gold.holding_history(t).collect()[0][:] == ("1", "s", DAY(2000, 6, 30), 3, 0)

"""Examples without issuers' names and those of one quarter against the whole gold; what the queries store for them."""

from pyspark.sql import functions as F

from quarterdeck.queries import forecasts, gold, labels
from quarterdeck.queries.tables import Tables
from quarterdeck.session import Workspace

SOURCE = "/root/testdata/sf0.001"


def _same(a, b):
    a = a.select(*b.columns)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0 and b.count() > 0


def _rounded(df):
    return df.select(*[F.round(c, 9).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def test_audit_and_fits_read_no_names(spark):
    t = Tables(spark, SOURCE)
    t.workspace.forget()
    gold.leakage_audit(t).collect()
    labels.action_fits(t)
    stored = {key[3] for key in Workspace._paths if key[1] == SOURCE}
    assert {"positions", "modelled"} <= stored and not stored & {"silver", "lines", "gold"}
    unnamed, modelled = _rounded(t.build_unnamed()).localCheckpoint(), _rounded(t.modelled()).localCheckpoint()
    whole = _rounded(t.build_gold()).localCheckpoint()
    _same(unnamed, whole.drop("issuer_name"))
    _same(modelled, whole.select(*modelled.columns))


def test_the_examples_of_one_quarter(spark):
    t = Tables(spark, SOURCE)
    for target in (forecasts.TARGET_QUARTER, "1996-03-31"):
        _same(_rounded(t.build_quarter(target)), _rounded(t.build_gold().filter(F.col("target_report_period") == F.lit(target).cast("date"))))

"""Rules of single operators on frames small enough to work out by hand."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import values
from transferwatch.functions import composite_key, parse_timestamp, to_number
from transferwatch.operators import amounts, calendar, cleaning, encoders, history, monitoring
from transferwatch.operators.records import align, require_manifest, typed_records
from transferwatch.schema import LABELLED_TRANSACTION, RECEIVER, SENDER

HOUR = 36000


def test_velocity_includes_both_ends_of_the_hour(transfers):
    df = transfers([(HOUR, "a", "x"), (HOUR + 3600, "a", "x"), (HOUR + 3601, "a", "x")])
    assert values(history.velocity(df, SENDER), "txn_velocity_sender") == [1, 2, 2]


def test_velocity_floors_to_seconds_and_counts_ties(transfers):
    df = transfers([(HOUR, "a", "x"), (HOUR + 0.5, "a", "x")])
    assert values(history.velocity(df, SENDER), "txn_velocity_sender") == [2, 2]


def test_velocity_before_the_epoch_rounds_down(transfers):
    df = transfers([(-3600.5, "a", "x"), (-0.5, "a", "x"), (0.0, "a", "x")])
    assert values(history.velocity(df, SENDER), "txn_velocity_sender") == [1, 2, 2]


def test_recency_keeps_fractions_and_starts_at_minus_one(transfers):
    df = transfers([(HOUR, "a", "x"), (HOUR + 0.25, "a", "y"), (HOUR + 0.25, "a", "z")])
    found = values(history.recency(df, SENDER), "time_since_last_txn_sender")
    assert found == [-1.0, 0.25, 0.0]


def test_rolling_frames_hold_five_rows_with_the_own_one(transfers):
    df = transfers([(HOUR + i, "a", "x") for i in range(6)])
    rolled = history.side_features(df, SENDER, [history.ROLLING_MEAN, history.ROLLING_STD])
    assert values(rolled, "rolling_avg_amount_paid_sender") == [1, 1.5, 2, 2.5, 3, 4]
    deviations = values(rolled, "rolling_std_amount_paid_sender")
    assert deviations[0] == 0
    assert deviations[1] == pytest.approx(0.5**0.5)
    assert deviations[5] == pytest.approx(2.5**0.5)


def test_ratio_to_rolling_mean_adds_epsilon(transfers):
    df = transfers([(HOUR, "a", "x")], amount_paid=[0.0])
    rolled = history.side_features(df, SENDER, [history.MEAN_RATIO])
    assert values(rolled, "amount_paid_to_avg_sender_ratio") == [0.0]


def test_rolling_unique_counts_twenty_rows_and_a_missing_receiver(transfers):
    df = transfers([(HOUR + i, "a", f"r{i}") for i in range(21)] + [(HOUR + 30, "a", None)])
    found = values(
        history.side_features(df, SENDER, [history.ROLLING_UNIQUE]),
        "rolling_unique_receivers_sender",
    )
    assert found == [*range(1, 21), 20, 20]


def test_missing_account_has_no_history(transfers):
    df = transfers([(HOUR, None, "x"), (HOUR + 1, None, "x")])
    wanted = [*history.HISTORY, history.TOTALS, history.FRAUD_RATE, history.UNIQUE_OTHERS]
    rows = history.side_features(df, SENDER, wanted)
    assert values(rows, "time_since_last_txn_sender") == [-1.0, -1.0]
    for name in (
        "txn_velocity_sender",
        "rolling_avg_amount_paid_sender",
        "rolling_std_amount_paid_sender",
        "rolling_unique_receivers_sender",
        "sender_total_txn",
        "sender_fraud_rate",
        "unique_receivers_per_sender",
    ):
        assert values(rows, name) == [None, None], name


def test_totals_and_counterparties(transfers):
    df = transfers(
        [(1, "a", "x"), (2, "a", "y"), (3, "a", None), (4, "b", "x")], is_laundering=[1, 0, 0, 0]
    )
    sender = history.unique_counterparties(history.account_totals(df, SENDER), SENDER)
    assert values(sender, "sender_total_txn") == [3, 3, 3, 1]
    assert values(sender, "sender_fraud_rate")[0] == pytest.approx(1 / 3)
    assert values(sender, "unique_receivers_per_sender") == [2, 2, 2, 1]
    receiver = history.unique_counterparties(df, RECEIVER)
    assert values(receiver, "unique_senders_per_receiver") == [2, 1, None, 2]


def test_amount_ratio_adds_one(transfers):
    df = transfers([(1, "a", "x"), (2, "a", "x")], amount_paid=[0.0, -1.0])
    rows = amounts.amount_features(df)
    assert values(rows, "amount_ratio") == [1.0, None]
    assert values(rows, "amount_diff") == [1.0, 3.0]


def test_outliers_lie_strictly_outside(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 7, 8]], "v double")
    bounds = {"v": (2.0, 7.0)}
    flags = amounts.flag_outliers(df, bounds).orderBy("v").collect()
    assert [r.outlier_v for r in flags] == [1, 0, 0, 0, 0, 1]


def test_threshold_weighs_groups_equally_and_flag_is_strict(transfers):
    df = transfers(
        [(0, "a", "x"), (1, "a", "x"), (2, "a", "x"), (3600, "a", "x")], is_laundering=[0, 0, 1, 1]
    )
    rows = {r.hour: r for r in calendar.high_risk_periods(df, "hour").collect()}
    assert rows[0].hour_thresh == pytest.approx((1 / 3 + 1) / 2)
    assert (rows[0].high_fraud_hour, rows[1].high_fraud_hour) == (0, 1)
    same = calendar.high_risk_periods(transfers([(0, "a", "x")], is_laundering=[1]), "hour")
    assert same.first().high_fraud_hour == 0


def test_frequency_ignores_a_missing_key_but_not_a_missing_part(transfers):
    df = transfers([(1, "a", "x"), (2, "b", "x")], from_bank=[None, 5])
    single = encoders.frequency_encode(df, ["from_bank"], "f")
    assert values(single, "f") == [None, 1.0]
    pair = encoders.frequency_encode(df, ["from_bank", "to_bank"], "f")
    assert values(pair, "f") == [0.5, 0.5]
    assert values(df.select("txn_id", composite_key("from_bank", "to_bank").alias("k")), "k") == [
        "nan_2",
        "5_2",
    ]


def test_one_hot_drops_the_first_category(transfers):
    df = transfers([(i, "a", "x") for i in range(3)], receiving_currency=["B", "A", None])
    columns = ["receiving_currency"]
    rows = encoders.one_hot(df, encoders.one_hot_categories(df, columns))
    assert "receiving_currency_A" not in rows.columns
    assert values(rows, "receiving_currency_B") == [1, 0, 0]


def test_any_categories_get_columns(spark):
    """Names that differ in case only, and more categories than fit a small table."""
    texts = ["wire", "Wire", "WIRE", "wire_2", None, *[f"c{i}" for i in range(1500)]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "txn_id int, kind string")
    categories = encoders.one_hot_categories(df, ["kind"])
    names = encoders.named_categories(categories)
    assert len(names) == 1503 == len({n.lower() for n in names})
    rows = encoders.one_hot(df, categories)
    sums = rows.select(*[F.sum(F.col(f"`{n}`")).alias(n) for n in list(names)[-8:]]).first()
    assert list(sums) == [1] * 8
    flags = rows.select("txn_id", *[F.col(f"`{n}`") for n, (_, v) in names.items() if v.lower() == "wire"])
    # The first category of all, WIRE, has no column.
    assert [sum(r[1:]) for r in flags.orderBy("txn_id").limit(5).collect()] == [1, 1, 0, 0, 0]


def test_alignment(spark):
    df = spark.createDataFrame([("1", "oops", 2.0, "id")], "a string, b string, extra double, i string")
    manifest = ["b", "new", "a"]
    rows = align(df, manifest, keep=["i"])
    assert rows.columns == ["i", "b", "new", "a"]
    assert tuple(rows.first()) == ("id", 0.0, 0.0, 1.0)
    require_manifest(rows, manifest, keep=["i"])
    with pytest.raises(ValueError, match="missing"):
        require_manifest(rows.drop("new"), manifest, keep=["i"])


def test_text_to_number(spark):
    df = spark.createDataFrame([("3.5",), ("x",), (None,), ("NaN",)], "v string")
    assert [r[0] for r in df.select(to_number("v")).collect()] == [3.5, 0.0, 0.0, 0.0]


def test_times_in_text(spark):
    df = spark.createDataFrame(
        [("2022/09/01 00:20",), ("2022-09-01 00:20:00",), ("soon",)], "v string"
    )
    found = [r[0] for r in df.select(F.unix_seconds(parse_timestamp("v"))).collect()]
    assert found == [1661991600, 1661991600, None]


def test_records_that_do_not_fit_are_kept_apart(spark):
    raw = {f.name: "1" for f in LABELLED_TRANSACTION} | {"ts": "2022/09/01 00:20"}
    bad = raw | {"amount_paid": "much", "txn_id": None}
    schema = ", ".join(f"{n} string" for n in raw)
    df = spark.createDataFrame([tuple(raw.values()), tuple(bad.values())], schema)
    accepted, rejected = typed_records(df, LABELLED_TRANSACTION)
    assert accepted.count() == 1
    assert accepted.dtypes == [(f.name, f.dataType.simpleString()) for f in LABELLED_TRANSACTION]
    assert rejected.first().bad_fields == ["txn_id", "amount_paid"]


def test_metrics_without_positive_predictions(spark):
    df = spark.createDataFrame([(0, 1), (0, 0), (0, 0), (0, 1)], "prediction int, label int")
    row = monitoring.quality_metrics(df).first()
    assert (row.precision, row.recall, row.f1, row.accuracy) == (0, 0, 0, 0.5)


def test_request_metrics_of_nothing(spark):
    df = spark.createDataFrame([], "ts timestamp, event_type string, value double")
    row = monitoring.request_metrics(df).first()
    assert (row.total_requests, row.error_rate_percent, row.avg_duration) == (0, 0, 0)


def test_split_is_complete_disjoint_and_exact(spark, tx):
    rest, part = cleaning.stratified_split(tx, 0.25)
    ids = {r[0] for r in part.select("txn_id").collect()}
    others = {r[0] for r in rest.select("txn_id").collect()}
    assert not ids & others and len(ids | others) == tx.count()
    for label, total in tx.groupBy("is_laundering").count().collect():
        assert part.where(F.col("is_laundering") == label).count() == int(0.25 * total + 0.5)
    again = cleaning.stratified_split(tx.repartition(13), 0.25)[1]
    assert {r[0] for r in again.select("txn_id").collect()} == ids


def test_split_of_tiny_classes(spark):
    df = spark.createDataFrame([(str(i), i % 3) for i in range(7)], "txn_id string, y int")
    counts = {0: 1, 1: 1, 2: 1}  # floor(0.25 * 3 + 0.5), floor(0.25 * 2 + 0.5)
    part = cleaning.stratified_split(df, 0.25, "y")[1]
    assert {r[0]: r[1] for r in part.groupBy("y").count().collect()} == counts
    assert cleaning.stratified_split(df, 0.0, "y")[1].count() == 0
    assert cleaning.stratified_split(df, 1.0, "y")[0].count() == 0

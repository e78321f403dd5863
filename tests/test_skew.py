"""Hot keys, big tables and big columns give the same results as small ones."""

import random

import pytest
from pyspark.sql import functions as F

from transferwatch.operators import amounts, history, skew
from transferwatch.plans.features import RiskFeatures
from transferwatch.schema import RECEIVER, SENDER


def same_rows(left, right):
    right = right.select(*[F.col(f"`{c}`") for c in left.columns])
    return left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


@pytest.fixture(scope="module")
def skewed(tx):
    """A third of all rows from one account at one moment, and some from no account."""
    chance = F.pmod(F.xxhash64("txn_id"), F.lit(12))
    busy = F.to_timestamp(F.lit("2022-09-05 12:00:00"))
    return (
        tx.withColumn("account", F.when(chance >= 5, F.col("account")).when(chance >= 1, "HUB"))
        .withColumn("ts", F.when(chance.between(1, 4), busy).otherwise(F.col("ts")))
        .withColumn("account_1", F.when(chance != 11, F.col("account_1")))
    )


@pytest.mark.parametrize("side", [SENDER, RECEIVER])
def test_hot_accounts_get_the_same_features(skewed, side):
    wanted = [*history.HISTORY, history.TOTALS, history.FRAUD_RATE, history.UNIQUE_OTHERS]
    wanted += [history.PAIR_COUNT, history.FORMAT_COUNT] if side == SENDER else []
    whole = history.side_features(skewed, side, wanted)
    split = history.side_features(skewed, side, wanted, max_group_rows=100)
    assert whole.count() == skewed.count()
    assert same_rows(whole, split)


def test_hot_accounts_in_the_whole_plan(skewed):
    whole, split = RiskFeatures(), RiskFeatures(max_group_rows=100)
    left = whole.fit(skewed).training_features(skewed)
    right = split.fit(skewed).training_features(skewed)
    assert same_rows(left, right)


def test_hot_accounts_in_new_data(skewed):
    plain, split = RiskFeatures().fit(skewed), RiskFeatures(max_group_rows=100).fit(skewed)
    new = skewed.drop("is_laundering")
    for mode in ("batch", "frozen"):
        assert same_rows(plain.transform(new, mode), split.transform(new, mode))


def test_receiver_side_is_shuffled_once_with_hot_accounts(skewed):
    """The receiver's windows are written before the rows are split by sender."""
    made = RiskFeatures(max_group_rows=1000).fit(skewed).training_features(skewed)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(account_1#" not in plan


def test_runs_are_full_but_the_last(skewed):
    runs = skew.ranked_runs(skewed.withColumn("_sec", F.unix_seconds("ts")), "account", history.ORDER, 50)
    sizes = runs.groupBy("account", skew.RUN).count()
    last = sizes.groupBy("account").agg(F.max(skew.RUN).alias("last"))
    inner = skew.join_same(sizes, last, ["account"]).where(F.col(skew.RUN) < F.col("last"))
    assert {r["count"] for r in inner.collect()} == {50}
    ranks = runs.groupBy("account").agg(
        F.count_distinct(skew.RANK).alias("ranks"), F.count("*").alias("n"), F.max(skew.RANK).alias("m")
    )
    assert all(r["ranks"] == r["n"] == r["m"] + 1 for r in ranks.collect())


def test_runs_must_hold_the_overlap(skewed):
    with pytest.raises(ValueError):
        skew.with_overlap(skewed, 19, 10)


def test_hot_keys_are_found(skewed):
    hot = skew.hot_keys(skewed, "account", 500)
    assert "HUB" in {r[0] for r in hot.collect()}
    assert skew.hot_keys(skewed, "account") is None


def test_salted_lookup_equals_broadcast(skewed):
    table = skewed.groupBy("account").agg(F.count("*").alias("n"))
    small = skew.lookup_join(skewed, table, ["account"])
    big = skew.lookup_join(skewed, table, ["account"], max_broadcast_rows=1)
    assert same_rows(small, big)


def test_quantiles_are_exact_when_narrowed(spark):
    random.seed(3)
    data = [random.lognormvariate(5, 2) for _ in range(3000)] + [7.0] * 2000 + [None] * 50
    frame = spark.createDataFrame([(v, float(i % 2)) for i, v in enumerate(data)], "v double, t double")
    shares = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    exact = frame.agg(
        *[F.percentile(c, F.array(*map(F.lit, shares))).alias(c) for c in ("v", "t")]
    ).first()
    found = amounts.exact_quantiles(frame, ["v", "t"], shares, max_values=20, cuts=40)
    assert found["v"] == pytest.approx(list(exact["v"]), rel=1e-12)
    assert found["t"] == list(exact["t"])


def test_quantiles_of_odd_values(spark):
    """NaN is missing, infinities and negative values are values like others."""
    inf, nan = float("inf"), float("nan")
    cases = {
        "a": [1.0, 2.0, 3.0, nan, nan, None],
        "b": [-inf, -5.0, -0.0, 0.0, 5e-324, inf, 1e308, -1e308],
        "c": [-float(i) for i in range(200)] + [nan],
        "d": [nan, None],
    }
    for name, data in cases.items():
        frame = spark.createDataFrame([(v,) for v in data], "v double")
        found = amounts.exact_quantiles(frame, ["v"], [0.25, 0.5, 0.75], max_values=3, cuts=5)["v"]
        own = sorted(v for v in data if v is not None and v == v)
        if not own:
            assert all(v != v for v in found)
            continue
        for p, v in zip([0.25, 0.5, 0.75], found, strict=True):
            at = (len(own) - 1) * p
            low, high = own[int(at)], own[-int(-at // 1)] if at != int(at) else own[int(at)]
            expected = low if low == high else low + (at - int(at)) * (high - low)
            assert v == pytest.approx(expected), name

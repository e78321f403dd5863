"""One runnable query per operator, over the driver's tables.

Each takes ``(spark, sf_dir)``, reads whole tables and returns a DataFrame. Doubles are rounded
where two engines may differ in the last digits.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from transferwatch.functions import calendar_parts, epoch_seconds, exact_key, objective, parse_timestamp
from transferwatch.operators import amounts, calendar, cleaning, encoders, history, monitoring, sketches
from transferwatch.operators.intervals import interval_matches
from transferwatch.operators.ordering import time_ordered
from transferwatch.operators.records import align, coerce_numeric, require_manifest, typed_records
from transferwatch.plans import learning, pipeline
from transferwatch.plans.features import RiskFeatures, RiskFeaturesModel
from transferwatch.schema import AMOUNTS, ID, LABEL, RECEIVER, SENDER, TIME
from transferwatch.session import ensure_checkpoint_dir, materialise, prepare, scratch_path
from transferwatch.sources import artefacts, fixtures
from transferwatch.sources.bucketed import join_bucketed, write_bucketed
from transferwatch.streaming import jobs
from transferwatch.streaming.history import mean_ratios, stream_history
from transferwatch.streaming.recent import stream_recent_average
from transferwatch.streaming.velocity import stream_velocity, use_rocksdb

Query = Callable[[SparkSession, str], DataFrame]

# Digits to which doubles are compared where the order of additions or the math library may differ.
# All others come from the same few operations on whole numbers or inputs and are compared as is.
DIGITS = {
    **{f"log_{a}": 6 for a in AMOUNTS},
    **{f"rolling_std_{a}_{s.name}": 2 for a in AMOUNTS for s in (SENDER, RECEIVER)},
    **{f"rolling_avg_{a}_{s.name}": 7 for a in AMOUNTS for s in (SENDER, RECEIVER)},
    **{f"{a}_to_avg_{s.name}_ratio": 4 for a in AMOUNTS for s in (SENDER, RECEIVER)},
    **dict.fromkeys(("hour_thresh", "value", "avg_duration", "average_value", "average_latency"), 8),
    **dict.fromkeys(("accuracy", "precision", "recall", "f1", "objective"), 8),
}
WHOLE = {
    f.format(s.name) for s in (SENDER, RECEIVER) for f in ("{}_total_txn", "txn_velocity_{}")
} | {SENDER.unique_others, RECEIVER.unique_others, "rolling_unique_receivers_sender"}


def shown(df: DataFrame, *columns: str, keys: list[str] | None = None) -> DataFrame:
    """The row id and some columns, whole numbers as longs and doubles as ``DIGITS`` says."""
    return df.select(*(keys or [ID]), *[_shown(df, c) for c in columns])


def _shown(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    column = F.col(f"`{name}`")
    if name in WHOLE or isinstance(kind, (T.IntegerType, T.LongType)):
        return column.cast("long").alias(name)
    if name in DIGITS:
        return F.round(column, DIGITS[name]).alias(name)
    return column


def _tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.transactions(prepare(spark), sf_dir)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.events(prepare(spark), sf_dir)


# -- cleaning and splitting ---------------------------------------------------------------------


def missing_target_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.labelled_documents(prepare(spark), sf_dir)
    return cleaning.missing_target_count(rows, "quality")


def clean_drop_null_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.labelled_documents(prepare(spark), sf_dir)
    return cleaning.drop_missing_target(rows, "quality")


def class_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.labelled_documents(prepare(spark), sf_dir)
    table = cleaning.class_distribution(rows, "quality")
    return shown(table, "n", "share", keys=["quality"])


def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cleaning.with_part(_tx(spark, sf_dir), cleaning.PRODUCTION_FRACTION)
    return rows.select(ID, LABEL, F.col("in_part").cast("int").alias("in_part"))


def train_test_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.labelled_documents(prepare(spark), sf_dir)
    kept = cleaning.drop_missing_target(rows, "quality")
    parts = cleaning.with_part(kept, cleaning.TEST_FRACTION, "quality", "doc_id")
    return parts.select("doc_id", "quality", F.col("in_part").cast("int").alias("in_part"))


# -- scalars and amounts ------------------------------------------------------------------------


def parse_time_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = _tx(spark, sf_dir).select(ID, F.date_format("ts", "yyyy/MM/dd HH:mm").alias("text"))
    parsed = text.withColumn("ts", parse_timestamp("text"))
    parts = parsed.withColumns({"epoch": epoch_seconds("ts"), **calendar_parts("ts")})
    return shown(parts, "epoch", "day", "hour", "minute")


def amount_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = amounts.amount_features(_tx(spark, sf_dir))
    return shown(rows, "log_amount_received", "log_amount_paid", "amount_diff", "amount_ratio")


def amount_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _tx(spark, sf_dir)
    flagged = amounts.flag_outliers(rows, amounts.iqr_bounds(rows))
    return shown(flagged, *[f"outlier_{a}" for a in AMOUNTS])


def iqr_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir)
    flagged = amounts.flag_outliers(rows, amounts.iqr_bounds(rows, ["value"]))
    return shown(flagged, "value", "outlier_value", keys=["event_id"])


# -- accounts -----------------------------------------------------------------------------------


def _account_totals(side) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = history.account_totals(_tx(spark, sf_dir), side)
        return shown(rows, f"{side.name}_total_txn", f"{side.name}_fraud_rate")

    return query


def batch_account_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    unlabelled = _tx(spark, sf_dir).drop(LABEL)
    rows = history.account_totals(unlabelled, SENDER, label=None)
    rows = history.account_totals(rows, RECEIVER, label=None, counted_on=unlabelled)
    return shown(rows, "sender_total_txn", "receiver_total_txn")


def unique_counterparties(spark: SparkSession, sf_dir: str) -> DataFrame:
    transfers = _tx(spark, sf_dir)
    rows = history.unique_counterparties(transfers, SENDER)
    rows = history.unique_counterparties(rows, RECEIVER, counted_on=transfers)
    return shown(rows, SENDER.unique_others, RECEIVER.unique_others)


def _side_query(wanted: str, *names: str, sides=(SENDER, RECEIVER)) -> Query:
    """A behaviour feature of one or both sides; ``{}`` in a name stands for the side."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        transfers = rows = _tx(spark, sf_dir)
        for side in sides:
            rows = history.side_features(rows, side, [wanted], counted_on=transfers)
        return shown(rows, *[n.format(s.name) for s in sides for n in names])

    return query


def interval_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each transfer with its receiver's transfers of the hour before it."""
    return interval_matches(_tx(spark, sf_dir), RECEIVER)


def distinct_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact distinct receivers of each sender, and whether merged sketches of days come near them."""
    rows = _tx(spark, sf_dir)
    days = [sketches.distinct_sketch(rows.where(F.dayofmonth("ts") % 3 == i), SENDER) for i in range(3)]
    merged = sketches.merged_distinct(reduce(DataFrame.unionByName, days), SENDER)
    guessed = sketches.estimated_distinct(merged, SENDER).withColumnRenamed(SENDER.unique_others, "guess")
    exact = rows.select(SENDER.key, SENDER.other).distinct().groupBy(SENDER.key)
    exact = exact.agg(F.count(SENDER.other).alias("n_exact"))
    error = F.abs(F.col("guess") - F.col("n_exact")) / F.greatest(F.col("n_exact"), F.lit(1))
    return guessed.join(exact, SENDER.key).select(
        SENDER.key, "n_exact", "transfers", (error <= sketches.DISTINCT_ERROR).alias("within_bound")
    )


def quartile_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quartiles of the amounts from merged sketches of banks: is their exact rank within the error?"""
    rows = _tx(spark, sf_dir)
    merged = sketches.merged_quantiles(sketches.quantile_sketch(rows, by=["from_bank"]))
    ranks = sketches.ranks_of(rows, sketches.quartiles(merged))
    close = (F.col("below") - sketches.RANK_ERROR <= F.col("share")) & (
        F.col("share") <= F.col("upto") + sketches.RANK_ERROR
    )
    return ranks.select("column", "share", close.alias("within_error"))


def time_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return time_ordered(_tx(spark, sf_dir).select(ID, TIME)).select(ID, "place")


# -- calendar -----------------------------------------------------------------------------------


def _fraud_rate_by(period: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        table = calendar.fraud_rate_by(_tx(spark, sf_dir), period)
        return shown(table, calendar.rate_name(period), keys=[period])

    return query


def high_risk_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which hours of the day have an above-average laundering rate?"""
    table = calendar.high_risk_periods(_tx(spark, sf_dir), "hour")
    return shown(table, "fraud_rate_by_hour", "hour_thresh", "high_fraud_hour", keys=["hour"])


def high_risk_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = calendar.calendar_risk(_tx(spark, sf_dir))
    names = [f(p) for f in (calendar.rate_name, calendar.flag_name) for p in calendar.PERIODS]
    return shown(rows, *names)


# -- encodings ----------------------------------------------------------------------------------


def _interaction(name: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = encoders.with_calendar(_tx(spark, sf_dir))
        return shown(encoders.frequency_encode(rows, encoders.INTERACTIONS[name], name), name)

    return query


def freq_account_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(encoders.account_pair_frequency(_tx(spark, sf_dir)), "account_pair_freq_enc")


def lookup_in_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequencies of account pairs from a lookup in buckets, which the join does not move."""
    rows, name = _tx(spark, sf_dir), "account_pair_freq_enc"
    keyed = rows.withColumn("_key", exact_key(*encoders.INTERACTIONS[name]))
    path = scratch_path(spark, "pairs")
    write_bucketed(materialise(encoders.frequency_table(keyed, ["_key"], name)), path, "_key")
    return shown(join_bucketed(keyed, path, "_key"), name)


def freq_sender_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = encoders.sender_format_frequency(_tx(spark, sf_dir))
    return shown(rows, "sender_payment_format_freq_enc")


def freq_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _tx(spark, sf_dir)
    names = {"from_bank": "from_bank_freq_enc", "to_bank": "to_bank_freq_enc"}
    for key, name in names.items():
        rows = encoders.frequency_encode(rows, [key], name)
    return shown(rows, *names.values())


def freq_account(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = transfers = _tx(spark, sf_dir)
    for side in (SENDER, RECEIVER):
        rows = encoders.with_total(rows, encoders.row_total(transfers, side.key))
        rows = history.account_frequency(rows, side, F.col("_total"), counted_on=transfers)
        rows = rows.drop("_total")
    return shown(rows, "account_freq_enc", "account_1_freq_enc")


def target_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _tx(spark, sf_dir)
    names = {"from_bank": "from_bank_target_enc", "to_bank": "to_bank_target_enc"}
    for key, name in names.items():
        rows = encoders.target_encode(rows, key, name)
    return shown(rows, *names.values())


def target_account(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = transfers = _tx(spark, sf_dir)
    for side in (SENDER, RECEIVER):
        rows = history.side_features(rows, side, [history.FRAUD_RATE], counted_on=transfers)
        rows = rows.withColumn(f"{side.key}_target_enc", F.col(f"{side.name}_fraud_rate"))
    return shown(rows, "account_target_enc", "account_1_target_enc")


def one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _tx(spark, sf_dir)
    categories = encoders.one_hot_categories(rows)
    return shown(encoders.one_hot(rows, categories), *encoders.one_hot_names(categories))


# -- records ------------------------------------------------------------------------------------


def typed_record_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log rows read as records with a whole-number field; error rows carry text in it."""
    events = _events(spark, sf_dir)
    text = events.select(
        F.col("event_id").cast("string").alias("event_id"),
        F.when(F.col("event_type") == "error", F.col("props"))
        .otherwise(F.get_json_object("props", "$.k"))
        .alias("k"),
    )
    record = T.StructType(
        [T.StructField("event_id", T.LongType(), False), T.StructField("k", T.LongType())]
    )
    accepted, rejected = typed_records(text, record)
    faults = rejected.select(
        F.col("event_id").cast("long").alias("event_id"),
        F.lit(None).cast("long").alias("k"),
        F.array_join("bad_fields", ",").alias("fault"),
    )
    return accepted.withColumn("fault", F.lit("")).unionByName(faults)


def numeric_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    text = events.select(
        "event_id", F.get_json_object("props", "$.k").alias("k"), F.col("event_type").alias("kind")
    )
    return coerce_numeric(text)


def feature_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame brought to a manifest: one column missing, one as text, the rest dropped."""
    rows = amounts.amount_features(encoders.with_calendar(_tx(spark, sf_dir)))
    rows = rows.withColumn("hour", F.col("hour").cast("string"))
    manifest = ["payment_format_9-UNSEEN", "hour", "amount_ratio"]
    aligned = require_manifest(align(rows, manifest, keep=[ID]), manifest, keep=[ID])
    return shown(aligned, *manifest)


# -- features -----------------------------------------------------------------------------------


def _features(df: DataFrame, model: RiskFeaturesModel) -> DataFrame:
    return shown(df, *model.manifest)


def training_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _tx(spark, sf_dir)
    model = RiskFeatures().fit(rows)
    return _features(model.training_features(rows), model)


_fitted: dict[tuple[str, str], tuple[RiskFeaturesModel, DataFrame]] = {}


def _fitted_on_train(spark: SparkSession, sf_dir: str) -> tuple[RiskFeaturesModel, DataFrame]:
    """Features fitted on the training part, and the production part, both written tables.

    One per application and scale: the lookups of a fitted model are used many times.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _fitted:
        train, production = cleaning.clean_and_split(_tx(spark, sf_dir))
        # Nothing is learned from ids, the widest column.
        _fitted[key] = RiskFeatures().fit(materialise(train.drop(ID))), materialise(production)
    return _fitted[key]


def lookup_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, _ = cleaning.clean_and_split(_tx(spark, sf_dir))
    lookups = RiskFeatures().fit(materialise(train.drop(ID))).lookups
    return shown(lookups, "value", keys=["lookup", "key"])


def lookup_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, production = _fitted_on_train(spark, sf_dir)
    names = [
        *[calendar.rate_name(p) for p in calendar.PERIODS],
        *[calendar.flag_name(p) for p in calendar.PERIODS],
        "sender_fraud_rate",
        "receiver_fraud_rate",
        "from_bank_target_enc",
        "to_bank_target_enc",
        "account_target_enc",
        "account_1_target_enc",
    ]
    return shown(model.transform(production, "frozen", only=names), *names)


def _production_features(frequency: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        model, production = _fitted_on_train(spark, sf_dir)
        return _features(model.transform(production, frequency), model)

    return query


# -- monitoring ---------------------------------------------------------------------------------


def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitoring.confusion_matrix(fixtures.predictions(prepare(spark), sf_dir))


def quality_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = monitoring.quality_metrics(fixtures.predictions(prepare(spark), sf_dir))
    return shown(table, "accuracy", "precision", "recall", "f1", "objective", keys=["tp"])


def class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = monitoring.class_report(fixtures.predictions(prepare(spark), sf_dir))
    return shown(table, "precision", "recall", "f1", "support", keys=["class"])


def prediction_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = monitoring.prediction_distribution(_events(spark, sf_dir), "event_type")
    return shown(table, "n", "share", keys=["event_type"])


def latency_last_1000(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = monitoring.recent_average(_events(spark, sf_dir), "value")
    return shown(table, "average_value", keys=["n_recent"])


def request_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = monitoring.request_metrics(_events(spark, sf_dir))
    return shown(table, "error_count", "error_rate_percent", "avg_duration", "last_duration",
                 keys=["total_requests"])


# -- learning -----------------------------------------------------------------------------------

# Fewer rounds than usual: over tables this small a pass costs what starting a job costs.
SETTINGS = learning.Settings(rounds=30)
_runs: dict[tuple[str, str], str] = {}


def _training_run(spark: SparkSession, sf_dir: str) -> str:
    """Folder of a finished training run on the transfers; one per application and scale."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _runs:
        folder = f"{ensure_checkpoint_dir(spark)}/run-{len(_runs)}-{abs(hash(sf_dir))}"
        pipeline.run_training(_tx(spark, sf_dir), folder, run_id="queries", settings=SETTINGS)
        _runs[key] = folder
    return _runs[key]


def run_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run's record, with the rows of the tables it wrote."""
    prepare(spark)
    out = _training_run(spark, sf_dir)
    run = pipeline.current_run(spark, out)
    tables = [
        spark.read.parquet(f"{run}/{t}").agg(F.count("*").alias(f"n_{t}"))
        for t in ("train", "production", "features")
    ]
    record = artefacts.read_run_records(spark, f"{out}/runs").drop("timestamp")
    return reduce(DataFrame.crossJoin, tables, record)  # one row each


def model_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each model's held-out rows, and whether its metrics and report fit together."""
    prepare(spark)
    run = pipeline.current_run(spark, _training_run(spark, sf_dir))
    metrics = spark.read.parquet(f"{run}/metrics").groupBy("model").pivot("metric", [*learning.METRICS])
    metrics = metrics.agg(F.first("value"))
    report = spark.read.parquet(f"{run}/class_report")
    positive = report.where("class = '1'").selectExpr("model", "precision as p", "recall as r", "f1 as f")
    whole = report.where("class = 'weighted avg'").select("model", F.col("support").alias("n_test"))
    joined = metrics.join(positive, "model", "left").join(whole, "model", "left")
    same = [F.abs(F.col(a) - F.col(b)) < 1e-9 for a, b in (("precision", "p"), ("recall", "r"), ("f1", "f"))]
    score = objective(F.col("precision"), F.col("recall"), F.col("f1"))
    fits = reduce(lambda a, b: a & b, [*same, F.abs(F.col("objective") - score) < 1e-9])
    return joined.select("model", "n_test", F.coalesce(fits, F.lit(False)).alias("metrics_fit"))


def best_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The choice among four made-up classifiers of the labelled documents."""
    labels = prepare(spark).read.parquet(f"{sf_dir}/labels.parquet")
    guesses = {
        "random_forest": 1 - F.col("quality"),
        "boosted_slow": F.col("quality"),
        "boosted_fast": (F.col("doc_id") % 2).cast("int"),
        "ensemble": F.lit(0),
    }
    rows = [F.struct(F.lit(m).alias("model"), g.alias("prediction")) for m, g in guesses.items()]
    pairs = labels.select(F.explode(F.array(*rows)).alias("r"), F.col("toxic").alias("label"))
    table = learning.best_model(learning.compare(pairs.select("r.*", "label")))
    return shown(table, "objective", keys=["model"])


def _checked_scores(scored: DataFrame, features: DataFrame, run: str) -> DataFrame:
    """Scores against what the saved trees give when walked node by node, and its mean and class."""
    spark = scored.sparkSession
    manifest = artefacts.read_manifest(spark, f"{run}/manifest")
    trained = learning.TrainedModels.load(spark, f"{run}/model")
    given = trained.probabilities(features, manifest).select(ID, *learning.MODELS)
    names = {m: f"walked_{m}" for m in learning.MODELS}
    walked = learning.walked_probabilities(features, manifest, f"{run}/model")
    walked = walked.select(ID, *[F.col(m).alias(n) for m, n in names.items()])
    rows = scored.join(given, ID).join(walked, ID)

    def near(a: Column, b: Column) -> Column:
        return F.coalesce(F.abs(a - b) < 1e-9, F.lit(False))

    best = F.col(names[trained.best])
    third = reduce(lambda a, b: a + b, [F.col(names[m]) for m in learning.MEMBERS]) / 3
    likelier = F.when(best > F.lit(0.5), 1).otherwise(0)
    members = [near(F.col(m), F.col(names[m])) for m in learning.MEMBERS]
    return rows.select(
        ID,
        reduce(lambda a, b: a & b, members).alias("walk_fits"),
        near(F.col(learning.ENSEMBLE), third).alias("vote_fits"),
        near(F.col("probability"), best).alias("probability_fits"),
        (F.col("prediction") == likelier).alias("class_fits"),
        near(F.col("confidence"), F.when(best > F.lit(0.5), best).otherwise(1 - best)).alias("confidence_fits"),
    )


def score_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    out = _training_run(spark, sf_dir)
    scored = pipeline.predict_batch(spark, out)
    run = pipeline.current_run(spark, out)
    features = spark.read.parquet(f"{run}/production_features_batch")
    return _checked_scores(scored, features, run)


# -- streaming ----------------------------------------------------------------------------------


def _scratch(spark: SparkSession, name: str) -> str:
    """A new folder for one run of a streaming job."""
    count = _scratch.used = getattr(_scratch, "used", 0) + 1
    return f"{ensure_checkpoint_dir(spark)}/{name}-{count}"


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = prepare(spark).read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
    return stream.parquet(sf_dir).withColumn("ts", parse_timestamp("ts"))


def _finished(stream: DataFrame, spark: SparkSession, name: str) -> DataFrame:
    folder = _scratch(spark, name)
    return jobs.run_available(stream, f"{folder}/table", f"{folder}/checkpoint")


def stream_velocity_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    use_rocksdb(spark)
    stream = stream_velocity(_event_stream(spark, sf_dir), "user_id", "event_id")
    rows = _finished(stream, spark, "velocity")
    return rows.select(
        "event_id", "user_id", "velocity", F.round("since_last", 6).alias("since_last")
    )


# Micro-batches that the transfers of a stream come in, one after the other in time.
STREAM_BATCHES = 4


def _as_they_come(rows: DataFrame, job: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """The table a streaming job has written after rows came in ``STREAM_BATCHES`` steps of time.

    The job is started anew for each step, from its checkpoint. Steps are cut between whole minutes.
    """
    spark = rows.sparkSession
    folder = _scratch(spark, name)
    first, last = rows.select(F.min(epoch_seconds("ts")), F.max(epoch_seconds("ts"))).first()
    width = ((last or 0) - (first or 0)) // STREAM_BATCHES // 60 * 60 + 60
    step = F.floor((epoch_seconds("ts") - (first or 0)) / width)
    for i in range(STREAM_BATCHES):
        rows.where(step == i).write.mode("append").parquet(f"{folder}/in")
        stream = jobs.read_stream(spark, f"{folder}/in", rows.schema)
        with jobs.state_partitions(spark):
            done = jobs.run_available(job(stream), f"{folder}/table", f"{folder}/checkpoint")
    return done


def stream_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What accounts did before, from state carried over micro-batches."""
    use_rocksdb(spark)
    rows = _as_they_come(_tx(spark, sf_dir).drop(LABEL), stream_history, "features")
    rows = rows.withColumns({k: v for side in (SENDER, RECEIVER) for k, v in mean_ratios(side).items()})
    names = ["time_since_last_txn_{}", "txn_velocity_{}"]
    for amount in AMOUNTS:
        names += [f"rolling_std_{amount}_{{}}", f"rolling_avg_{amount}_{{}}", f"{amount}_to_avg_{{}}_ratio"]
    wanted = [n.format(s.name) for s in (SENDER, RECEIVER) for n in names]
    return shown(rows, *wanted, "rolling_unique_receivers_sender")


def stream_request_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = jobs.stream_request_metrics(_event_stream(spark, sf_dir))
    rows = _finished(stream, spark, "requests")
    rows = rows.withColumn("window_start", epoch_seconds("window_start"))
    return shown(rows, "total_requests", "error_count", "error_rate_percent", "avg_duration",
                 "last_duration", keys=["window_start"])


def stream_prediction_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = jobs.stream_prediction_metrics(_event_stream(spark, sf_dir), "event_type", "value")
    rows = _finished(stream, spark, "predictions")
    rows = rows.withColumn("window_start", epoch_seconds("window_start"))
    return shown(rows, "n", "average_latency", keys=["window_start", "event_type"])


def stream_latency_last_1000(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of the last 1000 values, as it stands when all events have come in steps."""
    use_rocksdb(prepare(spark))

    def job(stream: DataFrame) -> DataFrame:
        return stream_recent_average(stream, "value")

    rows = _as_they_come(_events(spark, sf_dir), job, "recent")
    last = rows.orderBy(F.desc("step")).limit(1)
    return shown(last, "average_value", keys=["n_recent"])


def stream_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    use_rocksdb(prepare(spark))
    run = pipeline.current_run(spark, _training_run(spark, sf_dir))
    stream = jobs.read_stream(
        spark, f"{run}/production", spark.read.parquet(f"{run}/production").schema
    )
    folder = _scratch(spark, "scores")
    query = jobs.stream_score(
        stream,
        RiskFeaturesModel.load(spark, run),
        learning.TrainedModels.load(spark, f"{run}/model"),
        f"{folder}/table",
        f"{folder}/checkpoint",
    )
    query.awaitTermination()
    # The batch features with frozen frequencies are what the stream must have seen.
    pipeline.predict_batch(spark, _training_run(spark, sf_dir), "frozen")
    features = spark.read.parquet(f"{run}/production_features_frozen")
    return _checked_scores(spark.read.parquet(f"{folder}/table"), features, run)


# How long the labels of logged predictions are waited for.
LABEL_WAIT = "6 hours"


def stream_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logged predictions met by their labels five minutes later; clicks never get one."""
    events = _events(spark, sf_dir)
    later = F.col("ts") + F.make_dt_interval(mins=F.lit(5))
    parts = {
        "predictions": events.select(
            "event_id", (F.col("value") > 50).cast("int").alias("prediction"), "ts"
        ),
        "labels": events.where("event_type != 'click'").select(
            "event_id", (F.col("event_type") == "error").cast("int").alias("label"), later.alias("ts")
        ),
    }
    folder = _scratch(spark, "quality-input")
    streams = []
    for name, rows in parts.items():
        rows.write.parquet(f"{folder}/{name}")
        streams.append(jobs.read_stream(spark, f"{folder}/{name}", rows.schema))
    rated = jobs.stream_quality(*streams, unique="event_id", wait=LABEL_WAIT)
    rows = _finished(rated, spark, "quality")
    rows = rows.withColumn("window_start", epoch_seconds("window_start"))
    return shown(rows, "tp", "fp", "tn", "fn", "unlabelled", "accuracy", "precision", "recall", "f1",
                 keys=["window_start"])


QUERIES: dict[str, Query] = {
    "high_risk_hours": high_risk_hours,
    "missing_target_count": missing_target_count,
    "clean_drop_null_target": clean_drop_null_target,
    "class_distribution": class_distribution,
    "stratified_split": stratified_split,
    "train_test_split": train_test_split,
    "parse_time_parts": parse_time_parts,
    "amount_features": amount_features,
    "amount_outliers": amount_outliers,
    "iqr_outliers": iqr_outliers,
    "sender_totals": _account_totals(SENDER),
    "receiver_totals": _account_totals(RECEIVER),
    "batch_account_counts": batch_account_counts,
    "unique_counterparties": unique_counterparties,
    "recency_sender": _side_query(history.RECENCY, "time_since_last_txn_{}", sides=[SENDER]),
    "recency_receiver": _side_query(history.RECENCY, "time_since_last_txn_{}", sides=[RECEIVER]),
    "interval_pairs": interval_pairs,
    "distinct_sketches": distinct_sketches,
    "quartile_sketches": quartile_sketches,
    "time_order": time_order,
    "fraud_rate_by_day": _fraud_rate_by("day"),
    "fraud_rate_by_hour": _fraud_rate_by("hour"),
    "fraud_rate_by_minute": _fraud_rate_by("minute"),
    "high_risk_periods": high_risk_periods,
    "freq_bank_pair": _interaction("bank_pair_freq_enc"),
    "freq_account_pair": freq_account_pair,
    "lookup_in_place": lookup_in_place,
    "freq_format_hour": _interaction("payment_format_hour_freq_enc"),
    "freq_sender_format": freq_sender_format,
    "freq_day_hour": _interaction("day_hour_freq_enc"),
    "freq_bank_format_hour": _interaction("bank_payment_hour_freq_enc"),
    "freq_bank": freq_bank,
    "freq_account": freq_account,
    "target_bank": target_bank,
    "target_account": target_account,
    "rolling_std": _side_query(history.ROLLING_STD, *[f"rolling_std_{a}_{{}}" for a in AMOUNTS]),
    "rolling_mean": _side_query(history.ROLLING_MEAN, *[f"rolling_avg_{a}_{{}}" for a in AMOUNTS]),
    "amount_to_mean": _side_query(history.MEAN_RATIO, *[f"{a}_to_avg_{{}}_ratio" for a in AMOUNTS]),
    "rolling_unique_receivers": _side_query(
        history.ROLLING_UNIQUE, "rolling_unique_receivers_sender", sides=[SENDER]
    ),
    "velocity_sender": _side_query(history.VELOCITY, "txn_velocity_{}", sides=[SENDER]),
    "velocity_receiver": _side_query(history.VELOCITY, "txn_velocity_{}", sides=[RECEIVER]),
    "one_hot": one_hot,
    "typed_records": typed_record_split,
    "numeric_coerce": numeric_coerce,
    "feature_align": feature_align,
    "lookup_export": lookup_export,
    "lookup_apply": lookup_apply,
    "training_features": training_features,
    "production_features": _production_features("batch"),
    "production_features_frozen": _production_features("frozen"),
    "confusion_matrix": confusion_matrix,
    "quality_metrics": quality_metrics,
    "class_report": class_report,
    "prediction_distribution": prediction_distribution,
    "latency_last_1000": latency_last_1000,
    "request_metrics": request_metrics,
    "run_training": run_training,
    "model_compare": model_compare,
    "best_model": best_model,
    "score_batch": score_batch,
    "stream_velocity": stream_velocity_query,
    "stream_features": stream_features,
    "stream_request_metrics": stream_request_metrics,
    "stream_prediction_metrics": stream_prediction_metrics,
    "stream_latency_last_1000": stream_latency_last_1000,
    "stream_score": stream_score,
    "stream_quality": stream_quality,
}

"""The driver's tables seen as transfers, labelled items and request logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transferwatch.functions import parse_timestamp
from transferwatch.session import materialise


def spread(df: DataFrame) -> DataFrame:
    """A scan that gives fewer tasks than there are cores (one small file) is dealt out to all."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


_written: dict[tuple[str, str], DataFrame] = {}


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transfer table the other queries start from, written once per application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _written:
        _written[key] = materialise(transactions_view(spark, sf_dir))
    return _written[key]


def transactions_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as transfers from a customer's bank to a supplier's bank."""
    line, order, customer, supplier = (
        spark.read.parquet(f"{sf_dir}/{t}.parquet")
        for t in ("lineitem", "orders", "customer", "supplier")
    )
    line = spread(
        line.select(
            "l_orderkey",
            "l_linenumber",
            "l_partkey",
            "l_suppkey",
            "l_shipdate",
            "l_quantity",
            "l_tax",
            "l_extendedprice",
            "l_returnflag",
        )
    )
    minutes = F.expr(
        "(l_partkey * 7919 + l_orderkey * 104729 + l_linenumber * 15485863L) % 25920"
    )
    start = F.timestamp_seconds(F.lit(1661990400))  # 2022-09-01 00:00 UTC
    laundering = (
        (F.col("l_quantity") >= 40) & (F.col("l_tax") >= 0.07) & (F.col("l_returnflag") == "R")
    )
    # Orders meet their customers first, so that the order lines, of which there are most, are moved once.
    placed = order.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority").join(
        customer.select("c_custkey", "c_nationkey"), order.o_custkey == customer.c_custkey
    )
    # As short as can be before they move: the flag alone needs two of the columns.
    line = line.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        "l_shipdate",
        "l_tax",
        "l_extendedprice",
        "l_returnflag",
        laundering.cast("int").alias("is_laundering"),
    )
    return (
        line.join(placed, line.l_orderkey == placed.o_orderkey)
        .join(supplier, line.l_suppkey == supplier.s_suppkey)
        .select(
            F.concat_ws(
                "-",
                "l_orderkey",
                "l_linenumber",
                "l_partkey",
                "l_suppkey",
                F.date_format("l_shipdate", "yyyyMMdd"),
            ).alias("txn_id"),
            (start + F.make_dt_interval(mins=minutes.cast("int"))).alias("ts"),
            F.col("c_nationkey").alias("from_bank"),
            F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("account"),
            F.col("s_nationkey").alias("to_bank"),
            F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("account_1"),
            F.col("l_extendedprice").alias("amount_received"),
            F.col("l_returnflag").alias("receiving_currency"),
            (F.col("l_extendedprice") * (1 + F.col("l_tax"))).alias("amount_paid"),
            F.col("o_orderstatus").alias("payment_currency"),
            F.col("o_orderpriority").alias("payment_format"),
            "is_laundering",
        )
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The request and prediction log."""
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    return raw.withColumn("ts", parse_timestamp("ts"))


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items whose target ``quality`` is missing where nobody labelled them."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return documents.join(labels, "doc_id", "left")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted and true class per labelled item."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return labels.select(
        "doc_id", (1 - F.col("quality")).alias("prediction"), F.col("toxic").alias("label")
    )

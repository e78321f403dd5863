import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from transferwatch.session import prepare

    session = (
        SparkSession.builder.master("local[8]")
        .appName("transferwatch-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return prepare(session)


@pytest.fixture(scope="session", autouse=True)
def small_models():
    """The learning queries train small models in tests."""
    from transferwatch import queries
    from transferwatch.plans.learning import Settings

    queries.SETTINGS = Settings(trees=10, tree_depth=6, rounds=5)


@pytest.fixture(scope="session")
def tx(spark):
    from transferwatch.sources import fixtures

    return fixtures.transactions(spark, SF)


@pytest.fixture(scope="session")
def transfers(spark):
    """Builds a small transfer table from ``(seconds, sender, receiver)`` and keyword columns."""
    from transferwatch.schema import LABELLED_TRANSACTION

    def build(rows, **columns):
        full = []
        for i, (second, sender, receiver) in enumerate(rows):
            record = {
                "txn_id": f"t{i:03d}",
                "ts": float(second),
                "from_bank": 1,
                "account": sender,
                "to_bank": 2,
                "account_1": receiver,
                "amount_received": float(i + 1),
                "receiving_currency": "A",
                "amount_paid": float(i + 1),
                "payment_currency": "A",
                "payment_format": "wire",
                "is_laundering": 0,
            }
            record |= {name: values[i] for name, values in columns.items()}
            full.append(tuple(record.values()))
        names = LABELLED_TRANSACTION.fieldNames()
        kinds = {f.name: f.dataType.simpleString() for f in LABELLED_TRANSACTION}
        schema = ", ".join(f"{n} {'double' if n == 'ts' else kinds[n]}" for n in names)
        frame = spark.createDataFrame(full, schema)
        return frame.withColumn("ts", frame.ts.cast("timestamp"))

    return build


def values(df, name, order="txn_id"):
    return [r[0] for r in df.orderBy(order).select(name).collect()]

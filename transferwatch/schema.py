"""Names and types of transfers and of the features derived from them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

ID = "txn_id"
TIME = "ts"
LABEL = "is_laundering"

TRANSACTION = T.StructType(
    [
        T.StructField(ID, T.StringType(), False),
        T.StructField(TIME, T.TimestampType()),
        T.StructField("from_bank", T.IntegerType()),
        T.StructField("account", T.StringType()),
        T.StructField("to_bank", T.IntegerType()),
        T.StructField("account_1", T.StringType()),
        T.StructField("amount_received", T.DoubleType()),
        T.StructField("receiving_currency", T.StringType()),
        T.StructField("amount_paid", T.DoubleType()),
        T.StructField("payment_currency", T.StringType()),
        T.StructField("payment_format", T.StringType()),
    ]
)

LABELLED_TRANSACTION = T.StructType(TRANSACTION.fields + [T.StructField(LABEL, T.IntegerType())])

# Header names of the transfer files, by our column name.
FILE_HEADERS = {
    "txn_id": "Unnamed: 0",
    "ts": "Timestamp",
    "from_bank": "From Bank",
    "account": "Account",
    "to_bank": "To Bank",
    "account_1": "Account.1",
    "amount_received": "Amount Received",
    "receiving_currency": "Receiving Currency",
    "amount_paid": "Amount Paid",
    "payment_currency": "Payment Currency",
    "payment_format": "Payment Format",
    "is_laundering": "Is Laundering",
}

IDENTIFIERS = ["account", "account_1", TIME, "from_bank", "to_bank", ID]
ONE_HOT = ["receiving_currency", "payment_currency", "payment_format"]
AMOUNTS = ["amount_received", "amount_paid"]


@dataclass(frozen=True)
class Side:
    """One end of a transfer: ``key`` names its account, ``other`` the account at the far end."""

    name: str
    key: str
    other: str
    unique_others: str


SENDER = Side("sender", "account", "account_1", "unique_receivers_per_sender")
RECEIVER = Side("receiver", "account_1", "account", "unique_senders_per_receiver")

# The numeric features, in manifest order. One-hot columns follow them.
NUMERIC_FEATURES = [
    "log_amount_received",
    "log_amount_paid",
    "amount_diff",
    "amount_ratio",
    "outlier_amount_received",
    "outlier_amount_paid",
    "sender_total_txn",
    "sender_fraud_rate",
    "receiver_total_txn",
    "receiver_fraud_rate",
    "unique_receivers_per_sender",
    "unique_senders_per_receiver",
    "time_since_last_txn_sender",
    "time_since_last_txn_receiver",
    "fraud_rate_by_day",
    "fraud_rate_by_hour",
    "fraud_rate_by_minute",
    "high_fraud_day",
    "high_fraud_hour",
    "high_fraud_minute",
    "bank_pair_freq_enc",
    "account_pair_freq_enc",
    "payment_format_hour_freq_enc",
    "sender_payment_format_freq_enc",
    "day_hour_freq_enc",
    "bank_payment_hour_freq_enc",
    "txn_velocity_sender",
    "rolling_std_amount_received_sender",
    "rolling_std_amount_paid_sender",
    "rolling_std_amount_received_receiver",
    "rolling_std_amount_paid_receiver",
    "rolling_avg_amount_received_sender",
    "rolling_avg_amount_paid_sender",
    "rolling_avg_amount_received_receiver",
    "rolling_avg_amount_paid_receiver",
    "amount_received_to_avg_sender_ratio",
    "amount_paid_to_avg_sender_ratio",
    "amount_received_to_avg_receiver_ratio",
    "amount_paid_to_avg_receiver_ratio",
    "rolling_unique_receivers_sender",
    "txn_velocity_receiver",
    "from_bank_freq_enc",
    "to_bank_freq_enc",
    "from_bank_target_enc",
    "to_bank_target_enc",
    "account_freq_enc",
    "account_1_freq_enc",
    "account_target_enc",
    "account_1_target_enc",
]

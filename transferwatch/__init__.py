"""Risk features, scoring and monitoring for bank transfers, written as Spark DataFrame operators."""

"""Spark-native table ingestion: naming, inference, schema evolution, ledgers and reverts."""

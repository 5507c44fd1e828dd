"""Composed jobs: the table store, ingestion, and the registered queries."""

"""DataFrame operators: columns, inference, schema evolution, ledgers and reverts."""

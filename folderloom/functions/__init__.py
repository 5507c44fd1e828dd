"""Column expressions: identifiers, value cleaning and SQL type names."""

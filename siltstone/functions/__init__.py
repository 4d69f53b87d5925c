"""Column expressions and aggregates that operators share."""

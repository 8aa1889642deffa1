"""Column expressions: parsing, record rules, rounding, ordinal scoring."""

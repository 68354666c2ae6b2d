"""Column expressions: strings and keys, dates, geometry, statistics, text, nested values."""

"""Column expressions: dates, postcodes, address strings, tokens."""

"""DataFrame operators: aggregates, windows, joins, sampling, tagging."""

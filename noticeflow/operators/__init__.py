"""DataFrame to DataFrame operators: comparison, merging, admission, enrichment, aggregates."""

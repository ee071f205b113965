"""Search, aggregation and document operations."""

"""Incremental loading. The library has no unbounded streams, only idempotent batches."""

"""Operators over a foreign-key chain: joins, liveness, signed deltas, aggregates, rankings, checks."""

"""Scalar functions: money texts, discounts, revenue."""

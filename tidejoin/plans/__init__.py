"""Declarative descriptions of foreign-key chains."""

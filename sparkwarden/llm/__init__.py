"""Operators for preparing training data: formatting, filters, near-duplicates, search, tokens and packing."""

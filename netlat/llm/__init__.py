"""Operators of a training-data pipeline: quality, rules, duplicates, tokens,
packing, licences and URLs. Nothing else in the library imports this package."""

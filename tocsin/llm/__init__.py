"""Operators of a training-data pipeline: mixing, scoring, sharding, language, near copies, quality, leaks, personal data, rules, counts."""

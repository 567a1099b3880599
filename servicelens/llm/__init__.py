"""Operators of a training-data pipeline: quality rules, near-duplicate detection,
decontamination, extraction, formatting, scoring, tokenization and secret scans.

Every operator is a function from DataFrames to DataFrames; ``queries`` registers one
query per operator and ``corpus_pipeline`` (repository top) chains five of them.
"""

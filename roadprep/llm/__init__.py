"""Operators for large text corpora: quality, duplicates, contamination, secrets, tokens, language, scoring."""

"""Operators of a training-data pipeline: quality, near duplicates, personal data, languages, tokens,
embeddings, repeated passages, benchmark leaks, URL filters and mixing. Nothing outside imports this package."""

"""Operators for training-data corpora: archives, filters, near duplicates, search, tokenisation."""

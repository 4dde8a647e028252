"""Operators for training-data corpora: cleaning, near duplicates, tokens and archives."""

"""Corpus preparation jobs for language-model training data."""

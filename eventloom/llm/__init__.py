"""Corpus preparation operators for training data (mixing, dedup, quality, encoding, extraction, PII)."""

"""Corpus operators for preparing training data: text, media and tokens at scale."""

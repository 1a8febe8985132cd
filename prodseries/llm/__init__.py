"""Operators of a training-data pipeline: fixity, cleaning, deduplication, search and tokenization of documents."""

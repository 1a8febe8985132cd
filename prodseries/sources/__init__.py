"""Readers, writers, and the raw -> core load."""

"""Readers and writers of corpora."""

"""Readers (corpora, word vectors, vector CSV, sample summaries) and writers."""

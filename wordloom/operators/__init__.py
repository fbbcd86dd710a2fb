"""Relational operators: weighting, similarity, embedding, clustering, reduction."""

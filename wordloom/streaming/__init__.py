"""Structured Streaming: score arriving documents against a fitted corpus."""

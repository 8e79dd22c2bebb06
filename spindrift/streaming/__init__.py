"""Streaming of the digest engine."""

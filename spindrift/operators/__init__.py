"""Operators of the digest engine."""

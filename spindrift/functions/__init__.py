"""Functions of the digest engine."""

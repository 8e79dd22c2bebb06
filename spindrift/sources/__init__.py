"""Sources of the digest engine."""

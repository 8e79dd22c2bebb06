"""Plans of the digest engine."""

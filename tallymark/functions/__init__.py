"""Column builders: normalisation, equality, rules."""

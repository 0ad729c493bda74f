"""Column-parameterised operators."""

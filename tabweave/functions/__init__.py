"""Column expressions and the ordered building blocks the operators share."""

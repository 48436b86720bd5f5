"""Column expressions and small plans that the operators are made of."""

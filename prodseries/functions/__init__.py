"""Column expressions and order statistics shared by the operators."""

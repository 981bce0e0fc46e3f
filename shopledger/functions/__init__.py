"""Column expressions and skew-safe building blocks shared by the operators."""

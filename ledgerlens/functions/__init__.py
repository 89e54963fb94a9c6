"""Column expressions and distribution primitives shared by the operators."""

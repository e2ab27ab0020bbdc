"""Column expressions and numeric kernels shared by the operators."""

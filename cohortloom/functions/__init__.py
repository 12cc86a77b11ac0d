"""Column expressions and the few Arrow UDFs."""

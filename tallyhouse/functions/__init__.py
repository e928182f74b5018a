"""Column expressions: no UDF among them."""

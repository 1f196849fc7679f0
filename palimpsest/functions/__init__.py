"""Column expressions, and the pure Python that Arrow UDFs run."""

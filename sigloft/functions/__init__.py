"""Column expressions; none of them runs Python per row unless its docstring says so."""

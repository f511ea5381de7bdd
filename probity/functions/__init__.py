"""Column-to-column functions: special functions, arrays, text."""

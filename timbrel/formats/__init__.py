"""Log formats as data, and the compiler from a format to column expressions."""

"""The tabular operators.  Each takes a Table (or several) and returns one, lazily,
unless its docstring names a driver round trip."""

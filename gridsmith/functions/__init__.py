"""Pure functions without a plan: text of expressions, special functions."""

"""Column expressions and ordered helpers."""

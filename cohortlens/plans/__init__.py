"""Bindings of the shared tables, the query catalogue and its SQL checks."""

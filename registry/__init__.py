"""Registered queries: each operator on the given tables, with a plain SQL form to check it."""

"""Registered queries: each names its input tables, an operator, and the SQL that must agree with it."""

"""Dumps, lines and tables, in and out."""

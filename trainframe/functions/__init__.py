"""Expressions, field paths and functions that become Catalyst columns."""

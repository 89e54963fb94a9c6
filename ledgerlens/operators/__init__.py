"""Analytical operators, grouped by subject."""

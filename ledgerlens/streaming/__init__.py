"""Continuous scoring of arriving transaction files."""

"""Readers of files and of paged services."""

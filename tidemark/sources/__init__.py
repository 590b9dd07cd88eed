"""Readers for points, tables, results and corpora."""

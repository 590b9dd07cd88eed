"""Operators for training-data corpora over the tables documents, pages and labels."""

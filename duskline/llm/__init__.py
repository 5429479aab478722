"""Operators for building training corpora from the tables documents, conversations and labels."""

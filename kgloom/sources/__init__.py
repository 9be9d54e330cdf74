"""Readers and writers of graphs, questions and collections."""

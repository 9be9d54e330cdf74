"""Operators over triples, paths and graphs."""

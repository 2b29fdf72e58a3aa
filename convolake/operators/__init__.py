"""Relational, retrieval and maintenance operators."""

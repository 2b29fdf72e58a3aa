"""Conversation and document retrieval analytics on PySpark."""

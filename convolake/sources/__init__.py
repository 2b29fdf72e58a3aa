"""Readers for transcripts, exports, Markdown files and tables."""

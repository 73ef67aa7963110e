"""Structured Streaming forms of the two jobs that receive data continuously."""

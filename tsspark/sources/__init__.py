"""Readers and writers, and the panels derived from the warehouse tables."""

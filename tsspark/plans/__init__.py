"""Operators composed into whole jobs, and the registered queries."""

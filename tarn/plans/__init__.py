"""Queries of the engine itself."""

"""Relational operators with the engine's own semantics."""

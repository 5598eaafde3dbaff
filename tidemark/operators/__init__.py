"""Relational building blocks of the engine."""

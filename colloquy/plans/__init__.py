"""Registered queries: the given tables mapped onto the engine's tables, queries and their reference SQL."""

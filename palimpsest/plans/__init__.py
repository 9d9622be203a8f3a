"""Registered queries, their oracles, and helpers for plans that loop."""

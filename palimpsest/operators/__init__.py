"""Operators over the tables nodes, edges and kv_log: each takes and returns DataFrames."""

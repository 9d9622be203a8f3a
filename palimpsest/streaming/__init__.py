"""Structured Streaming over the change log and over episodes."""

"""Readers and writers: the binary log, node JSON and episodes."""

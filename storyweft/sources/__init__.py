"""Readers and sinks of the data root."""

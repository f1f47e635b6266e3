"""Structured Streaming over the monitor's log."""

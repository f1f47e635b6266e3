"""Operators of the evaluation and of the latency matrix."""
